"""Randomness from row keys.

Draws are functions of a seed and the row's own keys, so they do not depend on
partitioning, survive task retries unchanged and can be recomputed elsewhere.
``hash_uniform`` suits one draw per row; ``with_mix_uniform`` is an integer-only
mixer for the bootstrap, where every row is drawn for a thousand times.
"""

from __future__ import annotations

import math
from itertools import accumulate
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.expr import as_col

TWO_32 = 4294967296
MASK_32 = TWO_32 - 1
MIX_MULTIPLIER = 73244475


def hash_uniform(seed: int, *keys: Any) -> Column:
    """Uniform in [0, 1): first 32 bits of md5 over seed and keys (integers or strings)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return bits / F.lit(float(TWO_32))


def mix_seed(seed: int) -> int:
    return (seed * 2654435761 + 97) % TWO_32


def with_mix_uniform(df: DataFrame, name: str, seed: int, *keys: str) -> DataFrame:
    """Add a uniform in [0, 1) from non-negative integer key columns.

    Written in small steps because each uses the previous value twice; the
    optimizer keeps such projections apart, and one generated loop runs them all.
    The last step goes through a one-element explode: later filters and join keys on
    the draw must not be pushed down, where they would spell out every step again.
    """
    kept = [f"`{c}`" for c in df.columns]
    h = f"{mix_seed(seed)}L"
    for i, key in enumerate(keys):
        k = f"CAST({key} AS BIGINT)"
        df = df.selectExpr(*kept, f"{h} ^ (({k} ^ shiftright({k}, 32)) & {MASK_32}L) AS _mix")
        for shift, add in ((16, 0), (15, i + 1)):
            df = df.selectExpr(
                *kept, f"((_mix ^ shiftright(_mix, {shift})) * {MIX_MULTIPLIER}L + {add}L) & {MASK_32}L AS _mix"
            )
        h = "_mix"
    return df.selectExpr(*kept, f"explode(array((_mix ^ shiftright(_mix, 16)) / {TWO_32}D)) AS {name}")


def mix_step(state: Any, key: Any, place: int) -> Any:
    """What ``with_mix_uniform`` does with its key number ``place``, on whole numbers or on unsigned numpy arrays."""
    state = state ^ ((key ^ (key >> 32)) & MASK_32)
    state = ((state ^ (state >> 16)) * MIX_MULTIPLIER) & MASK_32
    return ((state ^ (state >> 15)) * MIX_MULTIPLIER + place + 1) & MASK_32


def mix_uniform(state: Any) -> Any:
    return (state ^ (state >> 16)) / TWO_32


def mix_bits(state: Any, keys: np.ndarray, place: int) -> np.ndarray:
    """``mix_uniform(mix_step(state, keys, place)) * 2**32`` for 32-bit keys, in 32-bit arithmetic, which wraps as the mask does."""
    h = keys ^ np.asarray(state, np.uint32)
    t = h >> np.uint32(16)
    h ^= t
    h *= np.uint32(MIX_MULTIPLIER)
    np.right_shift(h, np.uint32(15), out=t)
    h ^= t
    h *= np.uint32(MIX_MULTIPLIER)
    h += np.uint32(place + 1)
    np.right_shift(h, np.uint32(16), out=t)
    h ^= t
    return h


def mix_picks(bits: np.ndarray, n: Any) -> np.ndarray:
    """``floor(u * n)`` of the uniforms that ``bits`` stand for."""
    return (bits * (n / TWO_32)).astype(np.int64)


# P(count <= k) of a Poisson(1) count; beyond k = 12 less than one draw in 2**32 remains.
POISSON_1_CDF = list(accumulate(math.exp(-1) / math.factorial(k) for k in range(13)))


def poisson_one(u: Column) -> Column:
    """Poisson(1) count for a uniform, by inverting the distribution function."""
    out = F.lit(len(POISSON_1_CDF))
    for k, edge in reversed(list(enumerate(POISSON_1_CDF))):
        out = F.when(u < F.lit(edge), F.lit(k)).otherwise(out)
    return out
