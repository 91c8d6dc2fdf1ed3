"""Personal data: fixed patterns, and more spans found under weak supervision, in DataFrame operations only.

Patterns with a check (length, checksum, ranges) give the *base* spans, which always stay. Wider patterns
propose further spans: numbers written like phone or identity numbers, spelled-out addresses and
long mixed tokens. Every proposal and every match of a fixed pattern is an example. Three labelers vote on it
(yes, no, abstain): *regex* (the strict form holds), *gazetteer* (top-level domains, issuer and country prefixes,
reserved networks, digest lengths) and *context* (cue words just before it).

Expectation-maximisation estimates each labeler's reliability from the counts of vote patterns, without
labels. Its posteriors train the span classifier, a logistic regression on the span's features. Both fits
see all examples through counts of feature cells; there are at most ``len(KINDS) * 27 * 12`` cells
whatever the input, and only they reach the driver. The classifier is applied as a column expression.

Positions are code points, the end exclusive. The patterns are the plain ones with possessive repeats, and
begin where a run of their characters begins, so a run is tried once and not from each of its characters.

Defined results: NULL and empty texts have no span; rows are independent of each other (repeated rows and ids,
NULL ids) except for the model; without examples nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import stored

KINDS = ["email", "ip", "card", "phone", "id", "secret"]
BASE = 4
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: (guard that a text must pass, pattern) by base kind.
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
BEGIN = "(?<![A-Za-z0-9+@._-])"
WRITTEN = (
    r"(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|[A-Za-z0-9_+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,64}){1,8})"
)
WIDE = BEGIN + WRITTEN
#: A whole run of any length and the mark after it: what is a token is decided on the hit, so no run is read twice.
RUN = BEGIN + f"(?!{WRITTEN})" + "[A-Za-z0-9_+/-]{20,}+[@.]?"
#: The labelers' lists.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
COUNTRIES = r"\+(?:1|7|2[07]|3[0-69]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"0\.|127\.|255\.|22[4-9]\.|23[0-9]\."
CUES = r"(?i)(?:e-?mail|contact|phone|tel|call|fax|mobile|card|visa|account|ssn|passport|ip|address|host|token|key|secret|password|auth)[^A-Za-z]{0,8}$"
DENIALS = r"(?i)(?:version|isbn|doi|order|page|chapter|section|commit|sha1?|md5|checksum)[^A-Za-z]{0,8}$"
CONTEXT = 24
SURE = 0.9
ROUNDS = 60
PIECE = 128
EXAMPLE = "array<struct<start:int,k:int,stop:int,valid:boolean,hit:string>>"
VOTES = ["regex", "gazetteer", "context"]


def located(text: Column, pattern: str) -> Column:
    """(start, stop, hit) of all leftmost matches: what lies between them gives the positions.

    Positions are added up in pieces of PIECE matches, as adding to one long list copies it each time.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    kind = "array<struct<start:int,stop:int,hit:string>>"

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + p["gap"]
        stop = start + F.length(p["hit"])
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), p["hit"].alias("hit")))).alias("out"))

    def piece(state: Column, part: Column) -> Column:
        found = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        width = F.aggregate(part, F.lit(0), lambda n, p: n + p["gap"] + F.length(p["hit"]))
        return F.struct((state["at"] + width).alias("at"), F.concat(state["out"], F.array(found["out"])).alias("out"))

    def walked(pairs: Column) -> Column:
        ends = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PIECE).cast("int"))
        parts = F.transform(ends, lambda i: F.slice(pairs, i * PIECE + 1, F.lit(PIECE)))
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), piece)["out"])

    # a list of one, so that the pairs are worked out once and not for each piece
    return F.flatten(F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, walked(p)).otherwise(F.array().cast(kind))))


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def strict(kind: str, hit: Column) -> Column:
    """The check a match of a base pattern has to pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def example(k: Column, m: Column, valid: Column) -> Column:
    return F.struct(m["start"].alias("start"), k.cast("int").alias("k"), m["stop"].alias("stop"), valid.alias("valid"), m["hit"].alias("hit"))


def base_matches(text: Column) -> Column:
    """All matches of the base patterns as EXAMPLE, valid or not."""
    parts = []
    for k, kind in enumerate(KINDS[:BASE]):
        guard, pattern = PATTERNS[kind]
        some = text.contains(guard) if kind == "email" else text.rlike(guard)
        parts.append(F.when(some, marked(text, pattern, k, kind)).otherwise(F.array().cast(EXAMPLE)))
    return F.array_sort(F.concat(*parts))


def marked(text: Column, pattern: str, k: int, kind: str) -> Column:
    return F.transform(located(text, pattern), lambda m: example(F.lit(k), m, strict(kind, m["hit"]))).cast(EXAMPLE)


def wide_matches(text: Column) -> Column:
    """Matches of the wider patterns as EXAMPLE; valid means that the strict form of the kind holds."""
    def one(m: Column) -> Column:
        hit = m["hit"]
        k = (F.when(hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 4).when(hit.rlike(r"^[(0-9][0-9().\x20-]+$"), 3)
             .when(hit.rlike(r"[\[(]at[\])]"), 0).otherwise(5))
        valid = (F.when(k == 4, ~hit.rlike("^(?:000|666|9)")).when(k == 3, hit.rlike("^\\(?[2-9]")).when(k == 0, F.lit(True))
                 .otherwise(hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") | (hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9].*[0-9]"))))
        return example(k, m, valid)

    def found(pattern: str) -> Column:
        return F.when(text.rlike(pattern), located(text, pattern)).otherwise(F.array())

    tokens = F.filter(found(RUN), lambda m: m["hit"].rlike("[0-9]") & m["hit"].rlike("[A-Za-z]") & ~m["hit"].rlike("[@.]$"))
    # What is written inside a token is part of it.
    apart = lambda m: ~F.exists(tokens, lambda t: (t["start"] < m["start"]) & (m["stop"] <= t["stop"]))
    return F.array_sort(F.transform(F.concat(F.filter(found(WIDE), apart), tokens), one).cast(EXAMPLE))


def with_features(text: Column, examples: Column) -> Column:
    """Examples with the three votes and the classifier's features; ``hit`` is left out."""
    def one(m: Column) -> Column:
        hit, k = m["hit"], m["k"]
        before = F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
        regex = F.when(m["valid"], 1).otherwise(-1)
        digits = F.regexp_replace(hit, "[^0-9+]", "")
        gazetteer = (
            F.when(k == 0, F.when(hit.rlike(rf"(?i)(?:\.|dot[\])]\x20?)(?:{TOP_DOMAINS})$"), 1).otherwise(0))
            .when(k == 1, F.when(hit.rlike(f"^(?:{RESERVED})"), -1).otherwise(1))
            .when(k == 2, F.when(digits.rlike(f"^(?:{ISSUERS})"), 1).otherwise(-1))
            .when(k == 3, F.when(digits.rlike(f"^{COUNTRIES}"), 1).otherwise(0))
            .when(k == 5, F.when(F.length(hit).isin(32, 40, 64), 1).otherwise(0)).otherwise(0))
        context = F.when(before.rlike(DENIALS), -1).when(before.rlike(CUES), 1).otherwise(0)
        size = F.when(F.length(hit) < 12, 0).when(F.length(hit) < 20, 1).when(F.length(hit) < 33, 2).otherwise(3)
        share = F.length(digits) / F.length(hit)
        dense = F.when(share < 0.2, 0).when(share < 0.8, 1).otherwise(2)
        votes = [v.cast("int").alias(n) for v, n in zip((regex, gazetteer, context), VOTES)]
        return F.struct(m["start"].alias("start"), k.alias("k"), m["stop"].alias("stop"), m["valid"].alias("valid"), *votes,
                        size.cast("int").alias("size"), dense.cast("int").alias("dense"))

    return F.transform(examples, one)


@dataclass
class Model:
    """Labelers' reliabilities (labeler -> class -> vote) and the classifier's weights; none without examples."""

    reliability: np.ndarray | None = None
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    bias: float = -math.inf

    def probability(self, m: Column) -> Column:
        total = F.lit(self.bias)
        for (name, value), w in self.weights.items():
            total = total + F.when(m[name] == value, w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


CELL = ["k", *VOTES, "size", "dense"]


def estimate(cells: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit both models on (CELL columns, count) rows."""
    if not len(cells):
        return Model()
    kinds, votes, n = cells[:, 0], cells[:, 1:4] + 1, cells[:, -1].astype(float)
    p = np.clip(0.5 + (votes - 1).mean(axis=1) * 0.45, 0.05, 0.95)
    rates = np.zeros((3, 2, 3))
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        for j in range(3):
            for v in range(3):
                # The prior counts say that a labeler is more often right than wrong.
                rates[j, :, v] = weight[:, votes[:, j] == v].sum(axis=1) + [(6, 4, 2)[v], (2, 4, 6)[v]]
            rates[j] /= rates[j].sum(axis=1, keepdims=True)
        logit = np.zeros(len(n))
        for k in np.unique(kinds):
            at = kinds == k
            prior = (weight[1, at].sum() + 1) / (n[at].sum() + 2)
            logit[at] = math.log(prior / (1 - prior))
        for j in range(3):
            logit += np.log(rates[j, 1, votes[:, j]] / rates[j, 0, votes[:, j]])
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    names = [(c, int(v)) for i, c in enumerate(CELL) for v in np.unique(cells[:, i])]
    x = np.array([[cells[r, CELL.index(c)] == v for c, v in names] for r in range(len(cells))], float)
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - q)) - w
        step = np.linalg.solve(x.T @ (x * (n * q * (1 - q) + 1e-9)[:, None]) + np.eye(len(w)), gradient)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Model(rates, {name: float(v) for name, v in zip(names, w[1:])}, float(w[0]))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_wide``: examples with features."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_base", base_matches(text)).withColumn("_wide", wide_matches(text))
    return rows.withColumn("_base", with_features(text, F.col("_base"))).withColumn("_wide", with_features(text, F.col("_wide")))


def fit(found: DataFrame) -> Model:
    """The model of all examples in ``found`` (``_base``, ``_wide``)."""
    each = found.select(F.explode(F.concat("_base", "_wide")).alias("m"))
    cells = each.groupBy(*[F.col(f"m.{c}").alias(c) for c in CELL]).count().orderBy(*CELL).collect()
    return estimate(np.array([tuple(r) for r in cells], int).reshape(-1, len(CELL) + 1))


def spans(found: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """``found`` with ``base`` and ``spans``, each array<struct<start, k, stop>> in order of start and kind."""
    plain = lambda m: F.struct(m["start"].alias("start"), m["k"].alias("k"), m["stop"].alias("stop"))
    rows = found.withColumn("base", F.transform(F.filter("_base", lambda m: m["valid"]), plain))
    if not model.weights:
        return rows.withColumn("spans", F.col("base")).drop("_base", "_wide")
    clear = lambda m: ~F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))
    added = F.filter("_wide", lambda m: (model.probability(m) >= sure) & clear(m))
    return rows.withColumn("spans", F.array_sort(F.concat("base", F.transform(added, plain)))).drop("_base", "_wide")


def count_of(found: str, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["k"] == kind)).cast("long")


def listing(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row."""
    found = stored(candidates(docs.select("doc_id", "text")).select("doc_id", "_base", "_wide"))
    return spans(found, fit(found))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by <KIND>; overlapping spans become one, under the first one's kind.

    All columns come back; ``n_chars`` is counted anew where the text changed.
    """
    names = docs.columns
    slim = stored(candidates(docs.select("text")).select("_base", "_wide"))
    # the row travels as one column, so that none of its columns can be in the way
    rows = spans(candidates(docs.select(F.struct("*").alias("row"), "text")), fit(slim))
    labels = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        kept = F.array(F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.element_at(labels, s["k"] + 1))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], kept)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rows = rows.withColumn("_done", F.when(F.size("spans") > 0, F.aggregate("spans", start, step)))
    rest = F.substring(F.col("text"), F.col("_done.at") + 1, F.length("text"))
    rows = rows.withColumn("_text", F.concat(F.array_join("_done.out", ""), rest))
    new = {"text": F.coalesce("_text", "text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_text").isNotNull(), F.length("_text").cast("long")).otherwise(F.col("row.n_chars"))
    return rows.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in names])
