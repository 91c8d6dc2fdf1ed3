"""Rule-driven harmonisation of cohorts.

A rule fills columns of one cohort, from the row itself or from the same
participant's row at a donor visit. Rules run in order. Rules of one block read
donor rows as they were before the block, and their own row as it is now.

Donor rows are themselves filled by the rules. Instead of going back to the table
for every rule, the raw values of the donor visits are aggregated once, to one row
per participant, and taken through the rules; the filled donor values are then put
beside each row of the table. The whole rule table costs one aggregate and one join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Read = Callable[[str], Column]
KEY = ("source", "participant_id")


@dataclass(frozen=True)
class Rule:
    """Fill ``columns`` of ``source`` where NULL (or everywhere, or where ``test`` holds).

    ``donor`` is the visit to read from (plus ``offset``); without one, ``value`` says
    what to compute from the row.
    """

    source: str
    block: int
    columns: tuple[str, ...]
    donor: int | None = None
    offset: float = 0
    value: Callable[[Read], Column] | None = None
    at: tuple[int, ...] = ()
    not_at: tuple[int, ...] = ()
    always: bool = False
    test: Callable[[Read], Column] | None = None

    def may_apply(self, wave: int) -> bool:
        return (not self.at or wave in self.at) and wave not in self.not_at

    def condition(self, column: str, read: Read) -> Column:
        cond = F.lit(True) if self.always else self.test(read) if self.test else read(column).isNull()
        if self.at:
            cond = cond & read("wave").isin(list(self.at))
        if self.not_at:
            cond = cond & ~read("wave").isin(list(self.not_at))
        return cond

    def reads(self, column: str) -> set[str]:
        """Columns of the own row that decide or form the new value."""
        seen: set[str] = set()

        def note(name: str) -> Column:
            seen.add(name)
            return F.col(name)

        self.condition(column, note)
        if self.value:
            self.value(note)
        return (seen | {column}) - {"wave"}


def _donor_needs(rules: Sequence[Rule]) -> set[tuple[str, str, int]]:
    """(cohort, column, visit) to carry along: donors, and what fills those donors."""
    need = {(r.source, c, r.donor) for r in rules if r.donor is not None for c in r.columns}
    while True:
        more = set(need)
        for source, column, wave in need:
            for r in rules:
                if r.source == source and column in r.columns and r.may_apply(wave):
                    more |= {(source, c, wave) for c in r.reads(column)}
                    if r.donor is not None:
                        more.add((source, column, r.donor))
        if more == need:
            return need
        need = more


def _layers(rules: Sequence[Rule]) -> list[list[tuple[Rule, bool]]]:
    """The i-th rules of all cohorts, which are independent; True where a block starts."""
    by_source: dict[str, list[tuple[Rule, bool]]] = {}
    for r in rules:
        own = by_source.setdefault(r.source, [])
        own.append((r, not own or own[-1][0].block != r.block))
    depth = max(map(len, by_source.values()))
    return [[own[i] for own in by_source.values() if i < len(own)] for i in range(depth)]


def _chain(hits: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(*hits[0])
    for hit in hits[1:]:
        out = out.when(*hit)
    return out.otherwise(otherwise)


def harmonise(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = KEY) -> DataFrame:
    types = dict(df.dtypes)
    need = _donor_needs(rules)
    layers = _layers(rules)
    name = {(c, w): f"_at{w}_{c}" for _, c, w in sorted(need)}
    donors = df.groupBy(*keys).agg(
        *[F.max(F.when(F.col("wave") == w, F.col(c))).alias(n) for (c, w), n in name.items()]
    )
    # the donor rows through the rules, one row per participant; each rule keeps the
    # name of the donor value it saw when its block began
    saw: dict[tuple[int, str, str], str] = {}
    at_block_start: dict[str, dict[tuple[str, int], str]] = {}
    for i, layer in enumerate(layers):
        hits: dict[tuple[str, int], list[tuple[Column, Column]]] = {}
        for rule, starts in layer:
            if starts:
                at_block_start[rule.source] = dict(name)
            frozen = at_block_start[rule.source]
            for column in rule.columns:
                if rule.donor is not None:
                    saw[i, rule.source, column] = frozen[column, rule.donor]
                for wave in sorted(w for s, c, w in need if s == rule.source and c == column):
                    if not rule.may_apply(wave):
                        continue

                    def read(c: str, wave: int = wave) -> Column:
                        return F.lit(wave) if c == "wave" else F.col(name[c, wave])

                    value = F.col(frozen[column, rule.donor]) + F.lit(rule.offset) if rule.donor is not None else rule.value(read)
                    hit = (F.col("source") == rule.source) & rule.condition(column, read)
                    hits.setdefault((column, wave), []).append((hit, value.cast(types[column])))
        donors = donors.withColumns({
            f"_at{w}_{c}_{i}": _chain(h, F.col(name[c, w])) for (c, w), h in hits.items()
        }) if hits else donors
        name.update({(c, w): f"_at{w}_{c}_{i}" for c, w in hits})
    out = df.join(donors.select(*keys, *sorted(set(saw.values()))), list(keys), "left")
    for i, layer in enumerate(layers):
        own: dict[str, list[tuple[Column, Column]]] = {}
        for rule, _ in layer:
            for column in rule.columns:
                if rule.donor is None:
                    value = rule.value(F.col)
                else:
                    value = F.col(saw[i, rule.source, column])
                    value = value + F.lit(rule.offset) if rule.offset else value
                hit = (F.col("source") == rule.source) & rule.condition(column, F.col)
                own.setdefault(column, []).append((hit, value.cast(types[column])))
        out = out.withColumns({c: _chain(h, F.col(c)) for c, h in own.items()})
    return out.select(*df.columns)
