"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are (domain, lang, source); inner nodes are (domain, lang), (domain) and the root. A
budget of tokens comes down from the root: the children of a node share its budget by weight, no
child gets more than its subtree can give (all tokens times ``max_epochs``), and what one child lacks
goes to its siblings by weight. So a shortage stays below the lowest ancestor that can make it up
and moves further up only if that whole subtree is short.

A leaf's budget is drawn from seeded epochs: whole passes over the leaf first, then a prefix of one
more pass in that pass's seeded order. The prefix is every document whose running total of
tokens stays within what is left. Rows with the same (seed, epoch, id) are one unit of the order.

Only the leaf table passes through windows (a row for each leaf). A running total over a leaf's
documents is taken over key prefixes first, and single documents are sorted only in the
one prefix where the total crosses the budget, so a leaf with a third of all rows costs no more.
All amounts are whole numbers: shares are rounded down, so fewer tokens than nodes remain unspent.

Defined results: a NULL text has no tokens and a document without tokens is never selected (nor
are leaves without tokens); NULL domain, lang or source are names of their own; repeated rows are
repeated; other columns come through as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import WORD, stored

SEED = 11
MAX_EPOCHS = 3
DOMAINS = 4
#: Weights of the children of a node, by name; names not listed weigh OTHER.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
OTHER = 1
#: Documents a key prefix holds at most, on average.
PREFIX_ROWS = 2000
LEAF = ["_domain", "_lang", "_source"]


def domain_of_source() -> Column:
    """Stand-in for a domain column, which ``documents`` lacks: sources are dealt to DOMAINS by checksum."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(DOMAINS)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(OTHER)
    for key, value in weights.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("decimal(18,0)")


def share_out(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """``nodes`` (parent and name columns, budget of the parent, cap) with each node's own share as ``budget``.

    Nodes are ranked by cap per unit of weight. Those before the first node that its parent's
    rest would not fill get their cap; the others share the rest by weight.
    """
    big = lambda c: c.cast("decimal(38,0)")
    all_of = Window.partitionBy(*parent)
    order = all_of.orderBy(F.col("cap") / F.col("w"), F.col(name).asc_nulls_first())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = nodes.withColumn("w", weight(F.col(name), weights)).select(
        "*", F.row_number().over(order).alias("place"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("given"),
        F.sum("w").over(after).alias("open"))
    rest = big(F.col("budget") - F.col("given"))
    holds = big(F.col("cap")) * F.col("open") >= rest * F.col("w")
    first = F.min(F.when(holds, F.struct("place", rest.alias("rest"), "open"))).over(all_of)
    part = F.expr("CAST(least(cap, (first.rest * w) div first.open) AS BIGINT)")
    return ranked.withColumn("first", first).withColumn(
        "budget", F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap")).otherwise(part)
    ).drop("w", "place", "given", "open", "first")


def leaf_budgets(leaves: DataFrame, budget: int | None, max_epochs: int, domain_weights: dict[str, int],
                 lang_weights: dict[str, int], source_weights: dict[str, int]) -> DataFrame:
    """``leaves`` (LEAF, tokens, docs) with budget: the tokens to draw. Without ``budget``, all tokens there are."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("_domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    whole = Window.partitionBy(F.lit(0))  # a row for each domain
    wanted = F.sum("tokens").over(whole) if budget is None else F.lit(budget)
    domains = domains.withColumn("budget", F.least(wanted, F.sum("cap").over(whole)).cast("long")).withColumn("_root", F.lit(0))
    domains = share_out(domains, ["_root"], "_domain", domain_weights).select(F.col("_domain").alias("d"), "budget")
    langs = langs.join(domains, langs._domain.eqNullSafe(domains.d)).select("_domain", "_lang", "cap", "budget")
    langs = share_out(langs, ["_domain"], "_lang", lang_weights).select(
        F.col("_domain").alias("d"), F.col("_lang").alias("l"), "budget")
    leaves = leaves.join(langs, leaves._domain.eqNullSafe(langs.d) & leaves._lang.eqNullSafe(langs.l)).drop("d", "l")
    return share_out(leaves, ["_domain", "_lang"], "_source", source_weights)


def epoch_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), doc_id.cast("string")))


def cuts(slim: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """LEAF, passes, cut: whole passes over each leaf and the last key of the next one's prefix (NULL: none)."""
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.greatest(F.col("docs") / PREFIX_ROWS, F.lit(1.0))))).cast("int")
    leaves = stored(leaves.select(*[F.col(c).alias(f"p{c}") for c in LEAF], (F.expr("budget div tokens")).alias("passes"),
                                  (F.col("budget") % F.col("tokens")).alias("rest"), digits.alias("digits")))
    same = lambda a, b: [a[c].eqNullSafe(b[f"p{c}"]) for c in LEAF]
    keyed = slim.join(leaves, same(slim, leaves)).where("rest > 0")
    keyed = keyed.withColumn("key", epoch_key(seed, F.col("passes"), F.col("_id")))
    keyed = keyed.withColumn("prefix", F.expr("substring(key, 1, digits)"))
    units = keyed.groupBy(*LEAF, "prefix", "key", "rest").agg(F.sum("_tokens").alias("n"))
    sums = units.groupBy(*LEAF, "prefix", "rest").agg(F.sum("n").alias("n"), F.max("key").alias("last"))
    up = Window.partitionBy(*LEAF).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    sums = stored(sums.withColumn("upto", F.sum("n").over(up)))
    whole = sums.where("upto <= rest").select(*LEAF, F.col("last").alias("key"))
    crossing = sums.where("upto > rest AND upto - n < rest").select(
        *[F.col(c).alias(f"p{c}") for c in LEAF], F.col("prefix").alias("p_prefix"), (F.col("upto") - F.col("n")).alias("before"))
    inside = units.join(crossing, [*same(units, crossing), F.col("prefix") == F.col("p_prefix")])
    by_key = Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("total", F.col("before") + F.sum("n").over(by_key)).where("total <= rest").select(*LEAF, "key")
    last = whole.unionByName(inside).groupBy(*LEAF).agg(F.max("key").alias("cut"))
    return leaves.join(last, same(last, leaves), "left").select(*[f"p{c}" for c in LEAF], "passes", "cut")


def choose(docs: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None,
           domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS,
           source_weights: dict[str, int] = SOURCE_WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The slim table (LEAF, _id, _tokens of every row) and the cuts of every leaf."""
    domain = domain_of_source() if domain is None else domain
    slim = stored(docs.select(domain.alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                              F.col("doc_id").alias("_id"), word_count(F.col("text")).alias("_tokens")))
    used = slim.where("_tokens > 0")
    leaves = used.groupBy(*LEAF).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = leaf_budgets(leaves, budget, max_epochs, domain_weights, lang_weights, source_weights)
    return slim, stored(cuts(used, leaves, seed))


def with_copies(rows: DataFrame, found: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with LEAF, _id, _tokens) and _copies: how often each is drawn; rows drawn never are left out."""
    drawn = F.col("passes") + F.coalesce(epoch_key(seed, F.col("passes"), F.col("_id")) <= F.col("cut"), F.lit(False)).cast("long")
    joined = rows.where("_tokens > 0").join(found, [F.col(c).eqNullSafe(F.col(f"p{c}")) for c in LEAF])
    return joined.withColumn("_copies", drawn).where("_copies > 0").select(*rows.columns, "_copies")


def draws(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of every document drawn at least once."""
    slim, found = choose(docs, seed=seed, **options)
    return with_copies(slim, found, seed).select(
        F.col("_id").alias("doc_id"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"),
        F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"))


def mix(docs: DataFrame, seed: int = SEED, domain: Column | None = None, **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, with all their columns."""
    domain = domain_of_source() if domain is None else domain
    _, found = choose(docs, seed=seed, domain=domain, **options)
    rows = docs.select(F.struct("*").alias("_row"), domain.alias("_domain"), F.col("lang").alias("_lang"),
                       F.col("source").alias("_source"), F.col("doc_id").alias("_id"), word_count(F.col("text")).alias("_tokens"))
    rows = with_copies(rows, found, seed)
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
