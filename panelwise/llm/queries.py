"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import alignment, chat, hashing_search, licenses, mixing_lm, mixture, packing, periodic, pii, quality_forest, simhash, toxicity, warc
from panelwise.llm.common import WORD


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_forest.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), *quality_forest.COUNTS, "base_failed", "kept", "anomaly")


def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def mixture_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.draws(read(spark, sf_dir, "documents"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placements(read(spark, sf_dir, "documents"))


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.sql(
        f"SELECT -7L AS conv_id, turn, role, '{odd}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v (turn, role)"))
    return chat.digests(chat.formatted(chat.canonical(chat.records(rows))))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:pii.BASE])]
    return found.select("doc_id", *counts, F.sha2(pii.listing(F.col("base")), 256).alias("base_sha256"),
                        pii.listing(F.col("spans")).alias("spans"))


def warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.convert(warc.write_arc(read(spark, sf_dir, "pages")))
    return warc.read_warc(made).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hashing_search.sign_code(F.col("embedding")).alias("code"))
    return hashing_search.neighbours(codes, codes.where("id % 100 = 0"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score(read(spark, sf_dir, "documents"))


def cycled(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where, for a tenth of the ids, the words from some word on repeat a unit to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"),
                       F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    rows = rows.withColumn("n", F.coalesce(F.size("words"), F.lit(0)).cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = (F.col("n") - F.col("a")).cast("int")
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(cycled(read(spark, sf_dir, "documents")))
    best = found.withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return best.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.profiles(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def toxic_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5
    found = toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), lambda c: fold(c) != 0)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("clauses").cast("long").alias("n_clauses"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules,
    "op9_language_model": language_model,
    "op10_simhash_classes": simhash_classes,
    "op2_license_scan": license_scan,
    "op3_hamming_search": hamming_search,
    "op4_mixture_draws": mixture_draws,
    "op5_best_fit_packing": best_fit_packing,
    "op6_personal_data": personal_data,
    "op7_warc_conversion": warc_conversion,
    "op8_chat_formatting": chat_formatting,
    "op11_tokenizer_alignment": tokenizer_alignment,
    "op12_periodic_runs": periodic_runs,
    "op13_toxic_clauses": toxic_clauses,
}
