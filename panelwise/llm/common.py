"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from panelwise.session import ensure_checkpoint_dir

#: ASCII white space; words are the maximal runs of other characters. ``bytes.split()`` splits at these.
SPACE = b" \t\n\r\x0b\x0c"
#: The same words for Java's and Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes that continue a character.
CONTINUED = bytes(range(0x80, 0xC0))
#: Whole texts of an Arrow batch.
TEXTS = 512


def copy_folder(spark: SparkSession) -> str:
    """A new place for a written copy, in the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write df as Parquet to the folder all executors share and go on from the written copy.

    Unlike a row checkpoint the copy is read with column pruning and pushed filters, and a
    lost executor costs no recomputation. Copies go with the application's checkpoint folder, or
    by ``dropped`` if the caller names the ``copy_folder``.
    """
    spark = df.sparkSession
    path = folder or copy_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *folders: str) -> None:
    """Delete copies that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def short_shuffles(spark: SparkSession) -> None:
    """From now on the session deletes an execution's shuffle files when it has ended, not when the driver happens to collect its
    garbage. A table that is run a second time makes them anew."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the session broadcasts only tables whose size a stage has measured. Spark's guess at a table that has not been run counts neither the
    rows that an explode makes nor how closely Parquet packs numbers: what it takes for 5 MB may be 500 MB in the driver."""
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (guessed, measured)}
    spark.conf.set(measured, before[measured] or spark.conf.get(guessed))
    spark.conf.set(guessed, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends at most TEXTS rows in an Arrow batch to Python: Spark's own 10,000 whole texts take tens of
    MB several times over, in each task's JVM and Python. A smaller number that the user has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS:
        spark.conf.set(name, TEXTS)


def utf8(column) -> list:
    """Arrow strings as bytes, None kept; no round trip through str."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist() if not pa.types.is_null(column.type) else [None] * len(column)
