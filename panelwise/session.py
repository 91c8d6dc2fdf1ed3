"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

COPIES = "copies"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cutting lineage: the cluster's own, or a scratch one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="panelwise-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared checkpoint folder and go on from the written copy.

    df is worked out once, the copy is read with column pruning and pushed filters, and a lost executor costs no
    recomputation. Copies are deleted by ``drop_copies``, or with the checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{COPIES}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_copies(spark: SparkSession) -> None:
    """Delete the copies that this session has made; tables that still read them can no longer be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{COPIES}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


ROWS_PER_PARTITION = 50_000


def cut_for_fitting(df: DataFrame, least: int = ROWS_PER_PARTITION) -> DataFrame:
    """Cut lineage, in partitions of useful size: fits pass over the table many times, and
    each pass costs a task per partition. Fits that work hard on every row name a smaller
    ``least``: a partition then holds that many rows or more, as long as cores are idle.
    """
    df = cut_lineage(df)
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    dealt = df.repartition(max(1, -(-n // ROWS_PER_PARTITION), min(cores, n // least)))
    return dealt.checkpoint(eager=True)  # as rows: many passes would decode Parquet again and again
