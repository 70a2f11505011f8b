"""Folders for intermediate tables: below the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only a local session without that setting (as in tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
    return f"{base.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its plan is worked out once, and lost executors cost nothing."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input for each part of a table kept together.
PART = 4 << 20


def parts(df: DataFrame) -> int:
    """How many parts suit what is made of df, a table as it is read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART)), 50_000)


def together(df: DataFrame, name: str, n: int, by: str = "doc_id") -> DataFrame:
    """As stored, in n buckets by a column: windows, groups and, where in_place holds, joins by it (and by
    more) of what is made of such tables move no rows.

    df should lie in n parts by that column (df.repartition(n, by)); else every task writes a file for each bucket it meets."""
    spark = df.sparkSession
    path = folder(spark, name)
    table = "spark_catalog.default." + path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, by).saveAsTable(table)
    return spark.table(table)


@contextmanager
def in_place(spark: SparkSession):
    """What is written meanwhile may join by a bucket's column and more without moving rows."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
