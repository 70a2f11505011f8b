"""Row-local operators over streams: the same functions, on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.evaluate import scan

RUN_BLOCKS = "label string, pos bigint, key string, page int, src string, out string"


def stream_scan(spark: SparkSession, path: str, schema: str = RUN_BLOCKS, files: int = 100) -> DataFrame:
    """Flags of run blocks as their files arrive."""
    return scan(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Job events as they arrive, with the percentage done."""
    events = spark.readStream.schema(S.EVENTS).json(path)
    return events.withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("current") * 100 / F.col("total")).cast("int")).otherwise(100))


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what is there and return the result as a table: parquet files with a checkpoint, so that a lost run goes on."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
