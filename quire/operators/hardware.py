"""Which model suits which machine."""

from __future__ import annotations

import os
import shutil
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.MODELS, "id string, backend string, size string, min_ram_gb double, quality_rank int")


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.LANGUAGES, "code string, name string")


def supported(src: str, tgt: str) -> bool:
    return (src, tgt) in K.PAIRS


def detect(spark: SparkSession) -> DataFrame:
    """One row about the driver's machine: ram_gb, cores, gpu."""
    try:
        ram = os.sysconf("SC_PHYS_PAGES") * os.sysconf("SC_PAGE_SIZE") / 2**30
    except (ValueError, OSError, AttributeError):
        ram = 8.0
    gpu = False
    if tool := shutil.which("nvidia-smi"):
        try:
            gpu = subprocess.run([tool], capture_output=True, timeout=5).returncode == 0
        except (OSError, subprocess.TimeoutExpired):
            gpu = False
    return spark.createDataFrame([(round(ram, 1), os.cpu_count() or 2, gpu)], "ram_gb double, cores int, gpu boolean")


def recommend(specs: DataFrame, models: DataFrame) -> DataFrame:
    """specs with model: the best that fits into 70 % of the memory (a GPU lowers its need to 60 %), else the smallest.

    models is the catalogue, a handful of rows; each spec row meets each of them."""
    ranked = models.agg(F.array_sort(F.collect_list(F.struct("quality_rank", "min_ram_gb", "id"))).alias("m")).first()["m"]
    best = F.lit(min(ranked, key=lambda m: m["min_ram_gb"])["id"])
    for m in ranked:  # ascending quality: the last that fits wins
        ok = F.lit(m["min_ram_gb"]) * F.when(F.col("gpu"), 0.6).otherwise(1.0) <= F.col("ram_gb") * 0.7
        best = F.when(ok, F.lit(m["id"])).otherwise(best)
    return specs.withColumn("model", best)


def tier(ram: Column, gpu: Column) -> Column:
    return F.when(gpu & (ram >= 16), "Gama alta (GPU)").when(ram >= 16, "Gama alta").when(ram >= 8, "Gama media").otherwise("Gama básica")
