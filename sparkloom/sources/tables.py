"""Readers: named tables of a folder, and scoped reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scoped(rows: DataFrame, path: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Rows whose path is matched by `include`, if given, and not by `exclude`; a null path is out of scope."""
    out = rows.where(F.col(path).isNotNull())
    if include:
        out = out.where(F.col(path).rlike(include))
    return out.where(~F.col(path).rlike(exclude)) if exclude else out


def dealt(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of long texts, dealt over all cores where its files are fewer splits than that: a heavy map over one split is one task."""
    rows, cores = table(spark, folder, name), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
