"""Columnar matrix tables: scan, split, sink."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.scalars import split_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_split(rows: DataFrame, row_id: str | Column) -> DataFrame:
    """Add the deterministic `split` column."""
    return rows.withColumn("split", split_of(F.col(row_id) if isinstance(row_id, str) else row_id))


def read_splits(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """One frame from one path per split, marked by a `split` column.

    The marker is a literal per branch, so a filter on `split` drops whole branches from the plan.
    """
    parts = [
        spark.read.parquet(path).withColumn("split", F.lit(split)) for split, path in paths.items()
    ]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def write_matrix(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a matrix as Parquet, one directory per split where there is a `split` column."""
    writer = rows.write.mode(mode)
    if "split" in rows.columns:
        writer = writer.partitionBy("split")
    writer.parquet(path)


def read_matrix(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read a matrix back; naming a split prunes the other directories."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def shard(scan: DataFrame, slots: int | None = None) -> DataFrame:
    """Spread a scan with few splits over `slots` partitions (default: all cores).

    A scan with enough splits stays as it is, without a shuffle. Meant for plain scans: counting the
    partitions of a plan with shuffles would run them.
    """
    wanted = slots or scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)
