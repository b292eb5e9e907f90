"""Building blocks for plans whose cost must not depend on how the keys are distributed.

Two things recur: joining an aggregate back to the rows it came from, and finding positions in a
sorted order. Both have a textbook form that sends a whole group through one task (a shuffle join on
few keys, a window over one key). The forms here do not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.session import checkpoint_root, scratch_path

MAX_BROADCAST_ROWS = 500_000
SALTS = 64


def settle(rows: DataFrame) -> DataFrame:
    """Compute a small `rows` once into the shared checkpoint folder and cut the lineage there."""
    checkpoint_root(rows.sparkSession)
    return rows.checkpoint()


def settle_as_table(rows: DataFrame, stem: str) -> DataFrame:
    """The same for a large `rows`, as a Parquet table: later steps read only the columns they need."""
    path = scratch_path(rows.sparkSession, stem)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def attach(
    rows: DataFrame, summary: DataFrame, on: Sequence[str], max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Inner join of many `rows` with a settled `summary` that has few, fixed-width rows.

    The summary is counted first. Up to `max_rows` it is broadcast, and `rows` do not move. Beyond
    that the join is shuffled, with every key spread over `SALTS` tasks, because a key may own a
    large share of `rows`. Null keys match each other, as they do in grouping.
    """
    keys, broadcast = list(on), summary.count() <= max_rows
    if not broadcast:
        keys.append("_salt")
        rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        summary = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    other = summary.withColumnsRenamed({key: f"_other_{key}" for key in keys})
    match = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_other_{key}")) for key in keys])
    joined = rows.join(F.broadcast(other) if broadcast else other, match)
    return joined.drop("_salt", *[f"_other_{key}" for key in keys])


def sort_across(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A table of `rows` in global order, with the partition and the place within it.

    Range partitioning cuts large groups at values of `order`, so equal work lands in every task
    as long as (group, order) has no massive ties. AQE merges neighbouring ranges of little data. The result is written out because range bounds
    are sampled: a second evaluation could cut elsewhere.
    """
    keys = [*group, *order]
    placed = (
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    return settle_as_table(placed, "sorted")


def slices(
    sorted_rows: DataFrame, group: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Per group and partition: how much lies there and how much lies before it in the group.

    At most one row per partition plus one per group, hence the window over it is small.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    pieces = sorted_rows.groupBy(*group, "_part").agg(
        amount.alias("_held"), F.min("_place").alias("_first")
    )
    in_group = Window.partitionBy(*group)
    before = in_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn(
        "_before", F.coalesce(F.sum("_held").over(before), F.lit(0))
    ).withColumn("_total", F.sum("_held").over(in_group))


def positions(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Zero-based `position` of every row within its group, and the group's `total`.

    Equal to `row_number() - 1` over a window, without one task per group.
    """
    placed = sort_across(rows, group, order)
    pieces = settle(slices(placed, group).select(*group, "_part", "_first", "_before", "_total"))
    joined = attach(placed, pieces, [*group, "_part"])
    return joined.select(
        *rows.columns,
        (F.col("_before") + F.col("_place") - F.col("_first")).alias("position"),
        F.col("_total").alias("total"),
    )
