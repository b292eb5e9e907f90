"""Column statistics of a feature matrix, rankings and per-class histograms.

A matrix of width d becomes (position, value) pairs inside the scan stage and is aggregated to at
most classes x d groups before anything is shuffled, so the shuffle does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators.sizing import attach, settle


def long_form(rows: DataFrame, features: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per matrix entry: `pos` and `value` (double). Null entries are left out."""
    return (
        rows.select(*keep, F.posexplode(features).alias("pos", "value"))
        .where(F.col("value").isNotNull())
        .withColumn("value", F.col("value").cast("double"))
    )


def chosen_columns(
    rows: DataFrame, features: str, positions: Column, keep: Sequence[str] = ()
) -> DataFrame:
    """`long_form` for some positions only (an array column), without exploding the others."""
    value = F.get(F.col(features), F.col("pos")).cast("double").alias("value")
    return (
        rows.select(*keep, features, F.explode(positions).alias("pos"))
        .select(*keep, F.col("pos").cast("int").alias("pos"), value)
        .where(F.col("value").isNotNull())
    )


def column_profile(rows: DataFrame, features: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population deviation, minimum and maximum of every column, in one pass."""
    value = F.col("value")
    return (
        long_form(rows, features, by)
        .groupBy(*by, "pos")
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("std"),
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
        )
    )


def rank_columns(profile: DataFrame, statistic: str, descending: bool = True) -> DataFrame:
    """Rank matrix columns by a statistic; ties go by position, in the same direction.

    The window spans one row per matrix column, never data rows.
    """
    direction = F.desc if descending else F.asc
    order = Window.orderBy(direction(statistic), direction("pos"))
    return profile.select("pos", statistic, F.row_number().over(order).alias("rank"))


def top_columns(
    profile: DataFrame, statistic: str, k: int, descending: bool = True
) -> DataFrame:
    """The first `k` matrix columns by a statistic."""
    direction = F.desc if descending else F.asc
    return (
        profile.select("pos", statistic).orderBy(direction(statistic), direction("pos")).limit(k)
    )


def as_positions(columns: DataFrame) -> Column:
    """The `pos` values of a short table as one array, for use inside another plan.

    The table is settled first: a plan that looks at its rows twice must not rank columns twice.
    """
    return settle(columns).agg(F.array_sort(F.collect_list("pos"))).scalar()


def class_histogram(
    rows: DataFrame,
    features: str,
    positions: Column,
    label: str = "label",
    bins: int = 20,
    common_range: bool = False,
) -> DataFrame:
    """Equal-width histogram of chosen columns per class: `pos`, label, `bin`, `edge`, `n`.

    Each class has its own value range unless `common_range` is set. The last bin is closed; a
    constant column gets a range of width one around its value. Bins without rows are listed with
    zero. Ranges are one row per column and class. NaN and infinity have no bin and are an error.
    """
    values = chosen_columns(rows, features, positions, [label])
    odd = F.isnan("value") | (F.abs("value") == float("inf"))
    problem = F.raise_error(F.lit("a histogram takes finite numbers only")).cast("double")
    values = values.withColumn("value", F.when(odd, problem).otherwise(F.col("value")))
    groups = ["pos"] if common_range else ["pos", label]
    limits = values.groupBy(*groups).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    limits = settle(
        limits.select(
            *groups,
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
    )
    place = F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    counted = (
        attach(values, limits, groups)
        .withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
        .groupBy("pos", label, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    )
    # From here on everything has one row per column, class and bin.
    per_bin = counted.groupBy("pos", label).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"),
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
    )
    listed = per_bin.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return listed.select(
        "pos",
        label,
        "bin",
        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("edge"),
        F.coalesce(F.try_element_at("held", F.col("bin")), F.lit(0).cast("bigint")).alias("n"),
    )
