"""Exact quantiles and box-plot statistics without one task per column.

`percentile` collects all distinct values of a group in one buffer. Here the wanted ranks are found by
selection (`selection.py`), which neither sorts nor writes. Only with more groups than the driver can
hold, equal values are counted, the counts are sorted across all partitions, and the partitions that hold a
wanted rank are looked into.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators.profile import chosen_columns
from vectorloom.operators.selection import order_statistics
from vectorloom.operators.sizing import attach, settle, slices, sort_across

QUARTILES = (0.25, 0.5, 0.75)


def _sorted_counts(values: DataFrame, group: Sequence[str]) -> DataFrame:
    counts = values.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    return sort_across(counts, group, ["value"])


def _quantiles(counts: DataFrame, group: Sequence[str], shares: Sequence[float]) -> DataFrame:
    pieces = slices(counts, group, "n")
    each_share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    point = F.col("share") * (F.col("_total") - 1)
    ranks = (
        pieces.select(*group, "_part", "_before", "_held", "_total", each_share)
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(point), F.ceil(point)))))
        .where((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("_held")))
    )
    # One partition per wanted rank survives: two per group and share at most.
    wanted = settle(
        ranks.groupBy(*group, "_part", "_before", "_total").agg(
            F.collect_list(F.struct("share", "rank")).alias("_asked")
        )
    )
    held = attach(counts, wanted, [*group, "_part"])
    upto = Window.partitionBy(*group, "_part").orderBy("_place")
    reached = held.withColumn("_upto", F.col("_before") + F.sum("n").over(upto))
    met = F.filter(
        "_asked",
        lambda ask: (F.col("_upto") - F.col("n") <= ask["rank"]) & (ask["rank"] < F.col("_upto")),
    )
    found = reached.select(*group, "value", "_total", met.alias("_met")).select(
        *group, "value", "_total", F.inline("_met")
    )
    lower, upper = F.min("value"), F.max("value")
    part = F.col("share") * (F.max("_total") - 1) - F.floor(F.col("share") * (F.max("_total") - 1))
    return found.groupBy(*group, "share").agg(
        F.max("_total").alias("total"), (lower + (upper - lower) * part).alias("quantile")
    )


def _selected(
    values: DataFrame, group: Sequence[str], shares: Sequence[float]
) -> list[tuple[tuple, int, list[float]]] | None:
    """(group, rows, quantiles) by selection; None if there are too many groups."""
    ends = lambda total, share: (math.floor(share * (total - 1)), math.ceil(share * (total - 1)))
    found = order_statistics(values, group, lambda total: [r for s in shares for r in ends(total, s)])
    if found is None:
        return None
    out = []
    for name, own in found.items():
        quantiles = []
        for share in shares:
            lower, upper = (float(own.ranks[r].value) for r in ends(own.total, share))
            point = share * (own.total - 1)
            quantiles.append(lower + (upper - lower) * (point - math.floor(point)))
        out.append((name, own.total, quantiles))
    return out


def exact_quantiles(
    values: DataFrame, group: Sequence[str], shares: Sequence[float] = QUARTILES
) -> DataFrame:
    """Linearly interpolated quantiles of `value` per group: `share`, `total`, `quantile`. Null values are left out."""
    found = _selected(values, group, shares)
    if found is None:
        return _quantiles(_sorted_counts(values.where(F.col("value").isNotNull()), group), group, shares)
    rows = [(*name, share, total, q) for name, total, qs in found for share, q in zip(shares, qs)]
    kinds = [f"`{c}` {values.schema[c].dataType.simpleString()}" for c in group]
    return values.sparkSession.createDataFrame(rows, ", ".join([*kinds, "share double, total bigint, quantile double"]))


def _boxes(values: DataFrame) -> DataFrame:
    picked = [
        F.max(F.when(F.col("share") == share, F.col("quantile"))).alias(name)
        for share, name in zip(QUARTILES, ("q1", "median", "q3"))
    ]
    quartiles = exact_quantiles(values, ["pos"], QUARTILES)
    return settle(quartiles.groupBy("pos").agg(F.max("total").alias("total"), *picked))


def _fenced(values: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    boxes = _boxes(values)
    spread = (F.col("q3") - F.col("q1")) * reach
    inside = F.col("value").between(F.col("q1") - spread, F.col("q3") + spread)
    return boxes, attach(values, boxes, ["pos"]).withColumn("inside", inside)


def boxplot_stats(
    rows: DataFrame, features: str, positions: Column, reach: float = 1.5
) -> DataFrame:
    """Quartiles, whiskers and number of outliers of chosen columns.

    Whiskers end at the outermost values within `reach` interquartile ranges of the box, and never
    inside the box.
    """
    boxes, marked = _fenced(chosen_columns(rows, features, positions), reach)
    ends = marked.groupBy("pos").agg(
        F.min(F.when(F.col("inside"), F.col("value"))).alias("_low"),
        F.max(F.when(F.col("inside"), F.col("value"))).alias("_high"),
        F.count_if(~F.col("inside")).alias("outliers"),
    )
    return boxes.join(ends, "pos").select(
        "pos",
        "total",
        "q1",
        "median",
        "q3",
        F.least("_low", "q1").alias("whisker_low"),
        F.greatest("_high", "q3").alias("whisker_high"),
        "outliers",
    )


def boxplot_outliers(
    rows: DataFrame, features: str, positions: Column, reach: float = 1.5
) -> DataFrame:
    """The values beyond the whiskers with their multiplicity, left distributed."""
    marked = _fenced(chosen_columns(rows, features, positions), reach)[1]
    return marked.where(~F.col("inside")).groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))
