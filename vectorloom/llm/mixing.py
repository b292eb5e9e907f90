"""Mixing sources to target weights with nested hash thresholds.

A row's place on the hash axis is its digest; a source's budget is a prefix of that axis. Summing
sizes by source and the first digits of the digest shows in which bucket the budget ends; only rows
of that bucket are summed again by the next digits. What to take is then a comparison with a few
numbers per source: no row is ranked or sorted. Column expressions only.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows
that are equal in id and text are taken together; an empty table gives no rows; clashing columns of the
input are kept under a name with a leading underscore.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.text import WORD, text_of
from vectorloom.operators.sizing import settle_as_table

WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a row at most
DIGITS = 3  # hexadecimal digits of a bucket: 4,096 buckets a level
LEVELS = 3
RESULT = ("size", "source_size", "target", "copies", "taken")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source its `target`: shares by weight, none above `most` times its size.

    What a source cannot use is shared out again by weight. The sources that stop are those with the
    least size per weight, so one pass over the sources in that order finds the level at which the
    rest is filled: that of the first source that does not stop. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.array(*[F.lit(float(w)) for w in weights])[turn]
    rows = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), "source")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.select(
        "*",
        F.coalesce(F.sum("full").over(before), F.lit(0.0)).alias("used"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"),
        F.sum(F.col("source_size").cast("double")).over(whole).alias("total"),
        F.sum("weight").over(whole).alias("weights"),
    )
    level = (F.col("total") - F.col("used")) / (F.col("weights") - F.col("gone"))
    rows = rows.withColumn("level", level).withColumn("stops", F.col("full") <= F.col("weight") * F.col("level"))
    filled = F.max(F.when(~F.col("stops"), F.col("level"))).over(whole)
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("stops"), F.col("full")).otherwise(F.col("weight") * filled).alias("target"),
    )


def place(*columns: str | Column) -> Column:
    """Hexadecimal digest that orders rows at random, alike in every run."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in parts]).cast("binary"))


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def thresholds(rows: DataFrame, budgets: DataFrame, levels: int = LEVELS, digits: int = DIGITS) -> DataFrame:
    """Per source the `prefix` below which rows (source, size, place) come nearest to its `budget`.

    Each level sums the rows that share the prefix found so far by their next digits, and moves the
    prefix to the bucket in which the budget ends. At the last level that bucket is taken whole
    if this is nearer to the budget, which `closed` tells.
    """
    state = budgets.select(F.col("source").alias("_source"), "budget", F.lit("").alias("prefix"), F.lit(0.0).alias("below"))
    for level in range(1, levels + 1):
        inside = rows.join(state, same("source", "_source")).where(
            F.substring("place", 1, digits * (level - 1)) == F.col("prefix")
        )
        cells = inside.groupBy("_source", F.substring("place", 1, digits * level).alias("cell")).agg(
            F.sum("size").alias("held"), F.first("budget").alias("budget"), F.first("below").alias("below")
        )
        order = Window.partitionBy("_source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("reached", F.col("below") + F.sum("held").over(order))
        # The first cell that reaches the budget; if rounding leaves none, the last cell.
        short = F.col("reached") < F.col("budget")
        rank = F.struct(short.alias("short"), F.when(short, -F.col("reached")).otherwise(F.col("reached")).alias("near"))
        end = F.min_by(F.struct("cell", (F.col("reached") - F.col("held")).alias("below"), "reached"), rank)
        found = cells.groupBy("_source").agg(end.alias("end"), F.first("budget").alias("budget"))
        state = found.select("_source", "budget", F.col("end.cell").alias("prefix"), "end.below", "end.reached")
        state = settle_as_table(state, "thresholds")
    nearer = F.col("reached") - F.col("budget") <= F.col("budget") - F.col("below")
    return state.select("_source", "prefix", nearer.alias("closed"))


def plan(narrow: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source of `narrow` (source, size, place): size, target, whole copies and threshold."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = settle_as_table(targets(sizes, weights, most), "targets")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = wanted.withColumn("whole", copies.cast("bigint"))
    budget = (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")
    cuts = thresholds(narrow, wanted.select("source", budget))
    joined = wanted.withColumnRenamed("source", "_wanted").join(cuts, same("_wanted", "_source"), "left")
    return joined.select("_wanted", "source_size", "target", "whole", "prefix", "closed")


def copies(most: int = MOST) -> Column:
    """How often the mix takes a row that is joined with its source's plan."""
    head = F.substring("place", 1, DIGITS * LEVELS)
    inside = (head < F.col("prefix")) | (F.col("closed") & (head == F.col("prefix")))
    more = F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    return F.least(F.col("whole") + more, F.lit(most)).cast("bigint")


def size_of(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def mix(
    rows: DataFrame,
    ids: Sequence[str] = ("doc_id",),
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """`rows` without their text columns, and `size`, `source_size`, `target`, `copies`, `taken`.

    `copies` says how often the mix takes a row: the whole multiples of its source that the target
    holds, and once more for rows below the source's threshold.
    """
    kept = [c for c in rows.columns if c != text and c != source]
    renamed = {c: "_" + c for c in kept if c in (*RESULT, "place", "source")}
    narrow = rows.select(
        *[F.col(c).alias(renamed.get(c, c)) for c in kept],
        F.col(source).alias("source"),
        size_of(text).alias("size"),
        place(*ids, F.xxhash64(text)).alias("place"),
    )
    narrow = settle_as_table(narrow, "mix")
    taken = narrow.join(plan(narrow.select("source", "size", "place"), weights, most), same("source", "_wanted"))
    taken = taken.withColumn("copies", copies(most)).withColumn("taken", F.col("copies") * F.col("size"))
    return taken.select(*[renamed.get(c, c) for c in kept], "source", *RESULT)


def take(
    rows: DataFrame,
    ids: Sequence[str] = ("doc_id",),
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of `rows`.

    Rows without words weigh nothing in either direction and pass as they are drawn.
    """
    key = place(*ids, F.xxhash64(text))
    narrow = rows.select(F.col(source).alias("source"), size_of(text).alias("size"), key.alias("place"))
    narrow = settle_as_table(narrow, "mix")
    held = rows.select(F.struct(*rows.columns).alias("row"), F.col(source).alias("source"), key.alias("place"))
    drawn = held.join(plan(narrow, weights, most), same("source", "_wanted")).withColumn("copies", copies(most))
    drawn = drawn.where(F.col("copies") > 0).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return drawn.select("row.*")
