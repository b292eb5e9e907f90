"""Order statistics by selection against sorting."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import boxplot, folds, selection, sizing


def check(spark, pairs, kind="double"):
    frame = spark.createDataFrame(pairs, f"g int, value {kind}").repartition(4)
    ranks_of = lambda n: [0, n // 3, n // 2, n - 1]
    found = selection.order_statistics(frame, ["g"], ranks_of)
    groups = {g for g, v in pairs if v is not None}
    assert set(found) == {(g,) for g in groups}
    for g in groups:
        own = sorted((v for h, v in pairs if h == g and v is not None), key=lambda v: (v != v, v))
        assert found[(g,)].total == len(own)
        for r in ranks_of(len(own)):
            rank = found[(g,)].ranks[r]
            same = [k for k, v in enumerate(own) if v == own[r] or v != v and own[r] != own[r]]
            assert (rank.value == own[r] or rank.value != rank.value) and (rank.below, rank.equal) == (same[0], len(same))


@pytest.mark.parametrize("last_rows", [selection.LAST_ROWS, 0])
def test_values_of_every_kind(spark, monkeypatch, last_rows):
    monkeypatch.setattr(selection, "LAST_ROWS", last_rows)
    rng = random.Random(1)
    anything = lambda: struct.unpack("d", rng.randbytes(8))[0]
    pairs = [(1, anything()) for _ in range(300)] + [(2, rng.gauss(0, 1)) for _ in range(500)]
    pairs += [(3, v) for v in (0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 1.7e308, -1.7e308, 0.1)]
    pairs += [(4, 7.0)] * 400 + [(4, 7.0 + k * 2**-50) for k in range(9)] + [(None, 1.0), (None, 2.0), (5, None)]
    check(spark, pairs)


def test_whole_numbers_beyond_double_precision(spark, monkeypatch):
    monkeypatch.setattr(selection, "LAST_ROWS", 0)
    check(spark, [(k % 2, (1 << 62) + k * 3) for k in range(400)] + [(0, -(1 << 63)), (0, (1 << 63) - 1)], "long")


def test_quantiles_without_a_copy(spark, tmp_path, monkeypatch):
    frame = spark.range(5000).select((F.col("id") % 3).cast("int").alias("pos"), F.sin("id").alias("value"))

    def written(*_):
        raise AssertionError("a table was written")

    monkeypatch.setattr(sizing, "settle_as_table", written)
    spark.sparkContext.setJobGroup("quantiles", "quantiles")
    got = {(r["pos"], r["share"]): r["quantile"] for r in boxplot.exact_quantiles(frame, ["pos"]).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles")
    spark.sparkContext.setJobGroup("other", "other")
    for pos in range(3):
        values = np.sin(np.arange(5000)[np.arange(5000) % 3 == pos])
        for share in boxplot.QUARTILES:
            assert got[pos, share] == pytest.approx(np.quantile(values, share), abs=1e-12)
    assert len(jobs) < 10


def test_more_groups_than_the_driver_takes(spark, monkeypatch):
    frame = spark.range(600).select((F.col("id") % 40).cast("int").alias("pos"), F.cos("id").alias("value"))
    few = sorted(map(tuple, boxplot.exact_quantiles(frame, ["pos"]).collect()))
    monkeypatch.setattr(selection, "MAX_CELLS", 30)
    assert selection.order_statistics(frame, ["pos"], lambda n: [0]) is None
    many = sorted(map(tuple, boxplot.exact_quantiles(frame, ["pos"]).select("pos", "share", "total", "quantile").collect()))
    assert [r[:3] for r in few] == [r[:3] for r in many]
    assert [r[3] for r in few] == pytest.approx([r[3] for r in many])


@pytest.mark.parametrize("ids", ["plain", "repeated", "null", "text"])
def test_folds_have_equal_sizes(spark, ids):
    made = {
        "plain": F.col("id") * 7 - 900,
        "repeated": F.floor(F.col("id") / 9),
        "null": F.when(F.col("id") > 5, F.col("id")),
        "text": F.col("id").cast("string"),
    }[ids]
    label = F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 == 7, "b").when(F.col("id") == 8, "c")
    rows = spark.range(400).select(made.alias("key"), label.alias("y"))
    got = folds.stratified_folds(rows, "key", "y", 3)
    sizes = {(r["y"], r["fold"]): r["n"] for r in got.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    for name in ("a", "b", None, "c"):
        total = rows.where(F.col("y").eqNullSafe(F.lit(name))).count()
        assert [sizes.get((name, k), 0) for k in range(3)] == [len(p) for p in np.array_split(np.arange(total), 3)]
    if ids == "plain":
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
