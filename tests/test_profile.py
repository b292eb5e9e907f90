import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from vectorloom.operators import boxplot, profile, sizing


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(3)
    values = rng.normal(size=(300, 5))
    values[:, 1] = 2.5
    values[:, 2] = rng.integers(0, 4, 300)
    values[::50, 3] = 40.0
    values[:, 4] = np.where(np.arange(300) % 3 == 0, 7.0, values[:, 4])
    return values, (np.arange(300) % 3 == 0).astype(int)


@pytest.fixture(scope="module")
def rows(spark, matrix):
    values, labels = matrix
    data = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(values, labels))]
    return spark.createDataFrame(data, "id long, v array<double>, label int").repartition(5, "id").cache()


def every(n=5):
    return F.array(*[F.lit(i) for i in range(n)])


def test_column_profile(matrix, rows):
    values, _ = matrix
    got = profile.column_profile(rows, "v").orderBy("pos").toPandas()
    np.testing.assert_allclose(got["mean"], values.mean(axis=0), rtol=1e-10, atol=1e-12)
    np.testing.assert_allclose(got["std"], values.std(axis=0), rtol=1e-9, atol=1e-12)
    np.testing.assert_array_equal(got["lo"], values.min(axis=0))
    np.testing.assert_array_equal(got["hi"], values.max(axis=0))


def test_rankings(matrix, rows):
    values, _ = matrix
    found = profile.column_profile(rows, "v")
    by_mean = [r.pos for r in profile.rank_columns(found, "mean").orderBy("rank").collect()]
    assert by_mean == np.argsort(values.mean(axis=0))[::-1].tolist()
    by_std = [r.pos for r in profile.rank_columns(found, "std", descending=False).orderBy("rank").collect()]
    assert by_std == np.argsort(values.std(axis=0)).tolist()
    top = profile.top_columns(found, "mean", 2).collect()
    assert [r.pos for r in top] == by_mean[:2]


def counts_of(frame, label=None):
    wanted = frame.where(F.col("label") == label) if label is not None else frame
    return {(r.pos, r.bin): r.n for r in wanted.collect()}


@pytest.mark.parametrize("common", [False, True])
def test_histogram_per_class(matrix, rows, common):
    values, labels = matrix
    found = profile.class_histogram(rows, "v", every(), common_range=common).cache()
    assert found.count() == 5 * 2 * 20
    for label in (0, 1):
        counted = counts_of(found, label)
        for pos in range(5):
            own = values[labels == label, pos]
            whole = values[:, pos] if common else own
            wanted, edges = np.histogram(own, bins=20, range=(whole.min(), whole.max()))
            assert [counted[pos, b] for b in range(20)] == wanted.tolist(), (label, pos)
            got = [r.edge for r in found.where(f"label = {label} and pos = {pos}").orderBy("bin").collect()]
            np.testing.assert_allclose(got, edges[:-1], rtol=1e-12, atol=1e-12)


def test_histogram_of_chosen_columns_does_not_explode_the_others(rows):
    top = profile.top_columns(profile.column_profile(rows, "v"), "mean", 2)
    found = profile.class_histogram(rows, "v", profile.as_positions(top))
    assert {r.pos for r in found.select("pos").distinct().collect()} == {r.pos for r in top.collect()}


def brute_box(x):
    q1, median, q3 = np.percentile(x, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = x[(x >= low) & (x <= high)]
    return q1, median, q3, min(inside.min(), q1), max(inside.max(), q3), len(x) - len(inside)


def test_box_plots(matrix, rows):
    values, _ = matrix
    found = boxplot.boxplot_stats(rows, "v", every()).orderBy("pos").collect()
    for r, x in zip(found, values.T):
        got = (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers)
        np.testing.assert_allclose(got, brute_box(x), rtol=1e-12)
        assert r.total == len(x)


def test_box_plot_outliers(matrix, rows):
    values, _ = matrix
    found = boxplot.boxplot_outliers(rows, "v", F.array(F.lit(3))).agg(F.sum("n")).first()[0]
    assert found == brute_box(values[:, 3])[-1]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3).map(float), min_size=1, max_size=40), st.sampled_from([0.0, 0.1, 0.5, 0.99, 1.0]))
def test_quantiles_match_numpy(spark, values, share):
    frame = spark.createDataFrame([(0, v) for v in values] + [(1, 5.0)], "g int, value double")
    got = {r.g: r.quantile for r in boxplot.exact_quantiles(frame, ["g"], [share]).collect()}
    assert got[0] == pytest.approx(np.quantile(values, share), abs=1e-12) and got[1] == 5.0


def test_constant_and_single_row(spark):
    frame = spark.createDataFrame([([4.0],)], "v array<double>").withColumn("label", F.lit(0))
    box = boxplot.boxplot_stats(frame, "v", F.array(F.lit(0))).first()
    assert (box.q1, box.median, box.q3, box.whisker_low, box.outliers) == (4.0, 4.0, 4.0, 4.0, 0)
    bins = {r.bin: r.n for r in profile.class_histogram(frame, "v", F.array(F.lit(0))).collect()}
    assert bins[10] == 1 and sum(bins.values()) == 1


# ---- plans that do not depend on how keys are distributed -----------------------------------------


def skewed(spark, n=3000):
    """A third of the rows share one group."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise((F.col("id") % 50).cast("int"))
    return spark.range(n).select("id", key.alias("g"))


def test_positions_equal_row_number(spark):
    rows = skewed(spark).orderBy(F.rand(1))
    window = Window.partitionBy("g")
    wanted = rows.select("id", "g", (F.row_number().over(window.orderBy("id")) - 1).alias("p"), F.count("*").over(window).alias("t"))
    got = sizing.positions(rows, ["g"], ["id"])
    pair = lambda frame: sorted(map(tuple, frame.collect()))
    assert pair(got.select("id", "g", "position", "total")) == pair(wanted)


def test_rows_without_a_group_are_kept(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, 5)], "id long, g int")
    got = sorted(tuple(r) for r in sizing.positions(rows, ["g"], ["id"]).select("id", "position", "total").collect())
    assert got == [(1, 0, 2), (2, 1, 2), (3, 0, 1)]
    values = spark.createDataFrame([([1.0], None), ([2.0], None), ([3.0], 1)], "v array<double>, label int")
    bins = profile.class_histogram(values, "v", F.array(F.lit(0)))
    assert {r.label: r.n for r in bins.groupBy("label").agg(F.sum("n").alias("n")).collect()} == {None: 2, 1: 1}


def test_sorting_cuts_the_hot_group(spark):
    placed = sizing.sort_across(skewed(spark), ["g"], ["id"])
    held = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(held) == 4 and max(held) < 0.5 * sum(held)


def test_attach_gives_the_same_rows_on_both_ways(spark):
    rows = skewed(spark)
    summary = sizing.settle(rows.groupBy("g").agg(F.max("id").alias("top")))
    pair = lambda frame: sorted(map(tuple, frame.select("g", "id", "top").collect()))
    small = sizing.attach(rows, summary, ["g"])
    large = sizing.attach(rows, summary, ["g"], max_rows=3)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert "_salt" in large._jdf.queryExecution().toString()
    assert pair(small) == pair(large) and small.count() == 3000


def test_class_profile_moves_partial_sums_only(spark, rows):
    plan = profile.column_profile(rows, "v", ["label"])._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan.split("Exchange")[1]
    assert "partial_avg" in before_exchange and "Generate posexplode" in before_exchange
