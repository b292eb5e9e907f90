import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import functions as X
from vectorloom.operators import assembly


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def array(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_slices_take_the_matrix_apart(spark):
    row = array(1, 2, 3, 0, 1)
    got = one(spark, X.feature_slice(row, 2).alias("x"), X.label_slice(row, 2).alias("y"))
    assert got.x == [1.0, 2.0, 3.0] and got.y == [0.0, 1.0]


def test_arg_max_takes_the_first_of_ties(spark):
    assert one(spark, X.arg_max(array(1, 5, 5)).alias("k")).k == 1


def test_one_hot_by_name_and_index(spark):
    got = one(
        spark,
        X.one_hot_name(F.lit("b"), ["a", "b", "c"]).alias("n"),
        X.one_hot_index(F.lit(2), 3).alias("i"),
        X.one_hot_name(F.lit("z"), ["a", "b"]).alias("none"),
    )
    assert got.n == [0, 1, 0] and got.i == [0, 0, 1] and got.none == [0, 0]


def test_softmax_matches_numpy(spark):
    values = np.array([0.5, -1.0, 2.0])
    got = one(spark, X.softmax(array(*values)).alias("p")).p
    np.testing.assert_allclose(got, np.exp(values) / np.exp(values).sum(), rtol=1e-12)


def test_pick_columns_keeps_the_order_asked_for(spark):
    assert one(spark, X.pick_columns(array(1, 2, 3), [2, 0]).alias("v")).v == [3.0, 1.0]


def test_paths(spark):
    got = one(spark, X.parent_dir(F.lit("a/cat/1.png")).alias("p"), X.parent_dir(F.lit("x")).alias("q"))
    assert got.p == "cat" and got.q is None


def test_units_and_texts(spark):
    got = one(
        spark,
        X.minutes(F.lit(90.0)).alias("m"),
        X.hours(F.lit(1800.0)).alias("h"),
        X.percent_text(F.lit(0.739655)).alias("p"),
        X.iso_shifted(F.to_timestamp(F.lit("2024-10-04 03:33:07.818695"))).alias("t"),
    )
    assert (got.m, got.h, got.p) == (1.5, 0.5, "73.97%")
    assert got.t == "2024-10-03T22:33:07.818695-05:00"


def test_split_shares(spark):
    counts = {r.split: r["count"] for r in spark.range(1000).select(X.split_of(F.col("id")).alias("split")).groupBy("split").count().collect()}
    assert counts == {"train": 700, "test": 200, "validation": 100}


def test_class_names_are_bounded(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("c"))
    assert assembly.class_names(rows.where("id < 3"), "c") == ["0", "1", "2"]
    with pytest.raises(ValueError, match="distinct class names"):
        assembly.class_names(rows, "c", limit=10)


def test_label_filter_and_columns_reach_the_scan(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    plan = assembly.class_mask(rows, 3).select("vec_id")._jdf.queryExecution().toString()
    assert "EqualTo(label,3)" in plan
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in plan


def test_unmatched_reads_only_keys_of_the_label_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    plan = assembly.unmatched(docs, labels, "doc_id")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_hot_join_key_is_split(spark):
    """A key that owns a third of the rows is handled by several tasks."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.shuffle.partitions": "16",
    }
    kept = {key: spark.conf.get(key, None) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
        features = spark.range(0, 60000, 1, 12).select(key.alias("k"), F.rand(1).alias("v"), "id")
        labels = spark.range(0, 60000, 1, 4).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"))
        joined = assembly.join_labels(features, labels, "k")
        assert len(joined.collect()) == 60000
        assert "SortMergeJoin(skew=true)" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
