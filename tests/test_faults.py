"""Inputs that must raise or be kept apart instead of changing a result in silence."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vectorloom import functions as X
from vectorloom.functions.scalars import iso_shifted, split_of
from vectorloom.operators import profile
from vectorloom.operators.relu_perceptron import ReluPerceptronClassifier
from vectorloom.sources import read_npy
from vectorloom.sources.runlog import import_array_log


def first(frame):
    return frame.first()[0]


def save(folder, **arrays):
    folder.mkdir(exist_ok=True)
    for name, values in arrays.items():
        np.save(folder / f"{name}.npy", values)
    return str(folder)


def test_npy_takes_the_widest_type(spark, tmp_path):
    path = save(tmp_path / "m", a=np.ones((2, 3), np.float32), b=np.full((1, 3), 16777217.0))
    assert 16777217.0 in [v for r in read_npy(spark, path).collect() for v in r["features"]]
    longs = save(tmp_path / "l", a=np.full((1, 2), 2**53 + 1, np.int64), b=np.ones((1, 2), np.int8))
    assert 2**53 + 1 in [v for r in read_npy(spark, longs).collect() for v in r["features"]]
    for name, other in (("w", np.ones((1, 4))), ("r", None)):
        arrays = {"a": np.ones((1, 3)), "b": np.full((1, 3), 2**53 + 1, np.int64) if other is None else other}
        with pytest.raises((PySparkException, ValueError)):
            read_npy(spark, save(tmp_path / name, **arrays)).collect()


def test_one_hot_of_unknown_classes(spark):
    one = lambda v: first(spark.sql(f"SELECT cast({v} AS int) AS i").select(X.one_hot_index(F.col("i"), 3)))
    assert one(2) == [0, 0, 1] and one("NULL") is None
    for bad in (3, -1):
        with pytest.raises(PySparkException):
            one(bad)
    assert first(spark.sql("SELECT cast(NULL AS string) AS n").select(X.one_hot_name(F.col("n"), ["a"]))) is None


def test_split_needs_an_id(spark):
    with pytest.raises(PySparkException):
        first(spark.sql("SELECT cast(NULL AS bigint) AS i").select(split_of(F.col("i"))))


def test_softmax_of_large_scores(spark):
    got = first(spark.sql("SELECT array(1000D, 0D) AS r").select(X.softmax(F.col("r"))))
    assert got == [1.0, 0.0]


@pytest.mark.parametrize("value", [float("nan"), float("inf")])
def test_histogram_refuses_what_has_no_bin(spark, value):
    rows = spark.createDataFrame([([1.0, value], 0), ([2.0, 3.0], 0)], "features array<double>, label int")
    with pytest.raises(PySparkException):
        profile.class_histogram(rows, "features", F.array(F.lit(1))).collect()


@pytest.mark.parametrize("zone", ["UTC", "America/Bogota", "Europe/Berlin"])
def test_iso_text_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        made = spark.sql("SELECT timestamp_micros(1700000000123450) AS a, TIMESTAMP_NTZ'2023-11-14 22:13:20.12345' AS b")
        got = made.select(iso_shifted(F.col("a")), iso_shifted(F.col("b"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert set(got) == {"2023-11-14T17:13:20.123450-05:00"}


def test_log_keeps_a_record_with_an_unreadable_time(spark, tmp_path):
    records = [{"Metodo": "NB", "timestamp": "n/a"}, {"Metodo": "LR", "timestamp": "2001-02-03T04:05:06+00:00"}]
    (tmp_path / "log.json").write_text(json.dumps(records))
    got = {r["method"]: r for r in import_array_log(spark, str(tmp_path / "log.json")).collect()}
    assert got["NB"]["started_at"] is None and "n/a" in got["NB"]["_corrupt_record"]
    assert got["LR"]["started_at"] == dt.datetime(2001, 2, 3, 4, 5, 6) and got["LR"]["_corrupt_record"] is None


@pytest.mark.parametrize(
    "rows, options",
    [
        ([(0, [1.0, 2.0], 1.7), (1, [0.0, 1.0], 0.0)], {}),
        ([(0, [1.0, float("nan")], 1.0), (1, [0.0, 1.0], 0.0)], {}),
        ([], {"stepsPerEpoch": 1, "miniBatchFraction": 0.5}),
    ],
)
def test_training_refuses(spark, rows, options):
    frame = spark.createDataFrame(rows, "id long, features array<double>, label double")
    with pytest.raises((PySparkException, ValueError)):
        ReluPerceptronClassifier(layers=[2, 2], maxIter=1, idCol="id", **options).fit(frame)
