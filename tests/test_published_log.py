"""The log with a commit: what is published, once, and what a repeated task or job leaves."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from vectorloom.operators import classify
from vectorloom.operators.runs import fit_and_log
from vectorloom.sources import publish_runs, published_runs, scan_images, write_images
from vectorloom.sources.published_log import RunLogWriter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# A task fails after it has written its part, on its first attempt; Spark repeats it.
REPEATED = """
import sys
from vectorloom.session import build_session
from vectorloom.sources import publish_runs, published_runs
from vectorloom.sources.published_log import RunLogWriter
from pyspark import TaskContext
from pyspark.sql import functions as F

write = RunLogWriter.write
def failing(self, iterator):
    message = write(self, iterator)
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
    return message
RunLogWriter.write = failing
import pyspark.cloudpickle as cloudpickle
import vectorloom.sources.published_log as module
cloudpickle.register_pickle_by_value(module)
spark = build_session(master="local[2,3]", spark__ui__enabled="false", spark__checkpoint__dir=sys.argv[1] + "/checkpoints")
spark.sparkContext.setLogLevel("OFF")
rows = spark.range(0, 6, 1, 2).select(F.concat(F.lit("m"), "id").alias("method"))
publish_runs(rows, sys.argv[1] + "/log", "run")
print(sorted(r["method"] for r in published_runs(spark, sys.argv[1] + "/log").collect()))
"""


def runs(spark, *methods):
    return spark.createDataFrame([(m, float(len(m))) for m in methods], "method string, elapsed_seconds double")


def methods(spark, path):
    return sorted((r["run_id"], r["method"]) for r in published_runs(spark, path).collect())


def test_a_run_is_published_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert published_runs(spark, path).count() == 0
    publish_runs(runs(spark, "a", "b"), path, "one")
    publish_runs(runs(spark, "c"), path, "one")
    publish_runs(runs(spark, "a"), path, "two / ü")
    assert methods(spark, path) == [("one", "a"), ("one", "b"), ("two / ü", "a")]
    assert len(list((tmp_path / "log" / "commits").glob("*.json"))) == 2
    assert not list((tmp_path / "log" / "pending").glob("*.json"))
    first = published_runs(spark, path).where("method = 'a'").first()
    assert first["elapsed_seconds"] == 1.0 and first["accuracy"] is None


def test_a_run_without_records(spark, tmp_path):
    path = str(tmp_path / "log")
    publish_runs(runs(spark, "a").where("false"), path, "empty")
    assert published_runs(spark, path).count() == 0
    publish_runs(runs(spark, "a"), path, "empty")
    assert published_runs(spark, path).count() == 0
    publish_runs(runs(spark, "a"), path, "other")
    assert methods(spark, path) == [("other", "a")]


def test_unlisted_parts_are_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    publish_runs(runs(spark, "a"), path, "one")
    (tmp_path / "log" / "parts" / "left-over.json").write_text('{"method": "ghost"}\n')
    assert methods(spark, path) == [("one", "a")]


def test_an_aborted_job_leaves_nothing(tmp_path, monkeypatch):
    from types import SimpleNamespace

    import vectorloom.sources.published_log as module

    task = SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)
    monkeypatch.setattr(module, "TaskContext", SimpleNamespace(get=lambda: task))
    writer = RunLogWriter(f"file://{tmp_path}/log", "one")
    message = writer.write(iter([('{"method": "a"}',)]))
    assert (tmp_path / "log" / "parts" / message.name).exists()
    writer.abort([message, None])
    assert not list((tmp_path / "log" / "parts").iterdir()) and not (tmp_path / "log" / "commits").exists()


def test_a_repeated_task_adds_nothing(tmp_path):
    done = subprocess.run([sys.executable, "-c", REPEATED, str(tmp_path)], cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.strip().splitlines()[-1] == str([f"m{i}" for i in range(6)])
    assert len(list((tmp_path / "log" / "parts").glob("*.json"))) == 4


def test_what_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown run fields"):
        publish_runs(spark.range(1), str(tmp_path), "one")
    with pytest.raises(ValueError, match="needs an id"):
        publish_runs(runs(spark, "a"), str(tmp_path), "")


def test_fit_and_log(spark, blobs, tmp_path):
    path = str(tmp_path / "log")
    split = F.when(F.col("id") % 4 == 0, "test").otherwise("train")
    rows = classify_rows(blobs).withColumn("split", split)
    model = fit_and_log(rows, classify.gaussian_naive_bayes(), path, "run", "CPU", "nb", epochs=1)
    got = {r["split"]: r for r in published_runs(spark, path).collect()}
    for name, record in got.items():
        part = model.transform(rows.where(F.col("split") == name))
        assert record["rows"] == part.count() and record["mode"] == "CPU" and record["epochs"] == 1
        assert record["accuracy"] == pytest.approx(part.where("prediction = label").count() / part.count())
    assert set(got) == {"train", "test"}


def classify_rows(blobs):
    from pyspark.ml.functions import array_to_vector

    return blobs.withColumn("features", array_to_vector("features"))


@pytest.mark.parametrize("channels", [1, 3])
def test_written_images_are_read_back(spark, tmp_path, channels):
    data = [bytes((i + 7 * k) % 256 for k in range(6 * channels)) for i in range(5)]
    shape = "id int, kind string, image struct<height int, width int, nChannels int, data binary>"
    made = [(i, f"c{i % 2}", (2, 3, channels, d)) for i, d in enumerate(data)]
    made += [(8, "c0", None), (9, "c0", (-1, -1, -1, b""))]
    assert write_images(spark.createDataFrame(made, shape), str(tmp_path), "id", "kind") == 5
    got = {r["path"].rsplit("/", 1)[1]: r for r in scan_images(spark, str(tmp_path)).collect()}
    assert set(got) == {f"{i}.png" for i in range(5)}
    for i, d in enumerate(data):
        assert bytes(got[f"{i}.png"]["image"]["data"]) == d and got[f"{i}.png"]["class_name"] == f"c{i % 2}"
