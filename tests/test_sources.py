import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import assembly, classify
from vectorloom.sources import (
    append_run,
    import_array_log,
    list_files,
    read_log,
    read_matrix,
    read_npy,
    read_splits,
    scan_images,
    shard,
    shuffled,
    timed,
    write_matrix,
)


def png(pixels: np.ndarray) -> bytes:
    """Minimal encoder: 8-bit RGB or grey."""
    height, width = pixels.shape[:2]
    raw = b"".join(b"\x00" + pixels[r].astype(np.uint8).tobytes() for r in range(height))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    colour = 2 if pixels.ndim == 3 else 0
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def image_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for number, name in enumerate(["cat", "dog"]):
        (root / name).mkdir()
        for i in range(2):
            pixels = np.full((2, 3, 3), [10 + number, 20 + i, 30], np.uint8)
            (root / name / f"{i}.png").write_bytes(png(pixels))
    (root / "dog" / "broken.png").write_bytes(b"no image")
    (root / "LICENSE.txt").write_text("free")
    return str(root)


# ---- matrices ------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["float32", "float64", "int16"])
def test_npy_shards(spark, tmp_path, dtype, order):
    first = np.arange(18).reshape(3, 6).astype(dtype, order=order)
    second = (100 + np.arange(18)).reshape(3, 6).astype(dtype, order=order)
    np.save(tmp_path / "a.npy", first)
    np.save(tmp_path / "b.npy", second)
    (tmp_path / "notes.txt").write_text("not a matrix")
    got = read_npy(spark, str(tmp_path)).orderBy("path", "row_index").collect()
    assert [r.row_index for r in got] == [0, 1, 2, 0, 1, 2]
    np.testing.assert_array_equal([r.features for r in got], np.vstack([first, second]))
    element = read_npy(spark, str(tmp_path)).schema["features"].dataType.elementType.typeName()
    assert element == ("float" if dtype == "float32" else "double")


@pytest.mark.parametrize("split_bytes", [64, 100, 1000, 10**6])
def test_npy_ranges_cover_every_row_once(spark, tmp_path, split_bytes):
    matrix = np.random.default_rng(1).normal(size=(57, 5))
    np.save(tmp_path / "m.npy", matrix)
    rows = read_npy(spark, str(tmp_path / "m.npy"), split_bytes)
    got = rows.orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(57))
    np.testing.assert_array_equal([r.features for r in got], matrix)
    assert rows.rdd.getNumPartitions() == -(-(57 * 40 + 128) // split_bytes)


def test_npy_refuses_other_shapes(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(3))
    with pytest.raises(Exception, match="two-dimensional"):
        read_npy(spark, str(tmp_path / "m.npy")).collect()


def test_matrix_sink_prunes_splits(spark, folder, tmp_path):
    from vectorloom.plans.catalog import embeddings

    path = str(tmp_path / "matrix")
    rows = embeddings(spark, folder)
    write_matrix(rows, path)
    back = read_matrix(spark, path, "test")
    assert back.count() == rows.where("split = 'test'").count()
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().toString()
    assert read_matrix(spark, path).count() == rows.count()


def test_read_splits_marks_rows(spark, tmp_path):
    for split, n in {"train": 5, "test": 3}.items():
        spark.range(n).write.parquet(str(tmp_path / split))
    rows = read_splits(spark, {s: str(tmp_path / s) for s in ("train", "test")})
    assert {r.split: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 5, "test": 3}


def test_sharding_only_where_splits_are_few(spark):
    rows = spark.range(0, 100, 1, 2)
    assert shard(rows, 5).rdd.getNumPartitions() == 5 and shard(rows, 5).count() == 100
    assert shard(rows, 2) is rows and shard(rows, 1) is rows


# ---- images --------------------------------------------------------------------------------------


def test_listing_leaves_out_other_files(spark, image_root):
    rows = list_files(spark, image_root)
    assert rows.count() == 5
    assert "content" not in rows.columns
    assert [r.class_name for r in assembly.class_list(rows, "class_name").collect()] == ["cat", "dog"]


def test_listing_by_name(spark, image_root):
    assert list_files(spark, image_root, "*.txt").count() == 0
    assert list_files(spark, image_root, "*.txt", exclude=()).count() == 1
    content = list_files(spark, image_root, content=True).where(F.col("path").endswith("broken.png"))
    assert bytes(content.first().content) == b"no image"


def test_folders_are_listed_not_single_files(spark, tmp_path):
    """Many files make neither a listing job with a task a file nor a read task for every few of them."""
    for k in range(600):
        folder = tmp_path / ("a", "b")[k % 2]
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.txt").write_bytes(b"x")
    (tmp_path / "a" / "deep").mkdir()
    (tmp_path / "a" / "deep" / "in.txt").write_bytes(b"x")
    (tmp_path / "top.txt").write_bytes(b"x")
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    rows = list_files(spark, str(tmp_path))
    assert not context.statusTracker().getJobIdsForGroup("listing")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert rows.rdd.getNumPartitions() <= 4 * context.defaultParallelism
    assert rows.count() == 601 and rows.where("class_name = 'deep'").count() == 1
    assert list_files(spark, str(tmp_path), "*/1*.txt").count() == 111


def test_shuffle_keeps_the_rows(spark, image_root):
    plain = list_files(spark, image_root)
    mixed = list_files(spark, image_root, shuffle_seed=3)
    assert sorted(r.path for r in plain.collect()) == sorted(r.path for r in mixed.collect())
    many = [r.id for r in shuffled(spark.range(200), 5).collect()]
    assert many != sorted(many) and sorted(many) == list(range(200))


def test_scan_keeps_or_drops_invalid_images(spark, image_root):
    rows = scan_images(spark, image_root)
    assert {r.valid: r["count"] for r in rows.groupBy("valid").count().collect()} == {True: 4, False: 1}
    assert scan_images(spark, image_root, keep_invalid=False).count() == 4
    first = rows.where("class_name = 'cat'").orderBy("path").first().image
    assert (first.height, first.width, first.nChannels) == (2, 3, 3)
    assert bytes(first.data)[:3] == bytes([30, 20, 10])


# ---- run log -------------------------------------------------------------------------------------


def test_missing_log_is_empty(spark, tmp_path):
    assert read_log(spark, str(tmp_path / "none")).count() == 0
    assert import_array_log(spark, str(tmp_path / "none.json")).count() == 0


def test_append_adds_records(spark, tmp_path):
    path = str(tmp_path / "log")
    result, seconds = timed(lambda: 42)
    assert result == 42 and seconds >= 0
    append_run(spark, path, "Cluster", "LR", 120.0, accuracy=0.5)
    append_run(spark, path, "Cluster", "MLP", 60.0, accuracy_history=[0.1, 0.2], slots=2, epochs=2)
    got = read_log(spark, path).orderBy("method").collect()
    assert [(r.method, r.elapsed_minutes, r.slots, r.accuracy) for r in got] == [("LR", 2.0, None, 0.5), ("MLP", 1.0, 2, None)]
    assert got[1].accuracy_history == [0.1, 0.2] and got[0].started_at is not None
    with pytest.raises(ValueError, match="unknown run fields"):
        append_run(spark, path, "Cluster", "LR", 1.0, colour="red")


def test_unreadable_line_stays_visible(spark, tmp_path):
    path = tmp_path / "log"
    append_run(spark, str(path), "CPU", "NB", 1.0)
    (path / "part-extra.json").write_text('{"mode": "CPU", "meth\n')
    got = read_log(spark, str(path)).collect()
    assert len(got) == 2 and sum(r._corrupt_record is not None for r in got) == 1


def test_older_array_logs(spark, tmp_path):
    records = [
        {"Tipo Ejecucion": "Cluster", "Metodo": "MLPC", "Epochs": 20, "tiempo_ejecucion": 120.0, "accuracy": 0.7, "paralelism": 4},
        {"Tipo Ejecucion": "CPU", "timestamp": "2024-10-04T13:33:07.818695+00:00", "tiempo_ejecucion": 60.0, "Slots": 2, "accuracy": [0.5, 0.6]},
    ]
    (tmp_path / "good.json").write_text(json.dumps(records, indent=4))
    (tmp_path / "bad.json").write_text('[{"Metodo": "x", ')
    got = import_array_log(spark, str(tmp_path / "good.json"), shift_hours=5).orderBy("elapsed_seconds").collect()
    assert [(r.mode, r.accuracy, r.parallelism, r.elapsed_minutes) for r in got] == [("CPU", None, None, 1.0), ("Cluster", 0.7, 4, 2.0)]
    assert got[0].accuracy_history == [0.5, 0.6]
    assert got[0].started_at.isoformat() == "2024-10-04T18:33:07.818695"
    bad = import_array_log(spark, str(tmp_path / "bad.json")).collect()
    assert len(bad) == 1 and bad[0]._corrupt_record is not None


def test_model_round_trip(spark, blobs, tmp_path):
    from pyspark.ml.classification import NaiveBayesModel

    rows = assembly.training_frame(blobs, "features", "label", ["id"])
    model = classify.gaussian_naive_bayes().fit(rows)
    model.write().overwrite().save(str(tmp_path / "nb"))
    again = NaiveBayesModel.load(str(tmp_path / "nb"))
    both = [m.transform(rows).orderBy("id").select("prediction").collect() for m in (model, again)]
    assert both[0] == both[1]


def test_written_shards_and_their_manifest(spark, tmp_path):
    from vectorloom.sources import npy_manifest, write_npy

    matrix = np.random.default_rng(2).normal(size=(40, 3))
    rows = spark.createDataFrame([(row.tolist(),) for row in matrix], "x array<double>").repartition(3)
    shards = write_npy(rows, "x", str(tmp_path / "m"), "<f8", shard_bytes=100).collect()
    assert sum(r["rows"] for r in shards) == 40
    found = npy_manifest(spark, str(tmp_path / "m"), files_per_task=2).collect()
    assert len(found) == len(shards) and sum(r["rows"] for r in found) == 40
    assert {(r["kind"], r["item_bytes"], r["width"], r["by_column"]) for r in found} == {("f", 8, 3, False)}
    assert all(r["bytes"] == r["offset"] + 24 * r["rows"] for r in found)
    back = sorted(tuple(r["features"]) for r in read_npy(spark, str(tmp_path / "m")).collect())
    assert back == sorted(map(tuple, matrix.tolist()))
    for bad in ([[1.0], [1.0, 2.0]], [[1.0], None], [[1.0], [None]]):
        broken = spark.createDataFrame([(b,) for b in bad], "x array<double>").coalesce(1)
        with pytest.raises(Exception, match="no nulls|different length"):
            write_npy(broken, "x", str(tmp_path / "bad")).collect()
    np.save(tmp_path / "m" / "z.npy", np.zeros((2, 4)))
    with pytest.raises(ValueError, match="different width"):
        read_npy(spark, str(tmp_path / "m"))
