import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_sources import image_root  # noqa: F401

from vectorloom.operators import inference
from vectorloom.sources import scan_images


def test_bilinear_by_hand():
    image = np.array([[0.0, 4.0], [8.0, 12.0]])[None, :, :, None]
    got = inference.bilinear(image, 4, 4)[0, :, :, 0]
    wanted = [[0, 1, 3, 4], [2, 3, 5, 6], [6, 7, 9, 10], [8, 9, 11, 12]]
    np.testing.assert_allclose(got, wanted)


def test_bilinear_identity_and_constant():
    images = np.random.default_rng(0).integers(0, 255, (2, 5, 7, 3)).astype(np.uint8)
    np.testing.assert_allclose(inference.bilinear(images, 5, 7), images)
    np.testing.assert_allclose(inference.bilinear(np.full((1, 9, 4, 3), 8), 3, 6), 8)


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_channels_become_rgb(channels):
    stored = np.arange(2 * 2 * channels, dtype=np.uint8)
    got = inference.rgb(2, 2, channels, [stored.tobytes()])
    assert got.shape == (1, 2, 2, 3)
    assert got[0, 0, 0].tolist() == ([0, 0, 0] if channels == 1 else [2, 1, 0])


def test_frames_with_images_of_several_sizes():
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 255, shape).astype(np.uint8) for shape in ((2, 3, 3), (4, 4, 1), (2, 3, 3))]
    rows = [(*i.shape, i.tobytes()) for i in images]
    rows.insert(1, (-1, -1, -1, b""))
    frame = pd.DataFrame(rows, columns=["height", "width", "nChannels", "data"])
    pixels, places = inference.resized(frame, 3, 3)
    assert places.tolist() == [0, 2, 3]
    for found, image in zip(pixels, images):
        alone = inference.rgb(*image.shape, [image.tobytes()])
        np.testing.assert_array_equal(found, inference.bilinear(alone, 3, 3)[0])
    assert inference.resized(frame.iloc[1:2], 3, 3)[0].shape == (0, 3, 3, 3)


def short(path):
    return "/".join(path.split("/")[-2:])


def test_resized_images(spark, image_root):  # noqa: F811
    rows = inference.image_label_rows(scan_images(spark, image_root), ["cat", "dog"], 4, 4)
    got = {short(r.path): r for r in rows.collect()}
    assert got["dog/broken.png"].pixels is None
    assert len(got["cat/0.png"].pixels) == 48 and got["cat/0.png"].pixels[:3] == [10.0, 20.0, 30.0]
    assert got["cat/1.png"].label == [1, 0] and got["dog/0.png"].label == [0, 1]


def test_image_features_in_short_batches(spark, image_root):  # noqa: F811
    def factory():
        def model(batch):
            return np.stack([batch.mean(axis=(1, 2, 3)), np.full(len(batch), len(batch))], axis=1)

        return model

    images = scan_images(spark, image_root).coalesce(1)
    rows = inference.featurise_images(images, factory, 4, 4, batch_size=3).collect()
    found = {short(r.path): r.features for r in rows}
    assert found["dog/broken.png"] is None
    assert found["cat/0.png"][0] == pytest.approx(20.0)
    assert found["dog/1.png"][0] == pytest.approx(62 / 3, rel=1e-6)
    assert {f[1] for f in found.values() if f} <= {1.0, 2.0, 3.0}


def test_array_features_do_not_depend_on_batches(spark):
    def factory():
        return lambda batch: batch @ np.array([[1.0], [2.0]])

    rows = spark.range(100).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    for size, parts in ((7, 1), (64, 4)):
        found = inference.featurise(rows.repartition(parts), "v", factory, [2], batch_size=size)
        assert all(r.features == [r.id + 2.0] for r in found.collect())


def test_resized_column_keeps_nulls_and_invalid_images_apart(spark):
    rng = np.random.default_rng(8)
    image = rng.integers(0, 255, (5, 4, 3)).astype(np.uint8)
    struct = "struct<height int, width int, nChannels int, data binary>"
    rows = [(0, (5, 4, 3, image.tobytes())), (1, None), (2, (-1, -1, -1, b"")), (3, (5, 4, 3, None)), (4, (5, 4, 3, image.tobytes()))]
    frame = spark.createDataFrame(rows, f"id int, image {struct.replace(' int', ': int').replace(' binary', ': binary')}")
    found = {r["id"]: r["p"] for r in frame.select("id", inference.resize_images("image", 7, 2, 1).alias("p")).collect()}
    wanted = inference.bilinear(inference.rgb(5, 4, 3, [image.tobytes()]), 7, 2)[0].ravel()
    assert found[1] is None and found[2] is None and found[3] is None
    np.testing.assert_allclose(found[0], wanted)
    np.testing.assert_allclose(found[4], wanted)
