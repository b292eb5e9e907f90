"""Image resizing and batch featurisation with a model the user brings.

The model is given as a factory without arguments that returns a function from a batch (NumPy array)
to a batch of outputs. It is called once per Python worker, so weights are loaded there and never
travel with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, StructField, StructType

Factory = Callable[[], Callable[[np.ndarray], np.ndarray]]


@lru_cache(maxsize=256)
def taps(size: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weight matrix of one axis, two entries a row: their places and the weight of the second."""
    at = np.clip((np.arange(target) + 0.5) * (size / target) - 0.5, 0, size - 1)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, size - 1), (at - low).astype(np.float32)


def bilinear(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize of equally large images (count, rows, columns, channels).

    Half-pixel centres and clamped borders, without anti-aliasing.
    """

    top, bottom, down = taps(images.shape[1], height)
    left, right, along = taps(images.shape[2], width)
    down, along = down[:, None, None], along[:, None]
    pixels = images.astype(np.float32)
    rows = pixels[:, top] * (1 - down) + pixels[:, bottom] * down
    return rows[:, :, left] * (1 - along) + rows[:, :, right] * along


def rgb(height: int, width: int, channels: int, data: Sequence[bytes]) -> np.ndarray:
    """Pixels of equally large images, stored as grey, BGR or BGRA bytes, as RGB."""
    pixels = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), height, width, channels)
    return np.repeat(pixels, 3, axis=3) if channels == 1 else pixels[..., 2::-1]


def resized(frame: pd.DataFrame, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Resized pixels of the valid images of a frame, and the places of these images in it."""
    shapes = list(zip(frame["height"], frame["width"], frame["nChannels"]))
    groups: dict[tuple, list[int]] = {}
    for place, shape in enumerate(shapes):
        if min(shape) > 0:
            groups.setdefault(shape, []).append(place)
    data = frame["data"].to_numpy()
    places = np.array([p for group in groups.values() for p in group], dtype=np.int64)
    parts = [bilinear(rgb(*shape, data[group]), height, width) for shape, group in groups.items()]
    pixels = np.concatenate(parts) if parts else np.zeros((0, height, width, 3), np.float32)
    order = np.argsort(places)
    return pixels[order], places[order]


def batches_of(frame: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for start in range(0, len(frame), size):
        yield frame.iloc[start : start + size]


def resize_images(image: str | Column, height: int, width: int, batch_size: int = 64) -> Column:
    """Image struct to a flat `array<float>` of height x width x 3; null for an invalid image."""

    @F.arrow_udf(ArrayType(FloatType()))
    def resize(images: pa.Array) -> pa.Array:
        names = ("height", "width", "nChannels", "data")
        frame = pd.DataFrame({n: images.field(n).to_pandas() for n in names})
        sizes = frame[list(names[:3])].fillna(0).astype(np.int64)
        frame = frame.assign(**sizes)
        valid = (sizes > 0).all(axis=1).to_numpy() & frame["data"].notna().to_numpy()
        frame.loc[~valid, "height"] = 0
        each = height * width * 3
        pixels, start = np.empty((int(valid.sum()), each), np.float32), 0
        for part in batches_of(frame, batch_size):
            found, _ = resized(part, height, width)
            pixels[start : start + len(found)] = found.reshape(len(found), each)
            start += len(found)
        offsets = np.concatenate([[0], np.cumsum(valid)]) * each
        values, missing = pa.array(pixels.ravel()), pa.array(~valid)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=missing)

    struct = F.col(image) if isinstance(image, str) else image
    parts = [struct[name].alias(name) for name in ("height", "width", "nChannels", "data")]
    return resize(F.struct(*parts))


def featurise(
    rows: DataFrame,
    column: str,
    factory: Factory,
    shape: Sequence[int],
    alias: str = "features",
    batch_size: int = 64,
    returns: DataType | None = None,
) -> DataFrame:
    """Run a batch model over an array column."""
    model = predict_batch_udf(
        factory,
        return_type=returns or ArrayType(FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(shape)],
    )
    return rows.withColumn(alias, model(F.col(column)))


def featurise_images(
    images: DataFrame,
    factory: Factory,
    height: int,
    width: int,
    keep: Sequence[str] = ("path", "class_name"),
    alias: str = "features",
    batch_size: int = 64,
) -> DataFrame:
    """Resize and featurise in one pass through Python.

    Only the compact feature row leaves the worker, not the resized pixels. Invalid images yield
    null. The last batch of a partition may be short.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            for part in batches_of(frame, batch_size):
                pixels, places = resized(part, height, width)
                out = np.full(len(part), None, dtype=object)
                if len(places):
                    for place, row in zip(places, np.asarray(model(pixels), np.float32)):
                        out[place] = row.ravel()
                yield part[list(keep)].assign(**{alias: pd.Series(out, index=part.index)})

    schema = StructType(
        [images.schema[name] for name in keep] + [StructField(alias, ArrayType(FloatType()))]
    )
    flat = images.select(*keep, "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, schema)


def image_label_rows(images: DataFrame, classes: Sequence[str], height: int, width: int) -> DataFrame:
    """`path`, resized pixels and one-hot label of every image, in one projection."""
    from vectorloom.functions.vectors import one_hot_name

    return images.select(
        "path",
        resize_images("image", height, width).alias("pixels"),
        one_hot_name(F.col("class_name"), classes).alias("label"),
    )
