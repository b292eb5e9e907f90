"""Image folders laid out as `<root>/<class>/<file>`."""

from __future__ import annotations

import fnmatch
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.scalars import parent_dir
from vectorloom.operators.permutation import shuffle
from vectorloom.sources.files import open_folder, put, shared_uri


SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
TASK_PARTS = 32  # so many of Spark's parts of small files are read by one task


def read_below(reader: DataFrameReader, spark: SparkSession, root: str, pattern: str, path: str) -> DataFrame:
    """What `reader` gives of the files that `pattern` matches below `root`, and of those in folders that it matches.

    Folders are listed; a pattern that names the files would have Spark look each one up by a path of its own. A
    part holds a few small files only, so tasks take several parts.
    """
    folders, _, name = pattern.rpartition("/")
    if not folders or "{" in root + pattern:
        return reader.load(f"{root}/{pattern}")
    depth = re.sub(SCHEME, "", shared_uri(spark, root)).rstrip("/").count("/") + pattern.count("/") + 1
    inner = F.regexp_replace(path, SCHEME, "")
    below = F.size(F.split(inner, "/")) - 1 - depth
    fits = lambda place: F.element_at(F.split(inner, "/"), place).rlike("^(?:" + fnmatch.translate(name).replace("\\Z", "$").replace("\\z", "$") + ")")
    rows = reader.option("recursiveFileLookup", "true").load(f"{root}/{folders}")
    rows = rows.where(((below == 0) & fits(-1)) | ((below == 1) & fits(-2)))
    parts = rows.rdd.getNumPartitions()
    few = max(4 * spark.sparkContext.defaultParallelism, parts // TASK_PARTS)
    return rows.coalesce(few) if parts > few else rows


def list_files(
    spark: SparkSession,
    root: str,
    pattern: str = "*/*",
    exclude: Sequence[str] = ("LICENSE.txt",),
    content: bool = False,
    shuffle_seed: int | None = None,
) -> DataFrame:
    """Files below `root` with the class taken from the parent directory.

    File bytes are read only with `content=True`; otherwise the column is pruned and listing costs
    no reads. A shuffled order moves every row and is made only when a seed is given.
    """
    files = read_below(spark.read.format("binaryFile"), spark, root, pattern, "path")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(~name.isin(*exclude)) if exclude else files
    columns = ["path", "length", "modificationTime", parent_dir(F.col("path")).alias("class_name")]
    files = files.select(*columns, *(["content"] if content else []))
    return files if shuffle_seed is None else shuffled(files, shuffle_seed)


def shuffled(rows: DataFrame, seed: int, id_column: str | None = None, epoch: int = 0) -> DataFrame:
    """The same rows in a random order, fixed by seed and epoch, by `id_column` or else the first column."""
    return shuffle(rows, id_column or rows.columns[0], seed, epoch)


def scan_images(
    spark: SparkSession, root: str, pattern: str = "*/*", keep_invalid: bool = True
) -> DataFrame:
    """Decode the images below `root`: `path`, `class_name`, `image`, `valid`.

    A file that does not decode keeps its row, marked `valid = false`, unless `keep_invalid` is off.
    """
    reader = spark.read.format("image").option("dropInvalid", str(not keep_invalid).lower())
    rows = read_below(reader, spark, root, pattern, "image.origin")
    path = F.col("image.origin")
    return rows.select(
        path.alias("path"),
        parent_dir(path).alias("class_name"),
        "image",
        (F.col("image.height") > 0).alias("valid"),
    )



def png_bytes(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG file of the pixels of an image row: grey, or blue-green-red with or without alpha."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels > 1:
        pixels = pixels[..., [2, 1, 0, 3][:channels]]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(rows: DataFrame, root: str, name: str, class_name: str, image: str = "image") -> int:
    """Write each image as `<root>/<class>/<name>.png`, from the tasks; gives the number of files.

    Names must be unique within a class, else the last writer stays. A null or invalid image gives no file.
    """
    uri = shared_uri(rows.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, inner = open_folder(uri)
        made: set[str] = set()
        for batch in batches:
            count = 0
            for stem, folder, one in zip(*[column.to_pylist() for column in batch.columns]):
                if one is None or one["data"] is None or not (one["height"] or 0) > 0:
                    continue
                if folder not in made:
                    filesystem.create_dir(f"{inner}/{folder}", recursive=True)
                    made.add(folder)
                put(filesystem, f"{inner}/{folder}/{stem}.png", png_bytes(one["height"], one["width"], one["nChannels"], one["data"]))
                count += 1
            yield pa.RecordBatch.from_pydict({"files": pa.array([count], pa.int64())})

    parts = [F.col(image)[part].alias(part) for part in ("height", "width", "nChannels", "data")]
    whole = F.when(F.col(image).isNotNull(), F.struct(*parts))
    drawn = rows.select(F.col(name).cast("string").alias("stem"), F.col(class_name).cast("string").alias("folder"), whole.alias("image"))
    return drawn.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
