"""Reader for `.npy` matrices as a Spark data source (`format("npy")`).

A file is cut into byte ranges like a text file, so one huge matrix is read by many tasks and no
task, and not the driver either, ever holds a whole file. Each row keeps its file and its position
in it: rows are matched with other data by key, never by the order in which they arrive.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from numpy.lib import format as npy_format
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    LongType,
    StringType,
    StructField,
    StructType,
)

SPLIT_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
HEADER_BYTES = 64 * 1024


def _open_filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _list_npy(path: str) -> list[tuple[str, int]]:
    filesystem, inner = _open_filesystem(path)
    info = filesystem.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(inner, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = filesystem.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".npy"))


@dataclass
class _Header:
    rows: int
    width: int
    by_column: bool
    dtype: np.dtype
    offset: int


def _read_header(stream) -> _Header:
    stream.seek(0)
    head = io.BytesIO(stream.read(HEADER_BYTES))
    version = npy_format.read_magic(head)
    reader = npy_format.read_array_header_1_0 if version == (1, 0) else npy_format.read_array_header_2_0
    shape, by_column, dtype = reader(head)
    if len(shape) != 2:
        raise ValueError(f"expected a two-dimensional matrix, found shape {shape}")
    if dtype.hasobject or dtype.kind not in "fiub":
        raise ValueError(f"expected a numeric matrix, found dtype {dtype}")
    return _Header(shape[0], shape[1], by_column, dtype, head.tell())


@dataclass
class _Range(InputPartition):
    path: str
    inner: str
    start: int
    end: int


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, element: type):
        self.path, self.split_bytes, self.element = path, split_bytes, element

    def partitions(self) -> list[InputPartition]:
        return [
            _Range(self.path, inner, start, min(start + self.split_bytes, size))
            for inner, size in _list_npy(self.path)
            for start in range(0, size, self.split_bytes)
        ]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _open_filesystem(partition.path)
        with filesystem.open_input_file(partition.inner) as stream:
            header = _read_header(stream)
            stride = header.width * header.dtype.itemsize
            if header.rows == 0 or stride == 0:
                return

            # A row belongs to the range in which its share of the file begins.
            def first_row_from(position: int) -> int:
                return min(max(-(-(position - header.offset) // stride), 0), header.rows)

            begin, end = first_row_from(partition.start), first_row_from(partition.end)
            step = max(BATCH_BYTES // stride, 1)
            for low in range(begin, end, step):
                high = min(low + step, end)
                yield self._batch(partition.inner, low, self._rows(stream, header, low, high))

    def _rows(self, stream, header: _Header, low: int, high: int) -> np.ndarray:
        size = header.dtype.itemsize
        if not header.by_column:
            stream.seek(header.offset + low * header.width * size)
            data = stream.read((high - low) * header.width * size)
            return np.frombuffer(data, header.dtype).reshape(high - low, header.width)
        columns = []
        for column in range(header.width):
            stream.seek(header.offset + (column * header.rows + low) * size)
            columns.append(np.frombuffer(stream.read((high - low) * size), header.dtype))
        return np.stack(columns, axis=1)

    def _batch(self, inner: str, low: int, rows: np.ndarray) -> pa.RecordBatch:
        count, width = rows.shape
        if rows.dtype.kind in "iu" and rows.size:
            limit = 2**63 - 1 if self.element is np.int64 else 2**53
            if int(rows.max()) > limit or int(rows.min()) < -limit - 1:
                raise ValueError(f"{inner} holds whole numbers that {np.dtype(self.element)} cannot keep")
        values = pa.array(np.ascontiguousarray(rows, dtype=self.element).ravel())
        offsets = pa.array(np.arange(count + 1, dtype=np.int32) * width)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([inner] * count, pa.string()),
                pa.array(np.arange(low, low + count, dtype=np.int64)),
                pa.ListArray.from_arrays(offsets, values),
            ],
            names=["path", "row_index", "features"],
        )


ELEMENTS = {"float": np.float32, "long": np.int64, "double": np.float64}


def _common_element(widths: set[int], kinds: set[tuple[str, int]]) -> str:
    """The narrowest of float, long and double that holds the elements of every file."""
    if len(widths) > 1:
        raise ValueError(f"files of different width: {sorted(widths)}")
    letters, largest = {kind for kind, _ in kinds}, max(size for _, size in kinds)
    if letters <= set("iub") and largest == 8:
        return "long"  # double would round them
    return "float" if letters == {"f"} and largest <= 4 else "double"


class NpyMatrixSource(DataSource):
    """`spark.read.format("npy").load(path)` → `path`, `row_index`, `features`.

    `path` is a file or a folder of `.npy` files. Elements are `float` if all files hold
    single (or half) precision numbers, `long` if all hold whole numbers and some of them 64-bit ones, and `double` otherwise; files of
    different width are an error. Option `splitBytes` sets the range
    size. Option `element` (float, long, double) saves reading the headers while the query is planned.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _element(self) -> type:
        """As told by `read_npy`; else from the headers of all files, which are read one by one."""
        if "element" in self.options:
            return ELEMENTS[self.options["element"]]
        files = _list_npy(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no .npy file below {self.options['path']}")
        filesystem, _ = _open_filesystem(self.options["path"])
        headers = []
        for inner, _ in files:
            with filesystem.open_input_file(inner) as stream:
                headers.append(_read_header(stream))
        widths = {h.width for h in headers}
        return ELEMENTS[_common_element(widths, {(h.dtype.kind, h.dtype.itemsize) for h in headers})]

    def schema(self) -> StructType:
        element = {np.float32: FloatType(), np.int64: LongType(), np.float64: DoubleType()}[self._element()]
        return StructType(
            [
                StructField("path", StringType()),
                StructField("row_index", LongType()),
                StructField("features", ArrayType(element)),
            ]
        )

    def reader(self, schema: StructType) -> DataSourceReader:
        element = schema["features"].dataType.elementType
        return _NpyReader(
            self.options["path"],
            int(self.options.get("splitBytes", SPLIT_BYTES)),
            {FloatType: np.float32, LongType: np.int64}.get(type(element), np.float64),
        )


def npy_manifest(spark: SparkSession, path: str, files_per_task: int = 200) -> DataFrame:
    """What the headers of the files below `path` say, read by tasks: `path`, `bytes`, `rows`, `width`, `kind`,
    `item_bytes`, `by_column`, `offset` of the first element."""
    files = _list_npy(path)
    if not files:
        raise FileNotFoundError(f"no .npy file below {path}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _open_filesystem(path)
        for batch in batches:
            held = []
            for inner, size in zip(*(c.to_pylist() for c in batch.columns)):
                with filesystem.open_input_file(inner) as stream:
                    h = _read_header(stream)
                held.append((inner, size, h.rows, h.width, h.dtype.kind, h.dtype.itemsize, h.by_column, h.offset))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], MANIFEST_NAMES)

    listed = spark.createDataFrame(files, "path string, bytes long")
    return listed.repartition(-(-len(files) // files_per_task)).mapInArrow(run, MANIFEST)


MANIFEST_NAMES = ["path", "bytes", "rows", "width", "kind", "item_bytes", "by_column", "offset"]
MANIFEST = "path string, bytes long, rows long, width long, kind string, item_bytes long, by_column boolean, offset long"


def read_npy(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of all files; a first stage reads the headers, and few distinct layouts reach the driver."""
    layouts = npy_manifest(spark, path).select("width", "kind", "item_bytes").distinct().limit(1000).collect()
    element = _common_element({r["width"] for r in layouts}, {(r["kind"], r["item_bytes"]) for r in layouts})
    spark.dataSource.register(NpyMatrixSource)
    return spark.read.format("npy").option("splitBytes", split_bytes).option("element", element).load(path)


def write_npy(rows: DataFrame, features: str, folder: str, dtype: str = "<f4", shard_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write a column of equally long arrays as `.npy` shards below `folder`; one row (path, rows) per shard.

    Shards are named by partition, so a repeated task replaces its own. A null array or element and arrays of
    different length are errors. Write each folder once: shards of an earlier, longer table are not removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _open_filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        part, count = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            matrix = np.concatenate(held)
            name = f"part-{part:05d}-{count:05d}.npy"
            with filesystem.open_output_stream(f"{root}/{name}") as sink:
                head = {"descr": npy_format.dtype_to_descr(matrix.dtype), "fortran_order": False, "shape": matrix.shape}
                npy_format.write_array_header_1_0(sink, head)
                sink.write(matrix.tobytes())
            held.clear()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "rows": [len(matrix)]})

        for batch in batches:
            column = batch.column(0)
            values = column.flatten()
            if column.null_count or values.null_count:
                raise ValueError("a matrix has no nulls")
            if not len(column):
                continue
            width = len(values) // len(column)
            lengths = np.diff(column.offsets.to_numpy())
            if (lengths != width).any() or held and held[0].shape[1] != width:
                raise ValueError("rows of different length")
            held.append(values.to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), width))
            if sum(m.nbytes for m in held) >= shard_bytes:
                yield flush()
                count += 1
        if held:
            yield flush()

    return rows.select(features).mapInArrow(run, "path string, rows long")
