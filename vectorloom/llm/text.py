"""Helpers shared by the text operators: Arrow text columns, word hashes, column conventions.

Words are runs of bytes other than space and U+0009..U+000D everywhere. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.sources import table

CHUNK_BYTES = 4 << 20  # numpy work arrays are about ten times this size
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def crc_remainder_of(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def fresh(names, stem: str) -> str:
    """A column name that `names` does not hold yet, whatever the case."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its len + 1 offsets into them, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes, one row at least."""
    raw, offsets = text_buffers(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(rows, max(end, first + 1))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def worker_cache() -> dict:
    """What this process keeps between tasks. Task code travels by value, so its globals do not stay."""
    return sys.modules.setdefault("_vectorloom_cache", ModuleType("_vectorloom_cache")).__dict__


def powers(base: int, count: int) -> np.ndarray:
    kept = worker_cache()
    if len(kept.get(base, ())) < count:
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        kept[base] = np.multiply.accumulate(steps)
    return kept[base][:count]


def lowered(raw: np.ndarray) -> np.ndarray:
    """ASCII capitals to small letters, all else as it is."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per row the index of its first word (len + 1 values)."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    edges = edges[edges > 0] - 1
    ends[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_KEYS[raw] * powers(BASE, len(raw)), out=sums[1:])
        inner = (sums[ends] - sums[starts]) * powers(INVERSE, len(raw) + 1)[starts]
        return mix(inner + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive word hashes."""
    count = max(0, len(words) - size + 1)
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total += words[k : k + count] * np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1 | 1)
    return mix(total)
