"""Cost-balanced packing of token documents into sequences of bounded length.

Attention costs `LINEAR` per token and `QUADRATIC` per pair of tokens of one document. Within a pack of
about `PACK_TOKENS` tokens, documents in descending cost go to the sequence that costs least so far
among those with room; one that fits nowhere whole is cut. Room and tokens of a pack are equal: full
sequences first, and for the rest sequences whose lengths are powers of two, so that nothing is padded.

A pack is what one task holds at a time: rows are read as they come, no key is shuffled, and a hot
source or a group of copies changes nothing. Sequence ids carry the partition, so a repeated task
gives the same ones.

Defined results: a null text is the empty text, whose document is the end id alone; rows with equal
id are packed on their own each; an empty table gives no rows. The result has no columns of the input
but the id, so names cannot clash.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vectorloom.llm import subwords
from vectorloom.llm.text import give_back, text_of

SEQUENCE = 4096
PACK_TOKENS = 1 << 20
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def capacities(tokens: int, limit: int = SEQUENCE) -> list[int]:
    """Lengths of the sequences for `tokens` tokens: full ones, then powers of two."""
    rest = tokens % limit
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [limit] * (tokens // limit) + tail


def pack(lengths: list[int], limit: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents given by their lengths."""
    pieces: list[tuple[int, int, int, int, int]] = []
    todo: list[tuple[int, int, int]] = []
    sequences = 0
    for document, length in enumerate(lengths):
        whole = length // limit
        for k in range(whole):  # what fills sequences on its own
            pieces.append((document, k * limit, limit, sequences, 0))
            sequences += 1
        if length % limit:
            todo.append((length % limit, document, whole * limit))
    room = capacities(sum(piece[0] for piece in todo), limit)
    load = [0] * len(room)
    todo.sort(key=lambda piece: (-cost(piece[0]), piece[1]))
    open_now = [(0.0, s) for s in range(len(room))]
    heapq.heapify(open_now)
    cut: list[tuple[int, int, int]] = []

    def place(length: int, document: int, start: int, spent: float, s: int) -> None:
        pieces.append((document, start, length, sequences + s, load[s]))
        load[s] += length
        if load[s] < room[s]:
            heapq.heappush(open_now, (spent + cost(length), s))

    for length, document, start in todo:
        passed = []
        while open_now and room[open_now[0][1]] - load[open_now[0][1]] < length:
            passed.append(heapq.heappop(open_now))
        if open_now:
            spent, s = heapq.heappop(open_now)
            place(length, document, start, spent, s)
        else:
            cut.append((length, document, start))
        for entry in passed:
            heapq.heappush(open_now, entry)
    for length, document, start in cut:
        while length:
            spent, s = heapq.heappop(open_now)
            part = min(length, room[s] - load[s])
            place(part, document, start, spent, s)
            length, start = length - part, start + part
    return pieces


def packed(ids: list[bytes], names: list, first: int, limit: int) -> tuple[list[list], int]:
    """Result columns for the documents `ids`, sequences counted from `first`."""
    columns: list[list] = [[] for _ in range(1 + len(FIELDS))]
    last = -1
    for document, start, length, sequence, offset in pack([len(raw) // 4 for raw in ids], limit):
        raw = ids[document]
        piece = zlib.crc32(memoryview(raw)[4 * start : 4 * (start + length)])
        row = (names[document], start, length, piece, len(raw) // 4, first + sequence, offset)
        for column, value in zip(columns, row):
            column.append(value)
        last = max(last, sequence)
    return columns, first + last + 1


def pack_documents(
    rows: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    limit: int = SEQUENCE,
    pack_tokens: int = PACK_TOKENS,
) -> DataFrame:
    """One row per piece: the id, and `FIELDS`; `offset` counts from 0 in each sequence without a gap."""
    path = tokenizer or subwords.default_path()
    end = np.asarray([subwords.END], "<u4").tobytes()
    schema = StructType(
        [rows.schema[id_column], *[StructField(name, LongType(), False) for name in FIELDS]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = subwords.encoder(path).encode
        sequence = TaskContext.get().partitionId() << 40
        held: list[bytes] = []
        names: list = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, names, tokens, sequence
            columns, sequence = packed(held, names, sequence, limit)
            held, names, tokens = [], [], 0
            arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            return pa.RecordBatch.from_arrays(arrays, [id_column, *FIELDS])

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, raw in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    held.append(raw + end)
                    names.append(name)
                    tokens += len(raw) // 4 + 1
                if tokens >= pack_tokens:
                    yield flush()
        if held:
            yield flush()
        give_back()

    return rows.select(id_column, text_of(text).alias("text")).mapInArrow(run, schema)


def balance(pieces: DataFrame) -> DataFrame:
    """Tokens and estimated cost per sequence, to look at how even they are."""
    length = F.col("length").cast("double")
    spent = F.sum(F.lit(LINEAR) * length + F.lit(QUADRATIC) * length * length)
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), spent.alias("cost"))
