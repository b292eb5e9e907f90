"""Alignment of the tokens that two tokenizers cut from the same text.

Side A is a byte-level vocabulary over a space and the text, side B a piece vocabulary over the text, to which it
adds the space itself. Both cut the same bytes, so a token is a byte range. Per batch of texts `pandas.merge_asof`,
keyed by document, finds for every token start the token of the other side that covers it. Two ranges overlap
if and only if the start of one lies in the other, so the union of both directions is all links; ends that both sides share cut
the tokens into groups.

Texts are encoded once. A text's distinct id pairs with their numbers are written as a compact table; how many
documents hold a pair is added up in Spark. Counts of the most frequent pairs are broadcast, at most `MAX_HOT` of
them; rarer pairs, if there are more, meet their counts in a join.

Defined results: a null or empty text, or one that either side does not give back byte for byte, has no tokens:
zeros and empty groups. Very long texts are encoded whole, a chunk holding one text at least. Equal rows have equal
results each and count as one document each. An empty table gives an empty result. Kept columns that clash with a
result column get a leading underscore.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.text import chunks, fresh, worker_cache
from vectorloom.operators.sizing import settle_as_table
from vectorloom.session import scratch_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 1 << 19
MAX_HOT = 2_000_000  # broadcast pairs, 16 bytes each
PARTIAL_PAIRS = 1 << 20  # distinct pairs a task holds before it hands their counts on
SPACE = "▁"
# Fixed by the byte-level vocabulary: how it cuts a text before it merges.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


# ---- the two sides -------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in byte-level entries: printable ones are themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """Ids of texts, and the bytes and the length in bytes of each id."""

    pieces: list[bytes]

    def finish(self) -> None:
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        digits = [str(i).encode() for i in range(len(self.pieces))]
        self.width = max(map(len, digits), default=0) + 1
        padded = b"".join(d.ljust(self.width, b"\0") for d in digits)
        self.digits = np.frombuffer(padded, np.uint8).reshape(-1, self.width)
        self.n_digits = np.array([len(d) for d in digits], np.int64)


class ByteLevel(Side):
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            named = json.load(file)
        special = {t["id"] for t in named.get("added_tokens", ())}
        alphabet = byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in named["model"]["vocab"].items() if i not in special}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.encoder = tiktoken.Encoding("byte-level", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self.finish()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoder.encode_ordinary(" " + text) if text else [] for text in texts]


class Pieces(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.encoder.id_to_piece(i) for i in range(self.encoder.get_piece_size())]
        byte = [self.encoder.is_byte(i) for i in range(len(names))]
        self.pieces = [bytes([int(n[3:5], 16)]) if b else n.replace(SPACE, " ").encode() for n, b in zip(names, byte)]
        self.finish()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encoder.encode(texts, num_threads=1)


def sides(paths: tuple[str, str]) -> tuple[Side, Side]:
    """One pair of tokenizers per worker process."""
    kept = worker_cache()
    if ("sides", paths) not in kept:
        kept["sides", paths] = ByteLevel(paths[0]), Pieces(paths[1])
    return kept["sides", paths]


# ---- one batch -----------------------------------------------------------------------------------


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(i) for i in ids], np.int64)
    return np.fromiter((i for one in ids for i in one), np.int64, int(counts.sum())), counts


def given_back(side: Side, ids: list[list[int]], raw: list[bytes]) -> list[bool]:
    find = side.pieces.__getitem__
    return [b"".join(map(find, i)) == r for i, r in zip(ids, raw)]


class Aligned:
    """Token ids of a batch of texts, their documents, links and groups."""

    def __init__(self, a: Side, b: Side, texts: Sequence[str | None]):
        texts = [t or "" for t in texts]
        raw = [b" " + t.encode() if t else b"" for t in texts]
        ids_a, ids_b = a.encode(texts), b.encode(texts)
        same = [x and y for x, y in zip(given_back(a, ids_a, raw), given_back(b, ids_b, raw))]
        ids_a, ids_b = ([i if s else [] for i, s in zip(ids, same)] for ids in (ids_a, ids_b))
        self.sides, self.rows = (a, b), len(texts)
        self.a, self.n_a = flat(ids_a)
        self.b, self.n_b = flat(ids_b)
        docs = np.arange(self.rows)
        self.doc_a, self.doc_b = np.repeat(docs, self.n_a), np.repeat(docs, self.n_b)
        # Both sides give the same bytes in every document, so places in the joined bytes agree.
        self.end_a, self.end_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        self.start_a, self.start_b = self.end_a - a.lengths[self.a], self.end_b - b.lengths[self.b]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the tokens of all links, of side A and of side B."""
        left = pd.DataFrame({"doc": self.doc_a, "start": self.start_a, "at_a": np.arange(len(self.a))})
        right = pd.DataFrame({"doc": self.doc_b, "start": self.start_b, "at_b": np.arange(len(self.b))})
        if not len(left):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        covered = pd.merge_asof(left, right, on="start", by="doc")
        covering = pd.merge_asof(right, left.assign(begin=left["start"]), on="start", by="doc")
        covering = covering[covering["begin"] != covering["start"]]  # equal starts are in `covered` already
        both = [np.concatenate([covered[c], covering[c]]).astype(np.int64) for c in ("at_a", "at_b")]
        return both[0], both[1]

    def groups(self) -> tuple[np.ndarray, list[bytes]]:
        """Number of groups per document, and the groups as text."""
        last_a = np.isin(self.end_a, self.end_b, assume_unique=True)
        last_b = np.isin(self.end_b, self.end_a, assume_unique=True)
        counts = np.bincount(self.doc_a[last_a], minlength=self.rows)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        place_a = np.arange(len(self.a)) + np.concatenate([[0], ends_b])[group_a]
        place_b = np.arange(len(self.b)) + ends_a[group_b]
        width = max(s.width for s in self.sides)
        out = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        for side, ids, place, last, close in (
            (self.sides[0], self.a, place_a, last_a, b"|"),
            (self.sides[1], self.b, place_b, last_b, b";"),
        ):
            text = np.zeros((len(ids), width), np.uint8)
            text[:, : side.width] = side.digits[ids]
            text[np.arange(len(ids)), side.n_digits[ids]] = np.where(last, close[0], ord(","))
            out[place] = text
        sizes = np.count_nonzero(out, axis=1)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        joined = out[out != 0].tobytes()
        return counts, [joined[i:j][:-1] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def pair_key(a, b, size_b: int):
    return a * size_b + b


def pack(values: np.ndarray) -> bytes:
    """Ascending longs as steps, byte plane by byte plane, which compress well."""
    return np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def pairs_of(batch: Aligned, at_a: np.ndarray, at_b: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Per document its distinct id pairs, packed, and how many links have each."""
    keys = pair_key(batch.a[at_a], batch.b[at_b], len(batch.sides[1].pieces))
    docs = batch.doc_a[at_a]
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    firsts = np.flatnonzero(new)
    times = np.diff(np.append(firsts, len(keys))).astype("<u4")
    keys, bounds = keys[firsts], np.searchsorted(docs[firsts], np.arange(batch.rows + 1))
    planes = lambda t: t.view(np.uint8).reshape(-1, 4).T.tobytes()
    return [(pack(keys[i:j]), planes(times[i:j])) for i, j in zip(bounds[:-1], bounds[1:])]


def times_of(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


# ---- over a table --------------------------------------------------------------------------------


def encoded(rows: DataFrame, keep: Sequence[str], text: str, paths: tuple[str, str], groups: bool) -> DataFrame:
    """`keep` of each row, its counts, its groups (their digest unless `groups`) and its packed pairs."""
    taken = [*RESULTS, "row", "pairs", "times"]
    names: list[str] = []
    for column in keep:
        names.append(fresh([*taken, *names], column))
    narrow = rows.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("_content"))
    shown = "groups" if groups else "groups_sha256"
    fields = [f"`{n}` {narrow.schema[n].dataType.simpleString()}" for n in names]
    schema = ", ".join([*fields, "n_a long, n_b long, n_groups long, n_links long", f"{shown} string, pairs binary, times binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(paths)
        for batch in batches:
            texts = batch.column(len(names))
            for first, end, _, _ in chunks(texts, CHUNK_BYTES):
                one = Aligned(a, b, texts.slice(first, end - first).to_pylist())
                at_a, at_b = one.links()
                n_groups, shown_groups = one.groups()
                if not groups:
                    shown_groups = [hashlib.sha256(g).hexdigest().encode() if g else b"" for g in shown_groups]
                pairs = pairs_of(one, at_a, at_b)
                n_links = np.bincount(one.doc_a[at_a], minlength=one.rows)
                counts = [pa.array(c, pa.int64()) for c in (one.n_a, one.n_b, n_groups, n_links)]
                held = [batch.column(i).slice(first, end - first) for i in range(len(names))]
                rest = [pa.array([g.decode() for g in shown_groups], pa.string())]
                rest += [pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*held, *counts, *rest], [*names, "n_a", "n_b", "n_groups", "n_links", shown, "pairs", "times"]
                )

    return narrow.mapInArrow(run, schema)


def document_counts(table: DataFrame, size_b: int) -> DataFrame:
    """(a, pair, n): in how many documents a pair of ids is linked. Added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = np.empty(0, np.int64), np.empty(0, np.int64), []

        def merged():
            seen, place = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
            weights = np.concatenate([counts, np.ones(sum(map(len, waiting)), np.int64)])
            total = np.zeros(len(seen), np.int64)
            np.add.at(total, place, weights)
            return seen, total

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                waiting.append(unpack(raw))
                if sum(map(len, waiting[-64:])) and len(waiting) % 64 == 0 and sum(map(len, waiting)) > PARTIAL_PAIRS:
                    keys, counts = merged()
                    waiting = []
                    if len(keys) > PARTIAL_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    partial = table.select("pairs").mapInArrow(run, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n")).select((F.floor(F.col("pair") / size_b)).alias("a"), "pair", "n")


def hot_cut(counts: DataFrame, limit: int) -> int:
    """The least power of two such that at most `limit` pairs have that count or more."""
    scale = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("scale")).agg(F.count(F.lit(1)).alias("pairs"))
    total, cut = 0, 1
    for row in scale.orderBy(F.desc("scale")).collect():
        total += row["pairs"]
        if total > limit:
            return 1 << (row["scale"] + 1)
        cut = 1 << row["scale"]
    return cut if total else 1


def align(
    rows: DataFrame,
    keep: Sequence[str],
    text: str = "text",
    paths: tuple[str, str] | None = None,
    groups: bool = True,
    max_hot: int = MAX_HOT,
) -> DataFrame:
    """`keep` with the results of each row: `groups` as text, or only `groups_sha256` if `groups` is false."""
    spark = rows.sparkSession
    paths = paths or default_paths()
    size_b = len(sides(paths)[1].pieces)
    table = encoded(rows, keep, text, paths, groups).withColumn("row", F.monotonically_increasing_id())
    place = scratch_path(spark, "aligned")
    table.write.option("compression", "zstd").parquet(place)
    table = spark.read.schema(table.schema).parquet(place)
    counts = settle_as_table(document_counts(table, size_b), "pair-counts")
    cut = hot_cut(counts, max_hot)
    best = counts.groupBy("a").agg(F.max("n").alias("best")).toPandas()  # one row per id of side A
    bests = np.zeros(len(sides(paths)[0].pieces), np.int64)
    bests[best["a"]] = best["best"]
    hot = counts.where(F.col("n") >= cut).select("pair", "n").toPandas().sort_values("pair")
    held = spark.sparkContext.broadcast((hot["pair"].to_numpy(), hot["n"].to_numpy(), bests))
    names = [c for c in table.columns if c not in ("pairs", "times", "row")]
    fields = [f"`{n}` {table.schema[n].dataType.simpleString()}" for n in [*names, "row"]]

    def known(raw_pairs: bytes, raw_times: bytes):
        keys, numbers, top = held.value
        pairs, times = unpack(raw_pairs), times_of(raw_times)
        at = np.searchsorted(keys, pairs)
        found = np.zeros(len(pairs), bool)
        inside = at < len(keys)
        found[inside] = keys[at[inside]] == pairs[inside]
        n = numbers[at[found]]
        is_best = n == top[pairs[found] // size_b]
        return int(times[found][is_best].sum()), int((times[found] * n).sum()), pairs[~found], times[~found]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [known(p, t)[:2] for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist())]
            sums = [pa.array([e[k] for e in each], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in [*names, "row"]], *sums], [*names, "row", "n_best", "count_sum"])

    def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, p, t in zip(*(batch.column(c).to_pylist() for c in ("row", "pairs", "times"))):
                _, _, pairs, times = known(p, t)
                if len(pairs):
                    ids = np.full(len(pairs), row, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pairs), pa.array(times)], ["row", "pair", "times"])

    done = table.mapInArrow(scored, ", ".join([*fields, "n_best long", "count_sum long"]))
    if cut > 1:
        rare = counts.where(F.col("n") < cut)
        rare = rare.join(spark.createDataFrame(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
        rest = table.select("row", "pairs", "times").mapInArrow(left_over, "row long, pair long, times long").join(rare, "pair")
        rest = rest.groupBy("row").agg(
            F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("_best"),
            F.sum(F.col("times") * F.col("n")).alias("_sum"),
        )
        done = done.join(rest, "row", "left")
        done = done.withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0)))
        done = done.withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return done.select(*names, "n_best", "count_sum")
