"""Similarity self-join of documents on word n-grams, by T-occurrence search with DivideSkip.

A document is the set of its distinct word n-grams. Documents with equal sets are one class; the join runs
over classes. Two classes link when their Jaccard similarity reaches the threshold.

How all links are found without comparing all pairs:

* N-grams have one global order: rare ones by hash, then those that are frequent in the whole corpus. A
  set keeps as many leading n-grams (`prefix`) that two sets which link must share one. These short inverted
  lists are built by a shuffle on the n-gram; lists of one class are dropped.
* A list does not emit its pairs. Some classes of a list, its hubs, search the others of that list: blocks
  of candidates get a local inverted index of the hub's n-grams, whose short lists are merged and whose long
  lists are probed by binary search (`divide_skip`).
* Links make components, and within one no further comparison is needed. Near copies share many n-grams, so the
  first turn finds most components from one list in `FIRST` with one hub each. In the second turn every list has as hubs the
  classes outside its largest component, which completes it; a long list has only a bounded number of them. It stays for
  further turns, each with `MORE` times as many hubs, and is completed when few enough of its classes are outside. Hubs search
  other components only. So no link between components is missed, a turn costs in proportion to the lists, and a group of
  thousands of near copies is not compared pair by pair.
* From the third turn on, two classes that share several long lists meet in the first one only, as far as the first
  `EARLY` long lists of both tell. In the first n-gram of all that two sets share, they always meet.
* Pairs whose sizes, places of the n-gram or 256-bit parity maps already rule out the threshold are dropped within the join.

* With the components known, all links are inside them. The classes of a component are dealt into blocks, every
  pair of blocks is one task, and in it each class looks up its n-grams in the inverted lists of the other block.
  It gives the number of links of each class (`join`), or the links themselves (`links`).

Components are found by hooking each class to its smallest neighbour and contracting the links.

Defined results: a null text has no n-grams; sets without n-grams link with nothing; rows with equal
ids are kept each, and the smallest id of a component names it; rows with a null id are kept, and name their
component only if it has no other id; an empty table gives no rows. Only the id and text columns are read, so
other columns cannot clash. N-grams are compared by 64-bit hashes, sets by 64-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.text import WORD, chunks, give_back, lowered, span_hashes, text_of, window_hashes, word_bounds
from vectorloom.operators.sizing import settle_as_table

CHUNK_BYTES = 1 << 19
HOT = 16  # an n-gram in so many rows is frequent; raised until the frequent ones fit `MAX_HOT`
MAX_HOT = 1_000_000  # n-grams broadcast as frequent, 8 bytes each
SCOUT = 0.30  # share of a set whose n-grams are counted to find the frequent ones
BLOCK_GRAMS = 400_000  # n-grams of the candidates that one search block holds, about
FIRST = 8  # the first turn takes one list of so many, a power of two; the later ones take all
SHORT_LIST = 64  # so many classes outside its largest component search a list in the second turn
HUBS = 16  # of more than that, so many
MORE = 8  # both limits grow by this factor with every further turn
EARLY = 8  # long lists of a class that tell where a pair meets first
LINK_BLOCK = 512  # classes of a component in one block, about
SALTS = 64
MAP_BITS = 1 << 26  # 8 MB
BITS = ("b0", "b1", "b2", "b3")
SPREAD = 4.0  # DivideSkip's weight of a long list


@dataclass(frozen=True)
class Spec:
    size: int = 4
    num: int = 85  # similarity threshold as a fraction num / den
    den: int = 100

    def prefix(self, n: int) -> int:
        """Leading n-grams of a set of `n` among which every set that links must share one."""
        return n - -(-self.num * n // self.den) + 1


# ---- sets ----------------------------------------------------------------------------------------


def gram_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    for _, _, raw, offsets in chunks(column, CHUNK_BYTES):
        raw = lowered(raw)
        starts, ends, bounds = word_bounds(raw, offsets)
        words = span_hashes(raw, starts, ends)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            width = min(size, b - a)
            yield np.unique(window_hashes(words[a:b], width)) if width else np.empty(0, np.uint64)
    give_back()


def digest(grams: np.ndarray) -> int:
    raw = hashlib.blake2b(grams.tobytes(), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)


def keyed_sets(rows: DataFrame, id_column: str, text: str, spec: Spec) -> DataFrame:
    """(id, mark, n, node, b0..b3, scout) per row: hash of the text, size, digest and parity map of its set, and the n-grams
    of smallest hash in it, `SCOUT` of the set; node is null without n-grams."""
    kind = rows.schema[id_column].dataType.simpleString()
    size = spec.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts, nodes, scouts, bits = [], [], [], np.zeros((part.num_rows, len(BITS)), np.int64)
                for k, grams in enumerate(gram_sets(part.column(2), size)):
                    counts.append(len(grams))
                    nodes.append(digest(grams) if len(grams) else None)
                    scouts.append(grams[: int(SCOUT * len(grams)) + 2].copy())
                    bits[k] = parity(grams)
                offsets = np.cumsum([0, *map(len, scouts)]).astype(np.int32)
                scout = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(scouts).view(np.int64)))
                arrays = [*part.columns[:2], pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), *map(pa.array, bits.T.copy()), scout]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "mark", "n", "node", *BITS, "scout"])

    schema = ", ".join([f"id {kind}, mark long, n long, node long", *[f"{b} long" for b in BITS], "scout array<long>"])
    texts = rows.select(F.col(id_column).alias("id"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).alias("text"))
    return texts.mapInArrow(run, schema)


def parity(grams: np.ndarray) -> np.ndarray:
    """Per bit of a 256-bit map: whether an odd number of n-grams falls on it."""
    odd = np.bincount((grams >> np.uint64(20)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def frequent(keys: DataFrame) -> np.ndarray:
    """Frequent n-grams, sorted, from the column `scout`; which ones are does not affect the result, only the length of lists.

    All rows are counted. What comes to the driver is bounded by `MAX_HOT`: the limit doubles until it fits.
    """
    counts = keys.select(F.explode("scout").alias("gram")).groupBy("gram").count().where(F.col("count") >= HOT)
    counts = settle_as_table(counts, "grams")
    level = F.floor(F.log2(F.col("count") / HOT)).cast("int")
    by_level = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = 0
    while sum(n for k, n in by_level.items() if k >= least) > MAX_HOT:
        least += 1
    kept = counts.where(F.col("count") >= HOT * 2**least).select("gram").toPandas()["gram"]
    return np.sort(kept.to_numpy(np.int64).view(np.uint64))


def ordered(grams: np.ndarray, hot: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """The first `count` n-grams in the global order, rare by hash, then frequent by hash; how many are rare."""
    if not len(hot):
        return grams[:count], count
    place = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
    late = hot[place] == grams
    rare = grams[~late][:count]
    return np.concatenate([rare, grams[late][: count - len(rare)]]), len(rare)


def postings(rows: DataFrame, text: str, spec: Spec, hot) -> DataFrame:
    """(gram, salt, at, node) for the prefix of each row's set; `hot` is a broadcast variable.

    `at` is the place in the order of the set. `salt` is 0 for rare n-grams; the postings of a frequent one are spread over 1 to `SALTS`.
    """
    size = spec.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts, nodes):
            lengths = [len(p) for p, _ in parts]
            owner = np.repeat(np.array(nodes, np.int64), lengths)
            rare = np.concatenate([np.arange(len(p)) < r for p, r in parts])
            salt = np.where(rare, 0, 1 + (owner & (SALTS - 1))).astype(np.int32)
            grams = np.concatenate([p for p, _ in parts]).view(np.int64)
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            arrays = [pa.array(grams), pa.array(salt), pa.array(at), pa.array(owner)]
            return pa.RecordBatch.from_arrays(arrays, ["gram", "salt", "at", "node"])

        for batch in batches:
            parts, nodes = [], []
            for grams in gram_sets(batch.column(0), size):
                if len(grams):
                    parts.append(ordered(grams, hot.value, spec.prefix(len(grams))))
                    nodes.append(digest(grams))
                if len(parts) == 512:
                    yield flush(parts, nodes)
                    parts, nodes = [], []
            if parts:
                yield flush(parts, nodes)

    return rows.select(text_of(text).alias("text")).mapInArrow(run, "gram long, salt int, at int, node long")


def shared_lists(lists: DataFrame) -> DataFrame:
    """(gram, at, node): the inverted lists that more than one class is in, shuffled once.

    A rare n-gram's list is in one partition; lists of frequent ones, in many, are kept as they are.
    """
    dealt = lists.repartition("gram", "salt")
    per = dealt.groupBy("gram", "salt").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min("at").alias("first"))
    # With `at` both sides read the same columns, and so the same shuffle.
    per = per.where((F.col("first") >= 0) & ((F.col("salt") > 0) | (F.col("low") != F.col("high")))).select("gram", "salt")
    return dealt.join(per, ["gram", "salt"]).select("gram", "at", "node").distinct()


def mark(id_column: str) -> Column:
    """Bit of an id in the map that `set_table` looks into."""
    crc = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    return crc.bitwiseAND(F.lit(MAP_BITS - 1)).alias("mark")


def bit_map(marks: DataFrame) -> np.ndarray:
    """A map of `MAP_BITS` bits with those of the column `mark` set; at most 2^20 rows reach the driver."""
    bit = F.expr("shiftleft(1L, cast(mark & 63 as int))")
    words = marks.groupBy(F.shiftright("mark", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def set_table(rows: DataFrame, text: str, spec: Spec, wanted: DataFrame, id_column: str) -> DataFrame:
    """(node, grams) of the rows whose ids are in `wanted` (id).

    Ids are looked up in a bit map of fixed size, so that no text is shuffled. A few sets too many pass, and
    do no harm.
    """
    size = spec.size
    shared = rows.sparkSession.sparkContext.broadcast(bit_map(wanted.select(mark("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((shared.value[marks >> 6] >> (marks & 63) & 1).astype(bool)))
            for k in range(0, batch.num_rows, 512):
                held = [grams for grams in gram_sets(batch.column(1).slice(k, 512), size) if len(grams)]
                nodes, raw = [digest(grams) for grams in held], [grams.tobytes() for grams in held]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], ["node", "grams"])

    texts = rows.select(mark(id_column), text_of(text).alias("text"))
    return texts.mapInArrow(run, "node long, grams binary")


def may_link(spec: Spec) -> Column:
    """Whether two sets can link: by size, by place, and by the bits in which their parity maps differ.

    If the n-gram is the first that both have, what follows it must hold enough for the threshold. Each differing
    bit takes an n-gram that only one set has, and linking sets have few of those.
    """
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"hub_{b}"))) for b in BITS[1:]), F.bit_count(F.col(BITS[0]).bitwiseXOR(F.col(f"hub_{BITS[0]}"))))
    sizes = F.least("n", "hub_n") * spec.den >= F.greatest("n", "hub_n") * spec.num
    needed = (F.col("n") + F.col("hub_n")) * spec.num
    for size, at in (("n", "at"), ("hub_n", "hub_at")):
        sizes = sizes & ((F.col(size) - F.col(at)) * (spec.num + spec.den) >= needed)
    return sizes & (apart * (spec.num + spec.den) <= (F.col("n") + F.col("hub_n")) * (spec.den - spec.num))


# ---- search --------------------------------------------------------------------------------------


def divide_skip(lists: list[np.ndarray], least: int, spread: float = SPREAD) -> dict[int, int]:
    """Ids that occur in at least `least` of the sorted id `lists`, with the number of lists."""
    lengths = np.array([len(x) for x in lists], np.int64)
    if not lengths.sum():
        return {}
    ids, counts = in_many(np.concatenate(lists).astype(np.int64), lengths, least, spread)
    return dict(zip(ids.tolist(), counts.tolist()))


def in_many(flat: np.ndarray, lengths: np.ndarray, least: int, spread: float = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """`divide_skip` on lists laid end to end in `flat`: ids, ascending, and the number of lists.

    The longest lists, fewer than `least` of them, are set aside; the short ones are merged, and an id that
    occurs there often enough is looked up in the long ones by binary search.
    """
    if least <= 0 or np.count_nonzero(lengths) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    longest = int(lengths.max())
    aside = min(least - 1, int(least / (spread * np.log2(longest + 1) / 16 + 1)) if longest > 1 else 0)
    long = np.zeros(len(lengths), bool)
    if aside:
        long[np.argsort(lengths, kind="stable")[len(lengths) - aside :]] = True
    in_long = np.repeat(long, lengths)
    merged = np.sort(flat[~in_long], kind="stable")
    begins = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
    counts = np.diff(np.append(begins, len(merged)))
    ids, counts = merged[begins][counts >= least - aside].astype(np.int64), counts[counts >= least - aside]
    if aside and len(ids):
        # The long lists keep apart in one sorted array: list number first, then id.
        width = max(int(flat.max()), int(ids[-1])) + 1
        keys = np.repeat(np.arange(aside), lengths[long]) * width + flat[in_long]
        wanted = (np.arange(aside) * width)[:, None] + ids
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        counts = counts + (keys[place] == wanted).sum(axis=0)
    enough = counts >= least
    return ids[enough], counts[enough]


def overlaps(query: np.ndarray, grams: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sets laid end to end in `grams` share at least `least` n-grams with `query`, and how many."""
    small = np.uint16 if max(len(query), len(sizes)) < 1 << 16 else np.int64  # short numbers are sorted by digits
    place = np.minimum(np.searchsorted(query, grams), len(query) - 1)
    hit = query[place] == grams
    place, owner = place[hit], np.repeat(np.arange(len(sizes), dtype=small), sizes)[hit]
    order = np.argsort(place.astype(small), kind="stable")
    return in_many(owner[order], np.bincount(place, minlength=len(query)), least)


def laid_out(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a binary column end to end, and the size of each."""
    parts, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for raw in column.chunks:
        if not len(raw):
            continue
        offsets = np.frombuffer(raw.buffers()[1], np.int64 if pa.types.is_large_binary(raw.type) else np.int32)
        offsets = offsets[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        parts.append(np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64))
        sizes.append(np.diff(offsets) // 8)
    return np.concatenate(parts), np.concatenate(sizes)


def search(pairs: DataFrame, sets: DataFrame, spec: Spec) -> DataFrame:
    """Links (left, right) among the pairs (hub, node, n): each hub searches its candidates.

    The candidates of a hub are cut into blocks by size, each with the hub's set.
    """
    num, den = spec.num, spec.den
    blocks = pairs.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("blocks"))
    sized = pairs.select("hub", "node").join(blocks, "hub")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    wanted = sized.select("hub", block.alias("block"), "node")
    blocks = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    wanted = wanted.unionByName(blocks.select("hub", "block", F.col("hub").alias("node")))
    both = wanted.join(sets.dropDuplicates(["node"]), "node").select("hub", "block", "node", "grams")

    def one(group: pa.Table) -> pa.Table:
        hub, names = group.column("hub")[0].as_py(), group.column("node").to_numpy()
        mine = names == hub
        query = laid_out(group.filter(pa.array(mine)).column("grams"))[0]
        grams, sizes = laid_out(group.filter(pa.array(~mine)).column("grams"))
        names = names[~mine]
        found = np.empty(0, np.int64)
        if len(names):
            found, shared = overlaps(query, grams, sizes, -(-num * len(query) // den))
            found = found[den * shared >= num * (len(query) + sizes[found] - shared)]
        return pa.table({"left": pa.array(np.full(len(found), hub, np.int64)), "right": pa.array(names[found].astype(np.int64))})

    return both.groupBy("hub", "block").applyInArrow(one, "left long, right long")


# ---- components ----------------------------------------------------------------------------------


def renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """`rows` with the values of `column` replaced as `names` (root, parent) says, where it says so."""
    found = rows.join(names, rows[column] == names["root"], "left")
    return found.withColumn(column, F.coalesce("parent", column)).drop("root", "parent")


def components(links: DataFrame, known: DataFrame | None) -> DataFrame:
    """(node, component) after adding `links` (left, right) to the `known` components; the smallest node names one.

    Each vertex goes to its smallest neighbour, chains are followed to their ends, and links are contracted
    with it, so that a dense group costs its links once.
    """
    ends = links.select(F.col("left").alias("node")).union(links.select("right")).distinct()
    nodes = ends.withColumn("component", F.col("node"))
    edges = links.select("left", "right")
    if known is not None:
        old = known.select(F.col("node").alias("root"), F.col("component").alias("parent"))
        edges = renamed(renamed(edges, "left", old), "right", old)
        nodes = known.union(nodes.join(known, "node", "left_anti"))
    nodes = settle_as_table(nodes, "nodes")
    while True:
        edges = settle_as_table(edges.where(F.col("left") != F.col("right")).distinct(), "edges")
        if edges.isEmpty():
            return nodes
        both = edges.union(edges.select("right", "left")).groupBy(F.col("left").alias("root"))
        hooks = settle_as_table(both.agg(F.least("root", F.min("right")).alias("parent")), "hooks")
        while True:
            above = hooks.select(F.col("root").alias("parent"), F.col("parent").alias("beyond"))
            jumped = hooks.join(above, "parent").select("root", F.col("beyond").alias("parent"), F.col("parent").alias("old"))
            jumped = settle_as_table(jumped, "hooks")
            hooks = jumped.drop("old")
            if jumped.where(F.col("parent") != F.col("old")).isEmpty():
                break
        nodes = settle_as_table(renamed(nodes, "component", hooks), "nodes")
        edges = renamed(renamed(edges, "left", hooks), "right", hooks)


def link_lists(lists: DataFrame, classes: DataFrame, sets_of, spec: Spec) -> tuple[DataFrame | None, DataFrame | None]:
    """Components (node, component) from the inverted `lists` (gram, at, node), with enough links to find all, and the
    sets (node, grams) of all classes that were compared.

    `classes` has (node, id, n, b0..b3); `sets_of(ids)` gives the sets of some of them. It is asked once for each class.
    """
    lists = lists.join(classes.drop("id"), "node")
    known = sets = held = None
    for turn in count():
        rows, kept = lists.withColumn("component", F.col("node")), ["node", "n", "at", "component", *BITS]
        if known is not None:
            rows = lists.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn == 0:
            rows = rows.where(F.col("gram").bitwiseAND(F.lit(FIRST - 1)) == 0)
            first = rows.groupBy("gram").agg(F.min("node").alias("first"))
            rows = rows.join(first, "gram").withColumn("is_hub", F.col("node") == F.col("first")).drop("first")
        else:
            rows = open_rows(rows, MORE ** (turn - 1))
        met_first = F.lit(True)
        if turn > 1:
            rows, met_first = with_early(rows)
            kept += ["gram", "early"]
        rows = settle_as_table(rows, "lists")
        hubs = rows.where("is_hub").select("gram", *[F.col(c).alias(f"hub_{c}".replace("hub_node", "hub")) for c in kept])
        other = (F.col("component") != F.col("hub_component")) & (~F.col("is_hub") | (F.col("hub") < F.col("node")))
        same = rows["gram"] == hubs["gram"]
        pairs = rows.join(hubs, same & other & may_link(spec) & met_first).select("hub", "node", "n").distinct()
        pairs = settle_as_table(pairs, "pairs")
        if not pairs.isEmpty():
            nodes = pairs.select("node").union(pairs.select("hub")).distinct()
            if held is not None:
                nodes = nodes.join(held, "node", "left_anti")
            nodes = settle_as_table(classes.join(nodes, "node", "left_semi").select("node", "id"), "compared")
            if not nodes.isEmpty():
                more = settle_as_table(sets_of(nodes.select("id")).join(nodes.select("node"), "node", "left_semi"), "sets")
                sets = more if sets is None else sets.unionByName(more)
                held = nodes.select("node") if held is None else held.unionByName(nodes.select("node"))
            known = components(settle_as_table(search(pairs, sets, spec), "links"), known)
        if turn > 0:
            lists = rows.where("is_long").drop("is_hub", "is_long", "component", "early")
            if lists.isEmpty():
                return known, sets


def with_early(rows: DataFrame) -> tuple[DataFrame, Column]:
    """`rows` with `early`, the first n-grams of each class in these lists, and whether a pair has not met in an earlier list.

    Two sets have the n-grams that they share in one order. So where the first that both name is another one, it is earlier.
    """
    held = F.array_sort(F.collect_list(F.struct("at", "gram")))
    early = rows.groupBy("node").agg(F.slice(held, 1, EARLY)["gram"].alias("early"))
    both = F.array_intersect("early", "hub_early")
    return rows.join(early, "node"), (F.size(both) == 0) | (F.get(both, F.lit(0)) == F.col("hub_gram"))


def open_rows(rows: DataFrame, more: int = 1) -> DataFrame:
    """The lists with several components: `rows` of these with `is_hub`, the classes outside a list's largest component,
    and `is_long`.

    Long lists, with over `more` x `SHORT_LIST` such classes, have only one hub in each of `more` x `HUBS` parts.
    """
    cells = rows.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("held"))
    largest = F.max_by("component", F.struct("held", "component"))
    per = cells.groupBy("gram").agg(largest.alias("main"), (F.sum("held") - F.max("held")).alias("outside"))
    rows = rows.join(per.where(F.col("outside") > 0), "gram").withColumn("is_hub", F.col("component") != F.col("main"))
    rows = rows.withColumn("is_long", F.col("outside") > more * SHORT_LIST).drop("main", "outside")
    rows = settle_as_table(rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(more * HUBS))), "open")
    chosen = rows.where(F.col("is_long") & F.col("is_hub")).groupBy("gram", "part").agg(F.min("node").alias("first"))
    rows = rows.join(chosen, ["gram", "part"], "left")
    hub = F.col("is_hub") & (~F.col("is_long") | (F.col("node") == F.col("first")))
    return rows.withColumn("is_hub", hub).drop("part", "first")


def block_links(left: list[np.ndarray], right: list[np.ndarray], spec: Spec, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Per set of `left`: the places in `right` of the sets that link with it; of one block with itself, later ones only."""
    sizes = np.array([len(r) for r in right])
    grams = np.concatenate(right)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], np.repeat(np.arange(len(right)), sizes)[order]
    for k, query in enumerate(left):
        begins, ends = np.searchsorted(grams, query), np.searchsorted(grams, query, "right")
        lengths = ends - begins
        at = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[at], minlength=len(right))
        found = spec.den * shared >= spec.num * (len(query) + sizes - shared)
        if same:
            found[: k + 1] = False
        yield k, np.flatnonzero(found)


def in_blocks(members: DataFrame, sets: DataFrame, spec: Spec, counts: bool) -> DataFrame:
    """(node, n_links), added up by blocks, or the links (left, right), among classes (node, id, component).

    `sets` (node, grams) holds the sets of all classes that have a link.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 1)
    blocks = F.ceil(F.col("held") / LINK_BLOCK).cast("int").alias("blocks")
    linked = settle_as_table(members.join(sizes.select("component", blocks), "component"), "linked")
    sets = sets.join(linked.select("node"), "node", "left_semi").dropDuplicates(["node"])
    block = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    dealt = linked.select("component", "node", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    dealt = dealt.join(sets, "node").select("component", low, high, "block", "node", "grams")
    names = ["node", "n_links"] if counts else ["left", "right"]

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        sides = [group.filter(pa.array(group.column("block").to_numpy() == b)) for b in (low, high)]
        nodes = [side.column("node").to_numpy().astype(np.int64) for side in sides]
        first, second = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(nodes[0]) and len(nodes[1]):
            laid = [laid_out(side.column("grams")) for side in sides]
            found = block_links(*[np.split(grams, np.cumsum(sizes)[:-1]) for grams, sizes in laid], spec, low == high)
            if not counts:
                pairs = [(np.full(len(at), nodes[0][k]), nodes[1][at]) for k, at in found]
                first, second = (np.concatenate(x) for x in zip(*pairs))
            else:
                n = [np.zeros(len(side), np.int64) for side in nodes]
                for k, at in found:
                    n[0][k] += len(at)
                    n[1][at] += 1
                first, second = np.concatenate(nodes), np.concatenate(n)
                first, second = first[second > 0], second[second > 0]
        return pa.table({names[0]: pa.array(first, pa.int64()), names[1]: pa.array(second, pa.int64())})

    out = dealt.groupBy("component", "low", "high").applyInArrow(one, ", ".join(f"{c} long" for c in names))
    return out.groupBy("node").agg(F.sum("n_links").alias("n_links")) if counts else out


def class_members(named: DataFrame) -> DataFrame:
    return named.where(F.col("node").isNotNull()).groupBy("node", "component").agg(F.min("id").alias("id"))


def links(rows: DataFrame, id_column: str = "doc_id", text: str = "text", spec: Spec = Spec()) -> DataFrame:
    """All links (left, right) between different sets, each once, as digests of the sets with their smallest ids."""
    named, sets = labelled(rows, id_column, text, spec)
    members = settle_as_table(class_members(named), "members")
    found = in_blocks(members, sets, spec, counts=False)
    name = lambda side: members.select(F.col("node").alias(side), F.col("id").alias(f"{side}_id"))
    return found.join(name("left"), "left").join(name("right"), "right").select("left", "right", "left_id", "right_id")


def labelled(rows: DataFrame, id_column: str, text: str, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """Per row: id, mark, n, node, and of rows with n-grams class_id, component (its smallest node) and component_id.

    Beside it the sets (node, grams) of the classes that were compared, all classes with a link among them.
    """
    spark: SparkSession = rows.sparkSession
    keys = settle_as_table(keyed_sets(rows, id_column, text, spec), "keys")
    least = [F.first(c).alias(c) for c in ("n", *BITS)]
    classes = keys.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"), *least)
    classes = settle_as_table(classes, "classes")
    hot = spark.sparkContext.broadcast(frequent(keys))
    lists = settle_as_table(shared_lists(postings(rows, text, spec, hot)), "lists")
    found, sets = link_lists(lists, classes, lambda ids: set_table(rows, text, spec, ids, id_column), spec)
    members = classes.select("node", "id").withColumn("component", F.col("node"))
    if found is not None:
        members = classes.select("node", "id").join(found, "node", "left")
        members = members.withColumn("component", F.coalesce("component", "node"))
    names = members.groupBy("component").agg(F.min("id").alias("component_id"))
    named = members.join(names, "component").select("node", F.col("id").alias("class_id"), "component", "component_id")
    if sets is None:
        sets = spark.createDataFrame([], "node long, grams binary")
    return keys.drop("scout", *BITS).join(named, "node", "left"), sets


def join(rows: DataFrame, id_column: str = "doc_id", text: str = "text", spec: Spec = Spec()) -> DataFrame:
    """Per row: id, `n_shingles`, `class_id` (smallest id with the same set), `component_id` and `n_links`.

    `n_links` is the number of other classes with which the row's class links.
    """
    found, sets = labelled(rows, id_column, text, spec)
    named = settle_as_table(found, "named")
    counted = in_blocks(class_members(named), sets, spec, counts=True)
    return named.join(counted, "node", "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def distinct_documents(rows: DataFrame, id_column: str = "doc_id", text: str = "text", spec: Spec = Spec()) -> DataFrame:
    """One row of each component: of those with the smallest id (null is the largest), that with the smallest hash of the text.

    Rows without n-grams link with nothing and stay. Id and hash of the text find the row again; rows equal in both are exact copies.
    """
    found = labelled(rows, id_column, text, spec)[0].where(F.col("node").isNotNull())
    copies = found.groupBy("component", "id", "mark").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark", "times")).alias("first")
    kept = settle_as_table(copies.groupBy("component").agg(first).select("first.id", "first.mark", "first.times"), "kept")
    has_words = text_of(text).rlike(WORD)

    def having(condition: Column) -> DataFrame:
        ids = kept.where(condition).select(F.col("id").alias("_kept"), F.col("mark").alias("_mark"))
        same = F.col(id_column).eqNullSafe(F.col("_kept")) & (F.xxhash64(text_of(text)) == F.col("_mark"))
        return rows.where(has_words).join(ids, same, "left_semi")

    out = having(F.col("times") == 1).unionByName(rows.where(~has_words))
    again = F.col("times") > 1
    if kept.where(again).isEmpty():
        return out
    return out.unionByName(having(again).dropDuplicates([id_column, text]))
