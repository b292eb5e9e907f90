"""Document fingerprints from closed syncmers.

A text is read as units, words cut after `UNIT` code points. A k-mer of `K` units is an anchor if the
smallest hash of its inner runs of `S` units stands first or last. That depends on the k-mer alone, so equal
passages give equal anchors wherever they stand, and their distances stay the same: anchors have positions.
The fingerprint is the sorted set of anchor hashes; likeness is the share of common ones (Jaccard).
Column expressions only.

Defined results: a null text is the empty text; a text without anchors, such as one of fewer than `K`
units, has the hash of the whole as its only one, so equal texts always have equal fingerprints; rows are ordered by id, nulls first, then by
digest of the text, so ties have a fixed order and identical rows are interchangeable; an empty table gives
no rows. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.text import text_of

UNIT = 12
K = 6
S = 2
MAX_RANGES = 10_000
RANGE_ROWS = 2_000


def bound(value: Column, use) -> Column:
    """`use(value)` with `value` computed once per row: as the variable of a lambda over one element."""
    return F.get(F.transform(F.array(value), use), 0)


def units(text: Column) -> Column:
    """Hashes of the units of `text`, in order."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"), F.lit(0)), lambda unit: F.xxhash64(unit)
    )


def windows(hashes: Column, size: int) -> Column:
    """Hashes of all runs of `size` elements."""

    def slide(found: Column) -> Column:
        head = F.slice(found, 1, F.greatest(F.size(found) - (size - 1), F.lit(0)))
        return F.transform(head, lambda _, i: F.xxhash64(*[F.get(found, i + j) for j in range(size)]))

    return bound(hashes, slide)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of longs, position times 2^32 plus a 32-bit hash, for every closed syncmer of `text`."""
    width = k - s + 1

    def pick(inner: Column) -> Column:
        # Inner runs at steps of s and the last one cover the k-mer: their hashes stand for it.
        cover = sorted({*range(0, width, s), width - 1})

        def one(first: Column, i: Column) -> Column:
            edge = F.least(first, F.get(inner, i + (width - 1))) <= F.array_min(F.slice(inner, i + 1, width))
            value = F.hash(*[F.get(inner, i + j) for j in cover]).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
            return F.when(edge, i.cast("bigint") * F.lit(1 << 32) + value)

        starts = F.slice(inner, 1, F.greatest(F.size(inner) - (width - 1), F.lit(0)))
        return F.filter(F.transform(starts, one), lambda anchor: anchor.isNotNull())

    whole = F.array(F.hash(text).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    return bound(
        bound(windows(units(text), s), pick), lambda found: F.when(F.size(found) > 0, found).otherwise(whole)
    )


def fingerprint(anchor_array: Column) -> Column:
    """Sorted distinct anchor hashes, as ints."""
    low = lambda a: F.shiftright(F.shiftleft(a, 32), 32).cast("int")
    return F.sort_array(F.array_distinct(F.transform(anchor_array, low)))


def written(hashes: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits per hash."""
    digits = lambda h: F.lpad(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.array_join(F.transform(hashes, digits), "")


def likeness(left: Column, right: Column) -> Column:
    """Share of common hashes among all hashes of two fingerprints, 0 to 1."""
    common = lambda both: both / (F.size(left) + F.size(right) - both).cast("double")
    return bound(F.size(F.array_intersect(left, right)).cast("double"), common)


def matches(left: DataFrame, right: DataFrame, id_column: str, anchor_column: str = "anchors") -> DataFrame:
    """Positional matching of documents: (left id, right id, shift, count).

    A passage that two documents share gives anchors at one distance (`shift`); `count` of them says how
    long it is. An anchor that is frequent in a document is matched with each of its places.
    """

    def spread(rows: DataFrame, side: str) -> DataFrame:
        each = rows.select(F.col(id_column).alias(f"{side}_id"), F.explode(anchor_column).alias("a"))
        at = F.shiftright("a", 32).cast("int").alias(f"{side}_at")
        return each.select(f"{side}_id", at, F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"))

    both = spread(left, "left").join(spread(right, "right"), "hash")
    shift = (F.col("right_at") - F.col("left_at")).alias("shift")
    return both.groupBy("left_id", "right_id", shift).agg(F.count(F.lit(1)).alias("count"))


def range_of(value: Column, cuts: list) -> Column:
    """How many of the sorted `cuts` lie below `value`: first among every g-th, then within one group."""
    if not cuts:
        return F.lit(0)
    g = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + g] for i in range(0, len(cuts), g)]
    below = lambda array: F.size(F.filter(array, lambda cut: cut < value))
    group = below(F.array(*[F.lit(c[-1]) for c in groups]))
    inner = F.get(F.array(*[F.array(*map(F.lit, c)) for c in groups]), group)
    return group * g + F.coalesce(below(inner), F.lit(0))


def with_next(rows: DataFrame, order: str, tie: str, carried: list[str], ranges: int | None = None) -> DataFrame:
    """`rows` with `next`, a struct of the `carried` columns of the row that follows; after the last, the first.

    The order column is cut into ranges at quantiles, and each range is a window of its own, so `rows` are
    shuffled once. The last row of a range takes the first row of the next one; both sides of that join have
    a row per range.
    """
    if ranges is None:
        ranges = int(min(MAX_RANGES, max(2, rows.select(order).count() // RANGE_ROWS)))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = rows.select(F.percentile_approx(order, shares, 10 * MAX_RANGES).alias("c")).first()["c"]
    part = F.when(F.col(order).isNull(), -1).otherwise(range_of(F.col(order), sorted(set(cuts or []))))
    window = Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first(), tie)
    # One lead per column: a struct would be built, and shuffled, beside the columns that it holds.
    placed = rows.withColumn("_range", part).select(
        "*",
        *[F.lead(c).over(window).alias(f"_next_{c}") for c in carried],
        F.lead(F.lit(True)).over(window).isNull().alias("_last"),
        F.lag(F.lit(True)).over(window).isNull().alias("_first"),
    )
    kept = [F.col(c) for c in rows.columns]
    after = F.struct(*[F.col(f"_next_{c}").alias(c) for c in carried]).alias("next")
    inner = placed.where(~F.col("_last")).select(*kept, after)
    last = placed.where("_last").select(*kept, "_range")
    by_range = Window.orderBy("_range")
    firsts = placed.where("_first").select("_range", F.struct(*carried).alias("next"))
    before = F.coalesce(F.lag("_range").over(by_range), F.max("_range").over(Window.partitionBy()))
    joined = last.join(firsts.select(before.alias("_range"), "next"), "_range")
    return inner.unionByName(joined.drop("_range"))


def edited(text: Column, other: Column) -> Column:
    """`text` with its last half replaced by the start of `other`, as long as that goes."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compare_with_next(rows: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprints of its text and of its text edited with the next row's, and their likeness."""
    base = rows.select(F.col(id_column).alias("id"), text_of(text).alias("text"))
    prints = fingerprint(anchors(F.col("text")))
    base = base.select("id", "text", F.sha2("text", 256).alias("digest"), prints.alias("print"))
    both = with_next(base, "id", "digest", ["text", "print"])
    both = both.withColumn("edited", edited(F.col("text"), F.col("next.text")))
    both = both.withColumn("edited_print", fingerprint(anchors(F.col("edited"))))
    return both.select(
        F.col("id").alias(id_column),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"),
        written(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next.print")).alias("near_next"),
    )
