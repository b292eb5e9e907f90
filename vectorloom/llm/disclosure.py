"""Personal data and the terms that give it away.

Protected entities are found by rules: mail addresses, IP addresses, payment cards, phone numbers. A term near an entity
may reveal it as well. How much follows from the corpus: with documents as the unit,

    PMI(entity, term) = log2(N * n(entity, term) / (n(entity) * n(term)))

is at most the entity's own information IC = log2(N / n(entity)), which it reaches where the term never stands without the entity.
The share PMI / IC is the disclosure of the term. From `GENERALISE` on it is replaced by its kind, from `REMOVE`
on it goes. A pair needs `LEAST_CONTEXTS` different contexts, so that copies of one passage are no evidence.

The corpus is read three times, always whole: entities and the terms around them; in how many documents those terms
occur; spans. Pairs are counted in Spark. A bit map of fixed size lets only texts' candidate terms pass to the counts;
false hits of the map are dropped by the join that follows. Disclosing terms are broadcast up to `MAX_TERMS`; more of them meet
the texts in a join.

Defined results: a null text is empty, an empty one has no spans; very long texts are read whole, in time linear in
their length; equal rows have equal results each and count as one document each; of two equal disclosures the greater counts once; an
empty table gives an empty result. Kept columns that clash with a result column get a leading underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.text import chunks, fresh, lowered, span_hashes, text_of, word_bounds
from vectorloom.operators.sizing import settle_as_table

CHUNK_BYTES = 1 << 19
WINDOW = 6  # words on either side of an entity that count as near
LEAST_CONTEXTS = 3
GENERALISE, REMOVE = 0.9, 0.95
LEAST_TERM = 3  # bytes
MAP_BITS = 1 << 26
MAX_TERMS = 2_000_000
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("general", "removed")
HELD = 1 << 18  # rows a task gathers before it hands their counts on


# ---- entities ------------------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Whole runs, so that a search never starts again inside one.
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Each @ with the longest run of allowed characters before it and a dotted name after it."""
    last = 0
    at = text.find("@")
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def addresses(text: str) -> Iterator[Span]:
    """Every four numbers in a row of a dotted chain."""
    for chain in CHAIN.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for found in DIGITS.finditer(text):
        if 16 <= found.end() - found.start() <= 37:
            digits = NO_DIGIT.sub("", found.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", found.start(), found.end()


def phones(text: str) -> Iterator[Span]:
    for found in PHONE.finditer(text):
        if 8 <= len(NO_DIGIT.sub("", found.group())) <= 15:
            yield "phone", found.start(), found.end()


def entities(text: str | None) -> list[Span]:
    """All base spans, kind by kind, ascending."""
    if not text:
        return []
    found = list(emails(text)) if "@" in text else []
    if "." in text:
        found += addresses(text)
    found += cards(text)
    if "+" in text:
        found += phones(text)
    return found


def value_of(kind: str, text: str) -> str:
    """What names the same entity however it is written."""
    return kind + ":" + (text.lower() if kind in ("email", "ip") else NO_DIGIT.sub("", text))


# ---- terms ---------------------------------------------------------------------------------------

INSIDE = np.ones(256, bool)  # bytes that may begin or end a term: letters, digits, and all beyond ASCII
INSIDE[[b for b in range(128) if not chr(b).isalnum()]] = False


class Terms:
    """Words of a chunk of texts without marks at their ends, in small letters; those without a letter or digit are left out."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        starts, ends, _ = word_bounds(raw, offsets)
        solid = np.flatnonzero(INSIDE[raw])
        first = np.searchsorted(solid, starts)
        last = np.searchsorted(solid, ends) - 1
        held = first <= last
        self.starts, self.ends = solid[first[held]], solid[last[held]] + 1
        self.hashes = span_hashes(lowered(raw), self.starts, self.ends).view(np.int64)
        self.long = self.ends - self.starts >= LEAST_TERM
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1
        self.bounds = np.searchsorted(self.starts, offsets)


def hash_of(value: str) -> int:
    raw = np.frombuffer(value.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def byte_places(text: str, places: list[int]) -> list[int]:
    """Byte offsets of ascending code point offsets."""
    if text.isascii():
        return places
    out, at, done = [], 0, 0
    for place in places:
        done += len(text[at:place].encode())
        out.append(done)
        at = place
    return out


def on_entities(terms: Terms, row: int, spans: list[tuple[int, int]], base: int) -> np.ndarray:
    """Which terms of a row touch one of `spans`, given in bytes of the row."""
    lo, hi = terms.bounds[row], terms.bounds[row + 1]
    touched = np.zeros(hi - lo, bool)
    for start, end in spans:
        first = np.searchsorted(terms.ends[lo:hi], base + start, side="right")
        last = np.searchsorted(terms.starts[lo:hi], base + end)
        touched[first:last] = True
    return touched


def contexts(rows: DataFrame, text: str) -> DataFrame:
    """(entity, term, context, doc) for all terms near an entity; `term` null stands for the entity itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["entity", "term", "context", "doc"]
        number = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        for batch in batches:
            for first, end, raw, offsets in chunks(batch.column(0), CHUNK_BYTES):
                texts = batch.column(0).slice(first, end - first).to_pylist()
                found = [entities(t) for t in texts]
                if any(found):
                    terms = Terms(raw, offsets)
                for row, spans in enumerate(found):
                    number += 1
                    if not spans:
                        continue
                    content, base = texts[row], int(offsets[row])
                    flat = sorted({p for _, s, e in spans for p in (s, e)})
                    place = dict(zip(flat, byte_places(content, flat)))
                    in_bytes = [(place[s], place[e]) for _, s, e in spans]
                    touched = on_entities(terms, row, in_bytes, base)
                    lo, hi = int(terms.bounds[row]), int(terms.bounds[row + 1])
                    near: dict[int, dict[int, set]] = {}
                    for (kind, s, e), (bs, be) in zip(spans, in_bytes):
                        one = near.setdefault(hash_of(value_of(kind, content[s:e])), {})
                        left = int(np.searchsorted(terms.starts[lo:hi], base + bs))
                        right = int(np.searchsorted(terms.ends[lo:hi], base + be, side="right"))
                        picks = np.r_[max(0, left - WINDOW) : left, right : min(hi - lo, right + WINDOW)].astype(int)
                        picks = picks[~touched[picks]]
                        hashes = terms.hashes[lo + picks]
                        mark = hash(tuple(hashes.tolist()))
                        one.setdefault(None, set()).add(mark)
                        for term in set(hashes[terms.long[lo + picks]].tolist()):
                            one.setdefault(term, set()).add(mark)
                    out += [(c, t, m, number) for c, held in near.items() for t, marks in held.items() for m in marks]
                if len(out) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return rows.select(text_of(text).alias("_content")).mapInArrow(run, "entity long, term long, context long, doc long")


def pairs(near: DataFrame, least: int = LEAST_CONTEXTS) -> DataFrame:
    """(entity, term, both, own): documents with the pair and with the entity, for pairs in enough contexts.

    Distinct contexts and documents are told apart before they are added up by pair, so an entity in a third of all documents
    keeps many tasks busy.
    """
    counts = F.count_distinct("context").alias("contexts"), F.count_distinct("doc").alias("both")
    seen = near.groupBy("entity", "term").agg(*counts).where(F.col("contexts") >= least)
    own = seen.where("term is null").select("entity", F.col("both").alias("own"))
    return seen.where("term is not null").select("entity", "term", "both").join(own, "entity")


def bit_map(terms: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """One bit per hash; made in tasks by byte, so the driver gets `bits` / 8 bytes at most."""
    spot = F.pmod(F.col("term"), F.lit(bits))
    marks = terms.select(F.floor(spot / 8).alias("at"), F.call_function("shiftleft", F.lit(1), F.pmod(spot, F.lit(8)).cast("int")).alias("bit"))
    held = marks.groupBy("at").agg(F.bit_or("bit").cast("short").alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[held.column("at").to_numpy()] = held.column("bits").to_numpy().astype(np.uint8)
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = np.mod(hashes, len(bits) * 8)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def document_counts(rows: DataFrame, text: str, candidates: DataFrame) -> DataFrame:
    """(term, docs) for terms that the bit map of `candidates` lets pass; added up in each task."""
    held = rows.sparkSession.sparkContext.broadcast(bit_map(candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def counted():
            seen, n = np.unique(np.concatenate([np.empty(0, np.int64), *waiting]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n.astype(np.int64))], ["term", "docs"])

        for batch in batches:
            for first, end, raw, offsets in chunks(batch.column(0), CHUNK_BYTES):
                terms = Terms(raw, offsets)
                hit = np.flatnonzero(terms.long & marked(held.value, terms.hashes))
                if len(hit):
                    both = np.unique(np.stack([terms.rows[hit], terms.hashes[hit]]), axis=1)
                    waiting.append(both[1])
                    size += both.shape[1]
                if size > HELD:
                    yield counted()
                    waiting, size = [], 0
        yield counted()

    partial = rows.select(text_of(text).alias("_content")).mapInArrow(run, "term long, docs long")
    return partial.groupBy("term").agg(F.sum("docs").alias("docs"))


def disclosing(rows: DataFrame, text: str = "text", least: int = LEAST_CONTEXTS) -> DataFrame:
    """(term, disclosure) of every term whose greatest share PMI / IC reaches `GENERALISE`."""
    near = settle_as_table(contexts(rows, text), "near-entities")
    found = settle_as_table(pairs(near, least), "entity-terms")
    counts = document_counts(rows, text, found.select("term").distinct())
    total = F.lit(float(rows.count()))
    own = F.log2(total / F.col("own"))
    share = F.when(own > 0, F.log2(total * F.col("both") / (F.col("own") * F.col("docs"))) / own)
    scored = found.join(counts, "term").select("term", share.alias("disclosure"))
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


# ---- spans ---------------------------------------------------------------------------------------

SPAN = "struct<kind:string,start:long,end:long>"


def spans_of(batch_column: pa.Array, keys: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, list[Span]]]:
    """(row, base spans, then those of the terms in `keys`, with offsets in code points)."""
    for first, end, raw, offsets in chunks(batch_column, CHUNK_BYTES):
        texts = batch_column.slice(first, end - first).to_pylist()
        found = [entities(t) for t in texts]
        more: list[list[Span]] = [[] for _ in texts]
        if len(keys) and len(raw):
            terms = Terms(raw, offsets)
            at = np.minimum(np.searchsorted(keys, terms.hashes), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == terms.hashes) & terms.long)
            if len(hit):
                leads = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=leads[1:])
                for k in hit.tolist():
                    row = int(terms.rows[k])
                    zero = leads[offsets[row]]
                    start, stop = int(leads[terms.starts[k]] - zero), int(leads[terms.ends[k]] - zero)
                    if not any(s < stop and start < e for _, s, e in found[row]):
                        more[row].append((TERM_KINDS[kinds[at[k]]], start, stop))
        for row, (base, extra) in enumerate(zip(found, more)):
            yield first + row, base + sorted(extra, key=lambda s: (TERM_KINDS.index(s[0]), s[1]))


def with_spans(rows: DataFrame, keep: Sequence[str], text: str, keys: np.ndarray, kinds: np.ndarray) -> DataFrame:
    names: list[str] = []
    for column in keep:
        names.append(fresh(["spans", *names], column))
    narrow = rows.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("_content"))
    fields = [f"`{n}` {narrow.schema[n].dataType.simpleString()}" for n in names]
    held = rows.sparkSession.sparkContext.broadcast((keys, kinds))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans] for _, spans in spans_of(batch.column(len(names)), *held.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, span)], [*names, "spans"])

    return narrow.mapInArrow(run, ", ".join([*fields, f"spans array<{SPAN}>"]))


def kind_of(disclosure: Column) -> Column:
    return F.when(disclosure >= REMOVE, 1).otherwise(0)


def sanitise(rows: DataFrame, keep: Sequence[str], text: str = "text", least: int = LEAST_CONTEXTS, max_terms: int = MAX_TERMS) -> DataFrame:
    """`keep` of each row with `spans`: personal data by kind, then disclosing terms, `general` or `removed`."""
    terms = settle_as_table(disclosing(rows, text, least), "disclosing")
    if terms.count() <= max_terms:
        table = terms.select("term", kind_of(F.col("disclosure")).alias("kind")).toPandas().sort_values("term")
        return with_spans(rows, keep, text, table["term"].to_numpy(np.int64), table["kind"].to_numpy(np.int64))
    return sanitise_by_join(rows, keep, text, terms)


def sanitise_by_join(rows: DataFrame, keep: Sequence[str], text: str, terms: DataFrame) -> DataFrame:
    """The same with terms that are too many for a broadcast: spots the bit map lets pass meet the terms by hash, texts by content."""
    bits = rows.sparkSession.sparkContext.broadcast(bit_map(terms))
    content, none = fresh(rows.columns, "content"), np.empty(0, np.int64)
    base = with_spans(rows.withColumn(content, F.sha2(text_of(text), 256)), [*keep, content], text, none, none)
    content, names = base.columns[-2], base.columns[:-2]

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, raw, offsets in chunks(batch.column(1), CHUNK_BYTES):
                terms_here = Terms(raw, offsets)
                hit = np.flatnonzero(terms_here.long & marked(bits.value, terms_here.hashes))
                leads = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=leads[1:])
                row = terms_here.rows[hit]
                zero = leads[offsets[:-1]][row]
                places = [leads[t[hit]] - zero for t in (terms_here.starts, terms_here.ends)]
                columns = [pa.array([ids[first + r] for r in row.tolist()], pa.string()), pa.array(terms_here.hashes[hit]), *map(pa.array, places)]
                yield pa.RecordBatch.from_arrays(columns, ["_same", "term", "start", "end"])

    whole = rows.select(F.sha2(text_of(text), 256).alias("_content"), text_of(text).alias("_body"))
    at = whole.mapInArrow(spots, "_same string, term long, start long, end long").distinct().join(terms, "term")
    kind = F.element_at(F.array(*map(F.lit, TERM_KINDS)), kind_of(F.col("disclosure")) + 1)
    found = at.groupBy("_same").agg(F.collect_list(F.struct(kind.alias("kind"), "start", "end")).alias("_more"))
    joined = base.join(found, F.col(content) == F.col("_same"), "left")
    apart = lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    extra = F.array_sort(F.filter(F.coalesce("_more", F.array().cast(f"array<{SPAN}>")), apart))
    return joined.select(*names, F.concat("spans", extra).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def only(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(text: Column, spans: Column) -> Column:
    """`text` without disclosed values: removed terms go, everything else becomes the name of its kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    label = lambda s: F.when(s["kind"] == "removed", "").when(s["kind"] == "general", "[term]").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["done"].alias("done"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
        F.struct(F.concat(a["done"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), label(s)).alias("done"), s["end"].alias("at"))
    )
    return F.aggregate(ordered, begin, step, lambda a: F.concat(a["done"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))
