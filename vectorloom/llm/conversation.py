"""Repair of conversations by a generalised LR parse with weighted edits.

The grammar of roles is `(system? (user assistant)+)?`. Its stack has four tops: nothing yet, after system, after
user, after assistant. A turn may be kept, given another role or deleted, and empty turns may be inserted; the parse
follows all of them at once over a graph-structured stack. Where two ways reach the same top, the one with the
smaller (cost, audit) stays, the audit being the initials of the edits.

Tops are compared without their audits: each carries its rank among the tops. Inserts belong to the turn that
follows them, so all audits before a turn end with the letter of a turn and hold equally many such letters; none is a prefix of another, and
their order never changes as they grow.

Conversations of up to `BLOCK` turns are parsed in one piece. Longer ones are cut into segments of `BLOCK` turns,
wherever they lie: every segment is parsed from each of the four tops, which gives at most 16 (cost, rank) entries; a fold
over these small summaries fixes the tops between segments; then all segments are repaired independently. Only the SHA-256
of a long conversation's text has to read it in order; it does so in a stream, one segment in memory at a time.

Defined results: null roles and texts are one space here (`rows_of`); turns are ordered by number, nulls first, then role and text, so
equal rows are neighbours and all but one are duplicates; a null conversation id is a conversation of its own. Very long
texts are carried whole. An empty table gives an empty result. Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vectorloom.operators.sizing import MAX_BROADCAST_ROWS, positions, settle, settle_as_table

BLOCK = 4096
SPACES = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
START, SYSTEM, USER, ASSISTANT = range(4)  # stack tops
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an insert or a new role leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
LEGAL = ("su", "ua", "au")
FAULTS = ("", "blank", "duplicate", "truncated")


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5  # more than zero
    truncated: int = 5  # for a truncated turn that stays


# ---- the parse -----------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def actions(top: int, initial: str, fault: str, costs: Costs) -> tuple[tuple[int, str, int], ...]:
    """(cost, letters, next top) of all ways past one turn: up to two inserts, then one letter for the turn."""
    found = []
    at, letters, spent = top, "", 0
    for _ in range(3):
        found.append((spent + costs.delete, letters + "D", at))
        if fault not in ("blank", "duplicate"):
            held = spent + (costs.truncated if fault == "truncated" else 0)
            if initial == "s" and at == START:
                found.append((held, letters + "K", SYSTEM))
            elif initial in ("u", "a") and "sua".index(initial) + 1 == NEXT[at]:
                found.append((held, letters + "K", NEXT[at]))
            if initial != INITIALS[NEXT[at] - 1]:
                found.append((held + costs.rerole, letters + "R", NEXT[at]))
        at, letters, spent = NEXT[at], letters + "I", spent + costs.insert
    return tuple(found)


def endings(top: int, costs: Costs) -> tuple[int, str]:
    """Cost and letters of the inserts that close a conversation."""
    missing = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[top]
    return missing * costs.insert, "I" * missing


Stack = dict[int, tuple[int, int]]  # top -> (cost, rank of its audit)


def shift(stack: Stack, moves) -> tuple[Stack, dict[int, tuple[int, str]]]:
    """The stack after one step and, per top, where it came from and by which letters.

    `moves(top)` gives (cost, letters or a rank, next top). Equal tops merge by minimum (cost, audit).
    """
    best: dict[int, tuple] = {}
    for top, (cost, rank) in stack.items():
        for more, letters, to in moves(top):
            one = (cost + more, rank, letters, top)
            if to not in best or one < best[to]:
                best[to] = one
    order = {to: k for k, to in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
    return {to: (one[0], order[to]) for to, one in best.items()}, {to: (one[3], one[2]) for to, one in best.items()}


def parse(turns: list[tuple[str, str]], entry: int, costs: Costs):
    """The stack after (initial, fault) turns from one entry top, and the links to trace it back."""
    stack: Stack = {entry: (0, 0)}
    links = []
    for initial, fault in turns:
        stack, link = shift(stack, lambda top: actions(top, initial, fault, costs))
        links.append(link)
    return stack, links


def trace(links, top: int) -> list[str]:
    """Letters of each turn on the way to `top`."""
    out = []
    for link in reversed(links):
        top, letters = link[top]
        out.append(letters)
    return out[::-1]


def closed(stack: Stack, costs: Costs) -> tuple[int, int]:
    """(cost, top) of the cheapest way to end here; ties go to the smaller audit."""
    ends = [(cost + endings(top, costs)[0], rank, top) for top, (cost, rank) in stack.items()]
    cost, _, top = min(ends)
    return cost, top


# ---- one segment ---------------------------------------------------------------------------------


def fault_of(text: str) -> str:
    body = text.rstrip(SPACES)
    return "blank" if not body else "" if body.endswith(STOPS) else "truncated"


def faults_of(roles: list[str], texts: list[str], copies: list[bool] | None) -> list[str]:
    """The first fault of each turn; `copies` says which repeat an earlier one, where that is known."""
    if copies is None:
        seen: set[tuple[str, str]] = set()
        copies = []
        for one in zip(roles, texts):
            copies.append(one in seen)
            seen.add(one)
    found = map(fault_of, texts)
    return [f if f == "blank" else "duplicate" if copy else f for f, copy in zip(found, copies)]


def repaired(roles, texts, letters: list[str], entry: int, tail: str):
    """The turns after the edits."""
    out, at = [], entry
    for role, text, edits in [*zip(roles, texts, letters), ("", "", tail)]:
        for letter in edits:
            if letter == "D":
                continue
            to = SYSTEM if letter == "K" and role[:1] == "s" else NEXT[at]
            out.append((role if letter == "K" else ROLE[to], "" if letter == "I" else text))
            at = to
    return out


def describe(turns, roles, texts, copies, entry, leave, costs: Costs) -> dict:
    """Counts, edits and repaired turns of a segment. Without `entry` it is a whole conversation."""
    faults = faults_of(roles, texts, copies)
    initials = [r[:1] for r in roles]
    stack, links = parse(list(zip(initials, faults)), START if entry is None else entry, costs)
    whole = entry is None
    top = closed(stack, costs)[1] if whole or leave < 0 else leave
    tail_cost, tail = endings(top, costs) if whole or leave < 0 else (0, "")
    letters = trace(links, top)
    numbers = [t for t in turns if t is not None]
    return {
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "first_initial": initials[0],
        "last_initial": initials[-1],
        "first_turn": min(numbers) if numbers else None,
        "last_turn": max(numbers) if numbers else None,
        "distinct_turns": len(set(numbers)),
        "cost": stack[top][0] + tail_cost,
        "audit": "".join(letters) + tail,
        "repaired": [{"role": r, "text": t} for r, t in repaired(roles, texts, letters, START if whole else entry, tail)],
    }


SEGMENT = (
    "blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, "
    "last_turn long, distinct_turns long, cost long, audit string, repaired array<struct<role:string,text:string>>"
)


def arrow_of(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) of each run of rows with equal leading columns, across batches."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        marks = list(zip(*columns[:keys]))
        first = 0
        for k in range(1, len(marks) + 1):
            if k < len(marks) and marks[k] == marks[first]:
                continue
            if held and marks[first] != now:
                yield now, held
                held = []
            part = [c[first:k] for c in columns[keys:]]
            now, held = marks[first], [a + b for a, b in zip(held, part)] if held else part
            first = k
    if held:
        yield now, held


def by_segment(rows: DataFrame, costs: Costs) -> DataFrame:
    """`describe` of every (conversation, segment) of `rows`, whose tops, copies and places are null for whole ones."""
    schema = f"conversation {rows.schema['conversation'].dataType.simpleString()}, segment long, {SEGMENT}"
    sink = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for (conversation, segment, entry, leave), (turns, roles, texts, copies, _) in grouped(batches, 4):
            known = None if entry is None else copies
            one = describe(turns, roles, texts, known, entry, leave, costs)
            out.append({"conversation": conversation, "segment": segment, **one})
            size += sum(map(len, texts)) + 64 * len(texts)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, sink)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, sink)

    columns = ["conversation", "segment", "entry", "leave", "turn", "role", "text", "copy", "position"]
    order = ["conversation", "segment", "position", "turn", "role", "text"]
    return rows.select(*columns).repartition("conversation", "segment").sortWithinPartitions(*order).mapInArrow(run, schema)


# ---- long conversations --------------------------------------------------------------------------


def summaries(rows: DataFrame, costs: Costs) -> DataFrame:
    """(conversation, segment, entry, leave, cost, rank) for all pairs of tops that a segment can connect."""
    schema = f"conversation {rows.schema['conversation'].dataType.simpleString()}, segment long, entry int, leave int, cost long, rank int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conversation, segment), (_, initials, faults) in grouped(batches, 2):
            lines = []
            for entry in range(4):
                stack, _ = parse(list(zip(initials, faults)), entry, costs)
                lines += [(conversation, segment, entry, leave, *best) for leave, best in stack.items()]
            columns = [pa.array(c) for c in zip(*lines)]
            yield pa.RecordBatch.from_arrays(columns, ["conversation", "segment", "entry", "leave", "cost", "rank"]).cast(target)

    target = arrow_of(schema)
    narrow = rows.select("conversation", "segment", "position", F.substring("role", 1, 1).alias("initial"), fault_column().alias("fault"))
    dealt = narrow.repartition("conversation", "segment")
    return dealt.sortWithinPartitions("conversation", "segment", "position").mapInArrow(run, schema)


def fault_column():
    """`faults_of` as an expression, over `text` and `copy`."""
    body = F.rtrim(F.translate("text", SPACES[1:], " " * 5))
    blank, ended = F.length(body) == 0, F.substring(body, -1, 1).isin(*STOPS)
    return F.when(blank, "blank").when(F.col("copy"), "duplicate").when(ended, "").otherwise("truncated")


def routes(summary: DataFrame, costs: Costs) -> DataFrame:
    """(conversation, segment, entry, leave): the tops between segments on the cheapest way; -1 leaves the last one.

    A conversation gives one task at most 16 small rows for every `BLOCK` turns.
    """
    schema = f"conversation {summary.schema['conversation'].dataType.simpleString()}, segment long, entry int, leave int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conversation,), (segments, entries, leaves, spent, ranks) in grouped(batches, 1):
            steps: dict[int, dict[int, list]] = {}
            for segment, entry, leave, cost, rank in zip(segments, entries, leaves, spent, ranks):
                steps.setdefault(segment, {}).setdefault(entry, []).append((cost, rank, leave))
            stack: Stack = {START: (0, 0)}
            links = []
            for segment in sorted(steps):
                stack, link = shift(stack, lambda top: steps[segment].get(top, ()))
                links.append(link)
            top, way = closed(stack, costs)[1], []
            for segment, link in zip(sorted(steps, reverse=True), reversed(links)):
                way.append((segment, link[top][0], -1 if not way else top))
                top = link[top][0]
            columns = [pa.array([conversation] * len(way), target.field(0).type), *map(pa.array, zip(*way))]
            yield pa.RecordBatch.from_arrays(columns, ["conversation", "segment", "entry", "leave"]).cast(target)

    target = arrow_of(schema)
    dealt = summary.select("conversation", "segment", "entry", "leave", "cost", "rank").repartition("conversation")
    return dealt.sortWithinPartitions("conversation", "segment").mapInArrow(run, schema)


def same(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Join on equal or equally null columns, which are kept once."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    joined = left.join(F.broadcast(other) if broadcast else other, match, how)
    return joined.drop(*[f"_{c}" for c in columns])


def staged_long(rows: DataFrame, block: int, costs: Costs) -> DataFrame:
    """Rows of long conversations with their place, their segment and the tops before and after it."""
    placed = positions(rows, ["conversation"], ["turn", "role", "text"]).drop("total")
    placed = placed.withColumn("digest", F.sha2("text", 256))
    firsts = placed.groupBy("conversation", "role", "digest").agg(F.min("position").alias("first"))
    marked = same(placed, firsts, ["conversation", "role", "digest"])
    marked = marked.withColumn("copy", F.col("position") != F.col("first")).drop("digest", "first")
    marked = settle_as_table(marked.withColumn("segment", F.floor(F.col("position") / block)), "long-conversations")
    way = settle(routes(summaries(marked, costs), costs))
    return same(marked, way, ["conversation", "segment"], broadcast=way.count() <= MAX_BROADCAST_ROWS)


# ---- the operator --------------------------------------------------------------------------------


def rows_of(table: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return table.select(
        F.col(conversation).alias("conversation"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text")
    )


def repair(rows: DataFrame, block: int = BLOCK, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame | None]:
    """Segments of conversations of at most `block` turns (one each), and of longer ones, if there are any.

    `rows` are those of `rows_of`. A segment has its counts, cost, audit and the `repaired` turns.
    """
    sizes = rows.groupBy("conversation").agg(F.count(F.lit(1)).alias("turns"))
    long = settle(sizes.where(F.col("turns") > block).select("conversation"))
    many = long.count()
    short = same(rows, long, ["conversation"], "left_anti", broadcast=many <= MAX_BROADCAST_ROWS) if many else rows
    nothing = lambda kind: F.lit(None).cast(kind)
    unknown = {"entry": "int", "leave": "int", "copy": "boolean", "position": "long"}
    short = short.select("*", F.lit(0).cast("long").alias("segment"), *[nothing(kind).alias(c) for c, kind in unknown.items()])
    pieces = by_segment(short, costs)
    if not many:
        return pieces, None
    chosen = same(rows, long, ["conversation"], broadcast=many <= MAX_BROADCAST_ROWS)
    return pieces, by_segment(staged_long(chosen, block, costs), costs)


def line(turn) -> str:
    return turn["role"] + ":" + turn["text"]


def totals_of_long(segments: DataFrame) -> DataFrame:
    """One row per long conversation. Segments stream past in order; the hash needs them so."""
    kind = segments.schema["conversation"].dataType.simpleString()
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conversation {kind}, gaps long, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, parts, digest, last = (), {}, [], None, {}

        def done():
            first, end = out.pop("first"), out.pop("last")
            distinct, out["audit"] = out.pop("distinct"), "".join(parts)
            out["gaps"] = 0 if first is None else end - first + 1 - distinct
            out["repaired_sha256"] = digest.hexdigest()
            return pa.RecordBatch.from_pylist([out], target)

        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1).to_pylist()[0]
                if now != (one["conversation"],):
                    if now:
                        yield done()
                    now, parts, digest, last, begun = (one["conversation"],), [], hashlib.sha256(), {}, False
                    out = {"conversation": now[0], "first": None, "last": None, "distinct": 0, **dict.fromkeys(counts, 0)}
                for c in counts:
                    out[c] += one[c]
                out["distinct"] += one["distinct_turns"]
                if last:
                    out["illegal"] += last["last_initial"] + one["first_initial"] not in LEGAL
                    out["distinct"] -= last["last_turn"] is not None and last["last_turn"] == one["first_turn"]
                if one["first_turn"] is not None:
                    out["first"] = one["first_turn"] if out["first"] is None else out["first"]
                    out["last"] = one["last_turn"]
                parts.append(one["audit"])
                for turn in one["repaired"]:
                    digest.update(("\n" if begun else "").encode() + line(turn).encode())
                    begun = True
                last = one
        if now:
            yield done()

    target = arrow_of(schema)
    return segments.repartition("conversation").sortWithinPartitions("conversation", "segment").mapInArrow(run, schema)


def totals(short: DataFrame, long: DataFrame | None) -> DataFrame:
    """One row per conversation: counts, cost, audit and the SHA-256 of the repaired turns."""
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns"), F.lit(0).cast("long"))
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    out = short.select("conversation", gaps.alias("gaps"), *counts, F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    return out if long is None else out.unionByName(totals_of_long(long))


def damaged(table: DataFrame) -> DataFrame:
    """Conversations with faults that hang on the checksum of id and turn: a row lost, emptied, without stops, twice, or said by the user."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.pmod(F.crc32(named.cast("binary")), F.lit(20))
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    hurt = table.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return hurt.drop("_copy")


def repaired_totals(table: DataFrame, originals: DataFrame, block: int = BLOCK, costs: Costs = Costs()) -> DataFrame:
    """`totals` of `table` for every conversation of `originals`; one without rows has zeros and empty texts."""
    found = totals(*repair(rows_of(table), block, costs))
    ids = originals.select(F.col("conv_id").alias("conversation")).distinct()
    joined = same(ids, found, ["conversation"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.col("conversation").alias("conv_id"),
        *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
