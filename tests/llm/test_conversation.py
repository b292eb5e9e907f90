"""Repair of conversations against a search over all edits."""

import hashlib
import re
import zlib
from functools import lru_cache

import pytest

from vectorloom.llm import conversation
from vectorloom.llm.queries import QUERIES

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    found, seen = [], set()
    for _, _, role, text in rows:
        body = re.sub("[ \t-\r]", "", text)
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def brute(rows):
    """All edit sequences from the end, compared as (cost, audit) with the turns they give."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    found = faults(rows)

    @lru_cache(maxsize=None)
    def best(k, done):  # done: "" or the last initial, after which the rest is parsed
        options = []
        if k == len(rows) and done in ("", "a"):
            options.append((0, "", ()))
        follow = "a" if done == "u" else "u"
        name = {"u": "user", "a": "assistant"}[follow]
        if k < len(rows):
            _, _, role, text = rows[k]
            late = 5 if found[k] == "truncated" else 0
            steps = [(2, "D", done, ())]
            if found[k] not in ("blank", "duplicate"):
                if role[:1] == follow or (role[:1] == "s" and done == ""):
                    steps.append((late, "K", role[:1], ((role, text),)))
                steps.append((1 + late, "R", follow, ((name, text),)))
            for cost, letter, to, turn in steps:
                rest = best(k + 1, to)
                options.append((cost + rest[0], letter + rest[1], turn + rest[2]))
        if inserts[0] < 2:
            inserts[0] += 1
            rest = best.__wrapped__(k, follow)
            inserts[0] -= 1
            options.append((5 + rest[0], "I" + rest[1], ((name, ""),) + rest[2]))
        return min(options) if options else (10**9, "", ())

    inserts = [0]
    cost, audit, turns = best(0, "")
    initials = [r[2][:1] for r in rows]
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert GRAMMAR.match("".join(r[:1] for r, _ in turns))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, *counts, illegal, cost, audit, digest)


def wanted(rows):
    hurt = damage(rows)
    return {conv: brute([r for r in hurt if r[0] == conv]) for conv in {r[0] for r in rows}}


def tangled():
    """Conversations in every kind of disorder."""
    import random

    rng = random.Random(3)
    rows = []
    for conv in [None, *range(160)]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "and so", " \t", "", None, "Why? \n", f"t{turn}.", f"t{turn}"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(500, k // 2, "user" if k % 3 else "system", f"a{k % 7}.") for k in range(60)]
    rows += [(501, None, "user", "same.")] * 30 + [(502, 4, "system", "x" * 20_000)]
    return rows + [(503, k, "user", "") for k in range(3)]


SCHEMA = "conv_id long, turn long, role string, text string, segment string, copy int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [conversation.BLOCK, 7, 2, 1])
def test_repair_equals_all_edits(spark, block):
    rows = tangled()
    table = frame(spark, rows)
    got = conversation.repaired_totals(conversation.damaged(table), table, block).collect()
    expected = wanted(rows)
    assert len(got) == len(expected)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == expected[r["conv_id"]], r["conv_id"]


def test_other_costs_insert(spark):
    """Where deleting is dear, turns are inserted, also across segments."""
    costs = conversation.Costs(rerole=9, delete=9, insert=2, truncated=0)
    rows = [(1, k, "user", f"a{k}.") for k in range(5)] + [(2, 0, "system", "b.")]
    whole, parts = (
        {r["conv_id"]: r for r in conversation.repaired_totals(frame(spark, rows), frame(spark, rows), b, costs).collect()} for b in (99, 2)
    )
    assert whole[1]["audit"] == "KIKIKIKIKI" and whole[2]["audit"] == "KII" and whole == parts


def test_empty_and_lost(spark):
    none = frame(spark, [])
    assert conversation.repaired_totals(none, none).count() == 0
    lost = conversation.repaired_totals(none, frame(spark, [(7, 1, "user", "a.")])).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in lost] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_equals_all_edits(spark, folder):
    got = QUERIES["op13_conversation_repair"](spark, folder).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = wanted(rows)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == expected
