"""Personal data and disclosing terms against plain patterns and counts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectorloom.llm import disclosure
from vectorloom.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if holds(kind, m.group())
    ]


def terms_of(text):
    """(term, start, end) of each word without the marks around it."""
    out = []
    for m in re.finditer(r"[^ \t-\r]+", text or ""):
        inner = re.search(r"[A-Za-z0-9\x80-\U0010ffff](?:.*[A-Za-z0-9\x80-\U0010ffff])?", m.group(), re.S)
        if inner:
            out.append((odd.lower(inner.group()), m.start() + inner.start(), m.start() + inner.end()))
    return out


def brute(texts, least=disclosure.LEAST_CONTEXTS):
    """All spans of each text, with plain dictionaries."""
    near, docs, count = defaultdict(lambda: defaultdict(lambda: (set(), set()))), Counter(), len(texts)
    words = [terms_of(t) for t in texts]
    spans = [base(t) for t in texts]
    for d, text in enumerate(texts):
        docs.update({w for w, _, _ in words[d] if len(w.encode()) >= disclosure.LEAST_TERM})
        free = [not any(s < e2 and s2 < e for _, s2, e2 in spans[d]) for _, s, e in words[d]]
        for kind, s, e in spans[d]:
            held = near[disclosure.value_of(kind, text[s:e])]
            left = sum(x[1] < s for x in words[d])
            right = sum(x[2] <= e for x in words[d])
            picks = [*range(max(0, left - disclosure.WINDOW), left), *range(right, min(len(words[d]), right + disclosure.WINDOW))]
            picks = [words[d][k][0] for k in picks if free[k]]
            for term in [None, *picks]:
                if term is None or len(term.encode()) >= disclosure.LEAST_TERM:
                    held[term][0].add(tuple(picks))
                    held[term][1].add(d)
    known = {}
    for held in near.values():
        own = len(held[None][1])
        for term, (contexts, both) in held.items():
            if term is not None and len(contexts) >= least and own < count:
                share = math.log2(count * len(both) / (own * docs[term])) / math.log2(count / own)
                known[term] = max(known.get(term, 0), share)
    out = []
    for d in range(count):
        more = [
            ("removed" if known[w] >= disclosure.REMOVE else "general", s, e)
            for w, s, e in words[d]
            if known.get(w, 0) >= disclosure.GENERALISE and not any(s < e2 and s2 < e for _, s2, e2 in spans[d])
        ]
        out.append(spans[d] + sorted(more))
    return out


def planted():
    """A project name beside one address, a nickname beside one phone number, copies of one letter."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ré", "tu"]) for _ in range(3))
    fill = lambda n: " ".join(word() for _ in range(n))
    texts = [fill(40) for _ in range(60)]
    texts += [f"{fill(9)} Zorblat, ana.b@firm.example {fill(9)}" for _ in range(6)]
    texts += [f"{fill(9)} call (Quix) +1 (743) 555-3824 {fill(9)}" for _ in range(5)] + [f"{fill(20)} quix! {fill(5)}"]
    texts += [f"letter of frumious bandersnatch to 10.0.0.7 today {k}" for k in [0] * 8]
    texts += [f"{fill(30)} zorblat {fill(3)}", *[t if t is None else t[:5000] for _, t in odd.TEXTS]]
    return texts


SCHEMA = "doc_id long, text string, spans string"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], SCHEMA).repartition(3)


def shown(rows):
    return [[tuple(s) for s in r["spans"]] for r in sorted(rows, key=lambda r: r["doc_id"])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1250.@+-() %_é", max_size=60))
def test_entities_equal_patterns(text):
    assert disclosure.entities(text) == base(text)


def test_entities_of_long_texts():
    number = "4539578763621486"
    assert disclosure.luhn(number) == luhn(number)
    long = "a" * 400_000 + "1" * 400_000 + "." * 200_000 + "+1" + "(" * 400_000 + "@" * 1000
    assert disclosure.entities(long) == []
    assert disclosure.entities("0" * 6000 + "1.1.1.1, " + number) == [("ip", 0, 6007), ("card", 6009, 6025)]


@pytest.mark.parametrize("max_terms", [disclosure.MAX_TERMS, 0])
def test_terms_equal_counts(spark, max_terms):
    texts = planted()
    got = disclosure.sanitise(frame(spark, texts), ["doc_id", "spans"], max_terms=max_terms).collect()
    assert shown(got) == brute(texts) and {r["_spans"] for r in got} == {"mine"}
    kinds = Counter(s["kind"] for r in got for s in r["spans"])
    assert kinds["removed"] >= 5 and kinds["general"] >= 6
    found = {texts[r["doc_id"]][s["start"] : s["end"]].lower() for r in got for s in r["spans"] if s["kind"] in disclosure.TERM_KINDS}
    assert found == {"zorblat", "quix", "call"} and "frumious" not in found


def test_redaction(spark):
    texts = planted()
    found = disclosure.sanitise(frame(spark, texts), ["doc_id", "text"])
    got = found.select("doc_id", disclosure.redact(found["text"], found["spans"]).alias("text")).orderBy("doc_id").collect()
    label = {"removed": "", "general": "[term]"}
    for r, spans in zip(got, brute(texts)):
        wanted, at = "", 0
        for kind, s, e in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
            if s >= at:
                wanted += (texts[r["doc_id"]] or "")[at:s] + label.get(kind, f"[{kind}]")
            at = max(at, e)
        assert (r["text"] or "") == wanted + (texts[r["doc_id"]] or "")[at:]


def test_empty_table(spark):
    assert disclosure.sanitise(frame(spark, []), ["doc_id"]).count() == 0


def test_query_equals_counts(spark, folder):
    got = {r["doc_id"]: r for r in QUERIES["op11_pii"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    assert len(got) == len(rows)
    for r, spans in zip(rows, brute([r["text"] for r in rows])):
        one = got[r["doc_id"]]
        first = [s for s in spans if s[0] in disclosure.KINDS]
        assert one["spans"] == join(spans)
        assert one["base_sha256"] == hashlib.sha256(join(first).encode()).hexdigest()
        assert [one[f"n_{k}"] for k in disclosure.KINDS] == [sum(s[0] == k for s in first) for k in disclosure.KINDS]
