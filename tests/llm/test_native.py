"""Secret scans, mixing and fingerprints: column expressions against brute force."""

import hashlib
import re
import tempfile

import odd
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import mixing, secret_scan, syncmers
from vectorloom.llm.secret_scan import BASE_RULES, RULES, Rule


def brute_spans(text, rules=RULES):
    found = []
    for place, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), place, rule.kind, m.end()))
    return sorted(found)


def test_spans_equal_brute_force(spark, tmp_path):
    rows = odd.frame(spark)
    got = secret_scan.scan_versions(rows, str(tmp_path / "ledger"), path="doc_id").collect()
    assert len(got) == len(odd.TEXTS)
    for r in got:
        assert [tuple(s) for s in r["spans"]] == brute_spans(r["text"])
    assert any(r["spans"] for r in got) and {"_spans", "_blob"} <= set(got[0].asDict())


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = odd.frame(spark)
    secret_scan.scan_versions(rows, path, path="doc_id").count()
    first = spark.read.parquet(path).count()
    assert first == len({t or "" for _, t in odd.TEXTS})
    secret_scan.scan_versions(rows, path, path="doc_id").count()
    assert spark.read.parquet(path).count() == first
    raised = [Rule("hex", "[0-9a-f]{16,}", 0, 16, version=2) if r.kind == "hex" else r for r in RULES]
    got = secret_scan.scan_versions(rows, path, raised, path="doc_id").collect()
    ledger = spark.read.parquet(path)
    assert ledger.count() == 2 * first
    assert {tuple(r["rules"]) for r in ledger.collect()} == {tuple(secret_scan.label(r) for r in RULES), ("hex:2",)}
    for r in got:
        assert [tuple(s) for s in r["spans"]] == brute_spans(r["text"], raised)


def test_dropped_matches_hide_what_they_cover(spark, tmp_path):
    texts = ["token=token:abcdefgh1", "token==abc12345", "TOKEN : 'x' secret=\"abcdefgh\"", "ſecret=abcdefgh1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = secret_scan.scan_versions(rows, str(tmp_path / "l"), BASE_RULES, path="doc_id").orderBy("doc_id").collect()
    assert [[tuple(s) for s in r["spans"]] for r in got] == [brute_spans(t, BASE_RULES) for t in texts]


def test_redaction(spark, tmp_path):
    found = secret_scan.scan_versions(odd.frame(spark), str(tmp_path / "l"), path="doc_id")
    clean = found.select("text", secret_scan.redact(F.col("text"), F.col("spans")).alias("clean")).collect()
    for r in clean:
        spans = brute_spans(r["text"])
        if not spans:
            assert r["clean"] == r["text"]
        else:
            assert "AKIA" not in r["clean"] and "[SECRET]" in r["clean"]


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in done]
        rest = total - sum(done.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return {**done, **{s: weight[s] * level for s in free}}
        done |= {s: float(most * sizes[s]) for s in over}


def test_mixing_reaches_its_targets(spark):
    rows = odd.frame(spark)
    got = mixing.mix(rows).collect()
    assert len(got) == len(odd.TEXTS)
    sizes, most = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    wanted = brute_targets(sizes)
    for source in sizes:
        mine = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in mine} == {sizes[source]}
        assert all(abs(r["target"] - wanted[source]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - wanted[source]) <= most[source]
    again = mixing.mix(odd.frame(spark).repartition(2)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    taken = mixing.take(rows)
    assert taken.columns == rows.columns
    assert taken.count() == sum(r["copies"] for r in got)


def test_targets_stop_and_share_again(spark):
    sizes = {"a": 10, "b": 1000, None: 5, "c": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def chunked(text, size=syncmers.UNIT):
    return re.findall(rf"[^ \t-\r]{{1,{size}}}", text)


def test_fingerprints(spark):
    rows = odd.frame(spark)
    got = syncmers.compare_with_next(rows).collect()
    assert len(got) == len(odd.TEXTS)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(odd.TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1] or "")))
    texts = [t or "" for _, t in order]
    wanted = {}
    for k, ((doc_id, _), t) in enumerate(zip(order, texts)):
        after = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        wanted.setdefault((doc_id, len(t)), []).append(digest(t[: len(t) - half] + after[:half]))
    seen = {}
    for r in got:
        seen.setdefault((r["doc_id"], r["n_chars"]), []).append(r["edited_sha256"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and r["fingerprint"]
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in wanted.items()}
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[3] != prints[9] and prints[4] == prints[5]


def test_anchors_do_not_depend_on_their_surroundings(spark):
    middle = " ".join(f"m{i * 7 % 101}" for i in range(40))
    rows = spark.createDataFrame([(1, middle), (2, "some words before it " + middle + " and after")], "id long, text string")
    rows = rows.withColumn("anchors", syncmers.anchors(F.col("text")))
    inside, around = ({a & 0xFFFFFFFF for a in r["anchors"]} for r in rows.orderBy("id").collect())
    assert inside <= around and len(inside) >= 8
    hits = syncmers.matches(rows.where("id = 1"), rows.where("id = 2"), "id").orderBy(F.desc("count")).first()
    assert hits["shift"] == 4 and hits["count"] == len(inside)
    assert len(chunked(middle)) == 40


def test_empty_tables(spark):
    rows = odd.frame(spark, empty=True)
    assert secret_scan.scan_versions(rows, tempfile.mkdtemp() + "/l", path="doc_id").count() == 0
    assert mixing.mix(rows).count() == 0
    assert syncmers.compare_with_next(rows).count() == 0
