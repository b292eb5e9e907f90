"""N-gram join, packing and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectorloom.llm import ngram_join, packing, secret_scan, subwords
from vectorloom.llm.queries import QUERIES


def gram_set(text, size):
    words = odd.words(odd.lower(text))
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute_components(rows, spec):
    """(set size, smallest id of the component) per row, ids null last."""
    sets = [gram_set(t, spec.size) for _, t in rows]
    home = list(range(len(rows)))

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and spec.den * len(a & sets[j]) >= spec.num * len(a | sets[j]):
                home[top(i)] = top(j)
    names = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[top(i)].append(key)
    return [(key, len(sets[i]), min(names[top(i)], default=None) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def check(spark, rows, spec, **limits):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.join(frame, spec=spec).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows, spec))


def near_copies(seed, groups=6, copies=14):
    rng = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(30)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.choice([5, 20, 70]))] + passage * (g % 2)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6), " ".join(text)))
    return rows


@pytest.mark.parametrize("spec", [ngram_join.Spec(), corpus_pipeline.NEAR])
def test_components_equal_brute_force(spark, spec):
    check(spark, odd.TEXTS + near_copies(1), spec)


def test_components_with_frequent_grams_and_many_turns(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 300)
    monkeypatch.setattr(ngram_join, "MAX_HOT", 40)
    check(spark, near_copies(2, groups=4, copies=25), ngram_join.Spec())


def test_every_link_is_found(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", 5)
    spec, rows = ngram_join.Spec(), list(enumerate(t for _, t in near_copies(3)))
    sets = {}
    for key, text in rows:
        sets.setdefault(gram_set(text, spec.size), key)
    wanted = {(a, b) for x, a in sets.items() for y, b in sets.items() if a < b and spec.den * len(x & y) >= spec.num * len(x | y)}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(sorted((r["left_id"], r["right_id"]))) for r in ngram_join.links(frame, spec=spec).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    counts = Counter(key for pair in wanted for key in pair)
    joined = ngram_join.join(frame, spec=spec).collect()
    assert all(r["n_links"] == counts[sets[gram_set(dict(rows)[r["doc_id"]], spec.size)]] for r in joined) and max(counts.values()) > 5


def test_join_of_nothing(spark):
    assert ngram_join.join(odd.frame(spark, empty=True)).count() == 0


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lists = [np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(rng.integers(0, 25))]
        counts = Counter(int(x) for one in lists for x in one)
        least = int(rng.integers(1, 15))
        assert ngram_join.divide_skip(lists, least) == {k: c for k, c in counts.items() if c >= least}


def check_pieces(pieces, documents):
    """Pieces cover the documents (id, bytes of ids), and fill their sequences."""
    fills, covers = defaultdict(list), defaultdict(list)
    for p in pieces:
        fills[p["sequence_id"]].append((p["offset"], p["length"]))
        covers[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"], p["ids_crc32"]))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
    wanted = Counter((key, len(raw) // 4) for key, raw in documents)
    assert set(wanted) == set(covers)
    for name, parts in covers.items():
        assert sum(length for _, length, _ in parts) == wanted[name] * name[1]
        raws = [raw for key, raw in documents if (key, len(raw) // 4) == name]
        for start, length, crc in parts:
            assert crc in {zlib.crc32(raw[4 * start : 4 * (start + length)]) for raw in raws}


def ids_of(text):
    encoder = subwords.encoder(subwords.default_path())
    return encoder.direct(text or "") + np.asarray([2], "<u4").tobytes()


@pytest.mark.parametrize("pack_tokens", [100, 1 << 20])
def test_packing(spark, pack_tokens):
    pieces = packing.pack_documents(odd.frame(spark), pack_tokens=pack_tokens).collect()
    check_pieces(pieces, [(key, ids_of(text)) for key, text in odd.TEXTS])
    assert packing.pack_documents(odd.frame(spark, empty=True)).count() == 0


def test_packs_fill_and_balance():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.choice([1, 5, 100, 1000, 4095, 4096, 4097, 20_000]) for _ in range(rng.randint(0, 40))]
        used, covers = Counter(), Counter()
        for document, _, length, sequence, _ in packing.pack(lengths):
            used[sequence] += length
            covers[document] += length
        assert covers == Counter(dict(enumerate(lengths)))
        assert all(n == 4096 or n & (n - 1) == 0 for n in used.values())
    pieces = packing.pack([1024] * 8 + [256] * 32)
    spent = Counter()
    for _, _, length, sequence, _ in pieces:
        spent[sequence] += packing.cost(length)
    assert max(spent.values()) < 1.05 * min(spent.values())


def test_stages(spark, folder):
    docs = odd.frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, odd.frame(spark, empty=True), folder).count() == 0
    single = corpus_pipeline.without_near_copies(spark, docs, folder).collect()
    brute = brute_components(odd.TEXTS, corpus_pipeline.NEAR)
    kept = {(key, text) for (key, text), (_, _, home) in zip(odd.TEXTS, brute) if key == home}
    assert Counter((r["doc_id"], r["text"]) for r in single) == Counter(kept)
    clean = corpus_pipeline.without_secrets(spark, docs, folder).collect()
    assert len(clean) == len(odd.TEXTS) and not any("AKIA" in (r["text"] or "") for r in clean)
    extra = lambda rows: Counter((r["doc_id"], r["blob"], r["spans"], r["source"]) for r in rows)
    assert extra(clean) == extra(docs.collect())


def test_one_row_of_each_group(spark):
    base = [f"b{i}" for i in range(60)]
    near = lambda k: " ".join([*base, f"end{k}"])
    other = lambda k: " ".join([*[f"o{i}" for i in range(60)], f"end{k}"])
    alone = " ".join(f"a{i}" for i in range(30))
    rows = [
        *[(None, other(k)) for k in range(4)],  # a group without any id
        (5, near(0)), (9, near(1)), (None, near(2)), (None, near(2)),  # copies without id of a numbered document
        (9, alone), (9, alone), (5, near(3)),  # ids with several texts
        (None, None), (None, ""), (9, " "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in ngram_join.distinct_documents(docs, spec=corpus_pipeline.NEAR).collect()]
    assert Counter(key for key, _ in got) == Counter([None, 5, 9, None, None, 9])
    assert sum(text in {other(k) for k in range(4)} for _, text in got) == 1
    assert [key for key, text in got if (text or "").startswith("b0 ")] == [5]
    assert got.count((9, alone)) == 1 and len(set(got)) == len(got)


def test_pipeline_keeps_every_copy(spark, folder):
    docs = corpus_pipeline.documents(spark, folder)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.settle_as_table(stage(spark, docs, folder), "test-stage")
    good = {r["doc_id"] for r in QUERIES["op9_quality_rules"](spark, folder).where("kept").collect()}
    texts = [(r["doc_id"], r["text"]) for r in corpus_pipeline.documents(spark, folder).collect() if r["doc_id"] in good]
    single = {key for (key, _), (_, _, home) in zip(texts, brute_components(texts, corpus_pipeline.NEAR)) if key == home}
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter(single)
    taken = Counter({r["doc_id"]: r["copies"] for r in corpus_pipeline.mixing.mix(docs).collect() if r["copies"]})
    covered, tokens = Counter(), {}
    for p in corpus_pipeline.run(spark, folder).collect():
        covered[p["doc_id"]] += p["length"]
        tokens[p["doc_id"]] = p["doc_tokens"]
    assert {key: n / tokens[key] for key, n in covered.items()} == taken


def test_pipeline(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    quality = QUERIES["op9_quality_rules"](spark, folder)
    good = {r["doc_id"] for r in quality.where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r["doc_id"] in good}
    brute = brute_components(list(texts.items()), corpus_pipeline.NEAR)
    single = {key for key, _, home in brute if key == home}
    assert {p["doc_id"] for p in pieces} <= single
    copies = Counter()
    for p in pieces:
        copies[p["doc_id"]] += p["length"]
    tokens = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert all(n % tokens[key] == 0 and n <= 3 * tokens[key] for key, n in copies.items())
    assert secret_scan.RULES


def test_hubs_of_short_lists_do_not_search_long_ones(spark, monkeypatch):
    """Classes that are hubs of pairs stay out of the search of a list that all are in, until the last turn."""
    count, asked = 200, []
    postings = [(0, 0, k) for k in range(count)] + [(8 * (1 + k // 2), 0, k) for k in range(count)]
    lists = spark.createDataFrame(postings, "gram long, at int, node long")
    classes = spark.createDataFrame([(k, k, 50, 0, 0, 0, 0) for k in range(count)], "node long, id long, n long, b0 long, b1 long, b2 long, b3 long")

    def search(pairs, sets, spec):
        asked.append(pairs.count())
        return spark.createDataFrame([], "left long, right long")

    monkeypatch.setattr(ngram_join, "search", search)
    ngram_join.link_lists(lists, classes, lambda ids: ids.select(F.col("id").alias("node"), F.lit(b"").alias("grams")), ngram_join.Spec())
    first, second, last = asked
    assert first <= len(postings)
    assert second <= ngram_join.HUBS * len(postings)
    assert last == count * (count - 1) // 2  # nothing linked, so all of the long list is compared


def test_long_lists_connect_over_bounded_turns(spark, monkeypatch):
    """A group in which a class links with one in 32 is not compared pair by pair."""
    count, asked = 1200, []
    lists = spark.createDataFrame([(g, g, k) for g in (1, 2, 3) for k in range(count)], "gram long, at int, node long")
    classes = spark.createDataFrame([(k, k, 500, 0, 0, 0, 0) for k in range(count)], "node long, id long, n long, b0 long, b1 long, b2 long, b3 long")

    def search(pairs, sets, spec):
        asked.append(pairs.count())
        return pairs.where(F.pmod(F.xxhash64(F.least("hub", "node"), F.greatest("hub", "node")), F.lit(32)) == 0).select(F.col("hub").alias("left"), F.col("node").alias("right"))

    monkeypatch.setattr(ngram_join, "search", search)
    known, _ = ngram_join.link_lists(lists, classes, lambda ids: ids.select(F.col("id").alias("node"), F.lit(b"").alias("grams")), ngram_join.Spec())
    assert known.select("component").distinct().count() == 1 and known.count() == count
    assert sum(asked) <= (1 + ngram_join.MORE + 4) * ngram_join.HUBS * count  # of 719,400 pairs


def test_pairs_of_many_lists_meet_once(spark):
    rows = spark.createDataFrame([(g, g, k) for g in range(20) for k in range(3) if (g, k) != (0, 2)], "gram long, at int, node long")
    early, once = ngram_join.with_early(rows)
    hubs = early.select("gram", F.col("gram").alias("hub_gram"), F.col("early").alias("hub_early"), F.col("node").alias("hub"))
    met = early.join(hubs, "gram").where((F.col("hub") < F.col("node")) & once).select("hub", "node", "gram").collect()
    assert sorted(tuple(r) for r in met) == [(0, 1, 0), (0, 2, 1), (1, 2, 1)]


def test_overlaps_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(40):
        query = np.unique(rng.integers(0, 200, 120).astype(np.uint64))
        others = [np.unique(rng.integers(0, 200, rng.integers(1, 150)).astype(np.uint64)) for _ in range(rng.integers(1, 30))]
        least = int(rng.integers(1, 60))
        found = ngram_join.overlaps(query, np.concatenate(others), np.array([len(o) for o in others]), least)
        shared = {k: len(np.intersect1d(query, o)) for k, o in enumerate(others)}
        assert dict(zip(*(x.tolist() for x in found))) == {k: n for k, n in shared.items() if n >= least}
