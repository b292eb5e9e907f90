"""Quality rules, language identification, toxicity and language-model scores."""

import math
import zlib
from collections import Counter

import numpy as np
import odd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import langid, lm_score, quality, subwords, toxicity, window_graph
from vectorloom.llm.queries import QUERIES
from vectorloom.llm.text import lowered, span_hashes, text_buffers, word_bounds


def brute_stats(text):
    words = odd.words(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if odd.words(line)]
    marks = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), marks, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    got = quality.judge(odd.frame(spark)).collect()
    assert len(got) == len(odd.TEXTS)
    seen = Counter((r["doc_id"], *[r[c] for c in quality.STATS[:5]]) for r in got)
    assert seen == Counter((i, *brute_stats(t)) for i, t in odd.TEXTS)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.judge(odd.frame(spark, empty=True)).count() == 0
    kept = quality.good_documents(odd.frame(spark))
    assert kept.columns == odd.frame(spark).columns and kept.count() == sum(r["kept"] for r in got)


def test_quality_keeps_clashing_columns(spark):
    names = ["_content", "content", "kept", "_kept", "n_words", "row"]
    docs = odd.frame(spark).select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    judged = quality.judge(docs)
    assert judged.count() == len(odd.TEXTS) and "__kept" in judged.columns
    assert {tuple(r[2:]) for r in quality.good_documents(docs).collect()} == {tuple(range(len(names)))}


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    right = [0.95, 0.9, 0.85, 0.6]
    votes = np.stack([np.where(rng.random(len(good)) < a, ~good, good).astype(int) for a in right], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 2
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    fitted = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(fitted.share - 0.85) < 0.03
    rates = fitted.on_bad[:, 1] / fitted.on_bad[:, :2].sum(axis=1)
    assert np.abs(rates - right).max() < 0.06


def test_quality_agrees_with_labels(spark, folder):
    got = QUERIES["op9_quality_rules"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)


def test_kneser_ney_sums_to_one():
    model = langid.count_model({"a": ["abab abba", "baab"], "b": ["cacc ab"]}, order=3)
    alphabet = "abc ẞ"  # the last stands for all unseen symbols
    for language in range(2):
        total = 0.0
        for symbol in "abc":
            text = "ab" + symbol
            entropy, _ = model.entropies(["ab", text])
            total += math.exp(-(entropy[1, language] * 4 - entropy[0, language] * 3))
        space = model.entropies(["ab", "ab "])[0]
        total += math.exp(-(space[1, language] * 4 - space[0, language] * 3))
        unseen = model.entropies(["ab", "ab" + alphabet[-1].lower()])[0]
        total += math.exp(-(unseen[1, language] * 4 - unseen[0, language] * 3))
        assert total == pytest.approx(1, abs=1e-4)


def test_language_of_odd_rows(spark):
    model = langid.train([("en", "the cat and the dog " * 9)] * 6 + [("de", "der hund und die katze " * 9)] * 6)
    got = langid.identify(odd.frame(spark), model).collect()
    assert len(got) == len(odd.TEXTS)
    by_text = dict(zip([r["doc_id"] for r in got], got))
    for k in (4, 5, 6, 15):
        assert (by_text[k]["lang_pred"], by_text[k]["score"]) == ("und", 0)
    assert by_text[13]["rejected"] and by_text[13]["lang_pred"] in ("de", "en")
    assert model.predict(["the dog"])[0][0] == "en" and model.predict(["der hund"])[0][0] == "de"
    nothing = langid.train([])
    assert {r["lang_pred"] for r in langid.identify(odd.frame(spark), nothing).collect()} == {"und"}
    assert langid.identify(odd.frame(spark, empty=True), model).count() == 0


def test_language_accuracy(spark, folder):
    got = QUERIES["op8_language_id"](spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert held and sum(held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(0)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 300, n)]
    rows = []
    for k in range(400):
        text = draw(60)
        if k % 2:
            for at in rng.integers(0, 60, 3):
                text[at] = f"zork{rng.integers(0, 40)}"
        rows.append((" ".join(text), k % 2))
    return toxicity.train(rows)


def test_toxicity_learns_word_forms(toxic_model):
    rng = np.random.default_rng(5)
    clean = [" ".join(f"w{i}" for i in rng.integers(0, 300, 200)) for _ in range(30)]
    foul = [t.replace(t.split()[100], f"zork{k + 50} zork{k + 90}", 1) for k, t in enumerate(clean)]
    low, high = (toxic_model.scores(pa.array(x)) for x in (clean, foul))
    assert (high[:, None] > low).mean() > 0.9


def test_toxicity_windows_and_gradient():
    texts = pa.array([" ".join(map(str, range(50))), "", "a b", " ".join(map(str, range(32)))])
    (_, _, raw, offsets), = toxicity.chunks(texts, 1 << 30)
    words = toxicity.read_words(raw, offsets)
    assert words.owner.tolist() == [0, 0, 0, 2, 3]
    assert (words.windows >= 0).sum(axis=1).tolist() == [32, 32, 18, 2, 32]
    w = {k: v.astype(np.float64 if k != "common" else v.dtype) for k, v in toxicity.start_weights(words.hashes[:9]).items()}
    target, amount = np.array([1.0, 0, 1, 0, 1]), np.ones(5)

    def loss():
        p = toxicity.sigmoid(toxicity.logits(w, words, words.windows, toxicity.word_inputs(w, words)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    g = toxicity.gradient(w, words, words.windows, toxicity.word_inputs(w, words), target, amount)
    for name, value in g.items():
        at = np.unravel_index(np.abs(value).argmax(), value.shape)
        w[name][at] += 1e-3
        up = loss()
        w[name][at] -= 2e-3
        assert (up - loss()) / 2e-3 == pytest.approx(float(value[at]), rel=0.02, abs=1e-6)
        w[name][at] += 1e-3


def test_toxicity_of_odd_rows(spark, toxic_model):
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd.frame(spark), toxic_model).collect()}
    assert got[4] == got[5] == got[6] == 0 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(odd.frame(spark, empty=True), toxic_model).count() == 0
    assert toxicity.train([("a", 1)]).scores(pa.array(["a"])).tolist() == [0]


def test_lm_scores_each_token_once():
    ids = [np.arange(n) % 90 for n in (0, 1, 31, 32, 33, 100, 700)]
    model = lm_score.train(ids, 49408, epochs=1)
    inputs, targets, owner = model.windows(ids)
    for k, one in enumerate(ids):
        mine = targets[owner == k]
        assert mine[mine >= 0].tolist() == [*one.tolist(), lm_score.END]
    apart = [model.score([x])[0] for x in ids]
    assert model.score(ids) == pytest.approx(apart, rel=1e-4)
    w = model.weights
    rows = model.row_of[inputs[-1:]]
    changed = rows.copy()
    changed[0, 20] = 5
    a, b = (lm_score.forward(w, r)[0][0] for r in (rows, changed))
    assert np.allclose(a[:20], b[:20], atol=1e-5) and not np.allclose(a[20:], b[20:], atol=1e-5)
    mass = np.bincount(model.class_of, np.exp(model.within), lm_score.CLASSES)
    assert np.allclose(mass[mass > 0], 1)


def test_lm_learns_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SAMPLE_DOCS", 2)
    monkeypatch.setattr(lm_score.sample, "__defaults__", (2,))
    rng = np.random.default_rng(1)
    texts = [rng.integers(100, 300, 80) for _ in range(40)]
    for k, ids in enumerate(texts):
        ids[10:14] = [50, 1000 + k, 51, 7] if k % 2 else [7, 2000 + k, 52, 50]  # ids that occur once
    learned = spark.createDataFrame([(bytearray(t.astype("<u2").tobytes()),) for t in texts], "ids binary").repartition(5)
    model = lm_score.learn(learned, 49408)
    counts = np.bincount(np.concatenate(texts), minlength=49408)
    counts[lm_score.END] += len(texts)
    for one in range(49408):
        if counts[one] and one != lm_score.END:
            same = model.class_of == model.class_of[one]
            chance = (counts[one] + lm_score.SMOOTHING) / (counts[same].sum() + lm_score.SMOOTHING * same.sum())
            assert model.within[one] == pytest.approx(np.log(chance))
    once = [1000 + k if k % 2 else 2000 + k for k in range(40)]
    assert (model.class_of[once] != lm_score.CLASSES - 2).all() and len(set(model.row_of[once])) == 40
    assert set(model.class_of[once[::2]]).isdisjoint(model.class_of[once[1::2]])
    begun = lm_score.start_weights(49408)["input"]
    assert (model.weights["input"][once] != begun[once]).any(axis=1).all()
    assert (model.weights["input"][3000] == begun[3000]).all()


def test_base_scores(spark):
    rows = odd.frame(spark)
    training = rows.where("doc_id is null or doc_id % 3 <> 0")
    got = lm_score.score_texts(rows, training).collect()
    tokens = [[*odd.words(odd.lower(t)), None] for _, t in odd.TEXTS]
    counts = Counter(w for (i, _), ws in zip(odd.TEXTS, tokens) if i is None or i % 3 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    wanted = Counter()
    for (i, _), ws in zip(odd.TEXTS, tokens):
        value = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        wanted[i, len(ws), sum(counts[w] > 0 for w in ws), total, round(value, 4)] += 1
    assert wanted == Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
    assert all(r["score"] < 0 for r in got)
    assert lm_score.score_texts(odd.frame(spark, empty=True), odd.frame(spark, empty=True)).count() == 0


def test_rare_words_meet_their_counts(spark, monkeypatch):
    rows = odd.frame(spark)
    whole = lm_score.score_texts(rows, rows).collect()
    common = lm_score.common_words
    monkeypatch.setattr(lm_score, "common_words", lambda counts: common(counts, 3))
    part = lm_score.score_texts(rows, rows).collect()
    key = lambda r: (str(r["doc_id"]), r["n_known"], round(r["base_score"], 6))
    assert sorted(map(key, whole)) == sorted(map(key, part))


def test_encoder_equals_tokenizer():
    encoder = subwords.Encoder(subwords.default_path(), limit=20)
    texts = [t or "" for _, t in odd.TEXTS] + ["don't they'll 12.5% <|endoftext|>", "a\x1cb c", "ΣΑΣ İ ﬁ É́ x\u0085y"]
    for _ in range(2):
        for text, raw in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_lm_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    """Each text is scored alike however the rows lie, with steps taken in several parts."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [(i, " ".join(words[(i * k + k) % 8] for k in range(1, 20 + i % 7))) for i in range(60)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    learn = lm_score.learn
    monkeypatch.setattr(lm_score, "PART_TOKENS", 200)
    parts = []

    def watched(learned, size):
        parts.append(learned.rdd.getNumPartitions())
        return learn(learned, size)

    monkeypatch.setattr(lm_score, "learn", watched)
    trained = F.col("doc_id") % 5 != 1
    one, other = (
        {r["doc_id"]: r for r in lm_score.score_texts(part, trained).collect()} for part in (rows.coalesce(1), rows.repartition(6, "text"))
    )
    assert parts[0] != parts[1]
    for key, row in one.items():
        assert row["score"] == pytest.approx(other[key]["score"], rel=1e-5)
        assert row["base_score"] == pytest.approx(other[key]["base_score"], rel=1e-9)


def test_lm_log_sums_beyond_the_bound():
    logits = np.array([[300.0, 299.0], [-300.0, -301.0]], np.float32)
    far = {"out": np.full((2, 2), 200, np.float32), "out_add": np.zeros(2, np.float32)}
    np.testing.assert_allclose(lm_score.log_sums(far, logits), np.logaddexp(*logits.T.astype(float)), rtol=1e-6)
    near = {"out": np.full((2, 2), 2, np.float32), "out_add": np.zeros(2, np.float32)}
    np.testing.assert_allclose(lm_score.log_sums(near, logits / 100), np.logaddexp(*(logits / 100).T.astype(float)), rtol=1e-5)


def lm_case(texts=9):
    rng = np.random.default_rng(2)
    model = lm_score.untrained(np.arange(49408) % 7, np.arange(200), rng.normal(size=(200, lm_score.PROJECTED)))
    inputs, targets, _ = model.windows([rng.integers(0, 200, n) for n in rng.integers(0, 150, texts)])
    return model, inputs, targets, np.where(targets >= 0, model.class_of[np.maximum(targets, 0)], -1)


def test_lm_graph_equals_the_plain_form(monkeypatch):
    model, inputs, targets, classes = lm_case()
    assert window_graph.runtime() and {0, 8} == {first for first, chosen in lm_score.scored_from(targets) if len(chosen)}
    texts = [np.arange(n) % 90 for n in (0, 1, 31, 32, 33, 100)]
    fast, scores = lm_score.gradient(model.weights, inputs, classes), model.score(texts)
    monkeypatch.setattr(window_graph, "runtime", lambda: None)
    plain = lm_score.gradient(model.weights, inputs, classes)
    assert set(fast) == set(plain) == set(model.weights)
    for name, value in plain.items():
        assert np.abs(fast[name] - value).max() < 1e-5 * np.abs(value).max(), name
    assert scores == pytest.approx(model.score(texts), rel=1e-6)


def test_lm_steps_cost_the_vectors_seen_only():
    model, inputs, targets, _ = lm_case()
    begun = {k: v.copy() for k, v in model.weights.items()}
    taken = lm_score.Steps(model)
    for part in (slice(0, 5), slice(5, None)):  # more vectors are seen by the second step
        taken.take(inputs[part], targets[part], 0.01)
        assert len(taken.weights["input"]) == len(taken.first["input"]) == len(np.unique(inputs[: part.stop]))
    taken.end()
    seen = np.unique(inputs)
    assert (model.weights["input"][seen] != begun["input"][seen]).any(axis=1).all()
    unseen = np.setdiff1d(np.arange(49408), seen)
    assert (model.weights["input"][unseen] == begun["input"][unseen]).all()


def test_numbered_words_equal_the_tokenizer():
    texts = [t or "" for _, t in odd.TEXTS] + ["don't they'll 12.5% J̌ ǰ H̱ İ Für für x\u0085y a b", "ΣΑΣ İ ﬁ É́"]
    encoder = subwords.Encoder(subwords.default_path(), limit=20)
    for more in ([], ["<|endoftext|> a\x1cb c", "Two words"]):
        raw, offsets = text_buffers(pa.array(texts + more))
        small = lowered(raw)
        starts, ends, bounds = word_bounds(small, offsets)
        hashes = span_hashes(small, starts, ends).view(np.int64)
        table = lm_score.SortedWords(np.unique(hashes)[::2])
        place = table.find(hashes)
        assert [table.words[k] if k >= 0 else None for k in place] == [h if h in table.words else None for h in hashes]
        ids, cuts = subwords.NumberedWords(encoder, len(table.words) + 1).encode(raw, offsets, starts, ends, bounds, place)
        for text, a, b in zip(texts + more, cuts[:-1], cuts[1:]):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert (lm_score.SortedWords(np.empty(0, np.int64)).find(np.arange(3)) == -1).all()
