"""Alignment of two tokenizers against loops over tokens."""

import bisect
import hashlib
from collections import Counter, defaultdict

import odd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vectorloom.llm import alignment
from vectorloom.llm.queries import QUERIES

COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
ODD = ["<|endoftext|> <s> don't", "a▁b", "\x00 tab\t\n  ", "é é ﬁ İ", "ab" * 3000, "x\u0085y\x1cz", " "]


@pytest.fixture(scope="module")
def tools():
    a_path, b_path = alignment.default_paths()
    tokenizer = Tokenizer.from_file(a_path)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=b_path)


def spans(ids, pieces):
    at, out = 0, []
    for i, piece in zip(ids, pieces):
        out.append((at, at + len(piece), i))
        at += len(piece)
    return out


def brute(texts, tools):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, by loops."""
    tokenizer, pieces = tools
    alphabet = alignment.byte_alphabet()
    held, parts = Counter(), []
    for text in texts:
        links, groups = [], []
        if text:
            ids_a = tokenizer.encode(" " + text, add_special_tokens=False).ids
            raw_a = [bytes(alphabet[c] for c in tokenizer.id_to_token(i)) for i in ids_a]
            ids_b = pieces.encode(text)
            raw_b = [
                bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, pieces.id_to_piece(i)) for i in ids_b)
            ]
            a, b = spans(ids_a, raw_a), spans(ids_b, raw_b)
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
                groups = [([], []) for _ in ends]
                for side, tokens in enumerate((a, b)):
                    for _, e, i in tokens:
                        groups[bisect.bisect_left(ends, e)][side].append(str(i))
                groups = [tuple(map(",".join, g)) for g in groups]
                at = 0
                for s, e, i in a:
                    while at and b[at - 1][1] > s:
                        at -= 1
                    while b[at][1] <= s:
                        at += 1
                    k = at
                    while k < len(b) and b[k][0] < e:
                        links.append((i, b[k][2]))
                        k += 1
            else:
                a = b = []
        else:
            a = b = []
        held.update(set(links))
        parts.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), ";".join(map("|".join, groups)))
        for n_a, n_b, groups, links in parts
    ]


def test_ids_equal_the_tokenizer(tools):
    a, b = alignment.sides(alignment.default_paths())
    for text in [t for _, t in odd.TEXTS if t] + ODD:
        assert a.encode([text])[0] == tools[0].encode(" " + text, add_special_tokens=False).ids
        assert b.encode([text])[0] == tools[1].encode(text)


@pytest.mark.parametrize("max_hot", [alignment.MAX_HOT, 25, 0])
def test_alignment_of_odd_rows(spark, tools, max_hot):
    texts = [t if t is None else t[:4000] for _, t in odd.TEXTS] + ODD
    rows = [(k, t, "mine", 1.0) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, groups string, n_a double").repartition(3)
    got = alignment.align(frame, ["doc_id", "groups", "n_a"], max_hot=max_hot).orderBy("doc_id").collect()
    wanted = brute(texts, tools)
    assert [tuple(r[c] for c in [*COUNTS, "groups"]) for r in got] == wanted
    assert {(r["_groups"], r["_n_a"]) for r in got} == {("mine", 1.0)}
    assert [r["n_a"] for r in got][3:5] == [0, 0] and got[len(odd.TEXTS) + 1]["groups"] == ""


def test_empty_table(spark):
    assert alignment.align(odd.frame(spark, empty=True), ["doc_id"]).count() == 0


def test_query_equals_loops(spark, folder, tools):
    got = QUERIES["op12_token_alignment"](spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = {r["doc_id"]: w for r, w in zip(rows, brute([r["text"] for r in rows], tools))}
    assert len(got) == len(rows)
    for r in got:
        *counts, groups = wanted[r["doc_id"]]
        assert [r[c] for c in COUNTS] == counts
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
