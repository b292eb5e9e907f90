"""Quality rules as weak supervision.

Each rule votes good, votes bad or abstains. Expectation-maximisation over the counts of vote patterns of all
documents estimates the share of good documents and how often each rule votes which way on either kind; no
labels are read. A document is kept if its posterior probability of being good is high enough, which replaces
the demand that it pass every rule. Two base rules still reject outright.

Votes are counted in Spark; what reaches the driver is one row per pattern, 3 to the power of the number of
rules at most.

Defined results: a null text has no words and is rejected; an empty table gives an empty result, and the estimates are
then the starting values; rows that are equal have equal results each, and a posterior equal to `KEEP` keeps; very long
texts are counted whole, alone in their chunk; clashing columns of the input are kept under a name with leading
underscores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.text import chunks, fresh, give_back, span_hashes, text_of, window_hashes, word_bounds
from vectorloom.operators.sizing import settle_as_table

SYMBOLS = b"#*$%&|<>"
MARKS = b"#*$%&|<>!?@^~=+_\\{}[]"
CHUNK_BYTES = 1 << 19  # a chunk needs some 40 bytes of work arrays per byte of text
WINDOW = 3
LEAST_WORDS = 50
ROUNDS = 200
PRIOR_COUNT = 10.0  # pseudo-votes that hold each rule to its starting rates
KEEP = 0.5
STATS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capital_words",
    "n_distinct_words",
    "n_marked_words",
    "n_plain_chars",
)


# ---- counts of a text ----------------------------------------------------------------------------


def repeated(words: np.ndarray, size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words which the text holds twice or more."""
    windows = window_hashes(words, size)
    if len(windows) < 2:
        return 0
    _, place, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


def line_counts(raw: bytes) -> tuple[int, int]:
    """Lines that hold a word, and those among them that equal an earlier one."""
    seen: set[bytes] = set()
    lines = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            lines += 1
            seen.add(line)
    return lines, lines - len(seen)


def stats_of(column: pa.Array) -> np.ndarray:
    """One row of `STATS` per text."""
    out = np.zeros((len(column), len(STATS)), np.int64)
    symbol = np.isin(np.arange(256), list(SYMBOLS))
    mark = np.isin(np.arange(256), list(MARKS))
    every = np.arange(256)
    # Letters, digits, and the first bytes of what lies beyond ASCII.
    letter = ((every | 32) >= 97) & ((every | 32) <= 122) | (every >= 48) & (every <= 57) | (every >= 0xC0)
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    for first, end, raw, offsets in chunks(column, CHUNK_BYTES):
        rows = out[first:end]
        starts, ends, bounds = word_bounds(raw, offsets)
        hashes = span_hashes(raw, starts, ends)
        leads = sums((raw & 0xC0) != 0x80)  # code points are counted by their first bytes
        rows[:, 1] = np.diff(sums(leads[ends] - leads[starts])[bounds])
        del leads
        rows[:, 0] = np.diff(bounds)
        rows[:, 2] = np.diff(sums(symbol[raw])[offsets])
        rows[:, 9] = np.diff(sums(letter[raw])[offsets])
        odd = sums(mark[raw])
        rows[:, 8] = np.diff(sums(odd[ends] > odd[starts])[bounds])
        del odd
        small, large = sums((raw >= 97) & (raw <= 122)), sums((raw >= 65) & (raw <= 90))
        shouts = (large[ends] - large[starts] > 1) & (small[ends] == small[starts])
        rows[:, 6] = np.diff(sums(shouts)[bounds])
        del small, large
        text = raw.tobytes()
        for k in range(end - first):
            words = hashes[bounds[k] : bounds[k + 1]]
            rows[k, 5], rows[k, 3] = line_counts(text[offsets[k] : offsets[k + 1]])
            rows[k, 4] = repeated(words)
            rows[k, 7] = len(np.unique(words))
    return out


def counted(rows: DataFrame, names: list[str], texts: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The columns `names` of `rows` and `STATS` of the text that `texts` finds in a batch."""
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names], *[f"{s} long" for s in STATS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = stats_of(texts(batch))
            arrays = [batch.column(i) for i in range(len(names))] + [pa.array(stats[:, j]) for j in range(len(STATS))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *STATS])
        give_back()

    return rows.mapInArrow(run, schema)


def with_stats(rows: DataFrame, text: str = "text") -> DataFrame:
    """`rows` without the text, and `STATS` of it as longs."""
    names: list[str] = []
    others = [c for c in rows.columns if c != text]
    for column in others:
        names.append(fresh([*STATS, "votes", "posterior", "base_failed", "kept", *names], column))
    content = fresh(names, "content")
    narrow = rows.select(*[F.col(c).alias(n) for c, n in zip(others, names)], text_of(text).alias(content))
    return counted(narrow, names, lambda batch: batch.column(len(names)))


# ---- rules ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1) where `bad` holds, good (1) where `good` holds, else abstains (0)."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 50", "n_words >= 80"),
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.2 * n_words"),
    Rule("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 AND n_lines > 2"),
    Rule("capitals", "n_capital_words > 0.3 * n_words", "n_capital_words <= 0.05 * n_words"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3.5 * n_words AND 10 * n_words"),
    Rule("marks", "n_marked_words > 0.25 * n_words", "n_marked_words <= 0.08 * n_words"),
    Rule("letters", "n_plain_chars < 0.8 * word_chars", "n_plain_chars >= 0.9 * word_chars"),
    Rule("variety", "n_distinct_words < 0.15 * n_words", "n_distinct_words >= 0.3 * n_words"),
)


def base_failed() -> Column:
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * 50
    return (F.col("n_words") < LEAST_WORDS) | repeats


def votes(rules: Sequence[Rule] = RULES) -> Column:
    """The votes as text, one of the characters b, g and - per rule."""
    each = [F.when(F.expr(r.bad), "b").when(F.expr(r.good), "g").otherwise("-") for r in rules]
    return F.concat(*each)


@dataclass
class Estimate:
    """Share of good documents, and per rule the rates of (good, bad, no) votes on good and on bad documents."""

    share: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        place = np.arange(patterns.shape[1])
        good = np.log(self.share) + np.log(self.on_good[place, patterns]).sum(axis=1)
        bad = np.log(1 - self.share) + np.log(self.on_bad[place, patterns]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def encode(patterns: Sequence[str], rules: int) -> np.ndarray:
    codes = {"g": 0, "b": 1, "-": 2}
    return np.array([[codes[c] for c in p] for p in patterns], np.int64).reshape(len(patterns), rules)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Estimate:
    """Class-conditional rates of the votes, from patterns and their counts.

    The start says that votes are mostly right; it names the classes, and `PRIOR_COUNT` pseudo-votes keep a
    rule that never votes from drifting.
    """
    rules = patterns.shape[1]
    on_good = np.tile([0.8, 0.05, 0.15], (rules, 1))
    on_bad = np.tile([0.4, 0.4, 0.2], (rules, 1))
    start_good, start_bad = PRIOR_COUNT * on_good, PRIOR_COUNT * on_bad
    now = Estimate(0.8, on_good, on_bad)
    if not len(patterns):
        return now
    one = np.eye(3)[patterns]
    for _ in range(rounds):
        good = now.posterior(patterns) * counts
        bad = counts - good
        rates = [start + np.einsum("p,prv->rv", weight, one) for start, weight in ((start_good, good), (start_bad, bad))]
        rates = [r / r.sum(axis=1, keepdims=True) for r in rates]
        share = float((good.sum() + 4) / (counts.sum() + 5))
        moved = abs(share - now.share)
        now = Estimate(share, *rates)
        if moved < 1e-9:
            break
    return now


def estimate(voted: DataFrame, rules: Sequence[Rule] = RULES) -> Estimate:
    seen = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    return expectation_maximisation(encode([r["votes"] for r in seen], len(rules)), np.array([r["n"] for r in seen], float))


def posterior_column(fitted: Estimate, rules: Sequence[Rule] = RULES) -> Column:
    """Posterior probability of a document by its counts, as an expression."""
    log_odds = np.log(fitted.on_good / fitted.on_bad)
    total = F.lit(float(np.log(fitted.share / (1 - fitted.share))))
    for rule, (good, bad, none) in zip(rules, log_odds.tolist()):
        total = total + F.when(F.expr(rule.bad), bad).when(F.expr(rule.good), good).otherwise(none)
    return 1 / (1 + F.exp(-total))


def judge(rows: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, keep: float = KEEP) -> DataFrame:
    """`rows` without the text, with `STATS`, `votes`, `posterior`, `base_failed` and `kept`."""
    counted = settle_as_table(with_stats(rows, text).withColumn("votes", votes(rules)), "quality")
    judged = counted.withColumn("posterior", posterior_column(estimate(counted, rules), rules))
    judged = judged.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))


def good_documents(rows: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, keep: float = KEEP) -> DataFrame:
    """The rows that `judge` keeps, with their columns.

    The texts are counted twice, for the estimate and for the filter; they pass Python once each time and are not shuffled or written.
    """
    fitted = estimate(with_stats(rows.select(text), text).withColumn("votes", votes(rules)), rules)
    place = rows.columns.index(text)
    held = counted(rows.select(F.struct(*rows.columns).alias("row")), ["row"], lambda batch: batch.column(0).field(place))
    return held.where(~base_failed() & (posterior_column(fitted, rules) >= keep)).select("row.*")
