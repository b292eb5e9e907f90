"""Subword ids of whole texts with the public word-piece vocabulary, cached by word.

The tokenizer drops white space and never joins pieces across it, so the ids of a text are those of
its words in a row. Words repeat; their ids are kept in a table of bounded size in each worker, and
words that are new in a batch go to the tokenizer in one call.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import numpy as np
import regex

from vectorloom.llm.text import worker_cache

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")  # fixed by the vocabulary file
# str.split() cuts at the first four, the tokenizer does not; the last begins a special token.
DIRECT = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
CACHED_WORDS = 600_000
FILE = "word_bpe_49k.json"
END = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # Parts are normalised and split already; without these steps the same model takes less time.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        tokens = (self.tokenizer.id_to_token(i) or "" for i in range(size))
        self.closes = np.array([t.endswith("</w>") for t in tokens], bool)

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of pre-split parts: one call, cut where a word ends."""
        joined = self.merges.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0]
        ids = np.asarray(joined.ids, "<u4")
        cuts = np.flatnonzero(self.closes[ids]) + 1
        if len(cuts) != len(parts):
            return {part: self.direct(part) for part in parts}
        raw, begins = ids.tobytes(), [0, *(4 * cuts[:-1]).tolist()]
        return {p: raw[a:b] for p, a, b in zip(parts, begins, (4 * cuts).tolist())}

    def split(self, word: str) -> list[str]:
        if word.isascii():
            return [word.lower()] if word.isalpha() else WORDS.findall(word.lower())
        return WORDS.findall(self.tokenizer.normalizer.normalize_str(word))

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        split = {w: self.split(w) for w in words}
        new = list(set().union(*split.values()).difference(self.parts))
        fresh = self.learn_parts(new) if new else {}
        found = {w: b"".join([self.parts.get(p) or fresh[p] for p in parts]) for w, parts in split.items()}
        room = max(self.limit - len(self.parts), 0)
        self.parts.update(islice(fresh.items(), room))
        return found

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Single words, in which nothing of `DIRECT` occurs."""
        found = list(map(self.known.get, words))
        late = [k for k, x in enumerate(found) if x is None]
        if late:
            learned = self.learn({words[k] for k in late})
            self.known.update(islice(learned.items(), max(self.limit - len(self.known), 0)))
            for k in late:
                found[k] = learned[words[k]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts of known words take one pass; the new words of the others are learned together first."""
        find = self.known.__getitem__
        out: list[bytes | None] = []
        late: list[tuple[int, list[str]]] = []
        for text in texts:
            if any(odd in text for odd in DIRECT):
                out.append(self.direct(text))
                continue
            words = text.split()
            try:
                out.append(b"".join(map(find, words)))
            except KeyError:
                late.append((len(out), words))
                out.append(None)
        if late:
            found = self.learn(set().union(*(words for _, words in late)).difference(self.known))
            room = max(self.limit - len(self.known), 0)
            self.known.update(found)
            for place, words in late:
                out[place] = b"".join(map(find, words))
            for word in islice(found, room, None):  # what there is no room for
                del self.known[word]
        return out


class NumberedWords:
    """Ids of texts whose words are cut already; words with a number are encoded once and then copied.

    A number stands for one word in small letters. A text in which the tokenizer may cut elsewhere is encoded whole.
    """

    def __init__(self, encoder: Encoder, count: int):
        self.encoder = encoder
        self.begins, self.lengths = np.zeros(count, np.int64), np.full(count, -1, np.int64)
        self.ids = np.empty(0, "<u4")

    def learn(self, numbers: np.ndarray, words: list[str]) -> None:
        found = self.encoder.encode_words(words)
        lengths = np.array([len(x) // 4 for x in found], np.int64)
        self.begins[numbers] = len(self.ids) + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])

    def encode(self, raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the offsets of the texts in them; a word without a number has -1."""
        data = raw.tobytes()
        if b"<|" in data or ((raw >= 0x1C) & (raw <= 0x1F)).any():
            texts = [data[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
            found = self.encoder.encode(texts)
            return np.frombuffer(b"".join(found), "<u4"), np.cumsum([0, *(len(x) // 4 for x in found)])
        if not data.isascii():
            # Capitals become small after accents have joined their letters, so these words are taken as they stand.
            odd, large = (np.cumsum(np.concatenate([[0], x]), dtype=np.int32) for x in (raw >= 128, (raw >= 65) & (raw <= 90)))
            numbers = np.where((odd[ends] > odd[starts]) & (large[ends] > large[starts]), -1, numbers)
        cut = lambda at: [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        late = np.flatnonzero((numbers >= 0) & (self.lengths[numbers] < 0))
        if len(late):
            new, at = np.unique(numbers[late], return_index=True)
            self.learn(new, cut(late[at]))
        begins, lengths = self.begins[numbers], self.lengths[numbers]
        rest = np.flatnonzero(numbers < 0)
        found = self.encoder.encode_words(cut(rest))
        lengths[rest] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins[rest] = len(self.ids) + np.cumsum(lengths[rest]) - lengths[rest]
        source = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        offset = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(begins - offset[:-1], lengths)
        at += np.arange(len(at))
        return source.take(at), offset[bounds]


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    kept = worker_cache()
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
