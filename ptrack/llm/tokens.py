"""Whole texts to token ids with the tokenizers library.

Both vocabularies split a text into pieces before they merge, and no piece spans
the step from a letter or sign to a blank. A text may hence be cut there, each
distinct chunk be encoded once per worker, and the ids be put together as arrays."""
from __future__ import annotations

import os
import re

import numpy as np
import pyarrow.compute as pc

from ptrack.llm.common import kept

# Characters that some engines count as blanks and others do not: such texts are encoded uncut.
UNSURE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
CONTROLS = re.compile("[\x1c-\x1f]")
REMEMBERED = 500_000                 # chunks of a generation, about 150 bytes each in the younger one, 30 in the older
CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# A blank at most, letters that normalising leaves whole, and signs, which are pieces of their own.
WORD = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)")
PROBES = ("a", " a", "Word", " Word", "WORDS,", " It.", "a\xf1o", " \xc0\xd6\xd8\xf6\xf8\xff\xdf", " \xc9t\xe9!\")", "x'", " y_-")
TAILS = 10_000                       # signs after words that are remembered


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def _letters() -> dict:
    """Bytes as the letters that stand for them in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(own))
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


LETTERS = _letters()


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run of the given length."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _hashes(chunks) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of chunks, in two arrays."""
    import xxhash
    of = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([of(c.encode("utf-8", "surrogatepass")) for c in chunks]), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class Places(dict):
    """Chunk -> place; collects the chunks not met before."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, chunk: str) -> int:
        k = self[chunk] = len(self)
        self.new.append(chunk)
        return k


class Encoder:
    """Ids of many texts. Remembers chunks in two generations of up to `limit` each: what is met
    again moves from the older one to the younger, so frequent chunks stay and rare ones go."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        self.limit = limit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one thread for each task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.drops_blanks = self._ids(" a\n") == self._ids("a")
        # a text that names a special token is encoded uncut, as such a token may reach over blanks
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = self._ids("A") == self._ids("a")
        self.tails: dict = {}
        self.older = _hashes([])
        self.older_of = (np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32))
        self._renew()
        # only where the vocabulary treats words as `_word` does
        self.merges = self.tokenizer.model
        self.plain = all(self._word(w) == self._ids(w) for w in PROBES)

    def _ids(self, text: str) -> list:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, chunk: str) -> list | None:
        """Ids of a plain word, from the merges of its letters; None for any other chunk."""
        found = WORD.fullmatch(chunk)
        if not found:
            return None
        word, tail = found.groups()
        if self.drops_blanks:
            word = word.lstrip(" ")
        if self.lowers:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(LETTERS)
        elif word[0] == " ":
            word = "\u0120" + word[1:]
        ids = [t.id for t in self.merges.tokenize(word)]
        if tail:
            if tail not in self.tails:
                if len(self.tails) >= TAILS:
                    self.tails.clear()
                self.tails[tail] = self._ids(tail)
            ids += self.tails[tail]
        return ids

    def _renew(self) -> None:
        self.at = Places()
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _turn(self) -> None:
        """The younger generation becomes the older one: its chunks are kept as hashes in order, which
        take a sixth of a dictionary's memory."""
        hi, lo = _hashes(self.at)
        order = np.argsort(hi)
        self.older_of = (self.ids[:self.used].copy(), self.start[order].astype(np.int32), self.length[order].astype(np.int32))
        self.older = hi[order], lo[order]
        self._renew()

    def _met(self, chunks: list) -> np.ndarray:
        """Places of the chunks in the older generation, -1 for others. Where two chunks of a generation
        had the first half of their hashes alike, the second one would be taken for new."""
        hi, lo = self.older
        if not len(hi):
            return np.full(len(chunks), -1)
        first, second = _hashes(chunks)
        at = np.searchsorted(hi, first)
        at[at == len(hi)] = 0
        return np.where((hi[at] == first) & (lo[at] == second), at, -1)

    def _add(self, places: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        self.ids = grown(self.ids, self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[places] = self.used + np.cumsum(length) - length
        self.length[places] = length
        self.used += len(ids)

    def _learn(self) -> None:
        """Take new chunks over from the older generation, or encode them: words by the merges, others each by
        itself but in one call."""
        new, self.at.new = self.at.new, []
        first = len(self.at) - len(new)
        self.start, self.length = grown(self.start, len(self.at)), grown(self.length, len(self.at))
        old = self._met(new)
        ids, start, length = self.older_of
        kept_ = np.flatnonzero(old >= 0)
        if len(kept_):
            n = length[old[kept_]]
            self._add(first + kept_, ids[_spread(start[old[kept_]], n)], n)
        rest = np.flatnonzero(old < 0)
        if len(rest) and self.plain:
            many, ids, others = [], [], []
            for i in rest.tolist():
                word = self._word(new[i])
                if word is None:
                    others.append(i)
                else:
                    many.append(len(word))
                    ids += word
            others = np.array(others, np.int64)
            self._add(first + np.setdiff1d(rest, others, assume_unique=True), np.array(ids, np.uint32), np.array(many, np.int64))
            rest = others
        if len(rest):
            found = self.tokenizer.encode([new[i] for i in rest.tolist()], is_pretokenized=True, add_special_tokens=False)
            self._add(first + rest, np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(rest)))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each text)"""
        if len(self.at) > self.limit or self.used > 8 * self.limit:
            self._turn()
        flat, many = [], []
        for text in texts:
            sure = (text.isascii() and not CONTROLS.search(text) or not UNSURE.search(text)) and not any(m in text for m in self.marks)
            chunks = (text.split() if self.drops_blanks else CHUNK.findall(text)) if sure else [text]
            many.append(len(chunks))
            flat += chunks
        which = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        if self.at.new:
            self._learn()
        length = self.length[which]
        ends = np.cumsum(length)
        ids = self.ids[_spread(self.start[which], length)]
        at = np.concatenate([[0], np.cumsum(many, dtype=np.int64)]).astype(np.int64)
        return ids, np.diff(np.concatenate([[0], ends])[at])


def encoder(path: str, limit: int = REMEMBERED) -> Encoder:
    """The encoder of a worker process."""
    return kept(("encoder", path, limit), lambda: Encoder(path, limit))


def slices(texts: list, chars: int = 2_000_000):
    """Runs of texts of bounded total length (at least one text each)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > chars:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def text_runs(texts, chars: int = 500_000):
    """(first row, texts) for runs of an Arrow column of texts, of bounded total length in bytes (at least one
    text each): a batch may hold long texts, and is never turned into Python objects as a whole."""
    size = np.asarray(pc.binary_length(texts), dtype=np.int64)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > chars:
            yield at, texts.slice(at, i - at).to_pylist()
            at, total = i, 0
        total += n
    if at < len(size):
        yield at, texts.slice(at).to_pylist()
