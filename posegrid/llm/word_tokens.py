"""Word-end BPE of a `tokenizers` file, for many distinct words at once in numpy.

Reads the file's vocabulary and merges; text is NFC, lower case per character, white space is dropped, words split
by the file's pattern, bytes mapped to characters, the last character carries the word end. All distinct words of a
chunk merge side by side: in each round every word merges its leftmost pair of least rank.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex

from .csr import Rows

NONE = np.int64(1) << 40
#: Distinct white-space-free strings remembered by one worker before it starts afresh.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class PairTable:
    """Open-addressing hash table from pairs of ids to (rank, merged id)."""

    BITS = 18

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        self.bits = max(self.BITS, len(pairs).bit_length() + 2)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int64)
        self.new = np.zeros(size, np.int64)
        keys = np.array([(a << 20) | b for a, b in pairs], np.int64)
        homes = self._home(keys)
        self.reach = 1
        for rank, (key, at, new) in enumerate(zip(keys.tolist(), homes.tolist(), merged, strict=True)):
            far = 1
            while self.keys[at] != -1:
                at, far = (at + 1) % size, far + 1
            self.keys[at], self.rank[at], self.new[at] = key, rank, new
            self.reach = max(self.reach, far)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left << 20) | right
        at = self._home(keys)
        rank, new = np.full(len(keys), NONE, np.int64), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.reach):
            here = self.keys[at]
            hit = here == keys
            rank[open_[hit]], new[open_[hit]] = self.rank[at[hit]], self.new[at[hit]]
            go = ~hit & (here != -1)
            if not go.any():
                break
            open_, keys, at = open_[go], keys[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return rank, new


class WordBpe:
    def __init__(self, path):
        """path: of a file, or an open one."""
        with open(path, encoding="utf-8") if isinstance(path, str) else path as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = byte_characters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.table = PairTable([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.forget()

    def forget(self) -> None:
        self.word_at: dict[bytes, int] = {}
        self.words = Rows()  # chunk -> its parts
        self.part_at: dict[bytes, int] = {}
        self.parts = Rows()  # part -> its ids

    def split(self, word: bytes) -> list[bytes]:
        s = word.decode("utf-8", "replace")
        if not s.isascii():
            s = unicodedata.normalize("NFC", s)
            s = "".join(map(str.lower, s)) if "Σ" in s else s.lower()
        else:
            s = s.lower()
        return [s.encode()] if s.isalpha() else [p.encode() for p in self.pattern.findall(s)]

    def learn(self, words) -> None:
        """Adds words (white-space-free UTF-8) that are not known yet."""
        if len(self.word_at) > REMEMBERED:
            self.forget()
        fresh, split, known = [], self.split, self.part_at
        for word in set(words).difference(self.word_at):
            parts = []
            for p in split(word):
                at = known.get(p)
                if at is None:
                    at = known[p] = len(known)
                    fresh.append(p)
                parts.append(at)
            self.word_at[word] = self.words.add(parts)
        if fresh:
            lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
            self.parts.extend(*self.merge(np.frombuffer(b"".join(fresh), np.uint8), lengths))

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each word has."""
        self.learn(words)
        at = np.fromiter(map(self.word_at.__getitem__, words), np.int64, len(words))
        parts, n_parts = self.words.gather(at)
        ids, n_ids = self.parts.gather(parts.astype(np.int64))
        ends = np.concatenate(([0], np.cumsum(n_ids)))
        cuts = np.concatenate(([0], np.cumsum(n_parts)))
        return ids, ends[cuts[1:]] - ends[cuts[:-1]]

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of non-empty byte words: flat ids, and the number of ids of each word."""
        sym = self.inner[data]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.final[data[ends]]
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank, new = np.full(len(sym), NONE, np.int64), np.zeros(len(sym), np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], new[inside] = self.table.find(sym[inside], sym[inside + 1])
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            live = best < NONE
            if not live.all():
                mask = np.repeat(live, sizes)
                done_sym.append(sym[~mask])
                done_word.append(word[~mask])
                sym, word, rank, new = sym[mask], word[mask], rank[mask], new[mask]
                best, sizes = best[live], sizes[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = word[at]
            at = at[np.concatenate(([True], owner[1:] != owner[:-1]))]
            sym[at] = new[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
            at = at - np.arange(len(at))
            touched = np.concatenate((at, at[at > 0] - 1))
            rank[touched] = NONE
            pairs = touched[touched + 1 < len(sym)]
            pairs = pairs[word[pairs] == word[pairs + 1]]
            rank[pairs], new[pairs] = self.table.find(sym[pairs], sym[pairs + 1])
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(len(lengths), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(lengths))
