"""Byte-level BPE by prefix dynamic programming, and its decoding.

Every byte prefix of a piece has exactly one valid last token: the one whose predecessor, the last token of the prefix
before it, forms with it a pair that BPE would not merge across. Storing that token for each prefix encodes the piece
from left to right; bytes can be appended by going on, and after an edit only the prefixes behind it are computed anew.

Text is cut into pieces by the vocabulary's pattern. A worker remembers the ids of the strings between spaces, so the
pattern and the programming run once per distinct string. Texts in which a space touches other white space go through
the pattern whole.

Defined results: null text encodes as the empty text (no ids, digests of nothing); repeated rows stay; long texts and
long pieces need memory in proportion to their length; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_batches
from .csr import Rows

#: Distinct strings and token pairs remembered by one worker before it starts afresh.
REMEMBERED = 600_000
REMEMBERED_PAIRS = 3_000_000
#: Marks a string that has no space before it; a lone surrogate can't occur in a text.
BARE = "\ud800"
MIXED_SPACE = re.compile(r" \s|\s ")


def plain_merge(ranks: dict[bytes, int], piece: bytes, limit: int) -> list[bytes]:
    """BPE with the merges of rank below limit."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """Ranks, for each token the two tokens that its last merge joins, and the merges by pair. Bounded by the file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        n = max(self.ranks.values()) + 1
        self.left, self.right, self.joined = list(range(n)), list(range(n)), {}
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = plain_merge(self.ranks, token, rank)
                if len(parts) == 2:
                    a, b = self.ranks[parts[0]], self.ranks[parts[1]]
                    self.left[rank], self.right[rank], self.joined[a, b] = a, b, rank
        tokens = [b""] * n
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_ends = np.cumsum([0, *map(len, tokens)])
        by_end: dict[bytes, set[int]] = {}
        for token in self.ranks:
            by_end.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {k: sorted(v, reverse=True) for k, v in by_end.items()}

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the number of bytes of each."""
        starts = self.token_ends[ids]
        sizes = self.token_ends[ids + 1] - starts
        return self.token_bytes[spread(starts, sizes)], sizes


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.pattern = vocabulary, regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.cache, self.rows, self.pieces = _Cache(self), Rows(), {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether BPE of both tokens' bytes gives the two tokens: no merge across the seam comes before those inside."""
        v, below, x, y = self.v, 1 << 60, a, b
        while True:
            # x ends and y begins at the seam when all merges of rank under `below` are done
            across = v.joined.get((x, y))
            if across is not None and across < below:
                return False
            step_x = v.left[x] != x
            step_y = v.left[y] != y
            if x > y and step_x or not step_y and step_x:
                below, x = x, v.right[x]
            elif step_y:
                below, y = y + 1, v.left[y]
            else:
                return True

    def prefixes(self, piece: bytes, last: list[int], ends: list[int]) -> None:
        """Extends `last` (the last token of each prefix, from the empty one) over the whole piece."""
        ranks, lengths, pairs = self.v.ranks, self.v.lengths, self.pairs
        for end in range(len(last), len(piece) + 1):
            for size in lengths.get(piece[max(0, end - 2) : end], ()):
                if size > end:
                    continue
                token = ranks.get(piece[end - size : end])
                if token is None:
                    continue
                if size < end:
                    key = last[end - size] << 32 | token
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self.stays_apart(last[end - size], token)
                    if not ok:
                        continue
                last.append(token)
                ends.append(end - size)
                break
            else:
                token = ranks[piece[end - 1 : end]]  # a single byte always is a token
                last.append(token)
                ends.append(end - 1)

    def piece(self, piece: bytes) -> list[int]:
        whole = self.v.ranks.get(piece)
        if whole is not None:
            return [whole]
        last, ends = [-1], [0]
        self.prefixes(piece, last, ends)
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at = ends[at]
        return out[::-1]

    def string(self, text: str) -> list[int]:
        out, known = [], self.pieces
        for p in self.pattern.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = known[p] = self.piece(p.encode("utf-8", "surrogatepass"))
            out += ids
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids of each."""
        if len(self.cache) > REMEMBERED:
            self.forget()
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs.clear()
        keys, counts = [], []
        for text in texts:
            if MIXED_SPACE.search(text):
                own = [BARE + p for p in self.pattern.findall(text)]
            elif text:
                own = text.split(" ")
                own[0] = BARE + own[0]
            else:
                own = []
            keys += own
            counts.append(len(own))
        at = np.fromiter(map(self.cache.__getitem__, keys), np.int64, len(keys))
        ids, sizes = self.rows.gather(at)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        cuts = ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
        return ids, np.diff(cuts)


class _Cache(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, key: str) -> int:
        e = self.encoder
        at = self[key] = e.rows.add(e.string(key[1:] if key[:1] == BARE else " " + key))
        return at


class Editable:
    """A piece with its prefixes' last tokens: appends and edits compute only what lies behind them."""

    def __init__(self, encoder: Encoder, piece: bytes = b""):
        self.encoder, self.piece, self.last, self.ends = encoder, b"", [-1], [0]
        self.append(piece)

    def append(self, more: bytes) -> Editable:
        self.piece += more
        self.encoder.prefixes(self.piece, self.last, self.ends)
        return self

    def replace(self, start: int, end: int, by: bytes) -> Editable:
        tail = self.piece[end:]
        self.piece = self.piece[:start]
        del self.last[start + 1 :], self.ends[start + 1 :]
        return self.append(by + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at])
            at = self.ends[at]
        return out[::-1]


_ENCODERS: dict = {}


def _encoder(shared, pattern: str) -> Encoder:
    key = (shared.value.token_bytes.size, hash(shared.value.token_bytes[-4096:].tobytes()), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value, pattern)
    return _ENCODERS[key]


def _sha(data: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = memoryview(np.ascontiguousarray(data)).cast("B")
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per document: id, n_tokens and ids; with digests the hashes of the ids and of the decoded bytes in their place."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = _encoder(shared, pattern)
        for batch, data, offs in text_batches(batches):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            ids, sizes = encoder.texts(texts)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64())]
            if digests:
                back, widths = encoder.v.decode(ids.astype(np.int64))
                back_ends = np.concatenate(([0], np.cumsum(widths)))[ends]
                columns += [pa.array(_sha(ids.astype("<u4"), ends * 4)), pa.array(_sha(back, back_ends))]
            else:
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the bytes of its ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        v = shared.value
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            out = [None if r is None else v.decode(np.array(r, np.int64))[0].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded binary")
