"""Secret scan: fixed patterns, and password guess cost in credential contexts.

The base kinds are fixed patterns on the UTF-8 bytes of the text. The kind `guess` adds values in a credential context
(a credential key, `:` or `=`, a value without white space) that no base span covers and that are hard to guess: the
least cost of any segmentation of the value into words, dates, repeats, keyboard walks and brute-force spans is at least
MIN_COST powers of ten. Costs add over the spans, so one pass of dynamic programming finds the least.

Defined results: null text is empty; overlapping spans of different kinds stay; ties of start go by kind in the order of
KINDS; positions are code points, ends exclusive; long texts are read whole; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_batches, written

KINDS = ("assign", "access", "hex", "guess")
#: The base patterns.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16

CONTEXT = re.compile(rb"""(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization)["']?\s*(?:=>|[:=])\s*["']?([^\s"'<>,;]{8,})""")
CONTEXT_KEYS = (*ASSIGN_KEYS, b"passphrase", b"passcode", b"pwd", b"api-key", b"access", b"private", b"credential", b"authorization")
MIN_COST = 9.0

#: Words that guessers try first, commonest first.
WORDS = """password admin welcome login secret master hello monkey dragon letmein football baseball sunshine princess shadow
superman batman trustno qwerty iloveyou starwars freedom whatever computer internet service server root user guest test
demo example sample default changeme change temp temporary public private company office summer winter spring autumn
january february march april june july august september october november december monday friday database oracle mysql
postgres backup system manager operator support access token apikey account money love baby angel michael jordan
hunter soccer hockey ranger buster thomas robert daniel george charlie andrew michelle jessica ashley pepper ginger
cookie banana orange purple silver golden diamond magic power king queen star blue green black white red the and your
my key pass word one two abc foo bar none null true false value string placeholder redacted xxxx here insert""".split()
RANK = {w.encode(): i + 1 for i, w in reversed(list(enumerate(WORDS)))}
SHORTEST_WORD, LONGEST_WORD = 3, 20
#: Words that are learned from a corpus; they rank behind WORDS.
LEARNED = 50_000
LETTERS = re.compile(rb"[a-z]{3,20}(?![a-z])")
KEY_ROWS = (b"`1234567890-=", b"qwertyuiop[]", b"asdfghjkl;'", b"zxcvbnm,./", b"abcdefghijklmnopqrstuvwxyz")
_BESIDE = {(a, b) for row in KEY_ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
DATE = re.compile(rb"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
SPAN_COST = 0.3
_CARD = np.zeros(256)
for _b in range(256):
    _c = chr(_b)
    _CARD[_b] = math.log10(10 if 48 <= _b < 58 else 26 if _b < 128 and _c.isalpha() else 33 if _b < 128 else 100)


def guess_cost(value: bytes, rank_of: dict[bytes, int] = RANK) -> float:
    """log10 of the guesses of the cheapest segmentation. Work is linear in the length but for dates and words of bounded length."""
    n = len(value)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    lower = value.lower()
    card = _CARD[np.frombuffer(value, np.uint8)] if n else np.zeros(0)
    in_brute = np.full(n + 1, np.inf)  # cheapest cost with a brute-force span that ends here

    def reach(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    for at in range(n):
        # brute force goes on, or begins here
        in_brute[at + 1] = min(in_brute[at], best[at] + SPAN_COST) + card[at]
        reach(at + 1, in_brute[at + 1])
        here = best[at] + SPAN_COST
        for size in range(SHORTEST_WORD, min(LONGEST_WORD, n - at) + 1):
            rank = rank_of.get(lower[at : at + size])
            if rank:
                capitals = sum(65 <= b < 91 for b in value[at : at + size])
                reach(at + size, here + math.log10(rank + 1) + (0.3 if capitals in (1, size) else 0.3 * capitals))
        m = DATE.match(value, at)
        if m:
            reach(m.end(), here + math.log10(119) + (math.log10(365) if m.end() - at > 4 else 0))
        if not at or value[at] != value[at - 1]:
            end = at + 1
            while end < n and value[end] == value[at]:
                end += 1
            for stop in {*range(at + 3, min(end, at + 16) + 1), end} if end - at >= 3 else ():
                reach(stop, here + card[at] + math.log10(stop - at))
        for period in range(2, 9):
            if value[at : at + period] == value[at + period : at + 2 * period] and (at < period or value[at - period : at] != value[at : at + period]):
                end = at + 2 * period
                while value[end : end + period] == value[at : at + period]:
                    end += period
                reach(end, here + card[at : at + period].sum() + math.log10((end - at) / period))
        if at + 1 < n and (lower[at], lower[at + 1]) in _BESIDE and not (at and (lower[at - 1], lower[at]) in _BESIDE):
            end, turns, step = at + 1, 1, lower[at + 1] - lower[at]
            while end < n and (lower[end - 1], lower[end]) in _BESIDE:
                turns += lower[end] - lower[end - 1] != step
                step = lower[end] - lower[end - 1]
                end += 1
                if end - at >= 3:
                    reach(end, here + math.log10(47 * (end - at)) + 0.5 * turns)
    return float(best[n])


HEX = np.zeros(258, bool)
HEX[list(b"0123456789abcdef")] = True


def hex_runs(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of maximal runs of MIN_HEX or more lower-case hexadecimal digits, in bytes of the text."""
    mask = HEX[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= MIN_HEX
    out = []
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        text = int(np.searchsorted(offs, a, side="right")) - 1
        while a < b:  # a run may go on in the next text
            stop = min(b, int(offs[text + 1]))
            if stop - a >= MIN_HEX:
                out.append((text, a - int(offs[text]), stop - int(offs[text])))
            a, text = stop, text + 1
    return out


def spans_of(raw: bytes, hexes: list[tuple[int, int]], rank_of: dict[bytes, int] = RANK) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and kind."""
    out = [(a, b, "hex") for a, b in hexes]
    for m in ASSIGN.finditer(raw):
        if m.end(2) - m.start(2) >= MIN_VALUE:
            out.append((m.start(), m.end(), "assign"))
    for m in ACCESS.finditer(raw):
        if m.end() - m.start() >= MIN_ACCESS:
            out.append((m.start(), m.end(), "access"))
    base = sorted((a, b) for a, b, _ in out)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for m in CONTEXT.finditer(raw):
        a, b = m.span(1)
        before = bisect_right(starts, a)
        if not (before and reach[before - 1] >= b) and guess_cost(raw[a:b], rank_of) >= MIN_COST:
            out.append((a, b, "guess"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def found(data: np.ndarray, offs: np.ndarray, rank_of: dict[bytes, int] = RANK) -> dict[int, list[tuple[int, int, str]]]:
    """Spans by text, in code points; texts without any are absent."""
    hexes: dict[int, list] = {}
    for text, a, b in hex_runs(data, offs):
        hexes.setdefault(text, []).append((a, b))
    raw = data.tobytes()
    lower = raw.lower()
    hit = set(hexes)
    for where, keys in ((lower, CONTEXT_KEYS), (raw, (b"AKIA",))):
        for key in keys:
            at = where.find(key)
            while at >= 0:
                text = int(np.searchsorted(offs, at, side="right")) - 1
                hit.add(text)
                at = where.find(key, int(offs[text + 1]))  # on with the next text
    out = {}
    for text in sorted(hit):
        own = raw[offs[text] : offs[text + 1]]
        spans = spans_of(own, hexes.get(text, []), rank_of)
        if spans:
            if not own.isascii():
                before = np.concatenate(([0], np.cumsum((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)))
                spans = [(int(before[a]), int(before[b]), k) for a, b, k in spans]
            out[text] = spans
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEARNED) -> dict[bytes, int]:
    """Ranks of WORDS, then of the commonest other words of all texts, at most `most` and all or none of those about as common.

    A word is a run of 3 to 20 letters a-z, in either case. The ranks are broadcast.
    """

    def run(batches):
        counts: Counter = Counter()
        for _, data, offs in text_batches(batches, limit=1 << 20):
            raw = data.tobytes()
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                counts.update(LETTERS.findall(raw[a:b].lower()))
            if len(counts) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    words = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "word binary, n long")
    step = F.floor(F.log2("n") * 64)
    counts = written(words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("step", step))
    # Steps of a sixty-fourth of an octave: 4096 rows at most. Whole steps are taken, so that `most` words at most reach the driver.
    least, held = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    top = [] if least is None else counts.where(F.col("step") >= least).select("word", "n").collect()
    released(counts)
    ordered = sorted(((-r["n"], bytes(r["word"])) for r in top))
    ranks = {w: len(WORDS) + 1 + i for i, (_, w) in enumerate(ordered)}
    return ranks | RANK


def scan(docs: DataFrame, rank_of: dict[bytes, int] = RANK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256, spans. rank_of: the words that guessers know, by rank."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_of)
    kind = docs.schema[id_col].dataType.simpleString()
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch, data, offs in text_batches(batches):
            n = batch.num_rows
            counts, hashes, spans = np.zeros((3, n), np.int64), [none] * n, [""] * n
            for text, own in found(data, offs, shared.value).items():
                base = [s for s in own if s[2] != "guess"]
                for s in base:
                    counts[KINDS.index(s[2]), text] += 1
                hashes[text] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[text] = joined(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(hashes), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rank_of: dict[bytes, int] = RANK, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns; every found span of the text is replaced by `mark`, overlapping ones by one. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_of)

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        """The new text of those that change, null for the others."""
        values: list = []
        for _, data, offs in text_batches([pa.RecordBatch.from_arrays([text], ["text"])]):
            new: list = [None] * (len(offs) - 1)
            spans = found(data, offs, shared.value)
            raw = data.tobytes() if spans else b""
            for at_text, own in spans.items():
                s, out, at = raw[offs[at_text] : offs[at_text + 1]].decode("utf-8", "replace"), [], 0
                for a, b, _ in own:
                    if a >= at:
                        out += [s[at:a], mark]
                    at = max(at, b)
                new[at_text] = "".join(out) + s[at:]
            values += new
        return pa.array(values, pa.string())

    return docs.withColumn(text_col, F.coalesce(clean(F.coalesce(F.col(text_col), F.lit(""))), F.col(text_col)))
