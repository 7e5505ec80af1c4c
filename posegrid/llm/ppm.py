"""Code lengths by prediction by partial matching, with a word unigram baseline.

The model is a trie of byte contexts up to ORDER bytes, counted over all training documents. A symbol that a context
knows has probability (count - 1/2) / total; the mass distinct / (2 total) escapes to the context without
its first byte, whose probabilities are divided among the symbols that the longer context does not know (symbol
exclusion by renormalisation). Below the empty context all 256 bytes are equally likely. 0xFF, which no UTF-8 text holds,
stands before a text as often as a context is long and ends it; the end is a symbol like the others. Texts are lower-cased in A-Z.

Neither the trie nor the vocabulary is held in one place. Documents are dealt into blocks of about BLOCK_BYTES, runs of
rows of one input file; an input that isn't plain files is written as such first. Each block's distinct words and windows (a context and its symbol) go to shards: words by their hash, windows by
the last bytes of their context, so that a shard holds whole subtrees of the trie. Shards add the counts up over all blocks, work out the
probability of every window that occurs, and return to each block what its words and windows are worth. Contexts of LOW
bytes and less, 256 ** (LOW + 1) windows at most, are broadcast. Shards are as many as the text asks for; a window shard with over
HOT entries is added up and looked up in parts, so every task is bounded however large the input is.

Defined results: null text is empty: one end token, and one end symbol after the start context; texts are read whole;
repeated rows are each counted and scored; a null id's remainder is that of the empty text; without training documents all counts are zero (base
score as the formula gives it, model score uniform); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, chunks, parts_for, released, rescannable, text_batches, written

ORDER = 5  # at most: a window is packed into six bytes
#: Contexts of so many bytes and less are broadcast.
LOW = 2
EDGE = 0xFF
SCORE_BYTES = 1 << 20
#: Text of a block, and for each shard.
BLOCK_BYTES = 24 << 20
SHARD_BYTES = 16 << 20
LEAST_SHARDS = 64
#: Entries of a window shard that one task adds up.
HOT = 4_000_000
WORDS, WINDOWS, SHORT = range(3)


def symbols(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the (order + 1)-byte windows that end in each symbol, the end included; first symbol of each text."""
    n = len(offs) - 1
    sizes = np.diff(offs)
    padded = np.full(len(data) + n * (order + 1) + 8, EDGE, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(n) * (order + 1) + order, sizes)
    padded[at] = data
    # Eight bytes from every position, read big-endian; the first order + 1 of them are the window.
    eight = np.ndarray((len(padded) - 8 - order,), ">u8", padded, strides=(1,))
    code = (eight.astype(np.uint64) >> np.uint64(8 * (7 - order))).astype(np.int64)
    # windows that would begin in one text's end and reach into the next are those that end in the next's padding
    keep = np.ones(len(code), bool)
    ends = np.cumsum(sizes + order + 1)[:-1]
    for k in range(order):
        keep[ends - order + k] = False
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    return code[keep], starts


class Level:
    """Contexts of one length: sorted codes, totals, distinct symbols, and their (context, symbol) entries."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, count: np.ndarray):
        seq = (context << 8) | symbol
        order = np.argsort(seq)
        self.seq, self.count = seq[order], count[order].astype(float)
        ctx = self.seq >> 8
        self.starts = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, np.int64)
        self.context = ctx[self.starts]
        self.distinct = np.diff(np.append(self.starts, len(ctx))).astype(float)
        self.total = np.add.reduceat(self.count, self.starts) if len(ctx) else np.zeros(0)
        self.known = (self.count - 0.5) / np.repeat(self.total, self.distinct.astype(int))
        self.left = np.ones(len(self.context))  # mass of the shorter context that isn't excluded

    def exclude(self, shorter: Level | None, length: int) -> None:
        if not len(self.seq):
            return
        if shorter is None:
            below = np.full(len(self.seq), 1 / 256)
        else:
            at, hit = found(shorter.seq, self.seq & ((1 << (8 * length)) - 1))
            below = np.where(hit, shorter.known[at], 0.0) if len(shorter.seq) else np.zeros(len(self.seq))
        self.left = np.maximum(1 - np.add.reduceat(below, self.starts), 1e-12)


def found(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def counted_levels(seq: np.ndarray, count: np.ndarray, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(contexts, symbols, counts) of the levels low..high, from distinct windows of high + 1 bytes."""
    out = []
    for k in range(high, low - 1, -1):
        seq, count = _summed([(seq & ((1 << (8 * (k + 1))) - 1), count)])
        out.append((seq >> 8, seq & 255, count))
    return out[::-1]


class Trie:
    """levels[k]: (contexts of k bytes, symbols, counts); a level holds every symbol of each context it has.

    below: the finished levels of the shortest contexts, where `levels` begins above them.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], below: list[Level] = ()):
        self.levels = [*below, *(Level(*x) for x in levels)]
        for k in range(len(below), len(self.levels)):
            self.levels[k].exclude(self.levels[k - 1] if k else None, k)

    def probability(self, seq: np.ndarray) -> np.ndarray:
        """Of the last byte of each window after the bytes before it. Every level looks at each of its windows once, in order."""
        chain = [(seq, np.arange(len(seq)))]
        for k in range(len(self.levels) - 1, -1, -1):
            chain.append(np.unique(chain[-1][0] & ((1 << (8 * (k + 1))) - 1), return_inverse=True))
        p = np.full(len(chain[-1][0]), 1 / 256)
        for k, level in enumerate(self.levels):
            own, up = chain[len(self.levels) - k]
            if len(level.seq):
                c, there = found(level.context, own >> 8)
                e, known = found(level.seq, own)
                escape = 0.5 * level.distinct[c] / level.total[c] / level.left[c]
                p = np.where(known, level.known[e], np.where(there, p * escape, p))
            p = p[up]
        return p


def _summed(codes: list) -> tuple[np.ndarray, np.ndarray]:
    unique = np.concatenate([u for u, _ in codes]) if codes else np.zeros(0, np.int64)
    at, unique = pd.factorize(unique)
    n = np.bincount(at, weights=np.concatenate([n for _, n in codes]), minlength=len(unique)) if codes else np.zeros(0)
    return unique.astype(np.int64), n.astype(np.int64)


def _cut(keys: np.ndarray, n: np.ndarray, shard: np.ndarray):
    """(shard, keys, n) of each shard that occurs; the order within a shard is kept."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    keys, n, shard = keys[order], n[order], shard[order]
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(shard)).tolist(), strict=True):
        yield int(shard[a]), keys[a:b], n[a:b]


class Block:
    """Words and windows of a block's documents, with their counts in the training documents."""

    def __init__(self, order: int):
        self.order, self.words, self.others, self.codes, self.size = order, Counter(), set(), [], 0

    def add(self, data: np.ndarray, offs: np.ndarray, train: np.ndarray) -> None:
        raw = data.tobytes().lower()
        for a, b, own in zip(offs[:-1].tolist(), offs[1:].tolist(), train.tolist(), strict=True):
            self.words.update(raw[a:b].split()) if own else self.others.update(raw[a:b].split())
        seq, _ = symbols(np.frombuffer(raw, np.uint8), offs, self.order)
        at, unique = pd.factorize(seq)
        mine = np.repeat(train, np.diff(offs) + 1)
        self.codes.append((unique, np.bincount(at if mine.all() else at[mine], minlength=len(unique))))
        if len(self.codes) > 8:
            self.codes = [_summed(self.codes)]
        self.size += len(raw)

    def rows(self, shards: int):
        """(kind, shard, keys, n) with n as 32-bit counts."""
        words = [*self.words, *(w for w in self.others if w not in self.words)]
        n = np.zeros(len(words), np.uint32)
        n[: len(self.words)] = np.fromiter(self.words.values(), np.int64, len(self.words))
        home = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards
        for shard, which, count in _cut(np.arange(len(words)), n, home):
            yield WORDS, shard, b"\n".join([words[i] for i in which.tolist()]), count
        seq, n = _summed(self.codes)
        for shard, keys, count in _cut(seq, n.astype(np.uint32), _home(seq, min(LOW + 1, self.order), shards)):
            yield WINDOWS, shard, packed(keys), count
        known = n > 0
        short, n = _summed([(seq[known] & ((1 << (8 * (min(LOW, self.order) + 1))) - 1), n[known])])
        for shard, keys, count in _cut(short, n.astype(np.uint32), _home(short, min(LOW, self.order), LEAST_SHARDS)):
            yield SHORT, shard, packed(keys), count


def _home(seq: np.ndarray, length: int, shards: int) -> np.ndarray:
    """Shard of the last `length` bytes of each window's context."""
    suffix = (seq >> 8).astype(np.uint64) & np.uint64((1 << (8 * length)) - 1)
    return ((suffix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % shards


def _by_shard(batches, names: list[str]):
    """(key, rows) for each run of equal keys; rows as an iterator, to be read before the next key. names: the key's columns."""

    def each():
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            keys = [np.asarray(batch.column(n)).tolist() for n in names]
            for i, key in enumerate(zip(*keys, strict=True)):
                yield key, [c[i] for c in columns]

    for key, rows in groupby(each(), key=lambda r: r[0]):
        yield key, (r for _, r in rows)


def packed(seq: np.ndarray) -> bytes:
    """Windows of up to six bytes: all their high halves, then all their low ones."""
    return (seq >> 32).astype(np.uint16).tobytes() + seq.astype(np.uint32).tobytes()


def unpacked(raw) -> np.ndarray:
    n = len(raw) // 6
    return (np.frombuffer(raw, np.uint16, n).astype(np.int64) << 32) | np.frombuffer(raw[2 * n :], np.uint32)


def _ints(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _added(rows) -> tuple[np.ndarray, np.ndarray]:
    """Sum of rows (.., keys, n): distinct windows and counts, a bounded number of rows at a time."""
    held: list = []
    total = pending = 0
    for r in rows:  # n has 32 bits in a block, 64 in a sum
        seq = unpacked(r[-2].as_py())
        held.append((seq, _ints(r[-1], np.uint32 if len(r[-1].as_buffer()) == 4 * len(seq) else np.int64)))
        pending += len(seq)
        if pending > max(2 * total, 1_000_000):
            held = [_summed(held)]
            total, pending = len(held[0][0]), 0
    return _summed(held)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    low = min(LOW, order)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), train.alias("train"))
    if not rescannable(texts):
        texts = written(texts)
    facts = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows"), F.count_if("train").alias("ends")).first()
    shards, ends = max(LEAST_SHARDS, -(-facts["bytes"] // SHARD_BYTES)), facts["ends"]
    parts = parts_for(spark, facts["bytes"], SHARD_BYTES)
    run = max(1, block_bytes * facts["rows"] // max(1, facts["bytes"]))
    texts = texts.select("*", F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / run)).alias("block"))

    def count(batches):
        """Words and windows of each block; a task may see a part of a block only."""
        at, block = None, Block(order)

        def closed():
            rows, held = [], 0
            for r in block.rows(shards):
                rows.append(r)
                held += len(r[2])
                if held > 4 << 20:
                    yield blobs(rows)
                    rows, held = [], 0
            if rows:
                yield blobs(rows)

        def blobs(rows):
            n = len(rows)
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([at] * n, pa.int64()), pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3].tobytes() for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["kind", "shard", "block", "size", "keys", "n"])

        for whole in batches:
            home = np.asarray(whole.column("block"))
            cuts = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(home) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(home)).tolist(), strict=True):
                for batch, data, offs in text_batches([whole.slice(a, b - a)], limit=SCORE_BYTES):
                    if block.codes and (home[a] != at or block.size >= block_bytes):
                        yield from closed()
                        block = Block(order)
                    at = int(home[a])
                    block.add(data, offs, np.asarray(batch.column("train").fill_null(False)).astype(bool))
        if block.codes:
            yield from closed()

    counted = written(texts.mapInArrow(count, "kind int, shard int, block long, size long, keys binary, n binary"))

    def word_counts(batches):
        """To each block the counts of its words over all blocks, and the tokens and distinct words of the shard."""
        for (shard,), rows in _by_shard(batches, ["shard"]):
            own = [(r[1], r[2], r[2].as_py().split(b"\n"), _ints(r[3], np.uint32)) for r in rows]
            total: dict = {}
            for _, _, words, n in own:
                for w, c in zip(words, n.tolist(), strict=True):
                    total[w] = total.get(w, 0) + c
            all_ = np.fromiter(total.values(), np.int64, len(total))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([int(all_.sum())], pa.int64()), pa.array([int((all_ > 0).sum())], pa.int64())], names)
            for block, keys, words, _ in own:
                values = np.fromiter(map(total.__getitem__, words), np.int64, len(words))
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([keys.as_py()], pa.binary()), pa.array([values.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)

    names = ["block", "keys", "worth", "tokens", "distinct"]
    rows = counted.where(F.col("kind") == WORDS).select("shard", "block", "keys", "n")
    words = written(rows.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(word_counts, "block long, keys binary, worth binary, tokens long, distinct long"))
    found_ = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    all_tokens, distinct = found_["n"] + ends, found_["v"] + (ends > 0)

    def added(batches):
        """Sums by the first column, or the first two."""
        for key, rows in _by_shard(batches, ["shard", "salt"]):
            seq, n = _added(rows)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([packed(seq)], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["shard", "keys", "n"])

    def summed(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt").mapInArrow(added, "shard int, keys binary, n binary")

    # 256 ** (low + 1) windows at most.
    short = summed(counted.where(F.col("kind") == SHORT).select("shard", F.lit(0).alias("salt"), "keys", "n")).select("keys", "n").collect()
    seqs = [(unpacked(r["keys"]), np.frombuffer(r["n"], np.int64)) for r in short]
    below = spark.sparkContext.broadcast(Trie(counted_levels(*_summed(seqs), 0, low)).levels)

    windows = counted.where(F.col("kind") == WINDOWS).select("shard", "block", "size", "keys", "n")
    # At most (entries of all blocks) / hot shards are split.
    crowded = written(windows.groupBy("shard").agg(F.sum("size").alias("size")).where(F.col("size") > hot).select("shard", F.ceil(F.col("size") / hot).cast("int").alias("k")))
    salted = windows.withColumn("salt", F.lit(0))
    split = not crowded.isEmpty()
    if split:
        salted = windows.join(crowded, "shard", "left").withColumn("salt", F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("block"), F.col("k")).cast("int")))
        totals = written(summed(salted.select("shard", "salt", "keys", "n"))).select("shard", F.lit(0).alias("salt"), "keys", "n")
    else:
        totals = salted.select("shard", "salt", "keys", "n")

    def model(batches):
        """The log10 probability of every window of a shard, in the order of the windows."""
        for (shard, _), rows in _by_shard(batches, ["shard", "salt"]):
            seq, n = _added(rows)
            at = np.argsort(seq)
            seq, n = seq[at], n[at]
            known = n > 0
            trie = Trie(counted_levels(seq[known], n[known], low + 1, order), below.value)
            worth = np.concatenate([np.log10(trie.probability(seq[a : a + (1 << 20)])) for a in range(0, len(seq), 1 << 20)])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed(seq)], pa.binary()), pa.array([worth.tobytes()], pa.binary())], ["shard", "keys", "worth"])

    models = written(totals.repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt").mapInArrow(model, "shard int, keys binary, worth binary"))
    if split:
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))
        placed = models.join(crowded, "shard", "left").select("shard", salts.alias("salt"), "keys", "worth")
    else:
        placed = models.withColumn("salt", F.lit(0))
    asked = placed.select("shard", "salt", F.lit(None).cast("long").alias("block"), "keys", "worth").unionByName(salted.select("shard", "salt", "block", "keys"), allowMissingColumns=True)

    def answer(batches):
        """To each block what its windows are worth; a shard's model sorts before the blocks that ask."""
        for _, rows in _by_shard(batches, ["shard", "salt"]):
            first = next(rows)
            seq, worth = unpacked(first[3].as_py()), _ints(first[4], np.float64)
            for r in rows:
                own = worth[np.searchsorted(seq, unpacked(r[3].as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[2].as_py()], pa.int64()), pa.array([r[3].as_py()], pa.binary()), pa.array([own.tobytes()], pa.binary())], ["block", "keys", "worth"])

    ordered = asked.select("shard", "salt", "block", "keys", "worth").repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", F.asc_nulls_first("block"))
    answers = written(ordered.mapInArrow(answer, "block long, keys binary, worth binary"))
    released(counted, models)
    told = words.where("block IS NOT NULL").select("block", F.lit(0).alias("role"), "keys", "worth").unionByName(answers.select("block", F.lit(1).alias("role"), "keys", "worth"))
    asking = texts.select("block", F.lit(2).alias("role"), "doc_id", "text", "train")
    floor = all_tokens + 0.5 * (distinct + 1)

    def rate(batches):
        """A block's words, then its windows, then its documents."""
        at, counts, held, table = None, {}, [], None
        for batch in batches:
            block, role = np.asarray(batch.column("block")), np.asarray(batch.column("role"))
            cuts = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (role[1:] != role[:-1])))) if len(block) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(block)).tolist(), strict=True):
                own = batch.slice(a, b - a)
                if block[a] != at:
                    at, counts, held, table = block[a], {}, [], None
                if role[a] == 0:
                    for keys, worth in zip(own.column("keys").to_pylist(), own.column("worth"), strict=True):
                        counts.update(zip(keys.split(b"\n"), _ints(worth, np.int64).tolist(), strict=True))
                elif role[a] == 1:
                    held += [(unpacked(k.as_py()), _ints(w, np.float64).copy()) for k, w in zip(own.column("keys"), own.column("worth"), strict=True)]
                else:
                    if table is None:
                        seq = np.concatenate([k for k, _ in held])
                        by = np.argsort(seq)
                        table, held = (seq[by], np.concatenate([w for _, w in held])[by]), []
                    for part, data, offs in text_batches([own], limit=SCORE_BYTES):
                        yield scored(part, data, offs, counts, *table)

    def scored(part, data, offs, counts, keys, worth):
        raw = data.tobytes().lower()
        low_, n = np.frombuffer(raw, np.uint8), part.num_rows
        seq, starts = symbols(low_, offs, order)
        which, unique = pd.factorize(seq)
        score_ = np.add.reduceat(worth[np.searchsorted(keys, unique)][which], starts)
        split_ = [raw[a:b].split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        sizes = np.fromiter(map(len, split_), np.int64, n)
        c = np.zeros(int(sizes.sum()) + n)
        last = np.cumsum(sizes + 1) - 1
        is_word = np.ones(len(c), bool)
        is_word[last] = False
        c[is_word] = np.fromiter(map(counts.__getitem__, chain.from_iterable(split_)), np.int64, int(sizes.sum()))
        c[last] = ends
        first = last - sizes
        base = np.add.reduceat(np.log10((c + 0.5) / floor), first)
        known = np.add.reduceat((c > 0).astype(np.int64), first)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("train"), pa.array(sizes + 1), pa.array(known), pa.array(np.full(n, all_tokens, np.int64)), pa.array(base), pa.array(score_)], ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = told.unionByName(asking, allowMissingColumns=True).select("block", "role", "keys", "worth", "doc_id", "text", "train")
    # Blocks are dealt by hash; four times as many tasks as blocks keep two from meeting often.
    return both.repartition(parts_for(spark, 4 * facts["bytes"], block_bytes), "block").sortWithinPartitions("block", "role").mapInArrow(rate, out)
