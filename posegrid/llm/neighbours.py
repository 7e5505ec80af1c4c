"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns the unit vectors by three rounds of random signs and a fast Hadamard transform; a vector's bucket is the
signed axis that is nearest to the turned vector. Every row is indexed in every table. A query probes the buckets of its nearest signed
axes in each table, the candidates there are ranked by their exact inner product on the original vectors, and the tasks' best are merged.
For vectors of different norms one more component makes the largest inner product the nearest direction.

Queries for which fewer than k rows were found probe every bucket of one table, which is exact. Buckets with over CHUNK rows
or queries are dealt out in chunks of both; every chunk of queries visits every chunk of rows. Vectors travel in the precision of
their column. Rows whose norms agree to one in a thousand (their squares to SAME_NORM) are hashed as they are, since the nearest direction then is the largest
product but for ties within that; other rows get the further component. Results are ranked exactly either way.

Defined results: null, zero and non-finite vectors, those of another length than the commonest, and null ids take no part; ties go to the
smaller id; of rows with equal ids the best counts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, released, starts_of, whole_groups, written
from .vectors import exact_kind, from_bytes, matrix, takes_part, to_bytes, width_of

#: Reach a recall of 0.95 at k = 20 on unit vectors without structure; clustered ones need less.
TABLES = 24
PROBES = 5
CHUNK = 20_000
SAME_NORM = 0.998
ROWS_A_TASK = 150_000
ROUNDS = 3
BLOCK = 2048


class Rotations:
    def __init__(self, width: int, tables: int, seed: int = 5):
        self.width = width
        self.size = 1 << max(1, (width - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, ROUNDS, self.size))

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for signs in self.signs[table]:
            y *= signs
            h = 1
            while h < self.size:
                z = y.reshape(len(y), -1, 2, h)
                y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), axis=2).reshape(len(y), -1)
                h *= 2
        return y

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n nearest signed axes of each row, nearest first."""
        y = self.turned(x, table)
        both = np.concatenate((y, -y), axis=1)
        if n == 1:
            return both.argmax(axis=1)[:, None]
        return np.argsort(-both, axis=1, kind="stable")[:, :n]


def nearest(
    rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, chunk: int = CHUNK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (inner product in double precision). queries: which rows, by columns of `rows`."""
    out = "query_id long, rank int, vec_id long, score double"
    width = width_of(rows, vector_col)
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    if not width:
        return rows.sparkSession.createDataFrame([], out)
    vectors = written(base.where(takes_part("v", width) & F.col("vec_id").isNotNull()))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = vectors.agg(F.count("*").alias("n"), F.max(squares).alias("most"), F.min(squares).alias("least")).first()
    if not facts["n"]:
        return rows.sparkSession.createDataFrame([], out)
    top = facts["most"] if facts["least"] < SAME_NORM * facts["most"] else None
    exact = exact_kind(rows, vector_col)
    first = _search(vectors, vectors.where("asks"), k, width, top, tables, probes, chunk, exact)
    asked = vectors.where("asks").select(F.col("vec_id").alias("query_id")).distinct()
    enough = min(k, facts["n"] - 1)
    found = first.groupBy("query_id").count().where(F.col("count") >= enough)
    short = written(asked.join(found, "query_id", "left_anti"))
    if short.isEmpty():
        return first
    again = vectors.where("asks").join(short, F.col("vec_id") == F.col("query_id"), "left_semi")
    every = 2 * Rotations(width + (top is not None), 1).size
    return written(first.join(short, "query_id", "left_anti").unionByName(_search(vectors, again, k, width, top, 1, every, chunk, exact)))


def _search(vectors: DataFrame, asking: DataFrame, k: int, width: int, top: float | None, tables: int, probes: int, chunk: int, exact) -> DataFrame:
    spark = vectors.sparkSession
    turns = Rotations(width + (top is not None), tables)

    def placed(asks: bool):
        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    x = matrix(part.column("v"), width)
                    raw = pa.array(to_bytes(x, exact), pa.binary())
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    if top is not None:
                        unit = np.hstack([unit if asks else x, np.zeros((len(x), 1))])
                        if not asks:
                            unit[:, -1] = np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))
                    for t in range(tables):
                        at = turns.probes(unit, t, probes if asks else 1)
                        who = np.repeat(np.arange(len(x)), at.shape[1])
                        take = pa.array(who)
                        yield pa.RecordBatch.from_arrays([pa.array((t << 32) + at.ravel().astype(np.int64)), part.column("vec_id").take(take), raw.take(take)], ["bucket", "id", "x"])

        return run

    kinds = "bucket long, id long, x binary"
    index = indexed = written(vectors.select("vec_id", "v").mapInArrow(placed(False), kinds))
    asked = probing = written(asking.select("vec_id", "v").mapInArrow(placed(True), kinds))
    # At most (rows indexed and asked) / chunk buckets are crowded.
    sizes = index.select("bucket", F.lit(1).alias("i"), F.lit(0).alias("q")).unionByName(asked.select("bucket", F.lit(0).alias("i"), F.lit(1).alias("q"))).groupBy("bucket").agg(F.sum("i").alias("i"), F.sum("q").alias("q"))
    crowded = written(sizes.where((F.col("i") > chunk) | (F.col("q") > chunk)).select("bucket", *(F.greatest(F.ceil(F.col(n) / chunk), F.lit(1)).cast("int").alias(f"k{n}") for n in "iq")))
    if crowded.isEmpty():
        index, asked = (d.select("*", F.lit(0).alias("c"), F.lit(0).alias("d")) for d in (index, asked))
    else:
        one = F.lit(1)
        own = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(f"k{n}", one)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(f"k{n}", one) - 1))
        index = index.join(crowded, "bucket", "left").withColumn("c", own("i")).withColumn("d", every("q"))
        asked = asked.join(crowded, "bucket", "left").withColumn("d", own("q")).withColumn("c", every("i"))
    keys = ["bucket", "c", "d"]
    both = index.select(*keys, F.lit(0).alias("asks"), "id", "x").unionByName(asked.select(*keys, F.lit(1).alias("asks"), "id", "x"))
    dealt = both.repartition(parts_for(spark, indexed.count(), ROWS_A_TASK), *keys).sortWithinPartitions(*keys, "asks", "id")

    def rank(batches):
        best = Best(k)
        for t in whole_groups(batches, keys):
            asks, ids = t.column("asks").to_numpy(), t.column("id").to_numpy()
            x = from_bytes(t.column("x"), width, exact)
            starts = starts_of(t, keys)
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(ids)).tolist(), strict=True):
                m = a + int(np.searchsorted(asks[a:b], 1))
                for lo in range(m, b, BLOCK):
                    for from_ in range(a, m, BLOCK):
                        best.add(ids[lo : min(b, lo + BLOCK)], ids[from_ : min(m, from_ + BLOCK)], x[lo : min(b, lo + BLOCK)] @ x[from_ : min(m, from_ + BLOCK)].T)
            if best.size > Best.FULL // 2:
                yield from best.rows()
                best = Best(k)
        yield from best.rows()

    found = dealt.mapInArrow(rank, "query_id long, vec_id long, score double")
    unique = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = written(unique.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    released(indexed, probing)
    return out


class Best:
    """The k best candidates of each query that one task has met."""

    FULL = 1 << 21

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(queries[:, None] == ids[None, :], -np.inf, scores)
        if scores.shape[1] > self.k:
            pick = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]  # ids ascend, so ties keep the smaller
        else:
            pick = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        part = (np.repeat(queries, pick.shape[1]), ids[pick].ravel(), np.take_along_axis(scores, pick, axis=1).ravel())
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.FULL:
            self.shrink()

    def shrink(self) -> None:
        if not self.parts:
            return
        q, v, s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        own = s > -np.inf
        q, v, s = q[own], v[own], s[own]
        order = np.lexsort((-s, v, q))
        q, v, s = q[order], v[order], s[order]
        first = np.concatenate(([True], (q[1:] != q[:-1]) | (v[1:] != v[:-1]))) if len(q) else np.zeros(0, bool)
        q, v, s = q[first], v[first], s[first]
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        if len(q):
            starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
            q, v, s = q[place < self.k], v[place < self.k], s[place < self.k]
        self.parts, self.size = [(q, v, s)], len(q)

    def rows(self):
        self.shrink()
        for q, v, s in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])
