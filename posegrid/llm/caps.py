"""Embedding near-duplicates with spherical-cap filters.

A filter is a direction; it holds the vectors whose inner product with it exceeds a threshold. Directions are the sums of
one code word per half of the (randomly turned) space, so a vector finds all filters that it exceeds by list decoding:
it takes its products with the few code words of each half, and lists the combinations that reach the threshold. Vectors
are joined on filters; a pair is verified by its cosine in double precision, in the first filter that both share only.

The threshold follows the number of vectors, so that a filter holds about PER_FILTER of them, by the exact tail of the
sphere in that many dimensions (a Gaussian tail is heavier); the code size follows the threshold, so that two vectors at the link's cosine share SHARED filters of each of CODES codes on average. Filters with more than CHUNK vectors
are split into pairs of chunks.

Defined results: vectors that are null, of another length than the commonest, zero or not finite have no links, their
own id as component, and are kept. Equal vectors are one node with a weight, under whatever ids; rows of one id
with different vectors are nodes of their own; null ids take no part and get nulls;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, parts_for, released, starts_of, whole_groups, written
from .components import Forest, components
from .vectors import exact_kind, from_bytes, matrix, takes_part, to_bytes, width_of

COSINE = 0.95
PER_FILTER = 48
#: Independent codes, and how many filters of each two vectors at the limit share on average. One code may cover a dense
#: group badly as a whole; several seldom all do.
CODES = 4
SHARED = 6
CHUNK = 512
ROWS_A_TASK = 150_000
#: Bytes of products with a code's words that are held at a time.
DECODE_BYTES = 16 << 20
#: Narrower vectors are filled up: few dimensions split unevenly in halves, and no sum of two code words is near such a vector.
LEAST_HALF = 8


def sphere_tail(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(angle, share): angles on a grid, and the share of the unit sphere in `dims` dimensions within each of a direction."""
    angle = np.linspace(0, math.pi, 100_001)
    weight = np.sin(angle) ** (dims - 2)
    total = np.concatenate(([0.0], np.cumsum(weight[1:] + weight[:-1])))
    return angle, total / total[-1]


class Code:
    """Structured random product code in `width` dimensions, for about n vectors."""

    def __init__(self, n: int, width: int, cosine: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.half = max(LEAST_HALF, (width + 1) // 2)
        dims = 2 * self.half
        # The sum of two code words, shortened to length one, is a random direction, so its products follow the sphere's tail.
        angle, within = sphere_tail(dims)
        # A cap narrower than the limit's angle would part most pairs at the limit.
        share = max(min(0.1, PER_FILTER / max(n, 1)), float(np.interp(math.acos(cosine), angle, within)))
        cap = float(np.interp(share, within, angle))
        t = math.cos(cap)
        # P(the second vector exceeds too | the first does), over the first's angle to the direction
        v = (np.arange(2000) + 0.5) * cap / 2000
        weight = np.sin(v) ** (dims - 2)
        needed = (t - cosine * np.cos(v)) / (math.sqrt(max(1 - cosine**2, 1e-12)) * np.sin(v))
        beside, share_beside = sphere_tail(dims - 1)
        too = float((weight * np.where(needed > 1, 0, np.interp(np.arccos(np.clip(needed, -1, 1)), beside, share_beside))).sum() / weight.sum())
        self.words = max(4, math.ceil(math.sqrt(SHARED / too / share)))
        self.codes = []
        for _ in range(CODES):
            turn = np.linalg.qr(rng.standard_normal((2 * self.half, 2 * self.half)))[0][:width]  # odd and small widths are filled up with zeros
            halves = [rng.standard_normal((self.half, self.words)) for _ in range(2)]
            self.codes.append((turn, *(c / np.linalg.norm(c, axis=0) for c in halves)))
        self.threshold = t * math.sqrt(2)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the unit vectors exceed, by row and filter."""
        found = []
        for k, (turn, first, second) in enumerate(self.codes):
            x = unit @ turn
            a, b = x[:, : self.half] @ first, x[:, self.half :] @ second
            order = np.argsort(-b, axis=1)
            found.append((k * self.words**2, a, order, -np.take_along_axis(b, order, axis=1)))
        rows, filters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in range(len(unit)):
            own = []
            for base, a, order, falling in found:
                reach = np.searchsorted(falling[r], a[r] - self.threshold, side="right")
                i = np.repeat(np.arange(self.words), reach)
                j = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
                own.append(np.sort(base + i * self.words + order[r][j]))
            filters += own
            rows.append(np.full(sum(map(len, own)), r))
        return np.concatenate(rows), np.concatenate(filters).astype(np.int64)


def link_blocks(a: np.ndarray, b: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a cosine of at least `cosine`; with b None, pairs i < j inside a."""
    s = a @ (a if b is None else b).T
    if b is None:
        s = np.triu(s, 1)
    return np.nonzero(s >= cosine)


def share_none_before(before: list[np.ndarray], other: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the lists before[i] and other[j] have nothing in common."""
    seen = np.unique(np.concatenate([*before, *other, np.zeros(0, np.int64)]))
    if not len(seen):
        return np.ones(len(i), bool)

    def marks(lists):
        m = np.zeros((len(lists), len(seen)), np.float32)
        for r, own in enumerate(lists):
            m[r, np.searchsorted(seen, own)] = 1
        return m

    return (marks(before) @ marks(other).T)[i, j] == 0


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    width = width_of(rows, vector_col)
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept")]
    if not width:
        return base.select("vec_id", *alone)
    valid = takes_part("v", width) & F.col("vec_id").isNotNull()
    exact = exact_kind(rows, vector_col)
    vectors = written(base.where(valid).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")))
    # The number is fixed by writing it.
    nodes = written(vectors.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult")).withColumn("node", F.monotonically_increasing_id()))
    code = spark.sparkContext.broadcast(Code(nodes.count(), width, cosine))

    def filters(batches):
        step = max(1, min(2000, DECODE_BYTES // (8 * code.value.words)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = matrix(part.column("v"), width)
                r, f = code.value.decode(x / np.linalg.norm(x, axis=1, keepdims=True))
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(f), part.column("node").take(take), part.column("mult").take(take), pa.array(to_bytes(x, exact), pa.binary()).take(take)], ["f", "node", "mult", "x"])

    placed = written(nodes.select("node", "mult", "v").mapInArrow(filters, "f long, node long, mult long, x binary"))
    keys = ["f", "lo", "hi"]
    dealt = in_parts(placed, ["f"], "node", chunk).select(*keys, "c", "node", "mult", "x")
    dealt = dealt.repartition(parts_for(spark, placed.count(), ROWS_A_TASK), *keys).sortWithinPartitions(*keys, "c", "node")

    def verify(batches):
        for t in whole_groups(batches, keys):
            yield linked(t)

    def linked(t: pa.Table) -> pa.RecordBatch:
        f, lo, hi, c, name, mult = (t.column(n).to_numpy() for n in ("f", "lo", "hi", "c", "node", "mult"))
        x = from_bytes(t.column("x"), width, exact)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        ids, node = np.unique(name, return_inverse=True)
        forest, links = Forest(len(ids)), np.zeros(len(ids), np.int64)
        memo: dict[int, np.ndarray] = {}

        def listed(rows: np.ndarray) -> list[np.ndarray]:
            """All filters of each row, those that aren't known yet decoded together."""
            new = rows[[int(node[k]) not in memo for k in rows.tolist()]]
            step = max(1, DECODE_BYTES // (8 * code.value.words))
            for at in range(0, len(new), step):
                r, g = code.value.decode(x[new[at : at + step]])
                cuts = np.searchsorted(r, np.arange(len(new[at : at + step]) + 1))
                for i, k in enumerate(new[at : at + step].tolist()):
                    memo[int(node[k])] = g[cuts[i] : cuts[i + 1]]
            return [memo[int(node[k])] for k in rows.tolist()]

        starts = starts_of(t, keys)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(f)).tolist(), strict=True):
            if b - a < 2:
                continue
            if lo[a] == hi[a]:
                left, right, (i, j) = a, a, link_blocks(x[a:b], None, cosine)
            else:
                m = a + int(np.searchsorted(c[a:b], hi[a]))
                left, right, (i, j) = a, m, link_blocks(x[a:m], x[m:b], cosine)
            if not len(i):
                continue
            ui, i2 = np.unique(i, return_inverse=True)
            uj, j2 = np.unique(j, return_inverse=True)
            cut = lambda rows: [own[: np.searchsorted(own, f[a])] for own in listed(rows)]  # noqa: E731, B023
            first = share_none_before(cut(left + ui), cut(right + uj), i2, j2)
            p, q = left + i[first], right + j[first]
            np.add.at(links, node[p], mult[q])
            np.add.at(links, node[q], mult[p])
            forest.join(node[p], node[q])
        some = links > 0
        low, other = forest.links(ids)
        kinds = np.concatenate((np.zeros(int(some.sum()), np.int32), np.ones(len(low), np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate((ids[some], low))), pa.array(np.concatenate((links[some], other)))], ["kind", "a", "b"])

    found = written(dealt.mapInArrow(verify, "kind int, a long, b long"))
    released(placed)
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "member")
    home = nodes.join(links, F.col("node") == F.col("a"), "left").join(roots, F.col("node") == F.col("member"), "left")
    home = written(home.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")))
    least = home.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(home.join(least, "root").select("v", "n_links", "component_id"))
    joined = vectors.join(named, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return joined.unionByName(base.where(~valid).select("vec_id", *alone))
