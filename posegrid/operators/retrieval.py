"""A stated set of queries against all rows, block by block.

Rows and queries are dealt to blocks of bounded size by their ids' hashes; every pair of blocks meets in one small task, which
hands on only each query's best. Neither side is broadcast or collected, and a task's memory does not grow with the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _blocks(df: DataFrame, block: int) -> int:
    return max(1, math.ceil(df.count() / block))


def top_scores(queries: DataFrame, rows: DataFrame, k: int, unit: bool = False, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """a, b, score, k: the k rows (id, vector and, if queries have it, group) of greatest inner product with each query.

    `unit` makes it the cosine (0 for a zero vector). Rows of the query's own non-null group are left out; scores are rounded before
    they are ranked, ties go to the smaller id. Null vectors and ids take no part. Vectors are of one width, ids are unique and long.
    """
    grouped = "group" in queries.columns
    side = lambda df: df.dropna(subset=["id", "vector"]).select(F.col("id").cast("long").alias("id"), (F.col("group").cast("string") if grouped else F.lit(None).cast("string")).alias("group"), F.col("vector").cast("array<double>").alias("vector"))
    asked, all_ = side(queries), side(rows)
    nq, nr = _blocks(asked, block), _blocks(all_, block)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", deal(nq)).withColumn("rb", every(nr))
    right = all_.withColumn("rb", deal(nr)).withColumn("qb", every(nq))

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        r = r.sort_values("id", ignore_index=True)
        u, v = np.stack(q["vector"].to_numpy()), np.stack(r["vector"].to_numpy())
        ids, out = r["id"].to_numpy(), []
        own = r["group"].to_numpy()
        long = np.sqrt((v * v).sum(axis=1))
        for i, (a, g) in enumerate(zip(q["id"], q["group"], strict=True)):
            s = (v * u[i]).sum(axis=1)  # one query at a time: sums don't depend on the block
            if unit:
                s = s / np.maximum(long * np.sqrt((u[i] * u[i]).sum()), 1e-12)
            s = np.round(s, digits)
            if grouped and g is not None:
                s = np.where(own == g, -np.inf, s)
            at = np.argsort(-s, kind="stable")[:k]
            at = at[np.isfinite(s[at])]
            out.append(pd.DataFrame({"a": a, "b": ids[at], "score": s[at]}))
        return pd.concat(out)

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(best, "a long, b long, score double")
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))
    return ranked.where(F.col("k") <= k)
