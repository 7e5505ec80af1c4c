"""Graph fix-points on tables: components, alias resolution, uniqueness, edge clean-up."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder that the session names; a temporary one only in local mode. A cluster must name one."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="posegrid-"))
    return df.checkpoint()


FEW = 200_000  # rows of a few numbers: some MB


def few(df: DataFrame) -> DataFrame:
    """Written, counted, and broadcast where that is at most FEW rows."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= FEW else df


def resolve(aliases: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """End of every alias chain, by pointer doubling; a negative target ends a chain. Cycles are an error."""
    at = settled(aliases.select(F.col(source).alias("source"), F.col(target).alias("target")))
    for _ in range(40):
        on = at.select(F.col("source").alias("s2"), F.col("target").alias("t2"))
        step = at.join(on, (F.col("target") == F.col("s2")) & (F.col("source") != F.col("target")), "left")
        step = settled(step.select("source", F.coalesce("t2", "target").alias("target"), (F.col("t2").isNotNull() & (F.col("t2") != F.col("target"))).alias("moved")))
        at = step.select("source", "target")
        if not step.where("moved AND source = target").isEmpty():
            break
        if step.where("moved").isEmpty():
            return at
    raise ValueError("alias chain without an end")


def connected(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, component): least id reachable. Hooks to the least neighbour and jumps, so rounds grow with the logarithm."""
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = settled(nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("component")).distinct())
    while True:
        seen = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("low"))
        hooked = label.join(seen, label["id"] == seen["a"], "left").select("id", F.least("component", F.coalesce("low", "component")).alias("next"), "component")
        up = hooked.select(F.col("id").alias("up_id"), F.col("next").alias("up"))
        jumped = hooked.join(up, F.col("next") == F.col("up_id"), "left").select("id", F.least("next", F.coalesce("up", "next")).alias("next"), "component")
        jumped = settled(jumped)
        changed = not jumped.where("next <> component").isEmpty()
        label = jumped.select("id", F.col("next").alias("component"))
        if not changed:
            return label


def unique_partners(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Pairs whose both ends have no other partner: ambiguity is kept, not resolved by score."""
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    return pairs.withColumn("__l", n(left)).withColumn("__r", n(right)).where("__l = 1 AND __r = 1").drop("__l", "__r")


def acyclic(pairs: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Pairs whose parent is nobody's child."""
    children = pairs.select(F.col(child).alias("__c")).distinct()
    return pairs.join(children, pairs[parent] == F.col("__c"), "left_anti")


def without_dangling(edges: DataFrame, removed: DataFrame, id_col: str = "id") -> DataFrame:
    gone = removed.select(F.col(id_col).alias("__g"))
    return edges.join(gone, edges["a"] == gone["__g"], "left_anti").join(gone, edges["b"] == gone["__g"], "left_anti")


def between_living(edges: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    live = nodes.select(F.col(id_col).alias("__n"))
    return edges.join(live, edges["a"] == live["__n"], "left_semi").join(live, edges["b"] == live["__n"], "left_semi")


def role_partners(pairs: DataFrame, child: str = "child", parent: str = "parent", support: str = "support") -> DataFrame:
    """Pairs whose child has one possible parent in its role; a support's parent must have no other support either."""
    n = lambda c: F.count("*").over(Window.partitionBy(c, support))
    p = pairs.select(child, parent, support).dropna().distinct().withColumn("__c", n(child)).withColumn("__p", n(parent))
    return p.where((F.col("__c") == 1) & ((F.col("__p") == 1) | ~F.col(support))).drop("__c", "__p")
