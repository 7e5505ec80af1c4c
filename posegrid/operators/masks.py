"""Masks as (mask, point) membership tables: overlaps, exclusive ownership, smoothing, set repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame | None = None, mask: str = "mask_id", point: str = "point_id") -> DataFrame:
    """Pairs of masks that share points: a, b, both, size_a, size_b, iou. Within one table pairs are a < b."""
    own = left.select(F.col(mask).alias("a"), F.col(point).alias("p")).distinct()
    other = own.select(F.col("a").alias("b"), "p") if right is None else right.select(F.col(mask).alias("b"), F.col(point).alias("p")).distinct()
    pairs = own.join(other, "p")
    if right is None:
        pairs = pairs.where("a < b")
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("both"))
    sizes_a = own.groupBy("a").agg(F.count("*").alias("size_a"))
    sizes_b = other.groupBy("b").agg(F.count("*").alias("size_b"))
    return both.join(sizes_a, "a").join(sizes_b, "b").withColumn("iou", F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).select("a", "b", "both", "size_a", "size_b", "iou")


def owner(membership: DataFrame, point: list[str], order: list[Column]) -> DataFrame:
    """One row of each point: the first by the given order, which must end in something unique."""
    w = Window.partitionBy(*point).orderBy(*order)
    return membership.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def majority(points: DataFrame, segment: str, label: str, share: float = 0.5) -> DataFrame:
    """Points with `smoothed`: the label that holds more than `share` of their segment, else their own."""
    votes = points.groupBy(segment, label).agg(F.count("*").alias("n"))
    total = votes.groupBy(segment).agg(F.sum("n").alias("size"), F.max_by(label, F.struct(F.col("n"), F.negative(label))).alias("best"), F.max("n").alias("most"))
    wins = total.where(F.col("most") > share * F.col("size")).select(segment, F.col("best").alias("winner"))
    return points.join(wins, segment, "left").withColumn("smoothed", F.coalesce("winner", label)).drop("winner")


def repaired(base: DataFrame, peer: DataFrame, mode: str, mask: str = "mask_id", point: str = "point_id") -> DataFrame:
    """supplement: base and the masks that only peer has; union: rows of either; intersection: rows of both."""
    a, b = base.select(mask, point).distinct(), peer.select(mask, point).distinct()
    if mode == "supplement":
        return a.unionByName(b.join(a.select(mask).distinct(), mask, "left_anti"))
    return a.unionByName(b).distinct() if mode == "union" else a.join(b, [mask, point], "left_semi")


def without_nested(masks: DataFrame, contained: float = 0.9, larger: float = 1.5, mask: str = "mask_id", point: str = "point_id") -> DataFrame:
    """(mask, point) of masks (mask, parent, label, point) without the points of masks nested in them: of the same parent and another
    label, `contained` inside, and with the outer mask `larger` times the area. Rows with a null take no part."""
    m = masks.select(mask, "parent", "label", point).dropna().distinct()
    sizes = m.groupBy(mask, "parent", "label").agg(F.count("*").alias("n"))
    own = m.select(F.col(mask).alias("big"), "parent", F.col("label").alias("l1"), point)
    other = m.select(F.col(mask).alias("small"), "parent", F.col("label").alias("l2"), point)
    both = own.join(other, ["parent", point]).where("big <> small AND l1 <> l2").groupBy("big", "small").agg(F.count("*").alias("k"))
    nest = both.join(sizes.select(F.col(mask).alias("big"), F.col("n").alias("n1")), "big").join(sizes.select(F.col(mask).alias("small"), F.col("n").alias("n2")), "small")
    nest = nest.where((F.col("k") >= contained * F.col("n2")) & (F.col("n1") >= larger * F.col("n2"))).select(F.col("big").alias(mask), "small")
    gone = nest.join(m.select(F.col(mask).alias("small"), point), "small").select(mask, point)
    return m.select(mask, point).join(gone, [mask, point], "left_anti")
