"""Who owns surface: transfers to a bounded owner, peers verified in views, masks folded over views, painted frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AXES, distance
from . import graphs
from . import kernels as K
from . import spatial

PAINTED_MOST = 255  # ids of a frame fit a byte


def refined(original: Column, positive: Column, visible: Column) -> Column:
    """A point stays unless two or more views all deny it; two or more views that are two thirds of all add it."""
    added = (positive >= 2) & (positive / F.greatest(visible, F.lit(1)) >= 2 / 3)
    return (original & ~((visible >= 2) & (positive == 0))) | added


def verified_peers(seeds: DataFrame, visible: DataFrame, hits: DataFrame, scores: DataFrame, least: int = 32, cover: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(choices, points): the best mask of each peer in each view, and every point's counts and verdict.

    seeds (peer, point), visible (frame, point), hits (frame, peer, mask, point), scores (frame, peer, mask, score); repeated rows
    count once, rows with a null key not at all. A view needs `least` visible seed points. Quality is the root of coverage times
    purity, times the score; ties go to the smaller mask, and the best must cover `cover` of the seed."""
    s, v, h = seeds.select("peer", "point").dropna().distinct(), visible.select("frame", "point").dropna().distinct(), hits.select("frame", "peer", "mask", "point").dropna().distinct()
    h = h.join(v, ["frame", "point"], "left_semi")
    seen = s.join(v, "point").groupBy("frame", "peer").agg(F.count("*").alias("seed")).where(F.col("seed") >= least)
    counts = h.join(s.withColumn("own", F.lit(1)), ["peer", "point"], "left").groupBy("frame", "peer", "mask").agg(F.count("*").alias("size"), F.count("own").alias("both"))
    share = F.col("both") / F.col("seed")
    best = scores.groupBy("frame", "peer", "mask").agg(F.max("score").alias("score")).join(counts, ["frame", "peer", "mask"]).join(seen, ["frame", "peer"])
    # Rounded, so that ties don't hang on the last bit.
    best = best.withColumn("quality", F.round(F.sqrt(share * (F.col("both") / F.col("size"))) * F.col("score"), 9)).withColumn("cover", share)
    w = Window.partitionBy("frame", "peer").orderBy(F.desc("quality"), "mask")
    choices = best.withColumn("k", F.row_number().over(w)).where((F.col("k") == 1) & (F.col("cover") >= cover)).select("frame", "peer", "mask", "cover", "quality")
    looked = choices.select("frame", "peer").join(v, "frame").groupBy("peer", "point").agg(F.count("*").alias("visible"))
    hit = choices.select("frame", "peer", "mask").join(h, ["frame", "peer", "mask"]).groupBy("peer", "point").agg(F.count("*").alias("positive"))
    zero = F.lit(0).cast("long")
    points = s.withColumn("own", F.lit(True)).join(looked, ["peer", "point"], "full").join(hit, ["peer", "point"], "left")
    points = points.select("peer", "point", F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("positive", zero).alias("positive"), F.coalesce("visible", zero).alias("visible"))
    return choices, points.withColumn("kept", refined(F.col("own"), F.col("positive"), F.col("visible")))


def folded_masks(rows: pd.DataFrame, iou: float = 0.25, views: int = 2, least: int = 100) -> list[tuple[list[int], list[int], float]]:
    """Masks (frame, mask, point, score) of one parent, matched view after view: (points, frames, mean score) of every cluster that
    `views` views or more and `least` points or more support. Each view's masks pair with clusters of best total overlap."""
    clusters: list[tuple[set, list, list]] = []
    for frame, seen in rows.sort_values(["frame", "mask", "point"]).groupby("frame"):
        masks = [(set(m["point"]), float(m["score"].iloc[0])) for _, m in seen.groupby("mask")]
        agree = np.array([[len(c & m) / len(c | m) for m, _ in masks] for c, _, _ in clusters]).reshape(len(clusters), len(masks))
        taken = {j: i for i, j in K.assign(agree) if agree[i, j] >= iou}
        for j, (m, score) in enumerate(masks):
            if j in taken:
                points, frames, scores = clusters[taken[j]]
                points |= m
                frames.append(int(frame))
                scores.append(score)
            else:
                clusters.append((set(m), [int(frame)], [score]))
    return [(sorted(map(int, p)), f, float(np.mean(s))) for p, f, s in clusters if len(f) >= views and len(p) >= least]


def sub_proposals(masks: DataFrame, iou: float = 0.25, views: int = 2, least: int = 100) -> DataFrame:
    """parent, k, points, frames, score of masks (parent, frame, mask, point, score), one parent's masks at a time."""

    def run(p):
        found = folded_masks(p, iou, views, least)
        return pd.DataFrame({"parent": p["parent"].iloc[0], "k": range(len(found)), "points": [f[0] for f in found], "frames": [f[1] for f in found], "score": [f[2] for f in found]})

    return masks.dropna().distinct().groupBy("parent").applyInPandas(run, "parent long, k long, points array<long>, frames array<long>, score double")


def bounded_transfer(points: DataFrame, weak: DataFrame, pairs: DataFrame, seeds: DataFrame, semantic: float = 0.6, larger: float = 3.0, inclusion: float = 0.95, cover: float = 0.85, near: float = 0.03) -> DataFrame:
    """source, target, id: the points that a weak aggregate gives to its one maximal owner.

    points (g, id, x, y, z) with unique ids, weak (source), pairs (source, target, semantic), seeds (g). An owner lies inside the
    source, is a third of its volume or less, and the source covers it. A maximal owner lies inside no other fitting owner of twice
    its volume; a source with none or several keeps its points. Points inside the owner's box move, unless another seed that is no
    fitting owner is near. Bounds never grow."""
    p = points.dropna(subset=["g", "id", *AXES])
    box = p.groupBy("g").agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n"))
    sides = [F.greatest(F.col(f"hi{a}") - F.col(f"lo{a}"), F.lit(0.01)) for a in AXES]
    box = box.withColumn("volume", sides[0] * sides[1] * sides[2])
    named = lambda k: box.select(F.col("g").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in box.columns if c != "g"])
    within = lambda k, slack: [F.col(a).between(F.col(f"{k}_lo{a}") - slack, F.col(f"{k}_hi{a}") + slack) for a in AXES]
    asked = pairs.where((F.col("semantic") >= semantic) & (F.col("source") != F.col("target"))).join(weak.select("source").distinct(), "source", "left_semi").join(seeds.select(F.col("g").alias("target")).distinct(), "target", "left_semi")
    asked = asked.select("source", "target").distinct().join(named("source"), "source").join(named("target"), "target").where(F.col("source_volume") >= larger * F.col("target_volume"))
    x, y, z = within("source", 0.015)
    inner = p.withColumnRenamed("g", "target").join(asked, "target").groupBy("source", "target").agg(F.avg((x & y & z).cast("int")).alias("share")).where(F.col("share") >= inclusion).select("source", "target")
    inner = graphs.settled(inner)  # written, like each step below that several others read
    a = p.select(F.col("g").alias("target"), F.col("id").alias("p"), *AXES).join(inner, "target")
    b = p.select(F.col("g").alias("source"), *AXES).join(inner.select("source").distinct(), "source", "left_semi")
    met = spatial.reached(a, b, near, ["source", "target", "p"], ["source"]).groupBy("source", "target").agg(F.count("*").alias("met"))
    fitting = met.join(named("target"), "target").where(F.col("met") >= cover * F.col("target_n")).select("source", "target", "target_volume")
    fitting = graphs.settled(fitting)
    other = fitting.select("source", F.col("target").alias("outer"), F.col("target_volume").alias("outer_volume"))
    nested = fitting.join(other, "source").where(F.col("outer_volume") >= 2 * F.col("target_volume")).select("target", "outer").distinct().join(named("outer"), "outer")
    x, y, z = within("outer", 0.015)
    inside = p.withColumnRenamed("g", "target").join(nested, "target").groupBy("target", "outer").agg(F.avg((x & y & z).cast("int")).alias("share")).where(F.col("share") >= inclusion).select("target", "outer")
    covered = fitting.join(other, "source").join(inside, ["target", "outer"], "left_semi").select("source", "target").distinct()
    maximal = fitting.join(covered, ["source", "target"], "left_anti").withColumn("c", F.count("*").over(Window.partitionBy("source"))).where("c = 1").select("source", "target")
    x, y, z = within("target", 0.0)
    moved = p.withColumnRenamed("g", "source").join(maximal, "source").join(named("target"), "target").where(x & y & z).select("source", "target", "id", *AXES)
    moved = graphs.settled(moved)
    rivals = p.join(seeds.select("g").distinct(), "g", "left_semi").select(F.col("g").alias("rival"), *AXES)
    rivals, owners = rivals.distinct(), fitting.select("source", F.col("target").alias("rival"))
    alien = lambda df: df.where(F.col("rival") != F.col("source")).join(owners, ["source", "rival"], "left_anti")
    at, key = ["cx", "cy", "cz"], ["source", "id"]
    # A rival in the point's own cell of half the width is near; only points without one meet the points of rivals, not of owners.
    cells = spatial.with_cells(rivals, near / 2).select("rival", *at).distinct()
    free = moved.join(alien(spatial.with_cells(moved, near / 2).join(cells, at)).select(*key).distinct(), key, "left_anti")
    free = graphs.settled(free)
    around = spatial.with_cells(free, near).withColumn("n", F.explode(spatial.neighbours())).drop(*at).select(*key, *AXES, "n.*")
    homes = spatial.with_cells(rivals, near).withColumnsRenamed({x: f"r{x}" for x in AXES})
    close = alien(around.join(homes.select("rival", *at).distinct(), at)).join(homes, ["rival", *at])
    close = close.where(distance([F.col(x) for x in AXES], [F.col(f"r{x}") for x in AXES]) <= near)
    return free.join(close.select(*key).distinct(), key, "left_anti").select("source", "target", "id")


def painted(masks: DataFrame, frame: str = "frame", mask: str = "mask_id", pixel: str = "pixel", most: int | None = PAINTED_MOST) -> DataFrame:
    """frame, pixel, mask, local: masks painted largest first, so smaller ones stay on top; equal areas in order of their ids. An
    error where a frame has more than `most` masks, by default those a byte can name; None paints any number."""
    m = masks.select(frame, mask, pixel).dropna().distinct()
    w = Window.partitionBy(frame)
    local = m.groupBy(frame, mask).agg(F.count("*").alias("area")).withColumn("local", F.row_number().over(w.orderBy(F.desc("area"), mask)))
    if most is not None:
        guard = F.when(F.col("all") > most, F.raise_error(F.concat(F.lit("too many masks in frame "), F.col(frame).cast("string"))).cast("int")).otherwise(F.col("local"))
        local = local.withColumn("all", F.count("*").over(w)).select(frame, mask, guard.alias("local"))
    local = local.select(frame, mask, "local")
    return m.join(local, [frame, mask]).groupBy(frame, pixel).agg(F.max(F.struct("local", mask)).alias("top")).select(frame, pixel, F.col(f"top.{mask}").alias(mask), "top.local")
