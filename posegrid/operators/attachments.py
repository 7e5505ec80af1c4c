"""Shapes and attachments of point groups, measured by partial aggregates: a group's points never meet in one task.

Rows with a null group or a null coordinate take no part; a group of one point has no covariance and passes no rule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AXES
from . import spatial

ENTRIES = [(a, b) for i, a in enumerate(AXES) for b in list(AXES)[i:]]
SHAPE = "least double, middle double, largest double, normal array<double>, axis array<double>"
STEM_BANDS = 6  # from 0.2 to 0.8 of the height
LINE_BINS = 12


def _principal(n: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    c = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]], dtype=float).transpose(2, 0, 1)
    known = (n.to_numpy() > 1) & np.isfinite(c).all(axis=(1, 2))
    values, vectors = np.linalg.eigh(np.where(known[:, None, None], c, 0.0))
    return pd.DataFrame({"least": values[:, 0], "middle": values[:, 1], "largest": values[:, 2], "normal": list(vectors[:, :, 0]), "axis": list(vectors[:, :, 2])}).where(pd.Series(known), None)


def shapes(points: DataFrame, group: str) -> DataFrame:
    """One row a group: n, lo*, hi*, mid* (approximate medians, of 1/10000 in rank) and `shape`, its principal variances and axes."""
    known = points.dropna(subset=[group, *AXES])
    aggs = [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max), ("mid", lambda c: F.percentile_approx(c, 0.5, 10000)))]
    rows = known.groupBy(group).agg(F.count("*").alias("n"), *aggs, *[F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in ENTRIES])
    return rows.withColumn("shape", F.pandas_udf(_principal, SHAPE)("n", *[f"c{a}{b}" for a, b in ENTRIES])).drop(*[f"c{a}{b}" for a, b in ENTRIES])


def extent(axis: str):
    return F.col(f"hi{axis}") - F.col(f"lo{axis}")


def line_members(points: DataFrame, group: str) -> DataFrame:
    """group, n, bins and `member`: an upright thin shaft whose height is measured without a long gap."""
    s = shapes(points, group)
    at = F.least(F.floor((F.col("z") - F.col("loz")) / extent("z") * LINE_BINS), F.lit(LINE_BINS - 1))
    bins = points.select(group, "z").join(s.where("hiz > loz").select(group, "loz", "hiz"), group).groupBy(group).agg(F.countDistinct(at).alias("bins"))
    thin = F.col("shape.largest") >= 50 * F.greatest(F.col("shape.least") + F.col("shape.middle"), F.lit(1e-9))
    upright = F.abs(F.col("shape.axis")[2]) >= 0.98
    sized = (extent("z") >= 0.15) & (F.greatest(extent("x"), extent("y")) <= 0.055)
    joined = s.join(bins, group, "left")
    return joined.select(group, "n", F.coalesce("bins", F.lit(0)).alias("bins"), F.coalesce((F.col("n") >= 12) & upright & thin & sized & (F.col("bins") >= 10), F.lit(False)).alias("member"))


def stems(points: DataFrame, group: str, pairs: DataFrame) -> DataFrame:
    """For pairs (body, support): gap, offset, drift and `attached`: the body rests on a narrow, straight stem with a wider foot."""
    p = points.dropna(subset=[group, *AXES]).select(F.col(group).alias("g"), *AXES)
    asked = pairs.select("body", "support").distinct()
    box = p.groupBy("g").agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))], F.avg("x").alias("mx"), F.avg("y").alias("my"))
    # Every support is measured once, however many bodies ask for it.
    wanted = asked.select(F.col("support").alias("g")).distinct()
    height = F.col("hiz") - F.col("loz")
    level = (F.col("z") - F.col("loz")) / height
    band = F.when((level >= 0.2) & (level < 0.8), F.floor((level - 0.2) / (0.6 / STEM_BANDS)))
    rows = p.join(wanted, "g", "left_semi").join(box.where("hiz > loz").select("g", "loz", "hiz"), "g").withColumn("band", band).withColumn("foot", level < 0.15)
    parts = rows.where("band IS NOT NULL OR foot").groupBy("g", "band").agg(F.count("*").alias("n"), *[x for a in "xy" for x in ((F.max(a) - F.min(a)).alias(f"w{a}"), F.avg(a).alias(f"m{a}"))])
    inside = F.col("band").isNotNull()
    stem = parts.groupBy("g").agg(
        F.count_if(inside & (F.col("n") >= 16)).alias("bands"), F.max(F.when(~inside, F.col("n"))).alias("foot"), *[F.median(F.when(inside, F.col(f"w{a}"))).alias(f"w{a}") for a in "xy"],
        *[F.avg(F.when(inside, F.col(f"m{a}"))).alias(f"c{a}") for a in "xy"], *[F.max(F.when(~inside, F.col(f"w{a}"))).alias(f"f{a}") for a in "xy"], F.collect_list(F.when(inside, F.struct("mx", "my"))).alias("centres"),
    )
    stem = stem.withColumn("drift", F.array_max(F.transform("centres", lambda m: F.hypot(m["mx"] - F.col("cx"), m["my"] - F.col("cy"))))).drop("centres")
    own = box.select(F.col("g").alias("body"), *[F.col(f"{n}{a}").alias(f"b{n}{a}") for a in AXES for n in ("lo", "hi")], F.col("mx").alias("bmx"), F.col("my").alias("bmy"))
    joined = asked.join(own, "body").join(box.drop("mx", "my").withColumnRenamed("g", "support"), "support").join(stem.withColumnRenamed("g", "support"), "support", "left")
    near = spatial.range_join(p.withColumnRenamed("g", "body").join(asked.select("body").distinct(), "body", "left_semi"), p.withColumnRenamed("g", "support").join(asked.select("support").distinct(), "support", "left_semi"), 0.02)
    touching = near.select("body", "support").distinct().withColumn("touching", F.lit(True))
    bx, by = F.col("bhix") - F.col("blox"), F.col("bhiy") - F.col("bloy")
    gap, offset = F.col("bloz") - F.col("hiz"), F.hypot(F.col("bmx") - F.col("cx"), F.col("bmy") - F.col("cy"))
    shaped = (height >= 0.2) & (height >= 1.5 * F.greatest(extent("x"), extent("y"))) & (F.least(bx, by) >= 0.05) & gap.between(-0.04, 0.03)
    narrow = (F.col("wx") <= 0.7 * bx) & (F.col("wy") <= 0.7 * by) & (F.col("fx") >= 1.4 * F.col("wx")) & (F.col("fy") >= 1.4 * F.col("wy"))
    straight = (F.col("drift") <= 0.03) & (offset <= 0.15 * F.hypot(bx, by))
    counted = (F.col("bands") == STEM_BANDS) & (F.col("foot") >= 16)
    out = joined.join(touching, ["body", "support"], "left")
    return out.select("body", "support", gap.alias("gap"), offset.alias("offset"), "drift", F.coalesce(shaped & narrow & straight & counted & F.col("touching"), F.lit(False)).alias("attached"))


def boundary_parts(points: DataFrame, group: str, pairs: DataFrame) -> DataFrame:
    """For pairs (source, body, semantic, frames): inclusion, flatness, gap and `part`: a flat piece on a face of a body with volume.
    Faces are those of the axis-aligned box; rotate the points before for another frame."""
    s = shapes(points, group)
    named = lambda k: s.select(F.col(group).alias(k), *[F.col(c).alias(f"{k[0]}_{c}") for c in s.columns if c != group])
    j = pairs.dropDuplicates(["source", "body"]).join(named("source"), "source").join(named("body"), "body")
    bounds = j.select("source", "body", *[f"b_{n}{a}" for a in AXES for n in ("lo", "hi")])
    within = [F.col(a).between(F.col(f"b_lo{a}") - 0.025, F.col(f"b_hi{a}") + 0.025) for a in AXES]
    held = points.dropna(subset=[group, *AXES]).select(F.col(group).alias("source"), *AXES).join(bounds, "source").groupBy("source", "body").agg(F.avg((within[0] & within[1] & within[2]).cast("int")).alias("inclusion"))
    side = lambda k, a: F.col(f"{k}_hi{a}") - F.col(f"{k}_lo{a}")
    volume = lambda k: side(k, "x") * side(k, "y") * side(k, "z")
    normal = F.transform("s_shape.normal", F.abs)
    facing = F.array_max(normal)
    pick = lambda columns: F.element_at(F.array(*columns), F.array_position(normal, facing).cast("int"))
    middle = [F.col(f"s_mid{a}") for a in AXES]
    gap = pick([F.least(F.abs(m - F.col(f"b_lo{a}")), F.abs(m - F.col(f"b_hi{a}"))) for m, a in zip(middle, AXES, strict=True)])
    depth, across = pick([side("s", a) for a in AXES]), pick([side("b", a) for a in AXES])
    breadth = pick([F.least(*[side("s", b) for b in AXES if b != a]) for a in AXES])
    flat = (F.col("s_shape.middle") - F.col("s_shape.least")) / F.greatest(F.col("s_shape.middle"), F.lit(1e-12))
    solid = (F.least(*[side("b", a) for a in AXES]) >= 0.15) & (volume("b") >= 8 * F.greatest(volume("s"), F.lit(1e-12)))
    known = (F.col("s_n") >= 32) & (F.col("b_n") >= 32) & (F.col("semantic") >= 0.8) & (F.col("frames") >= 3)
    lies = (F.col("inclusion") >= 0.98) & (flat >= 0.9) & (facing >= 0.95) & (gap <= 0.035) & (depth <= 0.2 * across) & (breadth >= 0.1)
    return j.join(held, ["source", "body"]).select("source", "body", "inclusion", flat.alias("flatness"), gap.alias("gap"), F.coalesce(known & solid & lies, F.lit(False)).alias("part"))


def siblings(proposals: DataFrame, labels: DataFrame, share: float = 0.7, apart: float = 0.1) -> DataFrame:
    """mask_id, parent, siblings and `kept` of proposals (mask_id, name, point_id) inside coarse labels (point_id, label; 0 is none).

    The parent is the label of `share` or more of a mask, else 0; ties go to the smaller label. A sibling has the same parent and
    name, a quarter to four times the area, and shares less than `apart` of the smaller mask. A nested mask without one goes. Siblings
    are counted as those of fitting area less those that overlap, so only masks with common points form pairs. Points without a label
    count as 0, a null name is one of its own for each mask. Areas up to 10^9 are exact."""
    m = proposals.dropna(subset=["mask_id", "point_id"]).select("mask_id", F.coalesce("name", F.concat(F.lit("\0"), F.col("mask_id").cast("string"))).alias("name"), "point_id").distinct()
    known = labels.dropna().groupBy("point_id").agg(F.min("label").alias("label"))
    votes = m.join(known, "point_id", "left").groupBy("mask_id", "name", F.coalesce("label", F.lit(0)).alias("label")).agg(F.count("*").alias("k"))
    best = votes.groupBy("mask_id", "name").agg(F.sum("k").alias("area"), F.min(F.struct((-F.col("k")).alias("k"), "label")).alias("b"))
    one = best.select("mask_id", "name", "area", F.when(-F.col("b.k") >= share * F.col("area"), F.col("b.label")).otherwise(0).alias("parent"))
    # A factor of four is a distance of two in binary logarithms, here in units of 10^-12.
    sizes = one.groupBy("parent", "name", "area").agg(F.count("*").alias("k")).withColumn("log", F.round(F.log2("area") * 1e12).cast("bigint"))
    w = Window.partitionBy("parent", "name").orderBy("log").rangeBetween(-2 * 10**12 - 10, 2 * 10**12 + 10)
    fitting = sizes.select("parent", "name", "area", F.sum("k").over(w).alias("fitting"))
    left, right = (one.select(F.col("mask_id").alias(k), "parent", "name", F.col("area").alias(f"area_{k}")) for k in "ab")
    shared = m.select(F.col("mask_id").alias("a"), "name", "point_id").join(m.select(F.col("mask_id").alias("b"), "name", "point_id"), ["point_id", "name"]).where("a <> b").groupBy("a", "b", "name").agg(F.count("*").alias("both"))
    close = shared.join(left, ["a", "name"]).join(right, ["b", "parent", "name"]).where("area_b <= 4 * area_a AND area_a <= 4 * area_b").where(F.col("both") >= apart * F.least("area_a", "area_b"))
    taken = close.groupBy(F.col("a").alias("mask_id"), "name").agg(F.count("*").alias("taken"))
    out = one.join(fitting, ["parent", "name", "area"]).join(taken, ["mask_id", "name"], "left").withColumn("siblings", F.col("fitting") - 1 - F.coalesce("taken", F.lit(0)))
    return out.select("mask_id", "parent", "siblings", ((F.col("parent") == 0) | (F.col("siblings") > 0)).alias("kept"))


def bars(points: DataFrame, group: str, id_col: str, pairs: DataFrame) -> DataFrame:
    """For pairs (body, bar): alignment, contacts and `attached`: a long low bar along the body's upper part, touching it. Point ids are unique."""
    p = points.dropna(subset=[group, *AXES]).select(F.col(group).alias("g"), F.col(id_col).alias("p"), *AXES)
    asked = pairs.select("body", "bar").distinct()
    s = p.groupBy("g").agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))], F.covar_samp("x", "x").alias("xx"), F.covar_samp("x", "y").alias("xy"), F.covar_samp("y", "y").alias("yy"))
    half, spread = (F.col("xx") + F.col("yy")) / 2, F.hypot((F.col("xx") - F.col("yy")) / 2, F.col("xy"))
    s = s.withColumn("long", half + spread >= 2.5 * F.greatest(half - spread, F.lit(1e-9))).withColumn("angle", F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2)
    named = lambda k: s.select(F.col("g").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in s.columns if c != "g"])
    mine = lambda k: p.withColumnRenamed("g", k).join(asked.select(k).distinct(), k, "left_semi")
    met = spatial.range_join(mine("bar"), mine("body").drop("p"), 0.035, inclusive=False).join(asked, ["body", "bar"], "left_semi").groupBy("body", "bar").agg(F.countDistinct("p").alias("contacts"), F.min("dist").alias("nearest"))
    j = asked.join(named("body"), "body").join(named("bar"), "bar").join(met, ["body", "bar"], "left")
    tall, height = F.col("bar_hiz") - F.col("bar_loz"), F.col("body_hiz") - F.col("body_loz")
    sides = [F.col(f"bar_hi{a}") - F.col(f"bar_lo{a}") for a in "xy"]
    sized = (tall <= 0.18) & (F.greatest(*sides) >= 0.3) & (F.least(*sides) <= 0.35) & (F.greatest(*sides) >= 2 * tall)
    placed = (F.col("bar_loz") >= F.col("body_loz") + 0.55 * height) & (F.col("bar_hiz") <= F.col("body_hiz") + 0.05)
    along = F.abs(F.cos(F.col("body_angle") - F.col("bar_angle")))
    touches = (F.col("nearest") <= 0.025) & (F.col("contacts") >= 32)
    attached = F.coalesce(sized & placed & F.col("body_long") & F.col("bar_long") & (along >= 0.9) & touches, F.lit(False))
    return j.select("body", "bar", along.alias("alignment"), F.coalesce("contacts", F.lit(0)).alias("contacts"), attached.alias("attached"))
