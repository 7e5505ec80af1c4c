"""Composite constructors: cross-view evidence, mask research builders, publication steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import attachments, boxes as B, graphs, kernels as K, masks as M, ownership, retrieval, spatial
from .geometry import h6, r6
from .kernels import _suppressed, per_instance, xyz
from .registry import boxes, halves, masks, obs, place, pts, query, table

PIX = "SELECT l_suppkey AS frame, l_partkey % 64 AS u, l_orderkey % 48 AS v, max(l_quantity) AS d, bool_or(l_returnflag = 'R') AS mine FROM lineitem GROUP BY 1, 2, 3"
POINT = "SELECT p_partkey AS id, p_brand AS g, p_partkey % 64 AS u, p_size % 48 AS v, p_size::DOUBLE AS z FROM part"


def pixels(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 64).alias("u"), (F.col("l_orderkey") % 48).alias("v")).agg(F.max("l_quantity").alias("d"), F.bool_or(F.col("l_returnflag") == "R").alias("mine"))


def points(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), (F.col("p_partkey") % 64).alias("u"), (F.col("p_size") % 48).alias("v"), F.col("p_size").cast("double").alias("z"))


@query("g05_hard_projection", f"WITH px AS ({PIX}), pt AS ({POINT}) SELECT pt.id AS id, px.frame AS frame FROM pt JOIN px USING (u, v) WHERE d > 0 AND 1 - abs(z - d) / (0.5 + 0.01 * d) >= 0.7")
def hard_projection(spark, d):
    both = points(spark, d).join(pixels(spark, d), ["u", "v"])
    return both.where(S.visibility_weight(F.col("z"), F.col("d"), 0.5) >= 0.7).select("id", "frame")


@query("g07_visibility_score", f"""
WITH px AS ({PIX}), pt AS ({POINT}), s AS (SELECT pt.g AS g, px.frame AS frame, count(*) AS seen, count(*) FILTER (mine) AS hit FROM pt JOIN px USING (u, v) WHERE abs(z - d) <= 5 GROUP BY 1, 2), m AS (SELECT frame, count(*) FILTER (mine) AS area FROM px GROUP BY 1)
SELECT g, s.frame AS frame, round(hit / area::DOUBLE, 6) AS coverage FROM s JOIN m USING (frame) WHERE seen >= 2 AND hit > 0 AND hit / area >= 0.01""")
def visibility_score(spark, d):
    px = pixels(spark, d)
    s = points(spark, d).join(px, ["u", "v"]).where("abs(z - d) <= 5").groupBy("g", "frame").agg(F.count("*").alias("seen"), F.count_if("mine").alias("hit"))
    m = px.groupBy("frame").agg(F.count_if("mine").alias("area"))
    c = F.col("hit") / F.col("area")
    return s.join(m, "frame").where((F.col("seen") >= 2) & (F.col("hit") > 0) & (c >= 0.01)).select("g", "frame", r6(c).alias("coverage"))


@query("g09_inferred_surface", f"""
WITH px AS ({PIX}), pt AS ({POINT}), v AS (SELECT pt.g AS g, pt.id AS id, count(*) FILTER (z < d - 5) AS free, count(*) FILTER (abs(z - d) <= 5 AND NOT mine) AS alien FROM pt JOIN px USING (u, v) WHERE d > 0 GROUP BY 1, 2)
SELECT g, count(*) AS n, round(avg((free >= 3)::INT), 6) AS free_share, round(avg((alien >= 1)::INT), 6) AS foreign_share, avg((free >= 3)::INT) <= 0.9 AND avg((alien >= 1)::INT) <= 0.5 AS accepted FROM v GROUP BY 1""")
def inferred_surface(spark, d):
    hits = points(spark, d).join(pixels(spark, d).where("d > 0"), ["u", "v"])
    v = hits.groupBy("g", "id").agg(F.count_if(F.expr("z < d - 5")).alias("free"), F.count_if(F.expr("abs(z - d) <= 5 AND NOT mine")).alias("alien"))
    a, b = F.avg(F.expr("int(free >= 3)")), F.avg(F.expr("int(alien >= 1)"))
    return v.groupBy("g").agg(F.count("*").alias("n"), r6(a).alias("free_share"), r6(b).alias("foreign_share"), ((a <= 0.9) & (b <= 0.5)).alias("accepted"))


@query("g25_zoom_regions")
def zoom_regions(spark, d):
    """Boxes of bounded area, greedily without overlaps, four a class at most."""
    kept = boxes(spark, d).where("size BETWEEN 5 AND 40").groupBy("brand").applyInPandas(lambda p: _suppressed(p, 0.5), "brand string, id long, keeper long, kept boolean").where("kept")
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("brand").orderBy("id"))).where("k <= 4").select("brand", "k", "id")


@query("j13_track_scores", """
WITH t AS (SELECT scene, label, avg(conf) AS mean, count(*) AS n FROM obs WHERE event_id % 2 = 0 GROUP BY 1, 2), c AS (SELECT o.event_id AS event_id, t.label AS track, 1.2 - abs(o.conf - t.mean) / 50 AS score FROM obs o JOIN t ON t.scene = o.scene WHERE o.event_id % 2 = 1 AND abs(o.conf - t.mean) <= 30)
SELECT event_id, track, round(score, 6) AS score FROM c WHERE score > 0.9""", "obs")
def track_scores(spark, d):
    o = obs(spark, d)
    # Doubles add up in the file's order, so no mean hangs on the partitions, and copies of a row count each.
    w = Window.partitionBy("scene", "label").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    even = obs(spark, d, place().alias("at")).where("event_id % 2 = 0").withColumn("mean", F.avg("conf").over(w))
    t = even.groupBy("scene", F.col("label").alias("track")).agg(F.max("mean").alias("mean"))
    c = o.where("event_id % 2 = 1").join(t, "scene").where(F.abs(F.col("conf") - F.col("mean")) <= 30).withColumn("score", 1.2 - F.abs(F.col("conf") - F.col("mean")) / 50)
    return c.where("score > 0.9").select("event_id", "track", h6("score").alias("score"))


@query("j30_native_pairs", """
WITH f AS (SELECT l_partkey % 40 AS inst, l_suppkey AS frame, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1, 2), s AS (SELECT inst, frame, r / n::DOUBLE AS mass FROM f)
SELECT a.inst AS a, b.inst AS b, count(*) FILTER (least(a.mass, b.mass) >= 0.6) AS whole, count(*) FILTER (greatest(a.mass, b.mass) >= 0.8 AND least(a.mass, b.mass) < 0.2) AS separation FROM s a JOIN s b ON a.frame = b.frame AND a.inst < b.inst GROUP BY 1, 2""")
def native_pairs(spark, d):
    f = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("inst"), F.col("l_suppkey").alias("frame")).agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("mass"))
    p = f.select("frame", F.col("inst").alias("a"), F.col("mass").alias("p")).join(f.select("frame", F.col("inst").alias("b"), F.col("mass").alias("q")), "frame").where("a < b")
    low, high = F.least("p", "q"), F.greatest("p", "q")
    return p.groupBy("a", "b").agg(F.count_if(low >= 0.6).alias("whole"), F.count_if((high >= 0.8) & (low < 0.2)).alias("separation"))


@query("a22_robust_bounds")
def robust_bounds(spark, d):
    """Box of the statistical inliers along their principal axes; axis-aligned where there are under four."""
    def run(p):
        q = xyz(p)
        q = q[K.statistical_inliers(q, 20, 2.0)]
        c, _, size = K.principal_box(q) if len(q) >= 4 else ((q.min(axis=0) + q.max(axis=0)) / 2, None, np.ptp(q, axis=0))
        return pd.DataFrame({"g": [p["g"].iloc[0]], "centre": [c], "size": [size], "n": [len(q)]})

    return per_instance(spark, d, run, "g int, centre array<double>, size array<double>, n long")


@query("a24_plane_boxes")
def plane_boxes(spark, d):
    """Yaw from the largest upright plane, else the least floor area."""
    def run(p):
        q = xyz(p)
        n, _, inl = K.fit_plane(q, 0.03, 200, 0)
        c, yaw, size = K.upright_box(q)
        upright = bool(inl.sum() >= 8 and abs(n[2]) < 0.2)
        return pd.DataFrame({"g": [p["g"].iloc[0]], "yaw": [float(np.arctan2(n[1], n[0]) % (np.pi / 2)) if upright else yaw], "from_plane": [upright], "size": [size]})

    return per_instance(spark, d, run, "g int, yaw double, from_plane boolean, size array<double>")


@query("c05_anchored_components")
def anchored_components(spark, d):
    """Detached components stay when they hold an anchor or a fifth of the points."""
    def run(p):
        label = K.dbscan(xyz(p), 0.15, 1)
        anchored = set(label[(p["id"] % 20 == 0).to_numpy()])
        keep = [x in anchored or n >= 0.2 * len(p) for x, n in enumerate(np.bincount(label))]
        return pd.DataFrame({"g": p["g"], "id": p["id"], "kept": [keep[x] for x in label]})

    return per_instance(spark, d, run, "g int, id long, kept boolean")


def absorbed(p: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b, score) of one scene: strongest first, b is absorbed by a unless either is gone; chains end at the survivor."""
    into: dict = {}
    for r in p.sort_values(["score", "a", "b"], ascending=[False, True, True]).itertuples():
        if r.a not in into and r.b not in into and r.b not in into.values():
            into[r.b] = r.a
    return pd.DataFrame({"scene": p["scene"].iloc[0], "source": list(into), "target": list(into.values())})


@query("c08_duplicate_tracks")
def duplicate_tracks(spark, d):
    """Duplicates by overlap; the larger box absorbs, in a stated order."""
    from .kernels import _pairs

    rows = _pairs(spark, d, 0.15).select(F.col("brand").alias("scene"), F.least("truth", "pred").alias("a"), F.greatest("truth", "pred").alias("b"), F.col("iou").alias("score"))
    return rows.groupBy("scene").applyInPandas(absorbed, "scene string, source long, target long")


@query("c10_unique_contraction", """
WITH i AS (SELECT a.id AS a, b.id AS b, a.brand AS brand FROM boxes a JOIN boxes b ON a.brand = b.brand AND a.size > b.size AND b.lox >= a.lox AND b.hix <= a.hix AND b.loy >= a.loy AND b.hiy <= a.hiy), u AS (SELECT *, count(*) OVER (PARTITION BY b) AS n FROM i), e AS (SELECT b, a FROM u WHERE n = 1)
SELECT b AS source, a AS target FROM e WHERE a NOT IN (SELECT b FROM e)""", "boxes")
def unique_contraction(spark, d):
    def rule(child, parent):
        """Every child's containers counted; one of them stands for all, which matters where it is the only one."""
        i = (parent["size"] > child["size"]) & (child["lox"] >= parent["lox"]) & (child["hix"] <= parent["hix"]) & (child["loy"] >= parent["loy"]) & (child["hiy"] <= parent["hiy"])
        n = i.sum(axis=1)
        some = np.nonzero(n)[0]
        return some, i[some].argmax(axis=1), n[some]

    b = boxes(spark, d)
    held = B.joined(b, b, ["brand"], ["size"], rule, "child long, parent long, n long")
    unique = held.groupBy("child").agg(F.sum("n").alias("n"), F.min("parent").alias("parent")).where("n = 1").select("child", "parent")
    return graphs.acyclic(graphs.settled(unique)).select(F.col("child").alias("source"), F.col("parent").alias("target"))


@query("c24_atomic_partition", """
WITH a AS (SELECT id, x, y, z FROM pts WHERE id % 25 = 0), c AS (SELECT p.id AS id, a.id AS anchor, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(p.x - a.x, 2) + pow(p.y - a.y, 2) + pow(p.z - a.z, 2)), a.id) AS k FROM pts p CROSS JOIN a) SELECT id, anchor FROM c WHERE k = 1""", "pts")
def atomic_partition(spark, d):
    """Every point goes to its nearest anchor, by grid joins of growing radius."""
    p = pts(spark, d)
    return spatial.nearest_any(p, p.where("id % 25 = 0").withColumnRenamed("id", "anchor"), "id", "anchor").select("id", "anchor")


@query("c25_containment_split", """
WITH inside AS (SELECT DISTINCT point_id FROM masks WHERE mask_id = 3) SELECT mask_id, point_id, point_id IN (SELECT point_id FROM inside) AS core FROM masks WHERE mask_id <> 3""", "masks")
def containment_split(spark, d):
    m = masks(spark, d)
    inside = m.where("mask_id = 3").select("point_id", F.lit(True).alias("core")).distinct()
    return m.where("mask_id <> 3").join(inside, "point_id", "left").select("mask_id", "point_id", F.coalesce("core", F.lit(False)).alias("core"))


@query("c26_cannot_link", """
WITH v AS (SELECT l_partkey % 30 AS inst, l_suppkey AS frame, l_linenumber AS mask, avg(l_quantity) AS pos FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT a.inst AS a, b.inst AS b, a.frame AS frame, min(abs(a.pos - b.pos)) AS gap FROM v a JOIN v b ON a.frame = b.frame AND a.mask <> b.mask AND a.inst < b.inst GROUP BY 1, 2, 3) SELECT a, b, count(*) AS views FROM s WHERE gap > 0.2 GROUP BY 1, 2 HAVING count(*) >= 2""")
def cannot_link(spark, d):
    v = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 30).alias("inst"), F.col("l_suppkey").alias("frame"), F.col("l_linenumber").alias("mask")).agg(F.avg("l_quantity").alias("pos"))
    p = v.select("frame", F.col("inst").alias("a"), F.col("mask").alias("ma"), F.col("pos").alias("p")).join(v.select("frame", F.col("inst").alias("b"), F.col("mask").alias("mb"), F.col("pos").alias("q")), "frame")
    s = p.where("a < b AND ma <> mb").groupBy("a", "b", "frame").agg(F.min(F.abs(F.col("p") - F.col("q"))).alias("gap"))
    return s.where("gap > 0.2").groupBy("a", "b").agg(F.count("*").alias("views")).where("views >= 2")


@query("c27_positive_owner", """
WITH e AS (SELECT DISTINCT l_partkey AS point, l_suppkey % 4 AS candidate, l_orderkey AS frame, l_quantity AS pos FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT a.point AS point, a.candidate AS candidate FROM e a JOIN e b ON a.point = b.point AND a.candidate = b.candidate AND a.frame < b.frame AND abs(a.pos - b.pos) >= 15)
SELECT point, min(candidate) AS owner FROM c GROUP BY 1 HAVING count(*) = 1""")
def positive_owner(spark, d):
    """Two views apart are needed; a point with two such owners keeps none. The spread of the views decides without pairs."""
    e = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("point"), (F.col("l_suppkey") % 4).alias("candidate"), F.col("l_orderkey").alias("frame"), F.col("l_quantity").alias("pos")).distinct()
    a = e.select("point", "candidate", F.col("frame").alias("f"), F.col("pos").alias("p"))
    far = a.join(e, ["point", "candidate"]).where((F.col("f") < F.col("frame")) & (F.abs(F.col("p") - F.col("pos")) >= 15)).select("point", "candidate").distinct()
    return far.groupBy("point").agg(F.min("candidate").alias("owner"), F.count("*").alias("n")).where("n = 1").select("point", "owner")


@query("c28_nested_subtraction", """
WITH m AS (SELECT DISTINCT l_suppkey * 10 + k AS mask_id, l_suppkey AS parent, k % 3 AS label, l_orderkey * 10 + l_linenumber AS point_id FROM lineitem JOIN (SELECT unnest(range(1, 8)) AS k) ON k >= l_linenumber),
s AS (SELECT mask_id, count(*) AS n FROM m GROUP BY 1), o AS (SELECT a.mask_id AS big, b.mask_id AS small, count(*) AS k FROM m a JOIN m b ON a.point_id = b.point_id AND a.parent = b.parent AND a.label <> b.label AND a.mask_id <> b.mask_id GROUP BY 1, 2),
nest AS (SELECT big, small FROM o JOIN s p ON p.mask_id = big JOIN s q ON q.mask_id = small WHERE k >= 0.9 * q.n AND p.n >= 1.5 * q.n)
SELECT m.mask_id AS mask_id, count(*) AS kept FROM m WHERE NOT EXISTS (SELECT 1 FROM nest JOIN m i ON i.mask_id = nest.small WHERE nest.big = m.mask_id AND i.point_id = m.point_id) GROUP BY 1""")
def nested_subtraction(spark, d):
    """Suppliers as parents; their masks hold the lines up to a number, so they nest."""
    t = table(spark, d, "lineitem").withColumn("k", F.explode(F.sequence(F.col("l_linenumber").cast("int"), F.lit(7))))
    m = t.select((F.col("l_suppkey") * 10 + F.col("k")).alias("mask_id"), F.col("l_suppkey").alias("parent"), (F.col("k") % 3).alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"))
    return M.without_nested(m).groupBy("mask_id").agg(F.count("*").alias("kept"))


@query("c29_independent_siblings", """
WITH m AS (SELECT DISTINCT l_suppkey AS mask_id, l_orderkey AS point_id FROM lineitem), lab AS (SELECT o_orderkey AS point_id, CASE WHEN o_orderkey % 10 < 7 THEN 1 ELSE 0 END AS label FROM orders),
v AS (SELECT mask_id, coalesce(label, 0) AS label, count(*) AS k FROM m LEFT JOIN lab USING (point_id) GROUP BY 1, 2), r AS (SELECT *, sum(k) OVER (PARTITION BY mask_id) AS area, row_number() OVER (PARTITION BY mask_id ORDER BY k DESC, label) AS i FROM v),
o AS (SELECT mask_id, area, mask_id % 3 AS name, CASE WHEN k >= 0.7 * area THEN label ELSE 0 END AS parent FROM r WHERE i = 1), s AS (SELECT a.mask_id AS a, b.mask_id AS b, count(*) AS k FROM m a JOIN m b ON a.point_id = b.point_id GROUP BY 1, 2),
c AS (SELECT p.mask_id AS mask_id, count(*) AS n FROM o p JOIN o q ON p.parent = q.parent AND p.name = q.name AND p.mask_id <> q.mask_id AND q.area <= 4 * p.area AND p.area <= 4 * q.area LEFT JOIN s ON s.a = p.mask_id AND s.b = q.mask_id WHERE coalesce(k, 0) < 0.1 * least(p.area, q.area) GROUP BY 1)
SELECT o.mask_id AS mask_id, parent, coalesce(n, 0) AS siblings, parent = 0 OR coalesce(n, 0) > 0 AS kept FROM o LEFT JOIN c USING (mask_id)""")
def independent_siblings(spark, d):
    """Suppliers as masks over orders."""
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("mask_id"), (F.col("l_suppkey") % 3).cast("string").alias("name"), F.col("l_orderkey").alias("point_id"))
    return attachments.siblings(m, table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), F.when(F.col("o_orderkey") % 10 < 7, 1).otherwise(0).alias("label")))


@query("p21_line_members")
def line_members(spark, d):
    return attachments.line_members(pts(spark, d), "g")


@query("p19_stem_attachment")
def stem_attachment(spark, d):
    """Neighbouring labels as bodies and their supports."""
    p = pts(spark, d)
    pairs = p.select(F.col("g").alias("body"), (F.col("g") + 1).alias("support")).distinct()
    out = attachments.stems(p, "g", pairs)
    return out.select("body", "support", *[r6(c).alias(c) for c in ("gap", "offset", "drift")], "attached")


@query("p18_boundary_part")
def boundary_part(spark, d):
    """Neighbouring labels as parts and their bodies."""
    p = pts(spark, d)
    pairs = p.select(F.col("g").alias("source"), (F.col("g") + 1).alias("body"), F.lit(0.9).alias("semantic"), F.lit(3).alias("frames")).distinct()
    out = attachments.boundary_parts(p, "g", pairs)
    return out.select("source", "body", r6("inclusion").alias("inclusion"), r6("flatness").alias("flatness"), r6("gap").alias("gap"), "part")


@query("c30_detector_union", """
WITH a AS (SELECT * FROM masks WHERE mask_id % 2 = 0), b AS (SELECT * FROM masks WHERE mask_id % 2 = 1), sa AS (SELECT mask_id, count(*) AS n FROM a GROUP BY 1), sb AS (SELECT mask_id, count(*) AS n FROM b GROUP BY 1),
o AS (SELECT a.mask_id AS a, b.mask_id AS b, count(*) AS k FROM a JOIN b USING (point_id) GROUP BY 1, 2), i AS (SELECT o.a AS a, o.b AS b, k / (sa.n + sb.n - k)::DOUBLE AS iou, sa.n AS na, sb.n AS nb FROM o JOIN sa ON sa.mask_id = o.a JOIN sb ON sb.mask_id = o.b)
SELECT a, b, round(iou, 6) AS iou, CASE WHEN nb > 1.05 * na THEN 'replace' ELSE 'keep' END AS action FROM i WHERE iou >= 0.16""", "masks")
def detector_union(spark, d):
    m = masks(spark, d)
    o = M.overlaps(m.where("mask_id % 2 = 0"), m.where("mask_id % 2 = 1")).where("iou >= 0.16")
    return o.select("a", "b", r6("iou").alias("iou"), F.when(F.col("size_b") > 1.05 * F.col("size_a"), "replace").otherwise("keep").alias("action"))


@query("f02_record_validation", "SELECT p_partkey, p_name IS NOT NULL AND trim(p_name) <> '' AND NOT contains(p_name, ':') AS valid FROM part")
def record_validation(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_name").isNotNull() & (F.trim("p_name") != "") & ~F.col("p_name").contains(":")).alias("valid"))


@query("f09_tag_filter", """
WITH u AS (SELECT textual AS t FROM halves WHERE id % 100 = 0), s AS (SELECT id, max(list_dot_product(textual, t) / greatest(sqrt(list_dot_product(textual, textual)) * sqrt(list_dot_product(t, t)), 1e-12)) AS m FROM halves, u WHERE id % 100 <> 0 GROUP BY 1) SELECT id FROM s WHERE m < 0.3""", "halves")
def tag_filter(spark, d):
    """The unwanted tags are the stated set, compared with all rows in blocks; without tags no row is compared, as in the SQL."""
    h = halves(spark, d).select("id", F.col("textual").alias("vector"))
    best = retrieval.top_scores(h.where("id % 100 <> 0"), h.where("id % 100 = 0"), 1, unit=True, digits=12)
    return best.where("score < 0.3").select(F.col("a").alias("id"))


@query("f12_scene_names", r"SELECT page_id, regexp_matches(url, '^(https?)://') AS ok, regexp_extract(url, '([a-z]+)\.example\.', 1) AS member FROM pages")
def scene_names(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("url").rlike("^(https?)://").alias("ok"), F.regexp_extract("url", r"([a-z]+)\.example\.", 1).alias("member"))


@query("f19_finite_guard", "SELECT vec_id, list_sum([isfinite(v)::INT FOR v IN embedding]) = len(embedding) AS finite FROM embeddings")
def finite_guard(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).alias("finite"))


@query("n11_named_instances", """
WITH v AS (SELECT l_suppkey AS inst, l_returnflag AS name, count(DISTINCT l_orderkey) AS views, max(l_quantity) - min(l_quantity) AS baseline FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY views DESC, name) AS k FROM v WHERE views >= 2 AND baseline >= 15)
SELECT s_suppkey AS inst, coalesce(name, 'unknown') AS name FROM supplier LEFT JOIN r ON inst = s_suppkey AND k = 1""")
def named_by_views(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("inst"), F.col("l_returnflag").alias("name")).agg(F.countDistinct("l_orderkey").alias("views"), (F.max("l_quantity") - F.min("l_quantity")).alias("baseline"))
    best = v.where("views >= 2 AND baseline >= 15").withColumn("k", F.row_number().over(Window.partitionBy("inst").orderBy(F.desc("views"), "name"))).where("k = 1").select("inst", "name")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("inst")).join(best, "inst", "left").select("inst", F.coalesce("name", F.lit("unknown")).alias("name"))


@query("n12_observed_guard", "SELECT id, g FROM pts WHERE id % 2 = 0 UNION ALL SELECT a.id, 16581374 FROM pts a WHERE a.id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM pts b WHERE b.id % 2 = 0 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.05)", "pts")
def observed_guard(spark, d):
    """Surface that no instance owns is appended under the sentinel 255**3 - 1."""
    p = pts(spark, d)
    own = p.where("id % 2 = 0")
    rest = spatial.residual(p.where("id % 2 = 1"), own.withColumnRenamed("id", "other"), 0.05, "id")
    return own.select("id", "g").unionByName(rest.select("id", F.lit(255**3 - 1).alias("g")))


@query("z03_named_suppression")
def named_suppression(spark, d):
    b = boxes(spark, d).withColumn("brand", F.concat_ws("|", F.col("size") % 3, F.lower("brand")))
    return b.groupBy("brand").applyInPandas(lambda p: _suppressed(p, 0.2), "brand string, id long, keeper long, kept boolean")


@query("z05_agnostic_suppression")
def agnostic_suppression(spark, d):
    """Confidence first, then suppression over all classes of a frame."""
    b = boxes(spark, d).where("conf > 920").withColumn("brand", (F.col("id") % 20).cast("string"))
    return b.groupBy("brand").applyInPandas(lambda p: _suppressed(p, 0.1), "brand string, id long, keeper long, kept boolean")


@query("z08_hard_negatives", """
WITH s AS (SELECT o_custkey AS id, o_orderpriority AS d, avg(o_totalprice) AS s FROM orders GROUP BY 1, 2), t AS (SELECT id, arg_max(d, (s, d)) AS best, max(s) AS top FROM s GROUP BY 1) SELECT s.id AS id, any_value(best) AS best, bool_and(s.d = best OR top - s.s > 10000) AS clear FROM s JOIN t USING (id) GROUP BY 1""")
def hard_negatives(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("d")).agg(F.avg("o_totalprice").alias("s"))
    t = s.groupBy("id").agg(F.max_by("d", F.struct("s", "d")).alias("best"), F.max("s").alias("top"))
    return s.join(t, "id").groupBy("id").agg(F.first("best").alias("best"), F.bool_and((F.col("d") == F.col("best")) | (F.col("top") - F.col("s") > 10000)).alias("clear"))


VIEWED = """s AS (SELECT DISTINCT l_suppkey % 20 AS peer, l_partkey AS point FROM lineitem WHERE l_linenumber <= 2), v AS (SELECT DISTINCT l_linenumber AS frame, l_partkey AS point FROM lineitem),
h AS (SELECT DISTINCT l_linenumber AS frame, l_suppkey % 20 AS peer, l_orderkey % 2 AS mask, l_partkey AS point FROM lineitem), sc AS (SELECT DISTINCT frame, peer, mask, (mask + frame % 2 + 1) / 4.0 AS score FROM h),
n AS (SELECT frame, peer, count(*) AS seed FROM s JOIN v USING (point) GROUP BY 1, 2 HAVING count(*) >= 8), c AS (SELECT frame, h.peer AS peer, mask, count(*) AS size, count(s.point) AS both_ FROM h LEFT JOIN s ON s.peer = h.peer AND s.point = h.point GROUP BY 1, 2, 3),
q AS (SELECT frame, peer, mask, both_ / seed::DOUBLE AS cover, round(sqrt((both_ / seed::DOUBLE) * (both_ / size::DOUBLE)) * score, 9) AS quality FROM c JOIN n USING (frame, peer) JOIN sc USING (frame, peer, mask)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, peer ORDER BY quality DESC, mask) AS k FROM q) WHERE k = 1 AND cover >= 0.1)"""


def viewed(spark, d):
    """Line items as visible points, masks and seeds; both limits are lower than the operator's, since seeds are seen in few lines."""
    t = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("peer"), F.col("l_partkey").alias("point"), F.col("l_linenumber").alias("frame"), (F.col("l_orderkey") % 2).alias("mask"))
    scores = t.select("frame", "peer", "mask").distinct().withColumn("score", (F.col("mask") + F.col("frame") % 2 + 1) / 4.0)
    return ownership.verified_peers(t.where("frame <= 2"), t, t, scores, 8, 0.1)


@query("z18_verified_peers", f"WITH {VIEWED} SELECT frame, peer, mask, round(cover, 6) AS cover, round(quality, 6) AS quality FROM b")
def verified_peers(spark, d):
    return viewed(spark, d)[0].select("frame", "peer", "mask", r6("cover").alias("cover"), r6("quality").alias("quality"))


@query("z18_peer_points", f"""
WITH {VIEWED}, l AS (SELECT peer, point, count(*) AS visible FROM b JOIN v USING (frame) GROUP BY 1, 2), p AS (SELECT peer, point, count(*) AS positive FROM b JOIN h USING (frame, peer, mask) GROUP BY 1, 2),
a AS (SELECT peer, point, own IS NOT NULL AS own, coalesce(positive, 0) AS positive, coalesce(visible, 0) AS visible FROM (SELECT *, 1 AS own FROM s) FULL JOIN l USING (peer, point) LEFT JOIN p USING (peer, point))
SELECT *, (own AND NOT (visible >= 2 AND positive = 0)) OR (positive >= 2 AND positive / greatest(visible, 1)::DOUBLE >= 2 / 3::DOUBLE) AS kept FROM a""")
def peer_points(spark, d):
    return viewed(spark, d)[1]


@query("z17_sub_proposals")
def sub_proposals(spark, d):
    """Line items as masks of their part's brand in a frame, over suppliers; the least size is lower than the operator's."""
    m = table(spark, d, "lineitem").select((F.col("l_partkey") % 25).alias("parent"), F.col("l_linenumber").alias("frame"), (F.col("l_orderkey") % 3).alias("mask"), F.col("l_suppkey").alias("point"))
    out = ownership.sub_proposals(m.withColumn("score", (F.col("mask") + 1) / 3), least=10)
    return out.select("parent", "k", F.size("points").alias("n"), "frames", r6("score").alias("score"))


@query("z04_painted_frames", """
WITH m AS (SELECT DISTINCT l_shipdate AS frame, l_suppkey AS mask_id, l_partkey AS pixel FROM lineitem), r AS (SELECT frame, mask_id, row_number() OVER (PARTITION BY frame ORDER BY count(*) DESC, mask_id) AS local FROM m GROUP BY 1, 2),
o AS (SELECT m.frame AS frame, pixel, m.mask_id AS mask_id, local, row_number() OVER (PARTITION BY m.frame, pixel ORDER BY local DESC) AS k FROM m JOIN r ON r.frame = m.frame AND r.mask_id = m.mask_id) SELECT frame, pixel, mask_id, local FROM o WHERE k = 1""")
def painted_frames(spark, d):
    """Local numbers are a column here, so a day may hold any number of suppliers; files of bytes keep the operator's limit."""
    m = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("frame"), F.col("l_suppkey").alias("mask_id"), F.col("l_partkey").alias("pixel"))
    return ownership.painted(m, most=None)


@query("c23_best_turn")
def best_turn(spark, d):
    """Each instance against its own points, turned and stretched."""
    def run(p):
        q = xyz(p)
        k, loss = K.best_turn(q @ K.turns()[5].T * 2, q)
        return pd.DataFrame({"g": [p["g"].iloc[0]], "turn": [k], "loss": [round(loss, 6)]})

    return per_instance(spark, d, run, "g int, turn long, loss double")


@query("c22_drawn")
def drawn(spark, d):
    """Each instance's shifted points drawn back to it: the greatest movement, null where it is out of bounds."""
    def run(p):
        q = xyz(p)
        moved = K.drawn(q + 0.01, q)
        return pd.DataFrame({"g": [p["g"].iloc[0]], "most": [None if moved is None else round(float(np.linalg.norm(moved - q - 0.01, axis=1).max()), 6)]})

    return per_instance(spark, d, run, "g int, most double")


@query("y05_bounded_transfer")
def bounded_transfer(spark, d):
    """Even labels as weak aggregates, odd ones as seeds of half the size."""
    p = pts(spark, d)
    seeds = p.where("g % 2 = 1").select("id", "g", *[(F.col(a) / 2).alias(a) for a in "xyz"])
    both = p.where("g % 2 = 0").select("id", "g", "x", "y", "z").unionByName(seeds)
    g = both.select("g").distinct()
    pairs = g.select(F.col("g").alias("source"), (F.col("g") + 1).alias("target"), F.lit(0.9).alias("semantic"))
    return ownership.bounded_transfer(both, g.where("g % 2 = 0").withColumnRenamed("g", "source"), pairs, g.where("g % 2 = 1"), near=0.2, cover=0.5, inclusion=0.9)


@query("z20_batched_neighbours")
def batched_neighbours(spark, d):
    """Three nearest of each point inside its batch, the point itself left out."""
    def run(p):
        q = xyz(p)
        near = np.empty((len(q), min(3, len(q) - 1)), np.int64)
        for lo in range(0, len(q), 256):  # a slice of the distances at a time
            dist = np.sqrt(((q[lo : lo + 256, None] - q[None]) ** 2).sum(axis=2))
            dist[np.arange(len(dist)), np.arange(lo, lo + len(dist))] = np.inf
            near[lo : lo + 256] = np.argsort(dist, axis=1, kind="stable")[:, : near.shape[1]]
        return pd.DataFrame({"g": p["g"], "id": p["id"], "near": [p["id"].to_numpy()[r].tolist() for r in near]})

    return per_instance(spark, d, run, "g int, id long, near array<long>")


@query("y03_duplicate_absorption", """
WITH i AS (SELECT a.id AS small, b.id AS big, (b.hix - b.lox) * (b.hiy - b.loy) * (b.hiz - b.loz) AS volume FROM boxes a JOIN boxes b ON a.brand = b.brand AND a.id <> b.id AND b.size >= 2 * a.size AND a.lox >= b.lox AND a.hix <= b.hix), r AS (SELECT *, row_number() OVER (PARTITION BY small ORDER BY volume, big) AS k FROM i) SELECT small, big FROM r WHERE k = 1""", "boxes")
def duplicate_absorption(spark, d):
    """The smallest container that qualifies takes the duplicate."""
    def rule(small, big):
        fits = (small["id"] != big["id"]) & (big["size"] >= 2 * small["size"]) & (small["lox"] >= big["lox"]) & (small["hix"] <= big["hix"])
        some = np.nonzero(fits.any(axis=1))[0]
        order = np.lexsort((big["id"][0], B.volume(big)[0]))
        best = order[fits[np.ix_(some, order)].argmax(axis=1)]
        return some, best, B.volume(big)[0, best]

    b = boxes(spark, d)
    i = B.joined(b, b, ["brand"], ["size"], rule, "small long, big long, volume double", axis="x")
    return i.groupBy("small").agg(F.min(F.struct("volume", "big")).alias("m")).select("small", "m.big")


@query("y09_dense_recovery", """
WITH p AS (SELECT * FROM pts), c AS (SELECT floor(x / 0.1)::BIGINT AS i, floor(y / 0.1)::BIGINT AS j, count(DISTINCT g) AS views FROM p GROUP BY 1, 2) SELECT id FROM p JOIN c ON floor(x / 0.1)::BIGINT = i AND floor(y / 0.1)::BIGINT = j WHERE views >= 3""", "pts")
def dense_recovery(spark, d):
    p = pts(spark, d).withColumns({"i": S.cell(F.col("x"), 0.1), "j": S.cell(F.col("y"), 0.1)})
    c = p.groupBy("i", "j").agg(F.countDistinct("g").alias("views")).where("views >= 3")
    return p.join(c, ["i", "j"], "left_semi").select("id")


@query("n03_cleaned_nodes")
def cleaned_nodes(spark, d):
    """Largest cluster without outliers, refitted; nodes of under four points go, and edges to them with them."""
    def run(p):
        q = xyz(p)
        q = q[K.largest(K.dbscan(q, 0.2, 2))]
        q = q[K.statistical_inliers(q, 20, 2.0)] if len(q) else q
        if len(q) < 4:
            return pd.DataFrame({"g": [], "n": [], "x": [], "y": [], "z": [], "size": []})
        c, _, size = K.principal_box(q)
        return pd.DataFrame({"g": [p["g"].iloc[0]], "n": [len(q)], "x": [c[0]], "y": [c[1]], "z": [c[2]], "size": [size]})

    nodes = graphs.settled(per_instance(spark, d, run, "g int, n long, x double, y double, z double, size array<double>"))
    edges = spatial.near_pairs(nodes, 2.0, "g").groupBy("a").agg(F.count("*").alias("neighbours"))
    return nodes.join(edges, nodes["g"] == edges["a"], "left").select("g", "n", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


@query("n07_unified_graph", """
SELECT 'object' AS node_type, r_regionkey AS id, r_name AS name, NULL::INT AS parent FROM region UNION ALL
SELECT 'part', n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 2)""")
def unified_graph(spark, d):
    """Objects and confirmed parts in one table of nodes."""
    objects = table(spark, d, "region").select(F.lit("object").alias("node_type"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    confirmed = table(spark, d, "customer").groupBy("c_nationkey").count().where("count >= 2").select(F.col("c_nationkey").alias("id"))
    parts = table(spark, d, "nation").select(F.lit("part").alias("node_type"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    return objects.unionByName(parts.join(confirmed, "id", "left_semi"), allowMissingColumns=True)


@query("y02_role_partners", """
WITH p AS (SELECT DISTINCT l_orderkey AS child, l_partkey AS parent, l_returnflag = 'R' AS support FROM lineitem), c AS (SELECT *, count(*) OVER (PARTITION BY child, support) AS nc, count(*) OVER (PARTITION BY parent, support) AS np FROM p)
SELECT child, parent, support FROM c WHERE nc = 1 AND (np = 1 OR NOT support)""")
def role_partners(spark, d):
    """Orders as children, parts as possible parents."""
    return graphs.role_partners(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("child"), F.col("l_partkey").alias("parent"), (F.col("l_returnflag") == "R").alias("support")))


@query("y04_aggregate_rejection", """
WITH s AS (SELECT mask_id, count(*) AS n FROM masks GROUP BY 1), o AS (SELECT a.mask_id AS big, b.mask_id AS child, count(*) AS k FROM masks a JOIN masks b ON a.point_id = b.point_id AND a.mask_id <> b.mask_id GROUP BY 1, 2),
c AS (SELECT big, child FROM o JOIN s ON s.mask_id = child WHERE k >= 0.3 * n), u AS (SELECT c.big AS big, count(DISTINCT m.point_id) AS covered FROM c JOIN masks m ON m.mask_id = c.child JOIN masks w ON w.mask_id = c.big AND w.point_id = m.point_id GROUP BY 1), k AS (SELECT big, count(*) AS children FROM c GROUP BY 1)
SELECT u.big AS mask_id, children, round(covered / n::DOUBLE, 6) AS cover FROM u JOIN k USING (big) JOIN s ON s.mask_id = u.big WHERE children >= 2 AND covered >= 0.6 * n""", "masks")
def aggregate_rejection(spark, d):
    """Masks that several independent children cover jointly are aggregates."""
    m = masks(spark, d)
    o = M.overlaps(m)
    both = o.select("a", "b", "both", "size_b").unionByName(o.select(F.col("b").alias("a"), F.col("a").alias("b"), "both", F.col("size_a").alias("size_b")))
    c = both.where("both >= 0.3 * size_b").select(F.col("a").alias("big"), F.col("b").alias("child"))
    covered = c.join(m.withColumnRenamed("mask_id", "child"), "child").join(m.withColumnRenamed("mask_id", "big"), ["big", "point_id"]).groupBy("big").agg(F.countDistinct("point_id").alias("covered"))
    n = m.groupBy(F.col("mask_id").alias("big")).agg(F.count("*").alias("n"))
    k = c.groupBy("big").agg(F.count("*").alias("children"))
    return covered.join(k, "big").join(n, "big").where("children >= 2 AND covered >= 0.6 * n").select(F.col("big").alias("mask_id"), "children", r6(F.col("covered") / F.col("n")).alias("cover"))


@query("y07_closed_storage", """
WITH c AS (SELECT brand AS g, count(DISTINCT (floor(lox)::BIGINT * 100 + floor(loy)::BIGINT)) / 80.0 AS occupancy, count(*) FILTER (size % 5 = 0) AS frames FROM boxes GROUP BY 1) SELECT g, round(occupancy, 6) AS occupancy, CASE WHEN occupancy >= 0.6 AND frames >= 3 THEN 'cabinet' ELSE g END AS name FROM c""", "boxes")
def closed_storage(spark, d):
    c = boxes(spark, d).groupBy(F.col("brand").alias("g")).agg((F.countDistinct(F.floor("lox") * 100 + F.floor("loy")) / 80.0).alias("occupancy"), F.count_if(F.col("size") % 5 == 0).alias("frames"))
    return c.select("g", r6("occupancy").alias("occupancy"), F.when((F.col("occupancy") >= 0.6) & (F.col("frames") >= 3), "cabinet").otherwise(F.col("g")).alias("name"))


@query("y13_world_frame_guard", """
SELECT scene, label, count(*) AS n FROM obs WHERE scene IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2""", "obs")
def world_frame_guard(spark, d):
    """Constructors run only on scenes whose manifest states the frame they need."""
    level = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("scene"))
    return obs(spark, d).join(level, "scene", "left_semi").groupBy("scene", "label").agg(F.count("*").alias("n"))
