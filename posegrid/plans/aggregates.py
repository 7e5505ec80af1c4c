"""Aggregation queries: voxels, votes, embeddings, evidence, evaluation diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import masks as M, spatial
from .geometry import r6
from .registry import boxes, halves, masks, obs, pts, query, table

CELLS = "floor(x / 0.1)::BIGINT AS cx, floor(y / 0.1)::BIGINT AS cy, floor(z / 0.1)::BIGINT AS cz"


@query("a01_voxel_centroids", f"SELECT {CELLS}, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM pts GROUP BY cx, cy, cz".replace("GROUP BY cx, cy, cz", "GROUP BY 1, 2, 3"), "pts")
def voxel_centroids(spark, d):
    return spatial.voxel_centroids(pts(spark, d), 0.1).select("cx", "cy", "cz", *[r6(a).alias(a) for a in "xyz"], "n")


@query("a02_labelled_voxels", f"SELECT g, {CELLS}, round(avg(x), 6) AS x, count(*) AS n, min(id) AS first_id FROM pts GROUP BY 1, 2, 3, 4", "pts")
def labelled_voxels(spark, d):
    c = spatial.with_cells(pts(spark, d), 0.1)
    return c.groupBy("g", "cx", "cy", "cz").agg(r6(F.avg("x")).alias("x"), F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("a03_first_in_cell", f"WITH c AS (SELECT id, x, {CELLS} FROM pts) SELECT cx, cy, cz, min(id) AS id, round(arg_min(x, id), 6) AS x FROM c GROUP BY 1, 2, 3", "pts")
def first_in_cell(spark, d):
    return spatial.first_in_cell(pts(spark, d), 0.1, "id").select("cx", "cy", "cz", "id", r6("x").alias("x"))


@query("a04_voxel_set_iou", f"""
WITH c AS (SELECT DISTINCT g, {CELLS} FROM pts), n AS (SELECT g, count(*) AS n FROM c GROUP BY g), b AS (SELECT p.g AS a, q.g AS b, count(*) AS n FROM c p JOIN c q ON p.cx = q.cx AND p.cy = q.cy AND p.cz = q.cz AND p.g < q.g GROUP BY 1, 2)
SELECT a, b, round(b.n / (p.n + q.n - b.n)::DOUBLE, 6) AS iou FROM b JOIN n p ON p.g = a JOIN n q ON q.g = b""", "pts")
def voxel_set_iou(spark, d):
    key = S.voxel_key([S.cell(F.col(a), 0.1) for a in "xyz"])
    return M.overlaps(pts(spark, d).select(F.col("g").alias("mask_id"), key.alias("point_id"))).select("a", "b", r6("iou").alias("iou"))


@query("a05_supported_cells", "SELECT k % 10 AS cell, label, count(DISTINCT scene) AS views FROM obs GROUP BY 1, 2 HAVING count(DISTINCT scene) >= 3", "obs")
def supported_cells(spark, d):
    return obs(spark, d).groupBy((F.col("k") % 10).alias("cell"), "label").agg(F.countDistinct("scene").alias("views")).where("views >= 3")


@query("a06_name_mode", """
WITH c AS (SELECT scene, label, count(*) AS n, min(event_id) AS first_seen FROM obs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY n DESC, first_seen) AS k FROM c) SELECT scene, label, n FROM r WHERE k = 1""", "obs")
def name_mode(spark, d):
    c = obs(spark, d).groupBy("scene", "label").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))
    w = Window.partitionBy("scene").orderBy(F.desc("n"), "first_seen")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("scene", "label", "n")


@query("a07_largest_observation", "SELECT scene, arg_max(label, (conf, -event_id)) AS label, round(max(conf), 6) AS conf FROM obs GROUP BY 1", "obs")
def largest_observation(spark, d):
    return obs(spark, d).groupBy("scene").agg(F.max_by("label", F.struct("conf", F.negative("event_id"))).alias("label"), r6(F.max("conf")).alias("conf"))


@query("a08_vector_mean", "WITH i AS (SELECT unnest(range(1, 33)) AS i) SELECT g, i, round(sum(visual[i]), 6) AS total, round(avg(visual[i]), 6) AS mean FROM halves, i GROUP BY 1, 2", "halves")
def vector_mean(spark, d):
    v = halves(spark, d).select("g", F.posexplode("visual").alias("i", "v"))
    return v.groupBy("g", (F.col("i") + 1).cast("bigint").alias("i")).agg(r6(F.sum("v")).alias("total"), r6(F.avg("v")).alias("mean"))


@query("a09_running_mean", "SELECT event_id, round(sum(conf) OVER w, 2) AS total, count(*) OVER w AS n FROM obs WINDOW w AS (PARTITION BY scene ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "obs")
def running_mean(spark, d):
    """The mean is total / n; both are kept, as a stream would keep them."""
    w = Window.partitionBy("scene").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return obs(spark, d).select("event_id", F.round(F.sum("conf").over(w), 2).alias("total"), F.count("*").over(w).alias("n"))


@query("a10_two_level_mean", "WITH f AS (SELECT scene, frame, avg(conf) AS m FROM obs GROUP BY 1, 2) SELECT scene, count(*) AS frames, round(avg(m), 6) AS mean FROM f GROUP BY 1", "obs")
def two_level_mean(spark, d):
    f = obs(spark, d).groupBy("scene", "frame").agg(F.avg("conf").alias("m"))
    return f.groupBy("scene").agg(F.count("*").alias("frames"), r6(F.avg("m")).alias("mean"))


@query("a11_quality", """
WITH f AS (SELECT scene, max(conf) / 100 AS det, avg(k) / 100.0 AS mask_q, count(*) FILTER (conf > 30) / count(*)::DOUBLE AS reproj FROM obs GROUP BY 1) SELECT scene, round(det * (0.5 + 0.5 * mask_q) * sqrt(reproj), 6) AS quality FROM f""", "obs")
def quality(spark, d):
    f = obs(spark, d).groupBy("scene").agg((F.max("conf") / 100).alias("det"), (F.avg("k") / 100.0).alias("mask_q"), (F.count_if(F.col("conf") > 30) / F.count("*")).alias("reproj"))
    return f.select("scene", r6(F.col("det") * (0.5 + 0.5 * F.col("mask_q")) * F.sqrt("reproj")).alias("quality"))


@query("a12_point_votes", """
SELECT l_partkey AS point, count(*) AS views, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 6) AS positive, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END), 6) AS negative,
  round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(CASE WHEN l_returnflag IN ('R', 'A') THEN l_quantity END), 0), 6) AS ratio FROM lineitem GROUP BY 1""")
def point_votes(spark, d):
    """A view without a verdict abstains; it is no negative vote."""
    v = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("point")).agg(
        F.count("*").alias("views"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("p"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0)).alias("n")
    )
    both = F.col("p") + F.col("n")
    return v.select("point", "views", r6("p").alias("positive"), r6("n").alias("negative"), r6(F.when(both != 0, F.col("p") / both)).alias("ratio"))


@query("a13_parent_votes", """
WITH v AS (SELECT o_custkey AS part, o_orderpriority AS parent, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT part, sum(n) AS total, max(n) AS most, arg_max(parent, n) AS parent FROM v GROUP BY 1)
SELECT part, parent, most FROM t WHERE most >= 2 AND most >= 0.7 * total""")
def parent_votes(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("part"), F.col("o_orderpriority").alias("parent")).agg(F.count("*").alias("n"))
    t = v.groupBy("part").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("parent", "n").alias("parent"))
    return t.where("most >= 2 AND most >= 0.7 * total").select("part", "parent", "most")


@query("a14_label_mass", """
WITH m AS (SELECT scene, label, sum(conf) AS mass FROM obs GROUP BY 1, 2), s AS (SELECT *, mass / sum(mass) OVER (PARTITION BY scene) AS share, row_number() OVER (PARTITION BY scene ORDER BY mass DESC, label) AS k FROM m)
SELECT scene, k, label, round(share, 6) AS share FROM s WHERE k <= 2""", "obs")
def label_mass(spark, d):
    m = obs(spark, d).groupBy("scene", "label").agg(F.sum("conf").alias("mass"))
    w = Window.partitionBy("scene")
    s = m.withColumn("share", F.col("mass") / F.sum("mass").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("mass"), "label")))
    return s.where("k <= 2").select("scene", "k", "label", r6("share").alias("share"))


@query("a15_ownership_evidence", """
WITH f AS (SELECT l_partkey AS point, l_suppkey AS frame, avg((l_returnflag = 'R')::INT) AS own, avg((l_returnflag = 'N')::INT) AS bg FROM lineitem GROUP BY 1, 2)
SELECT point, count(*) AS views, round(avg((own >= 0.6)::INT), 6) AS stable, round(avg((own < 0.2 AND bg < 0.5)::INT), 6) AS contradicted, round(avg((bg >= 0.5)::INT), 6) AS background FROM f GROUP BY 1""")
def ownership_evidence(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("point"), F.col("l_suppkey").alias("frame")).agg(*[F.avg((F.col("l_returnflag") == v).cast("int")).alias(n) for v, n in (("R", "own"), ("N", "bg"))])
    share = lambda c: r6(F.avg(c.cast("int")))
    own, bg = F.col("own"), F.col("bg")
    return f.groupBy("point").agg(F.count("*").alias("views"), share(own >= 0.6).alias("stable"), share((own < 0.2) & (bg < 0.5)).alias("contradicted"), share(bg >= 0.5).alias("background"))


@query("a16_segment_majority", """
WITH p AS (SELECT c_custkey AS id, c_nationkey AS segment, c_mktsegment AS label FROM customer), v AS (SELECT segment, label, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT segment, sum(n) AS size FROM v GROUP BY 1)
SELECT p.id AS id, coalesce(w.label, p.label) AS smoothed FROM p LEFT JOIN (SELECT v.segment AS segment, label FROM v JOIN t USING (segment) WHERE n > 0.25 * size AND n = (SELECT max(n) FROM v u WHERE u.segment = v.segment) AND NOT EXISTS (SELECT 1 FROM v u WHERE u.segment = v.segment AND u.n = v.n AND u.label < v.label)) w ON w.segment = p.segment""")
def segment_majority(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("segment"), F.col("c_mktsegment").alias("label"))
    votes = p.groupBy("segment", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("segment")
    best = votes.withColumn("size", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "label"))).where("k = 1 AND n > 0.25 * size").select("segment", F.col("label").alias("winner"))
    return p.join(best, "segment", "left").select("id", F.coalesce("winner", "label").alias("smoothed"))


@query("a17_floor_level", """
WITH b AS (SELECT p_brand AS g, floor(p_retailprice / 20)::BIGINT AS level, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT g, sum(n) AS total FROM b GROUP BY g), ok AS (SELECT b.g AS g, level, n FROM b JOIN t USING (g) WHERE n >= 0.02 * total)
SELECT g, min(level) AS level, arg_min(n, level) AS n FROM ok GROUP BY 1""")
def floor_level(spark, d):
    b = table(spark, d, "part").groupBy(F.col("p_brand").alias("g"), F.floor(F.col("p_retailprice") / 20).alias("level")).agg(F.count("*").alias("n"))
    ok = b.withColumn("total", F.sum("n").over(Window.partitionBy("g"))).where("n >= 0.02 * total")
    return ok.groupBy("g").agg(F.min("level").alias("level"), F.min_by("n", "level").alias("n"))


@query("a18_platforms", """
WITH c AS (SELECT DISTINCT brand AS g, floor(hiz)::BIGINT AS level, floor(lox)::BIGINT AS cx, floor(loy)::BIGINT AS cy FROM boxes)
SELECT g, level, count(*) AS cells, round(count(*) / ((max(cx) - min(cx) + 1) * (max(cy) - min(cy) + 1))::DOUBLE, 6) AS fill FROM c GROUP BY 1, 2 HAVING count(*) >= 3""", "boxes")
def platforms(spark, d):
    c = boxes(spark, d).select(F.col("brand").alias("g"), F.floor("hiz").alias("level"), F.floor("lox").alias("cx"), F.floor("loy").alias("cy")).distinct()
    area = (F.max("cx") - F.min("cx") + 1) * (F.max("cy") - F.min("cy") + 1)
    return c.groupBy("g", "level").agg(F.count("*").alias("cells"), r6(F.count("*") / area).alias("fill")).where("cells >= 3")


@query("a19_grid_occupancy", "SELECT brand AS g, count(DISTINCT (floor(lox / 0.5)::BIGINT * 1000 + floor(loy / 0.5)::BIGINT)) AS cells, round(count(DISTINCT (floor(lox / 0.5)::BIGINT * 1000 + floor(loy / 0.5)::BIGINT)) / 400.0, 6) AS occupancy FROM boxes GROUP BY 1", "boxes")
def grid_occupancy(spark, d):
    cell = F.floor(F.col("lox") / 0.5) * 1000 + F.floor(F.col("loy") / 0.5)
    return boxes(spark, d).groupBy(F.col("brand").alias("g")).agg(F.countDistinct(cell).alias("cells")).select("g", "cells", r6(F.col("cells") / 400.0).alias("occupancy"))


@query("a20_covariance", "SELECT g, round(covar_samp(x, x), 6) AS xx, round(covar_samp(x, y), 6) AS xy, round(covar_samp(x, z), 6) AS xz, round(covar_samp(y, y), 6) AS yy, round(covar_samp(y, z), 6) AS yz, round(covar_samp(z, z), 6) AS zz FROM pts GROUP BY 1", "pts")
def covariance(spark, d):
    return pts(spark, d).groupBy("g").agg(*[r6(F.covar_samp(a, b)).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])


@query("a26_standardised_similarity", """
WITH p AS (SELECT user_id AS scene, event_type AS class, avg(value) AS s FROM events GROUP BY 1, 2), m AS (SELECT class, avg(s) AS mean, stddev_pop(s) AS dev FROM p GROUP BY 1),
z AS (SELECT scene, p.class AS class, (s - mean) / greatest(dev, 1e-9) AS z FROM p JOIN m USING (class)), r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY z DESC, class) AS k FROM z) SELECT scene, class, round(z, 6) AS z FROM r WHERE k = 1""")
def standardised_similarity(spark, d):
    p = table(spark, d, "events").groupBy(F.col("user_id").alias("scene"), F.col("event_type").alias("class")).agg(F.avg("value").alias("s"))
    m = p.groupBy("class").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("dev"))
    z = p.join(F.broadcast(m), "class").withColumn("z", (F.col("s") - F.col("mean")) / F.greatest("dev", F.lit(1e-9)))  # one row per class
    w = Window.partitionBy("scene").orderBy(F.desc("z"), "class")
    return z.withColumn("k", F.row_number().over(w)).where("k = 1").select("scene", "class", r6("z").alias("z"))


@query("a27_reference_margins", """
WITH s AS (SELECT o_custkey AS id, o_orderpriority AS d, avg(o_totalprice) AS s FROM orders GROUP BY 1, 2), ref AS (SELECT d, avg(s) AS mean FROM s WHERE id % 10 = 0 GROUP BY 1),
m AS (SELECT id, s.d AS d, s - mean AS margin FROM s JOIN ref USING (d) WHERE id % 10 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY margin DESC, d) AS k, lead(margin) OVER (PARTITION BY id ORDER BY margin DESC, d) AS rival FROM m)
SELECT id, d, round(margin, 4) AS margin, round(margin - rival, 4) AS lead_ FROM r WHERE k = 1""")
def reference_margins(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("d")).agg(F.avg("o_totalprice").alias("s"))
    ref = s.where("id % 10 = 0").groupBy("d").agg(F.avg("s").alias("mean"))
    m = s.where("id % 10 <> 0").join(ref, "d").withColumn("margin", F.col("s") - F.col("mean"))
    w = Window.partitionBy("id").orderBy(F.desc("margin"), "d")
    r = m.withColumn("k", F.row_number().over(w)).withColumn("rival", F.lead("margin").over(w)).where("k = 1")
    return r.select("id", "d", F.round("margin", 4).alias("margin"), F.round(F.col("margin") - F.col("rival"), 4).alias("lead_"))


@query("a28_count_error", """
WITH c AS (SELECT n_nationkey AS scene, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS found, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS truth FROM nation)
SELECT scene, found, truth, round(CASE WHEN found > 0 AND truth > 0 THEN abs(ln(found / truth::DOUBLE)) END, 6) AS error, CASE WHEN found > 0 AND truth > 0 THEN 'defined' WHEN truth > 0 THEN 'nothing found' ELSE 'nothing to find' END AS status FROM c""")
def count_error(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("scene"))
    count = lambda t, c, name: table(spark, d, t).groupBy(F.col(c).alias("scene")).agg(F.count("*").alias(name))
    c = n.join(count("customer", "c_nationkey", "found"), "scene", "left").join(count("supplier", "s_nationkey", "truth"), "scene", "left").na.fill(0)
    status = F.when((F.col("found") > 0) & (F.col("truth") > 0), "defined").when(F.col("truth") > 0, "nothing found").otherwise("nothing to find")
    return c.select("scene", "found", "truth", r6(S.count_error(F.col("found"), F.col("truth"))).alias("error"), status.alias("status"))


MATCHED = "m AS (SELECT l_suppkey AS pred, l_partkey % 20 AS truth, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _matched(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pred"), (F.col("l_partkey") % 20).alias("truth")).agg(F.count("*").alias("n"))


@query("a29_surface_diagnostics", f"""
WITH {MATCHED}, p AS (SELECT pred, sum(n) AS size, max(n) AS most FROM m GROUP BY 1), t AS (SELECT truth, sum(n) AS size, max(n) AS most, count(*) AS fragments FROM m GROUP BY 1)
SELECT (SELECT round(sum(most) / sum(size)::DOUBLE, 6) FROM p) AS purity, (SELECT round(avg(most / size::DOUBLE), 6) FROM t) AS macro_coverage, (SELECT round(sum(most) / sum(size)::DOUBLE, 6) FROM t) AS weighted_coverage,
  (SELECT count(*) FILTER (most >= 0.02 * size) FROM t) AS recalled, (SELECT sum(fragments - 1)::BIGINT FROM t) AS excess""")
def surface_diagnostics(spark, d):
    m = _matched(spark, d)
    p = m.groupBy("pred").agg(F.sum("n").alias("size"), F.max("n").alias("most")).agg(r6(F.sum("most") / F.sum("size")).alias("purity"))
    t = m.groupBy("truth").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.count("*").alias("fragments"))
    t = t.agg(r6(F.avg(F.col("most") / F.col("size"))).alias("macro_coverage"), r6(F.sum("most") / F.sum("size")).alias("weighted_coverage"), F.count_if(F.col("most") >= 0.02 * F.col("size")).alias("recalled"), F.sum(F.col("fragments") - 1).alias("excess"))
    return p.crossJoin(F.broadcast(t))  # one row each


@query("a30_union_boxes", "SELECT brand AS g, min(lox) AS lox, min(loy) AS loy, min(loz) AS loz, max(hix) AS hix, max(hiy) AS hiy, max(hiz) AS hiz, min(conf) AS conf, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM boxes GROUP BY 1", "boxes")
def union_boxes(spark, d):
    members = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",")
    return boxes(spark, d).groupBy(F.col("brand").alias("g")).agg(*[F.min(f"lo{a}").alias(f"lo{a}") for a in "xyz"], *[F.max(f"hi{a}").alias(f"hi{a}") for a in "xyz"], F.min("conf").alias("conf"), members.alias("members"))


@query("a31_fragment_union_iou", """
WITH t AS (SELECT brand AS g, min(lox) AS a, min(loy) AS b, min(loz) AS c, max(hix) AS p, max(hiy) AS q, max(hiz) AS r FROM boxes WHERE id % 2 = 0 GROUP BY 1), f AS (SELECT brand AS g, min(lox) AS a2, min(loy) AS b2, min(loz) AS c2, max(hix) AS p2, max(hiy) AS q2, max(hiz) AS r2 FROM boxes WHERE id % 2 = 1 AND size < 25 GROUP BY 1),
m AS (SELECT g, greatest(least(p, p2) - greatest(a, a2), 0.0) * greatest(least(q, q2) - greatest(b, b2), 0.0) * greatest(least(r, r2) - greatest(c, c2), 0.0) AS i, (p - a) * (q - b) * (r - c) AS va, (p2 - a2) * (q2 - b2) * (r2 - c2) AS vb FROM t JOIN f USING (g))
SELECT g, round(i / greatest(va + vb - i, 1e-12), 6) AS iou FROM m""", "boxes")
def fragment_union_iou(spark, d):
    def union(rows, name):
        u = rows.groupBy(F.col("brand").alias("g")).agg(*[F.min(f"lo{a}").alias(f"lo{a}") for a in "xyz"], *[F.max(f"hi{a}").alias(f"hi{a}") for a in "xyz"])
        return u.select("g", S.box([F.col(f"lo{a}") for a in "xyz"], [F.col(f"hi{a}") for a in "xyz"]).alias(name))

    b = boxes(spark, d)
    return union(b.where("id % 2 = 0"), "p").join(union(b.where("id % 2 = 1 AND size < 25"), "q"), "g").select("g", r6(S.box_iou(F.col("p"), F.col("q"))).alias("iou"))


@query("a32_mask_mixtures", f"""
WITH {MATCHED}, p AS (SELECT pred, sum(n) AS sp FROM m GROUP BY 1), t AS (SELECT truth, sum(n) AS st FROM m GROUP BY 1), j AS (SELECT m.pred AS pred, m.truth AS truth, n / (sp + st - n)::DOUBLE AS iou, n / sp::DOUBLE AS purity FROM m JOIN p USING (pred) JOIN t USING (truth))
SELECT pred, arg_max(truth, (iou, -truth)) AS truth, round(max(purity), 6) AS purity, count(*) FILTER (iou > 0.012) AS mixed FROM j GROUP BY 1 HAVING count(*) FILTER (iou > 0.012) > 1""")
def mask_mixtures(spark, d):
    m = _matched(spark, d)
    j = m.join(m.groupBy("pred").agg(F.sum("n").alias("sp")), "pred").join(m.groupBy("truth").agg(F.sum("n").alias("st")), "truth").withColumn("iou", F.col("n") / (F.col("sp") + F.col("st") - F.col("n")))
    return j.groupBy("pred").agg(F.max_by("truth", F.struct("iou", F.negative("truth"))).alias("truth"), r6(F.max(F.col("n") / F.col("sp"))).alias("purity"), F.count_if(F.col("iou") > 0.012).alias("mixed")).where("mixed > 1")


@query("a33_recall_at_k", """
WITH r AS (SELECT o_custkey AS gt, o_totalprice > 150000 AS good, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders), k AS (SELECT unnest([1, 3, 5]) AS k), h AS (SELECT gt, k, bool_or(good AND rank <= k) AS hit FROM r, k GROUP BY 1, 2)
SELECT k, round(avg(hit::INT), 6) AS recall FROM h GROUP BY 1""")
def recall_at_k(spark, d):
    w = Window.partitionBy("gt").orderBy("o_orderdate", "o_orderkey")
    r = table(spark, d, "orders").withColumn("gt", F.col("o_custkey")).withColumn("rank", F.row_number().over(w)).where("o_totalprice > 150000")
    first = table(spark, d, "orders").select(F.col("o_custkey").alias("gt")).distinct().join(r.groupBy("gt").agg(F.min("rank").alias("best")), "gt", "left")
    k = first.withColumn("k", F.explode(F.array(*[F.lit(v) for v in (1, 3, 5)])))
    return k.groupBy("k").agg(r6(F.avg(F.coalesce(F.col("best") <= F.col("k"), F.lit(False)).cast("int"))).alias("recall"))


@query("a34_centroid_uncertainty", "WITH f AS (SELECT scene, frame, avg(conf) AS x, avg(k) AS y FROM obs GROUP BY 1, 2) SELECT scene, count(*) AS views, round(covar_samp(x, x) / count(*), 6) AS vx, round(covar_samp(x, y) / count(*), 6) AS vxy FROM f GROUP BY 1 HAVING count(*) > 1", "obs")
def centroid_uncertainty(spark, d):
    f = obs(spark, d).groupBy("scene", "frame").agg(F.avg("conf").alias("x"), F.avg("k").alias("y"))
    s = f.groupBy("scene").agg(F.count("*").alias("views"), F.covar_samp("x", "x").alias("vx"), F.covar_samp("x", "y").alias("vxy")).where("views > 1")
    return s.select("scene", "views", r6(F.col("vx") / F.col("views")).alias("vx"), r6(F.col("vxy") / F.col("views")).alias("vxy"))
