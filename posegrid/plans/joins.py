"""Join queries: ranges, nearest, overlaps, evidence over shared frames, uniqueness."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import boxes as B, graphs, masks as M, spatial
from .geometry import r6, rect_iou_of_unknown
from .registry import as_box, boxes, halves, masks, obs, place, pts, query, table

D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


@query("j01_near_edges", f"SELECT a.id AS a, b.id AS b, round({D3}, 6) AS distance FROM pts a JOIN pts b ON a.id < b.id WHERE {D3} < 0.08", "pts")
def near_edges(spark, d):
    return spatial.near_pairs(pts(spark, d), 0.08, "id").select("a", "b", r6("distance").alias("distance"))


@query("j02_canonical_edges", f"""
SELECT a.g AS scene, a.id AS a, b.id AS b, round({D3}, 6) AS distance, round((b.x - a.x) / {D3}, 6) AS dx
FROM pts a JOIN pts b ON a.g = b.g AND a.id < b.id WHERE {D3} < 0.1 AND {D3} > 1e-8""", "pts")
def canonical_edges(spark, d):
    e = spatial.near_pairs(pts(spark, d).withColumnRenamed("g", "scene"), 0.1, "id", ["scene"], least=1e-8)
    return e.select("scene", "a", "b", r6("distance").alias("distance"), r6(F.col("direction")[0]).alias("dx"))


@query("j03_radius_coverage", f"""
WITH hit AS (SELECT a.g AS a, b.g AS b, count(DISTINCT a.id) AS near FROM pts a JOIN pts b ON a.g <> b.g WHERE {D3} <= 0.06 GROUP BY 1, 2), n AS (SELECT g, count(*) AS size FROM pts GROUP BY g)
SELECT a, b, round(near / size::DOUBLE, 6) AS share FROM hit JOIN n ON a = g""", "pts")
def radius_coverage(spark, d):
    p = pts(spark, d)
    hits = spatial.range_join(p.select(F.col("g").alias("a"), F.col("id").alias("p"), *"xyz"), p.select(F.col("g").alias("b"), *"xyz"), 0.06).where("a <> b")
    near = hits.groupBy("a", "b").agg(F.countDistinct("p").alias("near"))
    return near.join(p.groupBy(F.col("g").alias("a")).agg(F.count("*").alias("size")), "a").select("a", "b", r6(F.col("near") / F.col("size")).alias("share"))


@query("j04_symmetric_coverage", f"""
WITH k AS (SELECT DISTINCT g FROM pts), pr AS (SELECT p.g AS a, q.g AS b FROM k p JOIN k q ON p.g < q.g), n AS (SELECT g, count(*) AS size FROM pts GROUP BY g),
hit AS (SELECT a.g AS a, b.g AS b, count(DISTINCT a.id) AS near FROM pts a JOIN pts b ON a.g <> b.g WHERE {D3} <= 0.1 GROUP BY 1, 2),
s AS (SELECT k1.g AS a, k2.g AS b, coalesce(near, 0) / size::DOUBLE AS share FROM k k1 JOIN k k2 ON k1.g <> k2.g JOIN n ON n.g = k1.g LEFT JOIN hit ON hit.a = k1.g AND hit.b = k2.g)
SELECT pr.a AS a, pr.b AS b, round(s.share, 6) AS share, round(t.share, 6) AS back, round(CASE WHEN s.share + t.share > 0 THEN 2 * s.share * t.share / (s.share + t.share) ELSE 0 END, 6) AS symmetric
FROM pr JOIN s ON s.a = pr.a AND s.b = pr.b JOIN s t ON t.a = pr.b AND t.b = pr.a""", "pts")
def symmetric_coverage(spark, d):
    p = pts(spark, d)
    k = p.select("g").distinct()
    pairs = k.select(F.col("g").alias("a")).join(F.broadcast(k.select(F.col("g").alias("b"))), F.col("a") < F.col("b"))  # one row per instance
    c = spatial.coverage(p, "g", "id", 0.1, pairs)
    return c.select("a", "b", r6("share").alias("share"), r6("back").alias("back"), r6("symmetric").alias("symmetric"))


@query("j05_overlap_score", f"""
WITH one AS (SELECT a.g AS a, b.g AS b, a.id AS id, min({D3}) AS dist FROM pts a JOIN pts b ON b.g = a.g + 1 GROUP BY 1, 2, 3), m AS (SELECT g, count(*) AS n FROM pts GROUP BY g)
SELECT a, b, round(count(*) FILTER (dist < 0.12) / any_value(p.n)::DOUBLE, 6) AS ratio,
  round(count(*) FILTER (dist < 0.12) / (any_value(p.n) + any_value(q.n) - count(*) FILTER (dist < 0.12))::DOUBLE, 6) AS miou, round(avg(dist), 6) AS avg_dist
FROM one JOIN m p ON p.g = a JOIN m q ON q.g = b GROUP BY 1, 2""", "pts")
def overlap_score(spark, d):
    """Exact nearest distances inside an instance pair; the join is on the pair's key."""
    p = pts(spark, d)
    q = p.select((F.col("g") - 1).alias("g"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    dist = S.distance([F.col(a) for a in "xyz"], [F.col(f"q{a}") for a in "xyz"])
    one = p.join(q, "g").groupBy("g", "id").agg(F.min(dist).alias("dist"))
    n = p.groupBy("g").agg(F.count("*").alias("n"))
    s = one.groupBy("g").agg(F.count_if(F.col("dist") < 0.12).alias("near"), F.avg("dist").alias("avg_dist")).join(n, "g").join(n.select((F.col("g") - 1).alias("g"), F.col("n").alias("m")), "g")
    return s.select(F.col("g").alias("a"), (F.col("g") + 1).alias("b"), r6(F.col("near") / F.col("n")).alias("ratio"), r6(F.col("near") / (F.col("n") + F.col("m") - F.col("near"))).alias("miou"), r6("avg_dist").alias("avg_dist"))


@query("j06_nearest_label", f"""
WITH c AS (SELECT a.id AS id, b.id AS other, b.g AS label, {D3} AS dist FROM pts a JOIN pts b ON a.id % 2 = 1 AND b.id % 2 = 0 WHERE {D3} <= 0.1),
r AS (SELECT id, label, dist, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS k FROM c)
SELECT p.id AS id, coalesce(r.label, -1) AS label, round(r.dist, 6) AS dist FROM pts p LEFT JOIN r ON r.id = p.id AND k = 1 WHERE p.id % 2 = 1""", "pts")
def nearest_label(spark, d):
    p = pts(spark, d)
    near = spatial.nearest(p.where("id % 2 = 1"), p.where("id % 2 = 0").withColumnRenamed("id", "other"), 0.1, "id", "other")
    return near.join(p.select(F.col("id").alias("other"), "g"), "other", "left").select("id", F.coalesce("g", F.lit(-1)).alias("label"), r6("dist").alias("dist"))


@query("j07_residual", f"SELECT id FROM pts a WHERE a.id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM pts b WHERE b.id % 2 = 0 AND {D3} <= 0.05)", "pts")
def residual(spark, d):
    p = pts(spark, d)
    return spatial.residual(p.where("id % 2 = 1"), p.where("id % 2 = 0").withColumnRenamed("id", "other"), 0.05, "id").select("id")


PAIR = """SELECT a.id AS a, b.id AS b, a.brand AS brand, abs((a.lox + a.hix) / 2 - (b.lox + b.hix) / 2) AS dx, sqrt(pow((a.lox + a.hix) / 2 - (b.lox + b.hix) / 2, 2) + pow((a.loy + a.hiy) / 2 - (b.loy + b.hiy) / 2, 2) + pow((a.loz + a.hiz) / 2 - (b.loz + b.hiz) / 2, 2)) AS dist
FROM boxes a JOIN boxes b ON a.brand = b.brand AND a.id % 2 = 0 AND b.id % 2 = 1"""


def centred(spark, d):
    return boxes(spark, d).select("id", "brand", "size", "conf", *[((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(a) for a in "xyz"])


def _named_pairs(spark, d):
    c = centred(spark, d)
    a = c.where("id % 2 = 0").select("brand", F.col("id").alias("a"), *"xyz")
    b = c.where("id % 2 = 1").select("brand", F.col("id").alias("b"), *[F.col(v).alias(f"q{v}") for v in "xyz"])
    return a.join(b, "brand").withColumn("dist", S.distance([F.col(v) for v in "xyz"], [F.col(f"q{v}") for v in "xyz"]))


@query("j08_name_candidates", f"WITH p AS ({PAIR}), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM p WHERE dist <= 1.5) SELECT a, b, round(dist, 6) AS dist FROM r WHERE k = 1", "boxes")
def name_candidates(spark, d):
    w = Window.partitionBy("a").orderBy("dist", "b")
    return _named_pairs(spark, d).where("dist <= 1.5").withColumn("k", F.row_number().over(w)).where("k = 1").select("a", "b", r6("dist").alias("dist"))


@query("j09_embedding_candidates", f"""
WITH c AS (SELECT a.id AS a, b.id AS b, {D3} AS dist, list_dot_product(h.textual, k.textual) / greatest(sqrt(list_dot_product(h.textual, h.textual)) * sqrt(list_dot_product(k.textual, k.textual)), 1e-12) AS cos
  FROM pts a JOIN pts b ON a.id % 2 = 0 AND b.id % 2 = 1 JOIN halves h ON h.id = a.id JOIN halves k ON k.id = b.id WHERE {D3} <= 0.12),
s AS (SELECT a, b, 0.1 * cos + 0.3 * exp(-2 * dist) AS score FROM c WHERE cos >= 0.1), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s)
SELECT a, b, round(score, 6) AS score FROM r WHERE k = 1""", "pts halves")
def embedding_candidates(spark, d):
    p, h = pts(spark, d), halves(spark, d)
    near = spatial.range_join(p.where("id % 2 = 0").select(F.col("id").alias("a"), *"xyz"), p.where("id % 2 = 1").select(F.col("id").alias("b"), *"xyz"), 0.12)
    both = near.join(h.select(F.col("id").alias("a"), F.col("textual").alias("u")), "a").join(h.select(F.col("id").alias("b"), F.col("textual").alias("v")), "b")
    cos = both.withColumn("cos", S.cosine(F.col("u"), F.col("v"))).where("cos >= 0.1")
    scored = cos.select("a", "b", (0.1 * F.col("cos") + 0.3 * F.exp(-2 * F.col("dist"))).alias("score"))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return scored.withColumn("k", F.row_number().over(w)).where("k = 1").select("a", "b", r6("score").alias("score"))


@query("j10_similarity_matrix", """
WITH c AS (SELECT g, [avg(v) FOR v IN [1]] AS z FROM halves GROUP BY g), m AS (SELECT g, i, avg(visual[i]) AS v FROM halves, (SELECT unnest(range(1, 33)) AS i) GROUP BY g, i)
SELECT p.g AS a, q.g AS b, round(sum(p.v * q.v) / greatest(sqrt(sum(p.v * p.v)) * sqrt(sum(q.v * q.v)), 1e-12), 6) AS similarity FROM m p JOIN m q ON p.i = q.i GROUP BY 1, 2""".replace("c AS (SELECT g, [avg(v) FOR v IN [1]] AS z FROM halves GROUP BY g), ", ""), "halves")
def similarity_matrix(spark, d):
    m = halves(spark, d).select("g", F.posexplode("visual").alias("i", "v")).groupBy("g", "i").agg(F.avg("v").alias("v"))
    pairs = m.select("i", F.col("g").alias("a"), F.col("v").alias("p")).join(m.select("i", F.col("g").alias("b"), F.col("v").alias("q")), "i")
    s = pairs.groupBy("a", "b").agg(F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    return s.select("a", "b", r6(F.col("pq") / F.greatest(F.sqrt("pp") * F.sqrt("qq"), F.lit(1e-12))).alias("similarity"))


@query("j17_verified_correspondences", f"WITH p AS ({PAIR}) SELECT a, b, round(dist, 6) AS dist FROM p WHERE a + 1 = b AND dist <= 2", "boxes")
def verified_correspondences(spark, d):
    c = centred(spark, d)
    given = c.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    a = c.select(F.col("id").alias("a"), "brand", *"xyz")
    b = c.select(F.col("id").alias("b"), F.col("brand").alias("other"), *[F.col(v).alias(f"q{v}") for v in "xyz"])
    dist = S.distance([F.col(v) for v in "xyz"], [F.col(f"q{v}") for v in "xyz"])
    return given.join(a, "a").join(b, "b").where((dist <= 2) & (F.col("brand") == F.col("other"))).select("a", "b", r6(dist).alias("dist"))


@query("j18_defaulted_attributes", """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'unknown' ELSE 'known' END AS name FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def defaulted_attributes(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.lit(True).alias("there"))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("there"), "known").otherwise("unknown").alias("name"))


@query("j19_named_instances", """
SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> 'unknown' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def named_instances(spark, d):
    named = table(spark, d, "nation").where("n_name <> 'unknown'")
    skipped = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    c = table(spark, d, "customer")
    return c.join(skipped, c["c_custkey"] == skipped["o_custkey"], "left_anti").join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


EDGES = "SELECT DISTINCT l_suppkey AS a, l_partkey % 100 + 1 AS b FROM lineitem WHERE l_suppkey <> l_partkey % 100 + 1"


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b")).where("a <> b").distinct()


@query("j20_without_dangling", f"WITH e AS ({EDGES}) SELECT a, b FROM e WHERE a NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND b NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def without_dangling(spark, d):
    return graphs.without_dangling(_edges(spark, d), table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id")))


@query("j21_between_living", f"WITH e AS ({EDGES}) SELECT a, b FROM e WHERE a IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) AND b IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def between_living(spark, d):
    return graphs.between_living(_edges(spark, d), table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("id")))


@query("j22_global_ids", """
WITH m AS (SELECT user_id AS scene, CAST(ts AS DATE) AS frame, event_type AS label, min(event_id) AS gid FROM events WHERE value > 50 GROUP BY 1, 2, 3)
SELECT o.event_id AS event_id, coalesce(m.gid, -1) AS gid FROM obs o LEFT JOIN m USING (scene, frame, label)""", "obs")
def global_ids(spark, d):
    o = obs(spark, d)
    m = o.where("conf > 50").groupBy("scene", "frame", "label").agg(F.min("event_id").alias("gid"))
    return o.join(m, ["scene", "frame", "label"], "left").select("event_id", F.coalesce("gid", F.lit(-1)).alias("gid"))


@query("j23_recovered_ownership", """
WITH old AS (SELECT DISTINCT scene, frame FROM obs WHERE label = 'click'), new AS (SELECT scene, frame, max(event_id) AS event_id FROM obs WHERE label <> 'click' GROUP BY 1, 2)
SELECT scene, frame, event_id FROM new WHERE scene IN (SELECT c_custkey FROM customer) AND NOT EXISTS (SELECT 1 FROM old WHERE old.scene = new.scene AND old.frame = new.frame)""", "obs")
def recovered_ownership(spark, d):
    o = obs(spark, d)
    old = o.where("label = 'click'").select("scene", "frame").distinct()
    new = o.where("label <> 'click'").groupBy("scene", "frame").agg(F.max("event_id").alias("event_id"))
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("scene"))
    return new.join(owners, "scene", "left_semi").join(old, ["scene", "frame"], "left_anti")


@query("j24_parts_of_parent", """
SELECT 'part' AS kind, n_nationkey AS id, n_name AS name, n_regionkey AS parent_id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'object', r_regionkey, r_name, NULL FROM region WHERE r_regionkey = 2""")
def parts_of_parent(spark, d):
    parts = table(spark, d, "nation").where("n_regionkey = 2").select(F.lit("part").alias("kind"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_id"))
    return parts.unionByName(table(spark, d, "region").where("r_regionkey = 2").select(F.lit("object").alias("kind"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), allowMissingColumns=True)


@query("j25_parent_margin", """
WITH s AS (SELECT l_partkey AS part, l_suppkey AS gid, count(*) / sum(count(*)) OVER (PARTITION BY l_partkey) AS cover FROM lineitem GROUP BY 1, 2),
r AS (SELECT part, gid, cover, row_number() OVER (PARTITION BY part ORDER BY cover DESC, gid) AS k, lead(cover) OVER (PARTITION BY part ORDER BY cover DESC, gid) AS runner FROM s)
SELECT part, CASE WHEN cover >= 0.05 AND cover - coalesce(runner, 0) >= 0.02 THEN gid END AS parent FROM r WHERE k = 1""")
def parent_margin(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("gid")).agg(F.count("*").alias("n"))
    s = s.withColumn("cover", F.col("n") / F.sum("n").over(Window.partitionBy("part")))
    w = Window.partitionBy("part").orderBy(F.desc("cover"), "gid")
    r = s.withColumn("k", F.row_number().over(w)).withColumn("runner", F.lead("cover").over(w)).where("k = 1")
    return r.select("part", F.when((F.col("cover") >= 0.05) & (F.col("cover") - F.coalesce("runner", F.lit(0.0)) >= 0.02), F.col("gid")).alias("parent"))


@query("j26_best_record", """
WITH m AS (SELECT a.id AS a, b.id AS b, greatest(least(a.hix, b.hix) - greatest(a.lox, b.lox), 0.0) * greatest(least(a.hiy, b.hiy) - greatest(a.loy, b.loy), 0.0) AS i, (a.hix - a.lox) * (a.hiy - a.loy) AS va, (b.hix - b.lox) * (b.hiy - b.loy) AS vb
  FROM boxes a JOIN boxes b ON a.brand = b.brand AND a.id % 2 = 0 AND b.id % 2 = 1),
r AS (SELECT a, b, i / greatest(va + vb - i, 1e-12) AS iou, row_number() OVER (PARTITION BY a ORDER BY i / greatest(va + vb - i, 1e-12) DESC, b) AS k FROM m)
SELECT a, CASE WHEN iou >= 0.35 THEN b END AS b FROM r WHERE k = 1""", "boxes")
def best_record(spark, d):
    def rule(a, b):
        """A part's best partner of each box, where it is good enough; ties go to the smaller id."""
        both = B.sides(a, b, "x") * B.sides(a, b, "y")
        iou = both / np.maximum(B.area(a) + B.area(b) - both, S.EPS)
        some = np.nonzero((iou >= 0.35).any(axis=1))[0]
        order = np.argsort(b["id"][0], kind="stable")
        best = order[iou[np.ix_(some, order)].argmax(axis=1)]
        return some, best, iou[some, best]

    all_ = boxes(spark, d)
    even, odd = all_.where("id % 2 = 0"), all_.where("id % 2 = 1")
    met = B.joined(even, odd, ["brand"], [], rule, "a long, b long, iou double")
    side = lambda df, n, c: df.select("brand", F.col("id").alias(n), as_box().alias(c))
    unknown = side(B.broken(even), "a", "p").join(side(odd, "b", "q"), "brand").unionByName(side(even.join(B.broken(even).select("id"), "id", "left_anti"), "a", "p").join(side(B.broken(odd), "b", "q"), "brand"))
    met = met.unionByName(unknown.select("a", "b", rect_iou_of_unknown().alias("iou")))
    best = met.groupBy("a").agg(F.max(F.struct("iou", F.negative("b").alias("nb"))).alias("m"))
    asked = even.join(odd.select("brand").distinct(), "brand", "left_semi").select(F.col("id").alias("a"))
    return asked.distinct().join(best, "a", "left").select("a", F.when(F.col("m.iou") >= 0.35, -F.col("m.nb")).alias("b"))


@query("j27_mask_iou", """
WITH n AS (SELECT mask_id, count(*) AS n FROM masks GROUP BY 1), b AS (SELECT p.mask_id AS a, q.mask_id AS b, count(*) AS n FROM masks p JOIN masks q ON p.point_id = q.point_id AND p.mask_id < q.mask_id GROUP BY 1, 2)
SELECT a, b, b.n AS both_, round(b.n / (p.n + q.n - b.n)::DOUBLE, 6) AS iou FROM b JOIN n p ON p.mask_id = a JOIN n q ON q.mask_id = b""", "masks")
def mask_iou(spark, d):
    return M.overlaps(masks(spark, d)).select("a", "b", F.col("both").alias("both_"), r6("iou").alias("iou"))


@query("j28_owner_peer_intersections", """
SELECT c_nationkey AS owner, o_orderpriority AS peer, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def owner_peer_intersections(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("owner"), F.col("o_orderpriority").alias("peer")).agg(F.count("*").alias("n"))


@query("j29_pair_evidence", """
WITH m AS (SELECT scene, frame, label, sum(conf) AS mass FROM obs GROUP BY 1, 2, 3), t AS (SELECT scene, frame, sum(mass) AS total FROM m GROUP BY 1, 2),
s AS (SELECT m.scene, m.frame, label, mass / total AS share FROM m JOIN t USING (scene, frame))
SELECT a.label AS a, b.label AS b, count(*) AS joint_views, count(*) FILTER (least(a.share, b.share) >= 0.3) AS support_views, count(*) FILTER (greatest(a.share, b.share) >= 0.8) AS separation_views
FROM s a JOIN s b ON a.scene = b.scene AND a.frame = b.frame AND a.label < b.label GROUP BY 1, 2""", "obs")
def pair_evidence(spark, d):
    # Doubles add up in the file's order, labels as they first appear, so no share hangs on the partitions.
    w = lambda *k: Window.partitionBy(*k).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = obs(spark, d, place().alias("at")).withColumn("mass", F.sum("conf").over(w("scene", "frame", "label")))
    m = o.groupBy("scene", "frame", "label").agg(F.max("mass").alias("mass"), F.min("at").alias("at"))
    s = m.withColumn("share", S.quotient(F.col("mass"), F.sum("mass").over(w("scene", "frame"))))
    pairs = s.select("scene", "frame", F.col("label").alias("a"), F.col("share").alias("p")).join(s.select("scene", "frame", F.col("label").alias("b"), F.col("share").alias("q")), ["scene", "frame"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("joint_views"), F.count_if(F.least("p", "q") >= 0.3).alias("support_views"), F.count_if(F.greatest("p", "q") >= 0.8).alias("separation_views"))


@query("j31_coframe_separation", """
SELECT a.label AS a, b.label AS b, count(DISTINCT a.frame) AS views FROM obs a JOIN obs b ON a.scene = b.scene AND a.frame = b.frame AND a.label < b.label AND abs(a.conf - b.conf) > 0.5 * least(a.conf, b.conf) GROUP BY 1, 2""", "obs")
def coframe_separation(spark, d):
    o = obs(spark, d)
    pairs = o.select("scene", "frame", F.col("label").alias("a"), F.col("conf").alias("p")).join(o.select("scene", "frame", F.col("label").alias("b"), F.col("conf").alias("q")), ["scene", "frame"])
    return pairs.where((F.col("a") < F.col("b")) & (F.abs(F.col("p") - F.col("q")) > 0.5 * F.least("p", "q"))).groupBy("a", "b").agg(F.countDistinct("frame").alias("views"))


STACK = "b.loz - a.hiz BETWEEN -0.04 AND 0.03 AND b.lox < a.hix AND a.lox < b.hix AND b.loy < a.hiy AND a.loy < b.hiy"


def _stacks(spark, d):
    """Body above support: candidates meet in a cell of the support's top, then the exact rule decides."""
    b = boxes(spark, d)
    low = b.select("brand", F.col("id").alias("a"), *[F.col(f"{n}{x}").alias(f"a{n}{x}") for n in ("lo", "hi") for x in "xyz"])
    high = b.select("brand", F.col("id").alias("b"), *[F.col(f"{n}{x}").alias(f"b{n}{x}") for n in ("lo", "hi") for x in "xyz"])
    low = low.withColumn("level", F.explode(F.sequence(S.cell(F.col("ahiz") - 0.04, 0.25), S.cell(F.col("ahiz") + 0.03, 0.25))))
    pairs = low.join(high.withColumn("level", S.cell(F.col("bloz"), 0.25)), ["brand", "level"])
    gap = F.col("bloz") - F.col("ahiz")
    return pairs.where((F.col("a") != F.col("b")) & gap.between(-0.04, 0.03) & (F.col("blox") < F.col("ahix")) & (F.col("alox") < F.col("bhix")) & (F.col("bloy") < F.col("ahiy")) & (F.col("aloy") < F.col("bhiy")))


@query("j32_stack_candidates", f"SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.brand = b.brand AND a.id <> b.id WHERE {STACK}", "boxes")
def stack_candidates(spark, d):
    return _stacks(spark, d).select("a", "b")


@query("j33_ball_neighbours", f"WITH c AS (SELECT id, x * 10 AS x, y * 10 AS y, z * 10 AS z FROM pts) SELECT a.id AS id, count(*) AS neighbours FROM c a JOIN c b ON {D3} <= 0.65 AND a.id <> b.id GROUP BY 1", "pts")
def ball_neighbours(spark, d):
    c = pts(spark, d).select("id", *[(F.col(a) * 10).alias(a) for a in "xyz"])
    return spatial.range_join(c, c.withColumnRenamed("id", "other"), 0.65).where("id <> other").groupBy("id").agg(F.count("*").alias("neighbours"))


@query("j34_reciprocal_unique", f"""
WITH p AS (SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.brand = b.brand AND a.id <> b.id WHERE {STACK}), q AS (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM p)
SELECT a, b FROM q WHERE na = 1 AND nb = 1""", "boxes")
def reciprocal_unique(spark, d):
    return graphs.unique_partners(_stacks(spark, d).select("a", "b"))


@query("j35_acyclic_parents", f"""
WITH p AS (SELECT DISTINCT b.id AS child, a.id AS parent FROM boxes a JOIN boxes b ON a.brand = b.brand AND a.id <> b.id WHERE {STACK}) SELECT child, parent FROM p WHERE parent NOT IN (SELECT child FROM p)""", "boxes")
def acyclic_parents(spark, d):
    return graphs.acyclic(_stacks(spark, d).select(F.col("b").alias("child"), F.col("a").alias("parent")).distinct())


CONTAIN = "a.lox >= b.lox AND a.hix <= b.hix AND a.loy >= b.loy AND a.hiy <= b.hiy AND b.size >= 2 * a.size"


@query("j36_maximal_containers", f"SELECT a.id AS id, a.brand AS brand FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE a.brand = b.brand AND {CONTAIN})", "boxes")
def maximal_containers(spark, d):
    a, b = boxes(spark, d).alias("a"), boxes(spark, d).alias("b")
    return a.join(b, F.expr(f"a.brand = b.brand AND {CONTAIN}"), "left_anti").select("id", "brand")
