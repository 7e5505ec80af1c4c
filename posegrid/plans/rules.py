"""Rule queries over evidence read from line items, metric comparison, graph invariants, node-level API."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as P
from ..operators import spatial
from .geometry import r6
from .registry import VIEWS, obs, pts, query, table

#: Evidence is read from line items so that every rule has cases on both sides of its thresholds.
EVIDENCE = {
    "support": "l_linenumber % 6", "separation": "(l_orderkey + l_linenumber) % 2", "joint": "l_linenumber * 2", "whole": "l_linenumber + 1", "views": "l_linenumber + l_partkey % 3", "features": "l_suppkey % 5",
    "consensus": "0.3 + l_discount * 7", "owner": "0.4 + l_discount * 6", "inclusion": "0.9 + l_discount", "cover": "0.6 + l_tax * 5", "semantic": "0.4 + l_tax * 7", "iou": "0.5 + l_discount * 5", "purity": "l_quantity / 50",
    "extent": "l_quantity / 12", "points": "l_quantity * 8 * (l_partkey % 20 + 1)", "core": "l_quantity * 10", "confidence": "0.5 + l_discount * 5", "best": "0.6 + l_discount * 5", "baseline": "l_tax * 3", "gap": "0.08 - l_tax",
    "background": "l_quantity / 45", "supported": "l_discount * 9", "visible": "0.4 + l_tax * 7", "against": "0.5 + l_tax * 6", "own": "l_discount", "weighted": "l_discount * 4", "mixed": "l_tax * 3", "detected": "l_discount * 4",
    "margin": "l_discount - 0.05", "linear": "l_discount / 8", "level": "0.9 + l_discount", "flat": "0.7 + l_tax * 4", "removed": "l_discount * 5", "keep0": "0.5 + l_tax * 6", "keep1": "0.4 + l_discount * 6", "keep2": "l_quantity / 50",
    "areas": "l_linenumber % 4", "narrow": "l_quantity / 60", "wide": "l_quantity / 30", "added": "l_quantity * 20",
    "body": "l_quantity * 9 * (l_suppkey % 20 + 1)", "height": "l_quantity / 40", "face": "l_discount * 8", "contact": "l_quantity * 4", "cells": "l_quantity * 10", "seam": "0.6 + l_discount * 4", "continuity": "0.7 + l_tax * 4",
    "mismatch": "l_tax / 1.5", "tilt": "l_discount", "dot": "l_tax * 2.5", "parallel": "0.99 + l_discount / 10", "depth": "l_quantity / 50", "layers": "l_linenumber", "closed": "l_discount * 9", "kept": "l_quantity / 50",
    "complete": "l_discount * 9.5", "growth": "l_quantity / 12", "free": "l_tax / 2", "conflict": "l_discount * 0.8", "cohort": "l_linenumber % 3",
}
FLAGS = {"compositional": "l_returnflag = 'A'", "visual": "l_returnflag = 'R'", "aligned": "l_linestatus = 'O'", "same": "l_linestatus = 'F'"}

RULE_SQL = {
    "p01_contained_duplicate": "inclusion >= 0.95 AND cover >= 0.99 AND support >= 3 AND consensus >= 0.5 AND separation = 0",
    "p02_granularity": """CASE WHEN inclusion >= 0.95 AND cover >= 0.8 AND semantic >= 0.6 AND whole >= 5 AND consensus >= 0.5 AND separation = 0 THEN 'duplicate'
        WHEN gap >= 0.03 AND inclusion >= 0.95 AND cover >= 0.65 AND semantic >= 0.6 AND joint >= 8 AND owner >= 0.7 AND baseline >= 0.08 AND support <= 0.25 * joint THEN 'transfer' ELSE 'none' END""",
    "p03_background_rejection": "views >= 5 AND supported >= 0.5 AND background > 0.5 AND extent > 3",
    "p04_planar_rejection": "level >= 0.95 AND flat >= 0.9 AND views >= 5 AND supported >= 0.5 AND background > 0.8",
    "p05_confirmed_existence": "mixed <= 0.1 AND support >= 5 AND supported >= 0.65 AND baseline >= 0.08",
    "p05_confirmed_core": """mixed <= 0.1 AND support >= 5 AND baseline >= 0.08 AND core >= 128 AND core >= 0.3 * points AND list_sort([keep0, keep1, keep2])[3] >= 0.8 AND list_sort([keep0, keep1, keep2])[2] >= 0.6""",
    "p06_hierarchy": "whole >= 5 AND consensus >= 0.65 AND baseline >= 0.1",
    "p07_native_merge": "extent >= 0.5 AND semantic >= 0.8 AND whole >= 3 AND consensus >= 0.6 AND gap <= 0.03 AND separation = 0",
    "p08_whole_object": """CASE WHEN iou >= 0.9 AND cover >= 0.8 AND semantic >= 0.6 AND whole >= 5 AND consensus >= 0.5 AND separation = 0 THEN 'shared_measured_surface'
        WHEN visual AND iou >= 0.6 AND whole >= 3 AND consensus >= 0.8 AND gap <= 0.04 AND separation = 0 THEN 'complementary_measured_body'
        WHEN visual AND aligned AND whole >= 1 AND joint >= 2 AND consensus >= 0.5 AND gap <= 0.05 AND separation <= 1 THEN 'aligned_measured_terminal_face' END""",
    "p09_contradicted": "views >= 5 AND visible >= 0.6 AND against >= 0.8 AND own < 0.05 AND weighted < 0.2",
    "p10_rejection_reasons": """array_to_string(list_filter([CASE WHEN joint >= 3 AND mixed > 0.2 THEN 'mixed' END, CASE WHEN views >= 5 AND detected < 0.2 THEN 'undetected' END, CASE WHEN margin < 0 AND NOT supported >= 0.6 THEN 'below class mean' END,
        CASE WHEN margin < 0.02 AND NOT supported >= 0.6 THEN 'no contrast' END, CASE WHEN views >= 5 AND supported >= 0.5 AND background > 0.5 AND extent > 3 THEN 'background' END], lambda x: x IS NOT NULL), ', ')""",
    "p11_compact": "CASE WHEN views < 4 THEN 'too few frames' WHEN points < 64 OR baseline < 0.1 OR confidence < 0.75 OR features < 3 THEN 'weak surface' WHEN extent > 0.65 THEN 'too large' ELSE 'accepted' END",
    "p12_proposal": "views >= 4 AND features >= 3 AND baseline >= 0.15 AND points >= 64 AND confidence >= CASE WHEN views >= 6 THEN 0.55 ELSE 0.75 END AND extent <= 3",
    "p12_admissible_pair": "CASE WHEN gap <= 0.006 AND (same OR semantic >= 0.8) AND separation = 0 AND least(cover, inclusion) >= 0.15 AND greatest(cover, inclusion) >= 0.85 THEN least(cover, inclusion) ELSE 0.0::DOUBLE END",
    "p13_admission": """CASE WHEN baseline >= 0.15 AND features >= 1 AND views = 2 AND confidence >= 0.75 AND best >= 0.9 THEN 'strict_two_view'
        WHEN baseline >= 0.15 AND features >= 1 AND views >= 3 AND features >= 2 AND confidence >= 0.65 AND best >= 0.8 THEN 'multiview' END""",
    "p12_related_surface": "semantic >= 0.5 AND cover >= 0.8",
    "p15_existence_rejection": "linear < 0.02 AND margin < -0.02 AND views >= 5 AND visible >= 0.8 AND own < 0.05 AND background >= 0.9 AND weighted < 0.35 AND joint >= 5 AND baseline >= 0.15",
    "p16_isolated_fragment": "views >= 2 AND joint < 3 AND views / greatest(views + joint, 1.0) >= 0.6 AND baseline >= 0.15",
    "p17_witnessed": "best < 0.7 AND own < 0.25 AND extent <= 0.65 AND support >= 2 AND features >= 2 AND baseline >= 0.15 AND confidence >= 0.5 AND areas >= 2 AND points >= 64",
    "p24_support_surface": "views >= 3 AND cover >= 0.7 AND purity >= 0.6",
    "p18_part_acceptance": "semantic >= 0.8 OR (semantic >= 0.65 AND compositional) OR (semantic >= 0.4 AND whole >= 3 AND consensus >= 0.6 AND separation = 0)",
    "p18_anchored_part": "support >= 5 AND purity >= 0.5 AND joint >= 3 AND points >= 32 AND body >= 32 AND inclusion >= 0.98 AND mixed <= 0.5 AND gap <= 0.015",
    "p19_coobserved": "points >= 16 AND body >= 16 AND cover >= 0.6 AND visible >= 0.6",
    "p20_enclosure_seam": "points >= 512 AND points < body AND semantic >= 0.85 AND views >= 3 AND height >= 0.5 AND mismatch <= 0.04 AND tilt <= 0.08 AND face >= 0.4 AND dot <= 0.15 AND contact >= 64 AND cells >= 128 AND seam >= 0.8 AND continuity >= 0.8",
    "p22_rear_boundary": "core >= 256 AND parallel >= 0.995 AND depth > CASE WHEN visual THEN 0.04 ELSE 0.12 END AND depth < CASE WHEN visual THEN 0.22 ELSE 0.8 END",
    "p23_completion": "CASE WHEN cover < 0.8 OR complete < 0.1 OR complete > 0.85 OR growth > 3 THEN 'incompatible' WHEN conflict > 0.05 THEN 'other owner' WHEN free > 0.03 THEN 'free space' WHEN added < 32 THEN 'too few' ELSE 'accepted' END",
    "p25_open_layers": "layers >= 3 AND closed <= 0.6 AND kept >= 0.25 AND kept <= 0.95",
    "p28_dense_crossbar": "views >= 3 AND added >= 64",
    "p29_thin_recovery": "cohort = 1 AND views >= 12 AND added >= greatest(128, 3 * points)",
    "p30_fixture_part": "same AND views >= 3 AND support >= 3 AND purity >= 0.5",
    "p26_planar": "points >= 4096 AND flat >= 0.8 AND extent >= 0.5",
    "p27_dense_recovery": "points >= 1024 AND narrow >= 0.2 AND wide >= 0.8 AND level >= 0.995 AND flat >= 0.55 AND added >= 256",
}


def evidence(spark, d):
    # Rounded, so that thresholds do not depend on the last bit.
    cols = [F.round(F.expr(v).cast("double"), 6).alias(k) for k, v in EVIDENCE.items()]
    flags = [F.expr(v).alias(k) for k, v in FLAGS.items()]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *cols, *flags)


VIEWS["ev"] = "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in EVIDENCE.items()) + ", " + ", ".join(f"{v} AS {k}" for k, v in FLAGS.items()) + " FROM lineitem"


def _rule(name, rule):
    @query(name, f"SELECT l_orderkey, l_linenumber, {RULE_SQL[name]} AS verdict FROM ev", "ev")
    def run(spark, d):
        return evidence(spark, d).select("l_orderkey", "l_linenumber", rule(F.col).alias("verdict"))

    return run


for _name, _f in P.RULES.items():
    _rule(_name, _f)


@query("p14_supported_trim", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity % 7 AS positive, (l_partkey + l_linenumber) % 7 AS negative, round(l_tax / 2, 6) AS distance FROM lineitem),
f AS (SELECT *, positive / greatest(positive + negative, 1.0) < 0.4 AND negative >= 3 AND distance > 0.01 AS out FROM v)
SELECT l_orderkey, l_linenumber, out AND avg(out::INT) OVER (PARTITION BY l_suppkey) <= 0.3 AS removed FROM f""")
def supported_trim(spark, d):
    """Line items as voted points of their supplier's instance."""
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_quantity") % 7).alias("positive"), ((F.col("l_partkey") + F.col("l_linenumber")) % 7).alias("negative"), F.round(F.col("l_tax") / 2, 6).alias("distance"))
    return spatial.supported_trim(v, "l_suppkey").select("l_orderkey", "l_linenumber", "removed")


@query("p31_metric_compare", """
WITH m AS (SELECT c_nationkey AS scene, c_mktsegment AS profile, round(avg(c_acctbal), 6) AS ap25, round(min(c_acctbal), 6) AS ap50, count(*) AS frames FROM customer GROUP BY 1, 2), b AS (SELECT * FROM m WHERE profile = 'BUILDING')
SELECT m.scene AS scene, m.profile AS profile, m.ap25 >= b.ap25 - 1e-10 AND m.ap50 >= b.ap50 - 1e-10 AND (m.ap25 > b.ap25 + 1e-10 OR m.ap50 > b.ap50 + 1e-10) AS accepted, m.frames = b.frames AS same_scope FROM m JOIN b USING (scene) WHERE m.profile <> 'BUILDING'""")
def metric_compare(spark, d):
    """No metric may fall, one must rise, and both runs must have the same scope."""
    m = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("scene"), F.col("c_mktsegment").alias("profile")).agg(r6(F.avg("c_acctbal")).alias("ap25"), r6(F.min("c_acctbal")).alias("ap50"), F.count("*").alias("frames"))
    b = m.where("profile = 'BUILDING'").select("scene", *[F.col(c).alias(f"b_{c}") for c in ("ap25", "ap50", "frames")])
    j = m.where("profile <> 'BUILDING'").join(b, "scene")
    holds = P.every(*[F.col(c) >= F.col(f"b_{c}") - 1e-10 for c in ("ap25", "ap50")])
    gains = P.any_of(*[F.col(c) > F.col(f"b_{c}") + 1e-10 for c in ("ap25", "ap50")])
    return j.select("scene", "profile", (holds & gains).alias("accepted"), (F.col("frames") == F.col("b_frames")).alias("same_scope"))


@query("p32_evidence_rank", "WITH s AS (SELECT l_partkey, l_orderkey, l_linenumber, round(confidence * sqrt(cover), 6) AS quality FROM ev) SELECT l_partkey, max(quality) AS quality, count(*) AS n FROM s GROUP BY 1", "ev")
def evidence_rank(spark, d):
    return evidence(spark, d).select("l_partkey", r6(P.evidence_rank(F.col)).alias("quality")).groupBy("l_partkey").agg(F.max("quality").alias("quality"), F.count("*").alias("n"))


@query("p33_graph_invariants", """
SELECT 'orphan order' AS rule, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS violations UNION ALL SELECT 'orphan nation', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region))
UNION ALL SELECT 'repeated line', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) UNION ALL SELECT 'wrong width', (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) UNION ALL SELECT 'empty shape', (SELECT count(*) FROM part WHERE p_size <= 0)""")
def graph_invariants(spark, d):
    t = lambda n: table(spark, d, n)
    checks = {
        "orphan order": t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "orphan nation": t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_anti"),
        "repeated line": t("lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "wrong width": t("embeddings").where(F.size("embedding") != 64),
        "empty shape": t("part").where("p_size <= 0"),
    }
    out = None
    for name, bad in checks.items():
        n = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = n if out is None else out.unionByName(n)
    return out


D3 = "sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2))"
N1 = f"""
WITH cells AS (SELECT g, floor(x / 0.1)::BIGINT AS i, floor(y / 0.1)::BIGINT AS j, floor(z / 0.1)::BIGINT AS k, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY 1, 2, 3, 4),
nodes AS (SELECT g, min(x) AS lx, max(x) AS hx, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, count(*) AS n FROM cells GROUP BY 1)
"""


def nodes(spark, d):
    """Instances as nodes: occupied cells, bounds, centre."""
    cells = spatial.voxel_centroids(pts(spark, d), 0.1, ["g"]).drop("n")
    b = spatial.bounds(cells, "g")
    return b.select("g", *[((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(a) for a in "xyz"], (F.col("hix") - F.col("lox")).alias("length"), "n")


@query("n01_scene_graph", N1 + f"SELECT a.g AS source_id, b.g AS target_id, round({D3}, 6) AS distance, 'next to' AS description, a.n AS cells FROM nodes a JOIN nodes b ON a.g < b.g WHERE {D3} < 2", "pts")
def scene_graph(spark, d):
    n = nodes(spark, d)
    e = spatial.near_pairs(n, 2.0, "g")
    return e.join(n.select(F.col("g").alias("a"), "n"), "a").select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), r6("distance").alias("distance"), F.lit("next to").alias("description"), F.col("n").alias("cells"))


@query("n02_graph_nodes", N1 + "SELECT g, round(hx - lx, 6) AS length, n, n >= 10 AND hx - lx <= 3 AS kept FROM nodes", "pts")
def graph_nodes(spark, d):
    return nodes(spark, d).select("g", r6("length").alias("length"), "n", ((F.col("n") >= 10) & (F.col("length") <= 3)).alias("kept"))


@query("n04_cylinder_update", "SELECT p_partkey AS id, round((p_size / 10.0 + p_retailprice / 1000.0) / 4, 6) AS radius FROM part")
def cylinder_update(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6((F.col("p_size") / 10.0 + F.col("p_retailprice") / 1000.0) / 4).alias("radius"))


@query("n05_published_edges", N1 + f"SELECT a.g AS a, b.g AS b, round({D3}, 6) AS distance, (SELECT count(*) FROM nodes) AS nodes FROM nodes a JOIN nodes b ON a.g < b.g WHERE {D3} < 2 AND {D3} > 1e-8 AND a.n >= 16 AND b.n >= 16", "pts")
def published_edges(spark, d):
    n = nodes(spark, d)
    e = spatial.near_pairs(n.where("n >= 16"), 2.0, "g", least=1e-8).select("a", "b", r6("distance").alias("distance"))
    return e.crossJoin(F.broadcast(n.agg(F.count("*").alias("nodes"))))  # one row


@query("n06_graph_edits", """
WITH base AS (SELECT n_nationkey AS id, n_name AS name FROM nation), put AS (SELECT n_nationkey AS id, upper(n_name) AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 100 + r_regionkey, r_name FROM region), gone AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 3)
SELECT id, name FROM base WHERE id NOT IN (SELECT id FROM put) AND id NOT IN (SELECT id FROM gone) UNION ALL SELECT id, name FROM put WHERE id NOT IN (SELECT id FROM gone)""")
def graph_edits(spark, d):
    """Upserts and deletes of nodes as a new table version."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    base = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    put = n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"), F.upper("n_name").alias("name")).unionByName(r.select((100 + F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name")))
    gone = n.where("n_regionkey = 3").select(F.col("n_nationkey").alias("id"))
    return base.join(put, "id", "left_anti").unionByName(put).join(gone, "id", "left_anti")


@query("n08_scene_review", """
WITH m AS (SELECT l_partkey AS gt, max(l_discount) AS best FROM lineitem GROUP BY 1) SELECT CASE WHEN best >= 0.09 THEN 'good' WHEN best >= 0.06 THEN 'loose' WHEN best > 0 THEN 'poor' ELSE 'missed' END AS diagnosis, count(*) AS n FROM m GROUP BY 1""")
def scene_review(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gt")).agg(F.max("l_discount").alias("best"))
    b = F.col("best")
    return m.groupBy(F.when(b >= 0.09, "good").when(b >= 0.06, "loose").when(b > 0, "poor").otherwise("missed").alias("diagnosis")).agg(F.count("*").alias("n"))


@query("y01_identity_merge", """
WITH remap AS (SELECT s_suppkey AS source, arg_min(s2, s2) AS body FROM (SELECT a.s_suppkey AS s_suppkey, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey < a.s_suppkey) GROUP BY 1),
v AS (SELECT coalesce(body, l_suppkey) AS id, l_returnflag AS parent, count(*) AS votes FROM lineitem LEFT JOIN remap ON source = l_suppkey GROUP BY 1, 2)
SELECT id, parent, votes FROM v""")
def identity_merge(spark, d):
    """Accepted sources are renamed in every table; votes of source and body add up."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    body = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("body"))
    remap = s.join(body, "s_nationkey").where("s_suppkey <> body").select(F.col("s_suppkey").alias("source"), "body")
    v = table(spark, d, "lineitem").join(remap, F.col("l_suppkey") == F.col("source"), "left")
    return v.groupBy(F.coalesce("body", "l_suppkey").alias("id"), F.col("l_returnflag").alias("parent")).agg(F.count("*").alias("votes"))


@query("t00_event_windows", """
SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS label, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "label", "n", "total")
