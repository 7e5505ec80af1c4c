"""Source and sink queries: texts made from the tables, read back by the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import formats, topology
from .geometry import r6
from .registry import halves, pts, query, table
from .rules import N1, nodes, scene_graph


@query("s01_manifest", """
WITH f AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events) SELECT 'scene' || user_id AS scene_id, ord::INT AS ord, 'f' || event_id AS frame_id, event_type AS source_camera FROM f""")
def manifest(spark, d):
    e = table(spark, d, "events")
    frame = F.struct(F.concat(F.lit("f"), "event_id").alias("frame_id"), F.col("event_type").alias("source_camera"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", frame.alias("f")))), lambda x: x["f"])
    made = e.groupBy("user_id").agg(listed.alias("frames")).select(
        F.to_json(F.struct(F.lit("scannet_sg_input").alias("format"), F.concat(F.lit("scene"), "user_id").alias("scene_id"), F.lit("m").alias("length_unit"), F.lit(1000.0).alias("depth_scale"), "frames")).alias("value")
    )
    return formats.frames(formats.manifests(made)).select("scene_id", "ord", "frame_id", "source_camera")


@query("s05_camera_text", "SELECT 'c' || p_partkey AS path, k AS \"key\", round(CASE k WHEN 'fx' THEN p_size + 0.5 ELSE p_retailprice END, 6) AS first FROM part, (SELECT unnest(['fx', 'shift']) AS k)")
def camera_text(spark, d):
    text = F.concat(F.lit("fx = "), F.col("p_size") + 0.5, F.lit(" 0 0\r\nnote\nshift = "), F.col("p_retailprice"), F.lit("\n"))
    made = table(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("path"), text.alias("value"))
    return formats.camera(made).select("path", "key", r6(F.col("values")[0]).alias("first"))


@query("s06_pose_text", "SELECT id, round(x, 6) AS x, round(y, 6) AS y, 16 AS n FROM pts", "pts")
def pose_text(spark, d):
    text = F.concat_ws(" ", F.lit("1 0 0"), "x", F.lit("\n0 1 0"), "y", F.lit("\n0 0 1 0\n0 0 0 1\n"))
    p = pts(spark, d).select("id", formats.pose(text).alias("p"))
    return p.select("id", r6(F.col("p")[3]).alias("x"), r6(F.col("p")[7]).alias("y"), F.size("p").alias("n"))


@query("s09_detections", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END AS instance_id, event_type AS object_name, round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END, 6) AS confidence FROM events""")
def detections(spark, d):
    e = table(spark, d, "events")
    record = F.struct(F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("instance_id"), F.col("event_type").alias("object_name"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("confidence"))
    made = e.select("event_id", F.to_json(F.array(record)).alias("value"))
    return made.select("event_id", F.explode(formats.detections(F.col("value"))).alias("r")).select("event_id", "r.instance_id", "r.object_name", r6("r.confidence").alias("confidence"))


@query("s10_detection_sink", "SELECT user_id, count(*) FILTER (event_id % 3 <> 0) AS records FROM events GROUP BY 1")
def detection_sink(spark, d):
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("event_id")).alias("instance_id"), F.col("event_type").alias("object_name"), F.col("value").alias("confidence"))
    j = formats.detections_json(rows, ["user_id"])
    return j.select("user_id", F.size(F.from_json("json", "array<struct<instance_id:bigint>>")).cast("bigint").alias("records"))


@query("s11_feature_json", "SELECT id, id AS instance_id, round(visual[1], 6) AS first, 32 AS width FROM halves", "halves")
def feature_json(spark, d):
    h = halves(spark, d)
    listed = F.to_json(F.array(F.struct(F.col("id").alias("instance_id"), F.lit(1).alias("occurance"), F.col("visual").alias("feature"))))
    keyed = F.to_json(F.create_map(F.col("id").cast("string"), F.struct(F.lit(1).alias("occurance"), F.col("visual").alias("feature"))))
    made = h.select("id", F.when(F.col("id") % 2 == 0, listed).otherwise(keyed).alias("value"))
    r = made.select("id", F.explode(formats.features(F.col("value"))).alias("f"))
    return r.select("id", "f.instance_id", r6(F.col("f.feature")[0]).alias("first"), F.size("f.feature").alias("width"))


@query("s13_name_map", "SELECT p_brand AS path, p_partkey AS instance_id, p_name || ', ' || p_type AS name FROM part")
def name_map(spark, d):
    line = F.concat_ws("", "p_partkey", F.lit(","), "p_name", F.lit(", "), "p_type")
    made = table(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.concat(F.lit("instance_id,name\r\n"), F.array_join(F.collect_list(line), "\r\n"), F.lit("\r\n")).alias("value"))
    return formats.name_map(made)


@query("s16_topology_roundtrip", N1 + "SELECT a.g AS source_id, b.g AS target_id, round(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2)), 6) AS distance, 1.0::DOUBLE AS confidence FROM nodes a JOIN nodes b ON a.g < b.g", "pts")
def topology_roundtrip(spark, d):
    """Published as one JSON document, loaded again, exploded into edges."""
    n = nodes(spark, d).select(F.lit("s").alias("scene"), F.col("g").cast("string").alias("id"), F.concat(F.lit("object "), "g").alias("name"), F.array("x", "y", "z").alias("position"))
    e = scene_graph(spark, d).select(F.lit("s").alias("scene"), F.col("source_id").cast("string").alias("source_id"), F.col("target_id").cast("string").alias("target_id"), "distance")
    loaded = topology.parsed(topology.published(n, e))
    return topology.edges(loaded).select(F.col("source_id").cast("int").alias("source_id"), F.col("target_id").cast("int").alias("target_id"), "distance", "confidence")


@query("s17_topology_nodes", N1 + "SELECT g::VARCHAR AS id, 'object ' || g AS name, round(cx, 6) AS x FROM nodes", "pts")
def topology_nodes(spark, d):
    n = nodes(spark, d).select(F.lit("s").alias("scene"), F.col("g").cast("string").alias("id"), F.concat(F.lit("object "), "g").alias("name"), F.array("x", "y", "z").alias("position"))
    e = n.where("false").select("scene", F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit(0.0).alias("distance"))
    loaded = topology.parsed(topology.published(n, e))
    return topology.nodes(loaded).select("id", "name", r6(F.col("position")[0]).alias("x"))


@query("s20_sampled_frames", """
WITH p AS (SELECT user_id AS scene, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), q AS (SELECT user_id AS scene, quantile_cont(value, 0.9) AS bright FROM events GROUP BY 1)
SELECT scene, event_id, round(value / bright, 6) AS tone FROM p JOIN q USING (scene) WHERE i % 3 = 0 AND i // 3 < 10""")
def sampled_frames(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.col("user_id").alias("scene"), "event_id", "value")
    q = e.groupBy("scene").agg(F.percentile("value", F.lit(0.9)).alias("bright"))
    p = e.withColumn("i", F.row_number().over(Window.partitionBy("scene").orderBy("event_id")) - 1).where("i % 3 = 0 AND i div 3 < 10")
    return p.join(q, "scene").select("scene", "event_id", r6(F.col("value") / F.col("bright")).alias("tone"))


@query("s25_region_replace", "SELECT id, g, round(x, 6) AS x FROM pts WHERE g NOT IN (2, 3) UNION ALL SELECT id, g, round(x + 1, 6) FROM pts WHERE g = 2", "pts")
def region_replace(spark, d):
    """Only the named instances (2 and 3) are replaced; the replacement of others is ignored."""
    p = pts(spark, d)
    named = p.where("g IN (2, 3)").select("g").distinct()
    new = p.where("g IN (2, 7)").withColumn("x", F.col("x") + 1)
    kept = p.join(F.broadcast(named), "g", "left_anti")  # named by the caller: a few ids
    return kept.unionByName(new.join(F.broadcast(named), "g", "left_semi")).select("id", "g", r6("x").alias("x"))


@query("s26_owned_surface", "SELECT id FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts o WHERE o.id % 4 = 0 AND o.id % 8 <> 0 AND o.x = p.x AND o.y = p.y AND o.z = p.z)", "pts")
def owned_surface(spark, d):
    """Generated rows go by their exact coordinates, unless a measured row has the same."""
    p = pts(spark, d)
    owned, measured = p.where("id % 4 = 0").select(*"xyz"), p.where("id % 8 = 0").select(*"xyz")
    return p.join(owned.join(measured, ["x", "y", "z"], "left_anti"), ["x", "y", "z"], "left_anti").select("id")


@query("s27_content_hash", "SELECT page_id, sha256(html) AS hash FROM pages")
def content_hash(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("hash"))


@query("f06_event_frames", "SELECT conv_id::VARCHAR AS path, count(*) AS events FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY 1")
def event_frames(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL AND text <> ''")
    one = F.concat(F.lit("event: delta\ndata: "), F.to_json(F.struct("text")))
    made = c.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.concat(F.array_join(F.collect_list(one), "\n\n"), F.lit("\n\ndata: [DONE]\n\n")).alias("value"))
    return formats.event_frames(made).groupBy("path").agg(F.count("*").alias("events"))


@query("f07_redaction", "SELECT page_id, replace(url, 'example', '***') AS url FROM pages")
def redaction(spark, d):
    return table(spark, d, "pages").select("page_id", formats.redacted(F.col("url"), F.lit("example")).alias("url"))
