"""Readers and writers of the capture's text formats. Each parser is a Column or DataFrame function over text, so that a
file source is `spark.read.text(..., wholetext=True)` or `binaryFile` followed by the parser; schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "struct<frame_id:string,source_camera:string,source_camera_frame:int,rgb:string,depth:string,pose:array<double>>"
MANIFEST = f"format string, dataset string, scene_id string, camera_info string, length_unit string, pose_convention string, world_frame string, depth_type string, depth_scale double, frames array<{FRAME}>"
SAFE_ID = r"^[A-Za-z0-9._-]+$"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path and value of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def manifests(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row per manifest; what can't be parsed is an error, not a null."""
    m = texts.select(F.from_json(column, MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")
    ok = (F.col("format") == "scannet_sg_input") & (F.col("length_unit") == "m") & (F.col("depth_scale") > 0)
    return m.withColumn("format", F.when(ok, F.col("format")).otherwise(F.raise_error(F.concat(F.lit("manifest not accepted: "), F.coalesce("scene_id", F.lit("?"))))))


def frames(manifest: DataFrame) -> DataFrame:
    """Frames in manifest order."""
    return manifest.select("scene_id", F.posexplode("frames").alias("ord", "f")).select("scene_id", "ord", "f.*")


def frame_faults(frame_rows: DataFrame) -> DataFrame:
    """Rows that break a rule, with its name: repeated or unsafe ids, poses that aren't sixteen finite numbers."""
    repeated = frame_rows.groupBy("scene_id", "frame_id").count().where("count > 1").select("scene_id", "frame_id", F.lit("repeated id").alias("fault"))
    unsafe = frame_rows.where(F.col("frame_id").isNull() | ~F.col("frame_id").rlike(SAFE_ID)).select("scene_id", "frame_id", F.lit("unsafe id").alias("fault"))
    pose = frame_rows.where(F.col("pose").isNotNull() & ~pose_ok(F.col("pose"))).select("scene_id", "frame_id", F.lit("bad pose").alias("fault"))
    return repeated.unionByName(unsafe).unionByName(pose)


def pose_ok(p: Column) -> Column:
    finite = F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (F.size(p) == 16) & finite


def numbers(text: Column) -> Column:
    """All white-space separated numbers of a text; null where one isn't a number."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    return F.transform(parts, lambda t: t.try_cast("double"))


def camera(texts: DataFrame, column: str = "value") -> DataFrame:
    """(path, key, values) of `key = v v v` lines."""
    line = texts.select("path", F.explode(F.split(column, r"\r?\n")).alias("line")).where(F.col("line").contains("="))
    return line.select("path", F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("key"), numbers(F.split_part("line", F.lit("="), F.lit(2))).alias("values"))


def pose(text: Column) -> Column:
    p = numbers(text)
    return F.when(pose_ok(p), p).otherwise(F.raise_error(F.lit("a pose has sixteen finite numbers")).cast("array<double>"))


def features(text: Column) -> Column:
    """[{instance_id, occurance, feature}] or {"id": {...}}, as one array."""
    one = "struct<instance_id:bigint,occurance:bigint,feature:array<double>>"
    listed = F.from_json(text, f"array<{one}>")
    keyed = F.from_json(text, "map<string,struct<occurance:bigint,feature:array<double>>>")
    named = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].cast("bigint").alias("instance_id"), e["value"]["occurance"].alias("occurance"), e["value"]["feature"].alias("feature")))
    return F.when(F.ltrim(text).startswith("["), listed).otherwise(named)


def detections(text: Column) -> Column:
    one = "struct<instance_id:bigint,object_name:string,confidence:double,feature:array<double>>"
    parsed = F.from_json(text, f"array<{one}>")
    return F.transform(parsed, lambda d: F.struct(F.coalesce(d["instance_id"], F.lit(-1)).alias("instance_id"), F.coalesce(d["object_name"], F.lit("unknown")).alias("object_name"), F.coalesce(d["confidence"], F.lit(0.0)).alias("confidence")))


def detections_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame a JSON array, without unassigned records; a frame that has none gives `[]`. A frame is bounded."""
    kept = F.when(F.col("instance_id") != -1, F.struct("instance_id", "object_name", "confidence"))
    return rows.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(kept))).alias("json"))


def name_map(texts: DataFrame, column: str = "value") -> DataFrame:
    """(path, instance_id, name) of `id,name` lines after a header; a name may hold commas."""
    line = texts.select("path", F.posexplode(F.split(column, r"\r?\n")).alias("n", "line")).where("n > 0 AND line <> ''")
    return line.select("path", F.regexp_extract("line", "^([^,]*),(.*)$", 1).try_cast("bigint").alias("instance_id"), F.regexp_extract("line", "^([^,]*),(.*)$", 2).alias("name"))


def event_frames(texts: DataFrame, column: str = "value") -> DataFrame:
    """(path, n, data): server-sent events; the data lines of an event are joined, `[DONE]` is dropped."""
    event = texts.select("path", F.posexplode(F.split(column, r"\r?\n\r?\n")).alias("n", "block"))
    data = F.transform(F.filter(F.split("block", r"\r?\n"), lambda s: s.startswith("data:")), lambda s: F.ltrim(F.regexp_replace(s, "^data:", "")))
    return event.select("path", "n", F.array_join(data, "\n").alias("data")).where("data <> '' AND data <> '[DONE]'")


def redacted(text: Column, secret: Column) -> Column:
    return F.when(F.length(secret) > 0, F.replace(text, secret, F.lit("***"))).otherwise(text)
