"""The scene graph as one JSON document, and as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = "struct<radius:double,height:double,length:double,width:double,orientation:array<double>>"
NODE = f"struct<id:string,name:string,visual_embedding:array<double>,text_embedding:array<double>,shape:{SHAPE},position:array<double>>"
EDGE = "struct<source_id:string,target_id:string,distance:double,direction:array<double>,description:string>"
DOCUMENT = f"object_nodes struct<nodes:map<string,{NODE}>>, edge_hypotheses map<string,struct<id:string,confidence:double,edges:map<string,{EDGE}>>>, part_nodes map<string,string>"


def parsed(texts: DataFrame, column: str = "value", keep: list[str] = ()) -> DataFrame:
    """Missing maps are empty; a document that isn't an object is an error."""
    return texts.select(*keep, F.from_json(column, DOCUMENT, {"mode": "FAILFAST"}).alias("t"))


def nodes(documents: DataFrame, keep: list[str] = ()) -> DataFrame:
    n = documents.select(*keep, F.explode("t.object_nodes.nodes").alias("key", "n")).select(*keep, "key", "n.*")
    return n.withColumn("kind", F.when(F.col("shape.radius").isNotNull(), "cylinder").when(F.col("shape").isNotNull(), "box"))


def edges(documents: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Edges are keyed by their ends, whatever the document's own keys look like."""
    h = documents.select(*keep, F.explode("t.edge_hypotheses").alias("hypothesis_id", "h"))
    return h.select(*keep, "hypothesis_id", F.col("h.confidence").alias("confidence"), F.explode("h.edges").alias("key", "e")).select(*keep, "hypothesis_id", "confidence", "e.*")


def published(node_rows: DataFrame, edge_rows: DataFrame, scene: str = "scene") -> DataFrame:
    """(scene, value): a document per scene, which is bounded. node_rows: scene, id, name, position; edge_rows: scene, source_id, target_id, distance."""
    n = node_rows.groupBy(scene).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("id"), F.struct("id", "name", "position").alias("n"))))).alias("nodes"))
    key = F.concat_ws("_", "source_id", "target_id")
    e = edge_rows.groupBy(scene).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct("source_id", "target_id", "distance", F.lit("next to").alias("description")).alias("e"))))).alias("edges"))
    both = n.join(e, scene, "left")
    hypothesis = F.create_map(F.lit("default"), F.struct(F.lit("default").alias("id"), F.lit(1.0).alias("confidence"), F.coalesce("edges", F.from_json(F.lit("{}"), f"map<string,{'struct<source_id:string,target_id:string,distance:double,description:string>'}>")).alias("edges")))
    return both.select(scene, F.to_json(F.struct(F.struct("nodes").alias("object_nodes"), hypothesis.alias("edge_hypotheses"))).alias("value"))
