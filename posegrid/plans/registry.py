"""Registry of queries with their SQL twins, and the views that read the driver's tables as observation data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Views used on the SQL side, under the same names as the functions below.
VIEWS = {
    "pts": "SELECT vec_id AS id, label AS g, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings",
    "halves": "SELECT vec_id AS id, label AS g, [v::DOUBLE FOR v IN embedding[1:32]] AS visual, [v::DOUBLE FOR v IN embedding[33:64]] AS textual FROM embeddings",
    "masks": "SELECT DISTINCT l_suppkey AS mask_id, l_partkey AS point_id FROM lineitem",
    "obs": """SELECT event_id, user_id AS scene, CAST(ts AS DATE) AS frame, event_type AS label, value AS conf,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts FROM events""",
    "boxes": """SELECT p_partkey AS id, p_brand AS brand, p_size AS size, p_retailprice AS conf, (p_partkey % 41) * 0.25::DOUBLE AS lox, (p_partkey % 37) * 0.25::DOUBLE AS loy, (p_partkey % 29) * 0.25::DOUBLE AS loz,
        (p_partkey % 41) * 0.25::DOUBLE + p_size * 0.0625::DOUBLE AS hix, (p_partkey % 37) * 0.25::DOUBLE + (p_size % 13 + 1) * 0.125::DOUBLE AS hiy, (p_partkey % 29) * 0.25::DOUBLE + (p_size % 7 + 1) * 0.25::DOUBLE AS hiz FROM part""",
}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a query; `views` names the views that its SQL uses."""

    def put(f):
        QUERIES[name] = f
        if sql:
            with_ = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
            body = sql.strip()
            if with_:
                body = f"WITH {with_}, " + body[5:] if body.upper().startswith("WITH ") and not body.upper().startswith("WITH RECURSIVE") else f"WITH {with_} {body}" if not body.upper().startswith("WITH RECURSIVE") else f"WITH RECURSIVE {with_}, " + body[15:]
            SQL[name] = body
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark, d) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("g"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")])


def halves(spark, d) -> DataFrame:
    wide = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("g"), F.slice(wide, 1, 32).alias("visual"), F.slice(wide, 33, 32).alias("textual"))


def masks(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("mask_id"), F.col("l_partkey").alias("point_id")).distinct()


def obs(spark, d, *more) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("scene"), F.to_date("ts").alias("frame"), F.col("event_type").alias("label"), F.col("value").alias("conf"), k.alias("k"), "ts", *more)


def place():
    """Where a row stands in its table's files, to be read beside the table's columns: SQL on one thread adds up in this order."""
    return F.struct("_metadata.file_path", "_metadata.row_index")


def boxes(spark, d) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    lo = [(k % m) * 0.25 for m in (41, 37, 29)]
    size = [s * 0.0625, (s % 13 + 1) * 0.125, (s % 7 + 1) * 0.25]
    names = [f"lo{a}" for a in "xyz"], [f"hi{a}" for a in "xyz"]
    return table(spark, d, "part").select(
        k.alias("id"), F.col("p_brand").alias("brand"), s.alias("size"), F.col("p_retailprice").alias("conf"), *[v.alias(n) for v, n in zip(lo, names[0], strict=True)], *[(v + w).alias(n) for v, w, n in zip(lo, size, names[1], strict=True)]
    )


def as_box(prefix: str = ""):
    from ..functions.scalars import box

    return box([F.col(f"{prefix}lo{a}") for a in "xyz"], [F.col(f"{prefix}hi{a}") for a in "xyz"])
