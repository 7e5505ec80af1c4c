"""PLY points: a decoder for binaryFile rows (ASCII and little-endian) and an id-coloured ASCII text per cloud."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import colour_id, id_colour

KINDS = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "short": "<i2", "ushort": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4"}
POINTS = "path string, row long, x double, y double, z double, red int, green int, blue int"


def decode(raw: bytes) -> pd.DataFrame:
    """Vertices of one file; missing colours are 0."""
    head, _, body = raw.partition(b"end_header\n")
    lines = [x.split() for x in head.decode("ascii", "replace").splitlines()]
    if not lines or lines[0][:1] != ["ply"]:
        raise ValueError("no PLY header")
    form = next(x[1] for x in lines if x[:1] == ["format"])
    count, fields, inside = 0, [], False
    for x in lines:
        if x[:1] == ["element"]:
            inside = x[1] == "vertex"
            count = int(x[2]) if inside else count
        elif x[:1] == ["property"] and inside:
            fields.append((x[2], KINDS[x[1]]))
    if form == "ascii":
        values = np.array(body.split()[: count * len(fields)], float).reshape(count, len(fields))
        table = {n: values[:, i] for i, (n, _) in enumerate(fields)}
    else:
        rows = np.frombuffer(body, np.dtype(fields), count)
        table = {n: rows[n] for n, _ in fields}
    out = {a: np.asarray(table[a], float) for a in "xyz"}
    return pd.DataFrame(out | {c: np.asarray(table.get(c, np.zeros(count)), int) for c in ("red", "green", "blue")})


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, row, x, y, z, colours and instance_id of all points of all files. A file is decoded whole."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                p = decode(raw)
                yield p.assign(path=name, row=np.arange(len(p)))[["path", "row", "x", "y", "z", "red", "green", "blue"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path", "content")
    return files.mapInPandas(run, POINTS).withColumn("instance_id", colour_id(F.col("red"), F.col("green"), F.col("blue")))


def text(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per cloud, bounded by one scene, its ASCII file as a string."""
    line = F.concat_ws(" ", "x", "y", "z", *id_colour(F.col("instance_id")))
    cloud = points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda r: r["line"]).alias("lines"))
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("lines").cast("string"), F.lit("\nproperty double x\nproperty double y\nproperty double z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"))
    return cloud.select(*keys, F.concat(head, F.array_join("lines", "\n"), F.lit("\n")).alias("value"))
