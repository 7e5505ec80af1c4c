"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Hashes are taken modulo this.
SPAN = 1 << 30


def bounded_sample(rows: DataFrame, id_col: str, label_col: str, per_label: int) -> tuple[DataFrame, dict]:
    """At most per_label ids of each label, those of least hash; also the number of rows of each label.

    Null ids and labels take no part; of an id with several labels the least counts. The
    sample has per_label x labels rows at most and is made from a list on the driver, so it may be broadcast.
    """
    known = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return rows.sparkSession.createDataFrame([], _kinds(rows, id_col, label_col)), counts
    # Eight times the wanted share of hashes is nearly always enough; only then do few rows of each label meet, however many there are.
    share = {k: min(SPAN, -(-8 * per_label * SPAN // n)) for k, n in counts.items()}
    limits = F.broadcast(rows.sparkSession.createDataFrame(list(share.items()), f"label {known.schema['label'].dataType.simpleString()}, below long"))
    least = _ranked(known.join(limits, "label").where(F.pmod(F.xxhash64("id"), F.lit(SPAN)) < F.col("below")), per_label)
    found: dict = {}
    for r in least:
        found[r["label"]] = found.get(r["label"], 0) + 1
    short = [k for k in counts if found.get(k, 0) < per_label and share[k] < SPAN]  # ids repeat much
    if short:
        least = [r for r in least if r["label"] not in short] + _ranked(known.where(F.col("label").isin(short)), per_label)
    picked: dict = {}
    for r in least:
        picked[r["id"]] = min(picked.get(r["id"], r["label"]), r["label"])
    return rows.sparkSession.createDataFrame(sorted(picked.items()), _kinds(rows, id_col, label_col)), counts


def _kinds(rows: DataFrame, id_col: str, label_col: str) -> str:
    return f"sample_id {rows.schema[id_col].dataType.simpleString()}, label {rows.schema[label_col].dataType.simpleString()}"


def _ranked(known: DataFrame, per_label: int) -> list:
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod(F.xxhash64("id"), F.lit(SPAN)), "id"))
    return known.select("id", "label").distinct().withColumn("place", place).where(F.col("place") <= per_label).collect()


def one_each(picked: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row of each id, the least by the other columns, so that repeated rows don't lengthen a sample."""
    least = picked.groupBy(id_col).agg(F.min(F.struct(*columns)).alias("least"))
    return least.select(id_col, *(F.col(f"least.{c}").alias(c) for c in columns))
