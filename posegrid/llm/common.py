"""Shared helpers: bounded Arrow chunks, hashed row splits, tables written to the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel turns into numpy arrays at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Bytes of sorted rows that a kernel joins at a time; one larger group of equal keys is taken whole.
GROUPS_BYTES = 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def chunks(lengths: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of about `limit` bytes each, in order, covering all rows."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without nulls, and the offsets of its rows (rows + 1 values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32) if offsets is not None and offsets.size else np.zeros(1, np.int32)
    offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_batches(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """(rows of the batch as RecordBatch, bytes, offsets) in chunks of bounded size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = bytes_of(batch.column(column))
        for lo, hi in chunks(np.diff(offs), limit):
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session in one JVM may name none; then it is a temporary folder."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (set_dir.get() if set_dir.isDefined() else None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="posegrid-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Lets Spark delete the shuffle files of a query as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/posegrid/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        _drop(t.sparkSession, t.written_to)


#: More partitions than this cost the driver more than they help; tasks that stream their groups don't need them.
MOST_PARTS = 1 << 16


def parts_for(spark: SparkSession, rows: int, at_once: int) -> int:
    """Partitions so that about `at_once` rows meet in a task, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-rows // at_once)))


def in_parts(rows: DataFrame, keys: list[str], by: str, limit: int) -> DataFrame:
    """rows with c, lo, hi: a group of over `limit` rows is cut into parts c by the hash of `by`, and every two parts meet
    as the group (keys, lo, hi); other groups are one part. rows is read twice."""
    # At most (rows) / limit groups are crowded.
    crowded = written(rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("k")))
    if crowded.isEmpty():
        return rows.select("*", *(F.lit(0).alias(n) for n in ("c", "lo", "hi")))
    marked = rows.join(crowded, keys, "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("c", F.pmod(F.xxhash64(by), F.col("k")).cast("int"))
    twice = marked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return twice.withColumn("lo", F.least("c", "o")).withColumn("hi", F.greatest("c", "o")).drop("k", "o")


def whole_groups(batches, keys: list[str], size: int = GROUPS_BYTES):
    """Tables of about `size` bytes, of sorted batches; none begins or ends inside a group of equal keys."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.nbytes
        if n < size:
            continue
        table = pa.Table.from_batches(held)
        new = starts_of(table, keys)
        if len(new) > 1:
            yield table.slice(0, int(new[-1])).combine_chunks()
            held = table.slice(int(new[-1])).combine_chunks().to_batches()
            n = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in keys:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def rescannable(df: DataFrame) -> bool:
    """Whether df is deterministic filters and projections over files, so that `_metadata` names the same rows in every run."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"
