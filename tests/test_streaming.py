"""The stream's tracks and windows equal the batch's."""

from pyspark.sql import functions as F

from posegrid.operators.tracking import track_batch
from posegrid.plans.registry import obs
from posegrid.streaming import views


def split(spark, data, path):
    e = spark.read.parquet(f"{data}/events.parquet").orderBy("ts", "event_id").coalesce(1)
    days = [r[0] for r in e.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    half = days[len(days) // 2]
    e.where(F.to_date("ts") < half).coalesce(1).write.mode("append").parquet(path)
    e.where(F.to_date("ts") >= half).coalesce(1).write.mode("append").parquet(path)


def test_stream_tracks_equal_batch(spark, data, tmp_path):
    path = str(tmp_path / "in")
    split(spark, data, path)
    seen = {}

    def keep(df, number):
        for r in df.collect():
            seen[r["scene"], r["track"]] = r

    q = views.tracks(spark, path).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r["scene"], r["track"]): r for r in track_batch(obs(spark, data)).collect()}
    assert {k: (r["label"], r["n"], r["frames"], r["last_frame"]) for k, r in seen.items()} == {k: (r["label"], r["n"], r["frames"], r["last_frame"]) for k, r in batch.items()}


def test_windows_close_behind_the_watermark(spark, data, tmp_path):
    path = str(tmp_path / "in")
    split(spark, data, path)
    q = views.windows(views.observations(spark, path)).writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {(r["start"], r["label"]): r["n"] for r in spark.table("closed").collect()}
    full = views.windows(obs(spark, data))
    batch = {(r["start"], r["label"]): r["n"] for r in full.collect()}
    assert rows and all(batch[k] == n for k, n in rows.items())


def test_compaction_counts_each_row_once(spark, data, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    split(spark, data, path)
    q = views.compacted(views.observations(spark, path), out, str(tmp_path / "c"), 10.0).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == obs(spark, data).count()
