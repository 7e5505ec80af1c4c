"""Operators on small tables: empty input, nulls, ties, other partition counts, moved coordinates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.functions import scalars as S
from posegrid.operators import graphs, masks, spatial
from posegrid.operators.tracking import track_batch
from posegrid.plans.profiles import PROFILES
from posegrid.sources import formats, ply

POINTS = "id long, x double, y double, z double"


def cloud(spark, n, seed, shift=0.0):
    p = np.random.default_rng(seed).uniform(-0.3, 0.3, (n, 3)) + shift
    return p, spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], POINTS)


@pytest.mark.parametrize("shift", [0.0, 7.25])
def test_range_join_is_exact(spark, shift):
    p, df = cloud(spark, 80, 0, shift)
    q, other = cloud(spark, 70, 1, shift)
    d = np.linalg.norm(p[:, None] - q[None], axis=2)
    got = {(r["id"], r["other"]) for r in spatial.range_join(df, other.withColumnRenamed("id", "other"), 0.11).collect()}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(d <= 0.11))))


def test_empty_sides(spark):
    _, df = cloud(spark, 5, 0)
    none = df.limit(0).withColumnRenamed("id", "other")
    assert spatial.range_join(df, none, 0.1).count() == 0
    assert spatial.residual(df, none, 0.1, "id").count() == 5
    assert spatial.nearest(df, none, 0.1, "id", "other").where("other IS NULL").count() == 5
    assert spatial.voxel_centroids(df.limit(0), 0.1).count() == 0


def test_non_finite_points_have_no_voxel(spark):
    df = spark.createDataFrame([(0, float("nan"), 0.0, 0.0), (1, float("inf"), 0.0, 0.0), (2, 0.5, 0.0, 0.0)], POINTS)
    assert [r["n"] for r in spatial.voxel_centroids(df, 0.1).collect()] == [1]


def test_nearest_ties_take_the_smaller_id(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], POINTS)
    b = spark.createDataFrame([(9, 0.05, 0.0, 0.0), (3, -0.05, 0.0, 0.0)], POINTS).withColumnRenamed("id", "other")
    assert spatial.nearest(a, b, 0.1, "id", "other").first()["other"] == 3


def test_alias_chains_and_cycles(spark):
    df = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (7, -1), (8, 7)], "source long, target long")
    assert {(r["source"], r["target"]) for r in graphs.resolve(df).collect()} == {(5, 1), (4, 1), (3, 1), (7, -1), (8, -1)}
    with pytest.raises(ValueError):
        graphs.resolve(spark.createDataFrame([(1, 2), (2, 1)], "source long, target long"))


def test_components_of_a_long_chain(spark):
    nodes = spark.range(40).withColumnRenamed("id", "id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(29)], "a long, b long")
    got = {r["id"]: r["component"] for r in graphs.connected(nodes, edges).collect()}
    assert got == {i: 0 if i < 30 else i for i in range(40)}


def test_unique_partners_keep_ambiguity(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 11), (2, 12), (3, 13), (4, 13)], "a long, b long")
    assert [tuple(r) for r in graphs.unique_partners(pairs).collect()] == [(1, 10)]


def test_majority_needs_more_than_half(spark):
    rows = [(1, 0, 5), (2, 0, 5), (3, 0, 6), (4, 1, 5), (5, 1, 6)]
    df = spark.createDataFrame(rows, "id long, segment long, label long")
    assert {r["id"]: r["smoothed"] for r in masks.majority(df, "segment", "label").collect()} == {1: 5, 2: 5, 3: 5, 4: 5, 5: 6}


def test_voxel_keys_unpack(spark):
    df = spark.createDataFrame([(-5, 0, 7), (1_000_000, -1_000_000, 3)], "a long, b long, c long")
    key = df.withColumn("k", S.voxel_key([F.col(c) for c in "abc"]))
    for r in key.select("a", "b", "c", *[c.alias(n) for c, n in zip(S.voxel_cells(F.col("k")), "xyz")]).collect():
        assert (r["a"], r["b"], r["c"]) == (r["x"], r["y"], r["z"])
    with pytest.raises(Exception, match="voxel"):
        spark.createDataFrame([(1 << 21, 0, 0)], "a long, b long, c long").select(S.voxel_key([F.col(c) for c in "abc"])).collect()


def test_unknown_is_not_negative(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (1.0, 9.0)], "z double, d double")
    assert [r[0] for r in df.select(S.visibility_weight(F.col("z"), F.col("d"))).collect()] == [None, 1.0, 0.0]


def test_cosine_of_different_widths_is_unknown(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 0.0]), ([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [None, 1.0, 0.0]


def test_tracks_keep_covisible_things_apart(spark):
    rows = [(1, "f1", 1, "chair", 50.0, 5), (1, "f1", 2, "chair", 51.0, 5), (1, "f2", 3, "chair", 50.0, 5), (1, "f2", 4, None, None, None), (None, "f2", 5, "x", 1.0, 1)]
    t = track_batch(spark.createDataFrame(rows, "scene long, frame string, event_id long, label string, conf double, k long")).collect()
    assert sorted((r["label"], r["n"]) for r in t) == [("", 1), ("chair", 1), ("chair", 2)]


def test_profiles_replace_steps(spark, data):
    from posegrid.plans.registry import pts

    p = pts(spark, data)
    assert PROFILES["v3"].run(p).count() >= PROFILES["v1"].run(p).count() > 0
    with pytest.raises(KeyError):
        PROFILES["v1"].with_step("nothing", lambda d: d)


def test_manifest_rules(spark):
    good = '{"format":"scannet_sg_input","scene_id":"s","length_unit":"m","depth_scale":1000,"frames":[{"frame_id":"a","pose":[1,0,0,0,0,1,0,0,0,0,1,0,0,0,0,1]},{"frame_id":"a"},{"frame_id":"../x","pose":[1]}]}'
    f = formats.frames(formats.manifests(spark.createDataFrame([(good,)], "value string")))
    assert sorted((r["frame_id"], r["fault"]) for r in formats.frame_faults(f).collect()) == [("../x", "bad pose"), ("../x", "unsafe id"), ("a", "repeated id")]
    with pytest.raises(Exception, match="not accepted"):
        formats.manifests(spark.createDataFrame([(good.replace('"m"', '"mm"'),)], "value string")).collect()


def test_names_may_hold_commas(spark):
    t = spark.createDataFrame([("p", "instance_id,name\r\n3,chair, red\r\n4,\r\nx,y\n")], "path string, value string")
    assert [(r["instance_id"], r["name"]) for r in formats.name_map(t).collect()] == [(3, "chair, red"), (4, ""), (None, "y")]


def test_ply_round_trip(spark, tmp_path):
    rows = [("s", i, float(i), i / 2, -1.5, 70_000 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "scene string, row long, x double, y double, z double, instance_id long")
    (tmp_path / "s.ply").write_text(ply.text(df, ["scene"], "row").first()["value"])
    back = ply.read(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r["x"], r["y"], r["z"], r["instance_id"]) for r in back] == [r[2:] for r in rows]
    dtype = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
    raw = np.array([(1, 2, 3, 4, 5, 6)], dtype).tobytes()
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    assert ply.decode(head + raw).iloc[0].tolist() == [1, 2, 3, 4, 5, 6]
