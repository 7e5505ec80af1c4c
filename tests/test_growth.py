"""Tables that the smallest folder doesn't hold: copies, crowds, zeros and ties. Queries must still equal their SQL."""

import contextlib
import datetime
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from posegrid.operators import boxes as B
from posegrid.operators import graphs
from posegrid.operators import kernels as K
from posegrid.operators import ownership, spatial
from posegrid.plans import QUERIES, SQL

DAY = datetime.datetime(2024, 1, 1)


def written(folder, **tables):
    for name, rows in tables.items():
        rows.to_parquet(f"{folder}/{name}.parquet", coerce_timestamps="us", index=False)
    return str(folder)


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v + 0.0) if isinstance(v, float) else str(v)


def same(spark, folder, name, *tables):
    """The query's rows, which must equal those of its SQL."""
    c = duckdb.connect()
    c.execute("SET threads = 1")
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert got == sorted(tuple(map(norm, r)) for r in want)
    return got


@contextlib.contextmanager
def spark_conf(spark, key, value):
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key)


def most_rows(spark, folder, name):
    """The most rows that any step of the query's last job put out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES[name](spark, folder)
        df.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

    def walk(plan):
        m = plan.metrics().get("numOutputRows")
        inner = [plan.child()] if plan.nodeName() == "InputAdapter" else [plan.children().apply(i) for i in range(plan.children().size())]
        return max([m.get().value() if m.isDefined() else 0, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


def events(rows):
    e = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "value"])
    return e.assign(ts=DAY, props='{"k": 1}')


def parts(n, brands=1, seed=0, **fixed):
    r = np.random.default_rng(seed)
    p = pd.DataFrame({"p_partkey": np.sort(r.choice(50 * n, n, replace=False)), "p_name": "n", "p_brand": [f"b{k}" for k in r.integers(0, brands, n)], "p_type": "t", "p_size": r.integers(1, 51, n).astype("int32")})
    return p.assign(p_retailprice=900.0 + p["p_partkey"] % 7, **fixed)


def test_track_scores_add_up_in_order_and_round_as_sql(spark, tmp_path):
    values = np.random.default_rng(3).integers(0, 3000, 4000) / 100
    rows = [(i, i // 2 % 40, "abc"[i % 3], float(v)) for i, v in enumerate(values)]
    assert len(same(spark, written(tmp_path, events=events(rows)), "j13_track_scores", "events")) > 1000


@pytest.mark.parametrize("copies", [1, 3])
def test_track_scores_add_up_in_the_files_order(spark, tmp_path, copies):
    """Neither event ids nor their order matter: a file may hold an event again, anywhere."""
    r = np.random.default_rng(6)
    rows = [(i, i // 2 % 40, "abc"[i % 3], float(v)) for i, v in enumerate(r.integers(0, 3000, 4000) / 100)] * copies
    folder = written(tmp_path, events=events([rows[i] for i in r.permutation(len(rows))]))
    assert len(same(spark, folder, "j13_track_scores", "events")) > 1000
    with spark_conf(spark, "spark.sql.files.maxPartitionBytes", "16k"):
        pd.read_parquet(f"{folder}/events.parquet").to_parquet(f"{folder}/events.parquet", coerce_timestamps="us", index=False, row_group_size=300)
        same(spark, folder, "j13_track_scores", "events")


def test_pair_evidence_of_frames_without_mass(spark, tmp_path):
    rows = [(0, 1, "a", 0.0), (1, 1, "b", 0.0), (2, 2, "a", 1.0), (3, 2, "b", -1.0), (4, 3, "a", 3.0), (5, 3, "b", 4.0), (6, 4, "a", None), (7, 4, "b", 0.0)]
    same(spark, written(tmp_path, events=events(rows)), "j29_pair_evidence", "events")


def test_pair_evidence_adds_up_in_the_files_order(spark, tmp_path):
    """Labels of three events, whose shares of a frame are 0.3 or 0.8 but for rounding."""
    r = np.random.default_rng(4)
    rows = []
    for frame in range(400):
        labels = r.permutation(list("abcde"))[: r.integers(3, 6)]
        for k, label in enumerate(labels):
            share = (6, 21)[frame % 2] if k else (24, 9)[frame % 2] * (len(labels) - 1)
            rows += [(len(rows) + i, frame, label, share * (1 + frame % 97) * w / 100) for i, w in enumerate((1, 2, 7))]
    folder = written(tmp_path, events=events([rows[i] for i in r.permutation(len(rows))]))
    assert len(same(spark, folder, "j29_pair_evidence", "events")) == 10
    with spark_conf(spark, "spark.sql.files.maxPartitionBytes", "16k"):
        pd.read_parquet(f"{folder}/events.parquet").to_parquet(f"{folder}/events.parquet", coerce_timestamps="us", index=False, row_group_size=300)
        same(spark, folder, "j29_pair_evidence", "events")


def lineitems(n, suppliers, parts_, days=1, seed=0):
    r = np.random.default_rng(seed)
    day = np.array([DAY + datetime.timedelta(days=k) for k in range(days)])
    return pd.DataFrame({"l_orderkey": r.integers(0, n, n), "l_partkey": r.integers(0, parts_, n), "l_suppkey": r.integers(0, suppliers, n), "l_quantity": r.integers(1, 51, n).astype(float), "l_returnflag": r.choice(list("ARN"), n), "l_shipdate": day[r.integers(0, days, n)]})


def test_painted_frames_of_more_masks_than_a_byte_names(spark, tmp_path):
    got = same(spark, written(tmp_path, lineitem=lineitems(3000, 400, 500, days=2)), "z04_painted_frames", "lineitem")
    assert max(int(r[1]) for r in got) > 255


@pytest.mark.parametrize("name", ["g06_cross_depth_votes", "g08_free_space"])
def test_points_of_one_pixel_meet_the_frames_once(spark, tmp_path, name):
    copies = parts(10000).assign(p_partkey=lambda q: np.arange(len(q)) * 64 + np.arange(len(q)) % 3, p_size=7)
    copies = pd.concat([copies, parts(60, seed=1).assign(p_partkey=lambda q: q["p_partkey"] + 10**6)])
    folder = written(tmp_path, part=copies, lineitem=lineitems(4000, 30, 64))
    assert len(same(spark, folder, name, "part", "lineitem")) > 10000
    assert most_rows(spark, folder, name) <= 9 * 4000


@pytest.mark.parametrize("two", [False, True])
def test_boxes_meet_by_parts(spark, two):
    r = np.random.default_rng(5)
    lo = r.uniform(0, 4, (90, 3)).round(1)
    hi = lo + r.uniform(0, 1.5, (90, 3)).round(1)
    rows = [("k" if i % 3 else "m", i, *map(float, lo[i]), *map(float, hi[i])) for i in range(90)]
    gaps = [("k", 900, None, *[0.0] * 5), ("k", 901, float("nan"), *[0.0] * 5), (None, 902, *[0.0] * 3, *[9.0] * 3)]
    df = spark.createDataFrame(rows + gaps, "key string, id long, " + ", ".join(f"{c} double" for c in B.SIDES))

    def rule(a, b):
        assert a["lox"].size <= 40 and b["lox"].size <= 40  # 8 a part on average
        both = B.shared(a, b)
        i, j = np.nonzero(both > 0)
        return i, j, both[i, j]

    left, right = (df.where("id % 2 = 0"), df.where("id % 2 = 1")) if two else (df, None)
    got = {(q.key, q.a, q.b): q.v for q in B.joined(left, right, ["key"], [], rule, "key string, a long, b long, v double", part=8).collect()}
    want = {}
    for i in range(90):
        for j in range(90):
            v = np.maximum(np.minimum(hi[i], hi[j]) - np.maximum(lo[i], lo[j]), 0).prod()
            if v > 0 and (i % 2 == 0 and j % 2 == 1 if two else i < j) and (i % 3 > 0) == (j % 3 > 0):
                want["k" if i % 3 else "m", i, j] = v
    assert got.keys() == want.keys() and len(got) > 15
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def box_query(spark, tmp_path, monkeypatch, name):
    p = parts(500, 3, seed=2).astype({"p_size": "Int32"})
    p.loc[[7, 100, 300], "p_size"] = None
    folder = written(tmp_path, part=p)
    assert len(same(spark, folder, name, "part")) > 20
    monkeypatch.setattr(graphs, "settled", lambda df: df)  # written steps would hide from the plan
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan  # bounded parts meet, not all rows of a brand in one join


@pytest.mark.parametrize("name", ["g13_box_iou", "g14_max_volume_overlap", "g15_rect_iou", "g16_box_gap"])
def test_box_pairs_as_sql(spark, tmp_path, monkeypatch, name):
    box_query(spark, tmp_path, monkeypatch, name)


@pytest.mark.parametrize("name", ["c10_unique_contraction", "y03_duplicate_absorption", "j26_best_record"])
def test_best_boxes_as_sql(spark, tmp_path, monkeypatch, name):
    box_query(spark, tmp_path, monkeypatch, name)


@pytest.mark.parametrize("name", ["c10_unique_contraction", "y03_duplicate_absorption"])
def test_boxes_inside_out(spark, tmp_path, name):
    p = parts(200, 2, seed=4).assign(p_size=np.random.default_rng(9).integers(-20, 21, 200).astype("int32"))
    assert same(spark, written(tmp_path, part=p), name, "part")


def test_sparse_precision_equals_the_dense_one():
    r = np.random.default_rng(1)
    for n, m in ((40, 30), (0, 3), (5, 0), (25, 60)):
        iou, conf = np.where(r.random((n, m)) < 0.3, r.random((n, m)).round(1), 0.0), r.random(n).round(1)
        i, j = np.nonzero(iou > 0.1)
        for t in (0.2, 0.5, 0.9):
            a, b = K.average_precision(conf, iou, t), K.sparse_precision(conf, i, j, iou[i, j], m, t)
            assert a[0] == b[0] and (a[1] == b[1]).all()


def test_precision_holds_no_matrix_of_a_brand(spark, tmp_path, monkeypatch):
    """20000 predictions and as many truths would fill 3.2 GB; at sixty copies a brand has 48000 boxes."""
    folder = written(tmp_path, part=parts(400, 2, seed=6))
    plan = QUERIES["w01_average_precision"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    n = 20000
    ap, taken = K.sparse_precision(np.arange(n) / n, np.arange(n), np.arange(n), np.full(n, 0.6), n, 0.5)
    assert abs(ap - 1) < 1e-9 and (taken == np.arange(n)).all()


def test_reached_equals_brute_force(spark):
    r = np.random.default_rng(8)
    p, q = r.uniform(-1, 1, (150, 3)), r.uniform(-1, 1, (60, 3)).repeat(2, axis=0)
    left = spark.createDataFrame([(i, i % 2, *map(float, v)) for i, v in enumerate(p)], "id long, k int, x double, y double, z double")
    right = spark.createDataFrame([(i % 4 // 2, *map(float, v)) for i, v in enumerate(q)], "k int, x double, y double, z double")
    d = np.linalg.norm(p[:, None] - q[None], axis=2)
    alike = (np.arange(150) % 2)[:, None] == (np.arange(120) % 4 // 2)[None]
    got = [x.id for x in spatial.reached(left, right, 0.4, ["id"], ["k"]).collect()]
    assert sorted(got) == np.nonzero(((d <= 0.4) & alike).any(axis=1))[0].tolist()
    assert 10 < len(got) < 140


def test_crowds_settle_by_cells(spark, monkeypatch):
    """800 points on 800 others: their pairs met before, none do now."""
    met, plain = [], spatial.range_join
    monkeypatch.setattr(spatial, "range_join", lambda *a, **k: met.append(plain(*a, **k)) or met[-1])
    points = lambda g, n, width: [(g, g * 10**6 + i, *(width * (np.array([i % 20, i // 20 % 20, i // 400 % 20]) / 19 - 0.5)).tolist()) for i in range(n)]
    corners = [(0, 99 + k, *map(float, v)) for k, v in enumerate(([-3.0] * 3, [3.0] * 3))]
    p = spark.createDataFrame(points(0, 800, 1.0) + points(1, 800, 1.0) + corners, "g int, id long, x double, y double, z double")
    one = lambda text, *rows: spark.createDataFrame(list(rows), text)
    out = ownership.bounded_transfer(p, one("source int", (0,)), one("source int, target int, semantic double", (0, 1, 0.9)), one("g int", (1,)), near=0.2)
    assert out.count() == 800
    assert met and sum(m.count() for m in met[:1]) == 0
