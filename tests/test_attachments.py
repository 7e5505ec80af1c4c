"""Attachments against groups built to pass and to fail, and against plain loops."""

import numpy as np
import pandas as pd
import pytest

from posegrid.operators import attachments as A


def cloud(spark, groups):
    rows = [(k, float(x), float(y), float(z)) for k, p in groups.items() for x, y, z in p]
    return spark.createDataFrame(rows, "g string, x double, y double, z double")


def tube(rng, n, width, lo, hi):
    return np.column_stack([rng.uniform(-width / 2, width / 2, (n, 2)), np.linspace(lo, hi, n)])


def test_line_members(spark):
    rng = np.random.default_rng(1)
    rod = tube(rng, 200, 0.01, 0, 1)
    groups = {"rod": rod, "gap": rod[(rod[:, 2] < 0.3) | (rod[:, 2] > 0.6)], "short": rod * [1, 1, 0.1], "wide": rod + np.where(np.arange(200)[:, None] % 2, 0.1, 0) * [1, 0, 0], "tilted": rod @ [[1, 0, 0], [0, 1, 0], [0.5, 0, 1]], "few": rod[:11], "point": rod[:1], "same": np.zeros((30, 3))}
    got = {r.g: r.member for r in A.line_members(cloud(spark, groups).unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0), ("rod", None, 0.0, 9.0)], "g string, x double, y double, z double")), "g").collect()}
    assert got == {k: k == "rod" for k in groups}


def test_shapes_equal_the_dense_ones(spark):
    rng = np.random.default_rng(2)
    groups = {str(k): rng.normal(size=(50, 3)) * [3, 2, 0.5] for k in range(4)}
    for r in A.shapes(cloud(spark, groups), "g").collect():
        values, vectors = np.linalg.eigh(np.cov(groups[r.g].T))
        assert np.allclose([r.shape.least, r.shape.middle, r.shape.largest], values)
        assert abs(np.dot(r.shape.axis, vectors[:, 2])) == pytest.approx(1) and abs(np.dot(r.shape.normal, vectors[:, 0])) == pytest.approx(1)


def test_stems(spark):
    rng = np.random.default_rng(3)
    plate = lambda n, w, z: np.column_stack([rng.uniform(-w / 2, w / 2, (n, 2)), np.full(n, z)])
    stem = np.concatenate([tube(rng, 600, 0.03, 0, 0.8), plate(100, 0.2, 0.0)])
    top = np.concatenate([plate(3000, 0.4, 0.81), plate(100, 0.02, 0.805)])
    groups = {"top": top, "stem": stem, "far": top + [0, 0, 0.2], "side": top + [0.15, 0, 0], "footless": tube(rng, 600, 0.03, 0, 0.8)}
    pairs = spark.createDataFrame([("top", "stem"), ("far", "stem"), ("side", "stem"), ("top", "footless"), ("stem", "top"), ("top", "stem")], "body string, support string")
    got = {(r.body, r.support): r.attached for r in A.stems(cloud(spark, groups), "g", pairs).collect()}
    assert got == {("top", "stem"): True, ("far", "stem"): False, ("side", "stem"): False, ("top", "footless"): False, ("stem", "top"): False}


def test_boundary_parts(spark):
    rng = np.random.default_rng(4)
    body = np.concatenate([rng.uniform(0, 1, (2000, 3)), [[0, 0, 0], [1, 1, 1]]])
    face = np.column_stack([rng.uniform(0.2, 0.8, (300, 2)), rng.normal(0.99, 0.001, 300)])
    groups = {"body": body, "face": face, "inner": face - [0, 0, 0.4], "outside": face + [0.5, 0, 0], "ball": rng.uniform(0.8, 1, (300, 3))}
    pairs = spark.createDataFrame([(k, "body", s, f) for k, s, f in (("face", 0.9, 3), ("inner", 0.9, 3), ("outside", 0.9, 3), ("ball", 0.9, 3))], "source string, body string, semantic double, frames int")
    got = {r.source: r.part for r in A.boundary_parts(cloud(spark, groups), "g", pairs).collect()}
    assert got == {"face": True, "inner": False, "outside": False, "ball": False}
    weak = spark.createDataFrame([("face", "body", 0.7, 3)], pairs.schema)
    assert [r.part for r in A.boundary_parts(cloud(spark, groups), "g", weak).collect()] == [False]


def test_siblings_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    masks = {k: (int(rng.integers(0, 2)), set(rng.choice(60, int(rng.integers(1, 25)), replace=False).tolist())) for k in range(40)}
    masks[40], masks[41] = (0, set(range(4))), (0, set(range(10, 26)))  # four times the area exactly
    label = {p: 1 if p < 45 else 2 if p < 55 else 0 for p in range(60)}
    parent = {}
    for k, (_, ps) in masks.items():
        n = pd.Series([label[p] for p in ps]).value_counts()
        best = min(n.index, key=lambda v: (-n[v], v))
        parent[k] = int(best) if n[best] >= 0.7 * len(ps) else 0
    want = {}
    for k, (name, ps) in masks.items():
        found = [j for j, (other, qs) in masks.items() if j != k and other == name and parent[j] == parent[k] and len(ps) <= 4 * len(qs) and len(qs) <= 4 * len(ps) and len(ps & qs) < 0.1 * min(len(ps), len(qs))]
        want[k] = (parent[k], len(found), parent[k] == 0 or bool(found))
    rows = [(k, str(name), p) for k, (name, ps) in masks.items() for p in ps]
    m = spark.createDataFrame(rows + rows[:5], "mask_id long, name string, point_id long")
    out = A.siblings(m, spark.createDataFrame(list(label.items()), "point_id long, label int")).collect()
    assert {r.mask_id: (r.parent, r.siblings, r.kept) for r in out} == want


def test_empty_tables(spark):
    p = cloud(spark, {"a": np.zeros((1, 3))}).limit(0)
    pairs = spark.createDataFrame([], "source string, body string, support string, semantic double, frames int")
    assert A.line_members(p, "g").count() == A.stems(p, "g", pairs).count() == A.boundary_parts(p, "g", pairs).count() == 0
    assert A.siblings(spark.createDataFrame([], "mask_id long, name string, point_id long"), spark.createDataFrame([], "point_id long, label int")).count() == 0


def test_bars(spark):
    rng = np.random.default_rng(6)
    block = lambda n, sides: rng.uniform(-0.5, 0.5, (n, 3)) * sides
    head = block(3000, [0.8, 0.2, 0.1])
    bar = block(400, [0.6, 0.03, 0.03]) + [0, 0, 0.04]
    groups = {"head": head, "bar": bar, "across": bar[:, [1, 0, 2]], "low": bar - [0, 0, 0.08], "off": bar + [0, 0.3, 0], "round": block(400, [0.3, 0.3, 0.03]) + [0, 0, 0.04]}
    rows = [(k, f"{k}{i}", *map(float, p)) for k, points in groups.items() for i, p in enumerate(points)]
    p = spark.createDataFrame(rows, "g string, id string, x double, y double, z double")
    pairs = spark.createDataFrame([("head", k) for k in groups if k != "head"], "body string, bar string")
    got = {r.bar: r for r in A.bars(p, "g", "id", pairs).collect()}
    assert {k: r.attached for k, r in got.items()} == {k: k == "bar" for k in groups if k != "head"}
    near = np.sqrt(((bar[:, None] - head[None]) ** 2).sum(axis=2)).min(axis=1)
    angles = [np.linalg.eigh(np.cov(v[:, :2].T))[1][:, 1] for v in (head, bar)]
    assert got["bar"].contacts == (near < 0.035).sum() and got["bar"].alignment == pytest.approx(abs(angles[0] @ angles[1]))
    assert A.bars(p.limit(0), "g", "id", pairs).count() == 0
