"""Ownership operators and shape kernels against cases worked out by hand and plain loops."""

import numpy as np
import pandas as pd
import pytest

from posegrid.operators import kernels as K
from posegrid.operators import ownership as O


def test_folded_masks():
    m = lambda frame, mask, points, score: [(frame, mask, p, score) for p in points]
    rows = m(1, 0, range(10), 0.5) + m(1, 1, range(20, 30), 0.9) + m(2, 0, range(22, 32), 0.7) + m(2, 1, range(2, 12), 0.7) + m(3, 0, range(50, 60), 0.1) + m(4, 0, range(0, 40), 0.3)
    p = pd.DataFrame(rows, columns=["frame", "mask", "point", "score"])
    got = O.folded_masks(p, least=5)
    # The last mask overlaps both by 12 of 40; assignment gives it to one of them.
    assert sorted(map(len, (f[0] for f in got))) == [12, 40] and sorted(len(f[1]) for f in got) == [2, 3]
    assert O.folded_masks(p, least=41) == [] and O.folded_masks(p[p["frame"] == 3], least=1) == []


def test_bounded_transfer(spark):
    grid = lambda lo, hi, n: [(x, y, z) for x in np.linspace(lo, hi, n) for y in np.linspace(lo, hi, n) for z in np.linspace(lo, hi, n)]
    groups = {"weak": grid(0, 1, 41), "owner": grid(0.1, 0.5, 9), "inner": grid(0.2, 0.3, 4), "rival": grid(0.45, 0.55, 3)}
    rows = [(g, f"{g}{i}", *map(float, p)) for g, points in groups.items() for i, p in enumerate(points)]
    p = spark.createDataFrame(rows, "g string, id string, x double, y double, z double")
    weak, seeds = spark.createDataFrame([("weak",)], "source string"), spark.createDataFrame([("owner",), ("inner",), ("rival",)], "g string")
    pairs = spark.createDataFrame([("weak", "owner", 0.7), ("weak", "inner", 0.7), ("weak", "rival", 0.5)], "source string, target string, semantic double")
    out = O.bounded_transfer(p, weak, pairs, seeds).collect()
    r = np.array(groups["rival"])
    eps = 1e-12
    want = {f"weak{i}" for i, q in enumerate(groups["weak"]) if all(0.1 <= v <= 0.5 for v in q) and np.sqrt(((r - q) ** 2).sum(axis=1)).min() > 0.03 + eps}
    assert {x.target for x in out} == {"owner"} and {x.id for x in out} == want and len(out) == len(want)
    # Two owners side by side are ambiguous.
    far = spark.createDataFrame([("far", f"far{i}", *(float(v) for v in np.add(q, 0.45))) for i, q in enumerate(groups["owner"])], p.schema)
    more = pairs.unionByName(spark.createDataFrame([("weak", "far", 0.9)], pairs.schema))
    assert O.bounded_transfer(p.unionByName(far), weak, more, seeds.unionByName(spark.createDataFrame([("far",)], "g string"))).count() == 0


def test_painted_smaller_masks_stay_on_top(spark):
    rows = [(1, 7, p) for p in range(5)] + [(1, 8, p) for p in (3, 4)] + [(1, 9, p) for p in (4, 5)] + [(1, 9, 5), (1, None, 0)]
    out = O.painted(spark.createDataFrame(rows, "frame int, mask_id int, pixel int")).collect()
    assert {r.pixel: (r.mask_id, r.local) for r in out} == {0: (7, 1), 1: (7, 1), 2: (7, 1), 3: (8, 2), 4: (9, 3), 5: (9, 3)}
    many = spark.createDataFrame([(1, k, k) for k in range(256)], "frame int, mask_id int, pixel int")
    assert O.painted(many.where("mask_id < 255")).count() == 255
    with pytest.raises(Exception, match="too many masks"):
        O.painted(many).collect()


def test_turns_and_drawing():
    t = K.turns()
    assert len(t) == 24 and len({tuple(r.ravel()) for r in t}) == 24 and all(round(np.linalg.det(r)) == 1 for r in t)
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 1, (300, 3)) ** 2 * [1, 2, 3]
    for k in (0, 5, 17):
        assert K.best_turn(p @ t[k].T * 0.5, p)[0] == k and K.best_turn(p @ t[k].T * 0.5, p)[1] < 1e-9
    shape = p + [0.03, 0, 0]
    moved = K.drawn(shape, p)
    assert np.linalg.norm(moved - p, axis=1).mean() < 0.5 * np.linalg.norm(shape - p, axis=1).mean()
    alone = np.concatenate([shape, [[30, 0, 0]]])
    assert (K.drawn(alone, p)[-1] == alone[-1]).all()
    assert K.drawn(shape, p, most=0.0001) is None


def test_refined(spark):
    from pyspark.sql import functions as F

    cases = [(True, 0, 1, True), (True, 0, 2, False), (False, 1, 1, False), (False, 2, 3, True), (False, 2, 4, False), (True, 1, 5, True)]
    df = spark.createDataFrame(cases, "own boolean, p long, v long, want boolean").withColumn("got", O.refined(F.col("own"), F.col("p"), F.col("v")))
    assert df.where("got <> want").count() == 0
