"""Block-wise retrieval and nearest rows at any distance against brute force."""

import numpy as np

from posegrid.operators import retrieval, spatial


def test_top_scores_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (90, 4)).astype(float)  # many ties and repeated rows
    v[7] = 0
    group = [None if i == 5 else str(i % 3) for i in range(90)]
    rows = [(i, group[i], v[i].tolist()) for i in range(90)] + [(90, "0", None), (None, "0", [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, `group` string, vector array<double>")
    got = {(r.a, r.k): (r.b, r.score) for r in retrieval.top_scores(df.where("id % 10 = 5"), df, 4, block=16).collect()}
    want = {}
    for a in range(5, 90, 10):
        order = sorted((-round(float(v[a] @ v[b]), 9), b) for b in range(90) if group[a] is None or group[a] != group[b])
        want |= {(a, k + 1): (b, -s) for k, (s, b) in enumerate(order[:4])}
    assert got == want
    plain = df.drop("group")
    ranked = {r.a: r.b for r in retrieval.top_scores(plain.where("id = 5"), plain, 1, unit=True, block=16).collect()}
    long = np.sqrt((v * v).sum(axis=1))
    cosine = np.round(v @ v[5] / np.maximum(long * long[5], 1e-12), 9)
    assert ranked == {5: int(cosine.argmax())}
    assert retrieval.top_scores(df.limit(0), df, 2).count() == retrieval.top_scores(df.where("id = 5"), df.limit(0), 2).count() == 0


def test_nearest_any_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.integers(0, 6, (150, 3)) / 4, [[12, 0, 0], [-30, 1, 0]]]).astype(float)
    q = np.concatenate([rng.integers(0, 6, (25, 3)) / 4, [[5, 0, 0]]]).astype(float)
    left = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)] + [(999, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double")
    right = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "other long, x double, y double, z double")
    got = {r.id: (r.other, r.dist) for r in spatial.nearest_any(left, right, "id", "other").collect()}
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
    assert {k: v[0] for k, v in got.items()} == {i: int(d[i].argmin()) for i in range(len(p))}
    assert all(abs(v[1] - d[k].min()) < 1e-12 for k, v in got.items())
    assert spatial.nearest_any(left, right.limit(0), "id", "other").count() == spatial.nearest_any(left.limit(0), right, "id", "other").count() == 0
    one = spatial.nearest_any(left, right.limit(1), "id", "other")
    assert one.count() == len(p)
