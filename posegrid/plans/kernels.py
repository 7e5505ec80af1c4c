"""Queries whose groups go through numpy kernels: matching, suppression, clustering, fitting, tracking.

A group is a scene, an instance, a brand or a frame, which the data model bounds; partial work that can be done with columns
is done before the groups meet. SQL has no twin for these; tests hold them against plain versions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import boxes as B, kernels as K
from ..operators.tracking import track_batch
from .registry import as_box, boxes, obs, pts, query, table


def xyz(p: pd.DataFrame) -> np.ndarray:
    return p[["x", "y", "z"]].to_numpy(float)


def per_instance(spark, d, kernel, schema: str):
    return pts(spark, d).groupBy("g").applyInPandas(lambda p: kernel(p.sort_values("id", ignore_index=True)), schema)


def _pairs(spark, d, least: float = 0.0):
    """Truths (even) and predictions (odd) of one brand whose boxes overlap: the candidates, sparse."""
    def rule(t, q):
        both = B.shared(t, q)
        iou = both / np.maximum(B.volume(t) + B.volume(q) - both, S.EPS)
        i, j = np.nonzero(iou > least)
        return i, j, q["conf"][0, j], iou[i, j]

    b = boxes(spark, d)
    return B.joined(b.where("id % 2 = 0"), b.where("id % 2 = 1"), ["brand"], ["conf"], rule, "brand string, truth long, pred long, conf double, iou double")


def dense(p: pd.DataFrame, row: str, col: str, value: str):
    r, c = np.sort(p[row].unique()), np.sort(p[col].unique())
    m = np.zeros((len(r), len(c)))
    m[np.searchsorted(r, p[row]), np.searchsorted(c, p[col])] = p[value]
    return r, c, m


@query("j14_optimal_assignment")
def optimal_assignment(spark, d):
    def run(p):
        r, c, m = dense(p, "pred", "truth", "iou")
        out = K.assign(m)
        return pd.DataFrame({"brand": p["brand"].iloc[0], "pred": [r[i] for i, _ in out], "truth": [c[j] for _, j in out], "iou": [m[i, j] for i, j in out]})

    return _pairs(spark, d).groupBy("brand").applyInPandas(run, "brand string, pred long, truth long, iou double")


@query("j15_greedy_assignment")
def greedy_assignment(spark, d):
    def run(p):
        r, c, m = dense(p, "pred", "truth", "iou")
        out = K.greedy(m)
        return pd.DataFrame({"brand": p["brand"].iloc[0], "pred": [r[i] for i, _ in out], "truth": [c[j] for _, j in out]})

    return _pairs(spark, d).groupBy("brand").applyInPandas(run, "brand string, pred long, truth long")


@query("j16_valid_first_matching")
def valid_first_matching(spark, d):
    def run(p):
        _, _, m = dense(p, "pred", "truth", "iou")
        rows = [(p["brand"].iloc[0], t, len(K.match_valid_first(m, t))) for t in (0.1, 0.25, 0.5)]
        return pd.DataFrame(rows, columns=["brand", "threshold", "matched"])

    return _pairs(spark, d).groupBy("brand").applyInPandas(run, "brand string, threshold double, matched long")


@query("w01_average_precision")
def average_precision(spark, d):
    return precisions(spark, d, (0.1, 0.25, 0.5))


def precisions(spark, d, thresholds):
    """At each threshold; predictions and truths without any overlap count, too."""
    b = boxes(spark, d)
    counts = b.groupBy("brand").agg(F.count_if(F.col("id") % 2 == 0).alias("truths"))
    alone = b.where("id % 2 = 1").select("brand", F.lit(None).cast("long").alias("truth"), F.col("id").alias("pred"), "conf", F.lit(0.0).alias("iou"))
    # Pairs below every threshold match nothing, so they stay where they are found.
    rows = _pairs(spark, d, math.nextafter(min(thresholds), 0)).unionByName(alone).join(counts, "brand")

    def run(p):
        preds = p.groupby("pred", as_index=False)["conf"].first().sort_values("pred")
        q = p.dropna(subset=["truth"])
        at, truth = np.searchsorted(preds["pred"], q["pred"]), q["truth"].to_numpy(np.int64)
        n = int(p["truths"].iloc[0])
        out = [(p["brand"].iloc[0], t, K.sparse_precision(preds["conf"].to_numpy(), at, truth, q["iou"].to_numpy(), n, t)[0]) for t in thresholds]
        return pd.DataFrame(out, columns=["brand", "threshold", "ap"])

    return rows.groupBy("brand").applyInPandas(run, "brand string, threshold double, ap double")


@query("w02_mean_precision")
def mean_precision(spark, d):
    """Over 0.50 to 0.95 by 0.05."""
    b = precisions(spark, d, [t / 100 for t in range(50, 100, 5)])
    return b.groupBy("brand").agg(F.round(F.avg("ap"), 9).alias("mean_ap"))


@query("w03_ranking_reasons")
def ranking_reasons(spark, d):
    """At 0.25: why each prediction counts or doesn't, by confidence."""
    alone = boxes(spark, d).where("id % 2 = 1").select("brand", F.lit(None).cast("long").alias("truth"), F.col("id").alias("pred"), "conf", F.lit(0.0).alias("iou"))

    def run(p):
        order = p.drop_duplicates("pred").sort_values(["conf", "pred"], ascending=[False, True])["pred"].tolist()
        q = p.dropna(subset=["truth"])
        pairs: dict = {}
        for r in q.itertuples():
            pairs.setdefault(r.pred, []).append((r.iou, int(r.truth)))
        out = K.ranking_reasons(order, pairs, 0.25)
        return pd.DataFrame({"brand": p["brand"].iloc[0], "pred": [x[0] for x in out], "truth": pd.array([x[1] for x in out], "Int64"), "reason": [x[2] for x in out]})

    return _pairs(spark, d).unionByName(alone).groupBy("brand").applyInPandas(run, "brand string, pred long, truth long, reason string")


def _suppressed(p: pd.DataFrame, threshold: float) -> pd.DataFrame:
    p = p.sort_values("id", ignore_index=True)
    lo, hi = p[["lox", "loy", "loz"]].to_numpy(), p[["hix", "hiy", "hiz"]].to_numpy()
    keeper = K.suppress_pairs(len(p), *K.box_pairs(lo, hi), np.lexsort((p["id"], -p["conf"])), threshold)
    return pd.DataFrame({"brand": p["brand"], "id": p["id"], "keeper": p["id"].to_numpy()[keeper], "kept": keeper == np.arange(len(p))})


@query("w05_class_suppression")
def class_suppression(spark, d):
    return boxes(spark, d).groupBy("brand").applyInPandas(lambda p: _suppressed(p, 0.25), "brand string, id long, keeper long, kept boolean")


@query("w06_mask_aliases")
def mask_aliases(spark, d):
    """Kept boxes with the aliases that they absorbed."""
    s = class_suppression(spark, d)
    return s.groupBy("brand", F.col("keeper").alias("id")).agg(F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("id")))).alias("aliases"))


@query("w07_cross_source_suppression")
def cross_source_suppression(spark, d):
    """Ties of score prefer the later source; ranks of equal scores are averaged."""
    def run(p):
        p = p.sort_values(["id"], ignore_index=True)
        p["conf"] = p.groupby(p["id"] % 2)["conf"].rank(method="average") / (p.groupby(p["id"] % 2)["conf"].transform("size") + 1)
        return _suppressed(p, 0.5)

    return boxes(spark, d).groupBy("brand").applyInPandas(run, "brand string, id long, keeper long, kept boolean")


@query("w10_core_distance_owner")
def core_distance_owner(spark, d):
    def run(p):
        p = p.sort_values("id", ignore_index=True)
        q, out = xyz(p), []
        cores = {m: q[(p["id"] % 3 == m) & (p["id"] % 2 == 0)] for m in range(3)}
        value = np.stack([1 / (1 + K.nearest_index(q, c)[1] / 0.05) if len(c) else np.zeros(len(q)) for c in cores.values()])
        out = value.argmax(axis=0)  # the earlier mask wins ties
        return pd.DataFrame({"g": p["g"], "id": p["id"], "owner": out})

    return per_instance(spark, d, run, "g int, id long, owner long")


@query("w13_farthest_points")
def farthest_points(spark, d):
    def run(p):
        at = K.farthest_first(xyz(p), 8)
        return pd.DataFrame({"g": p["g"].iloc[0], "k": range(len(at)), "id": p["id"].to_numpy()[at]})

    return per_instance(spark, d, run, "g int, k long, id long")


@query("w14_distinct_cameras")
def distinct_cameras(spark, d):
    def run(p):
        at = K.separated(np.lexsort((p["id"], -p["x"])), xyz(p), 0.15, 5)
        return pd.DataFrame({"g": p["g"].iloc[0], "k": range(len(at)), "id": p["id"].to_numpy()[at]})

    return per_instance(spark, d, run, "g int, k long, id long")


@query("c01_largest_cluster")
def largest_cluster(spark, d):
    return per_instance(spark, d, lambda p: p.assign(cluster=K.dbscan(xyz(p), 0.15, 4), kept=K.largest(K.dbscan(xyz(p), 0.15, 4)))[["g", "id", "cluster", "kept"]], "g int, id long, cluster long, kept boolean")


@query("c02_statistical_inliers")
def statistical_inliers(spark, d):
    return per_instance(spark, d, lambda p: p.assign(kept=K.statistical_inliers(xyz(p), 20, 2.0))[["g", "id", "kept"]], "g int, id long, kept boolean")


@query("c03_euclidean_clusters")
def euclidean_clusters(spark, d):
    def run(p):
        label = K.euclidean_clusters(xyz(p), 0.12, 2)
        sizes = np.bincount(label[label >= 0], minlength=1)
        return p.assign(cluster=label, kept=(label >= 0) & (sizes[np.maximum(label, 0)] * 2 >= sizes.max()))[["g", "id", "cluster", "kept"]]

    return per_instance(spark, d, run, "g int, id long, cluster long, kept boolean")


@query("c04_voxel_component")
def voxel_component(spark, d):
    def run(p):
        label = K.dbscan(np.floor(xyz(p) / 0.12), 1.75, 1)  # 26 neighbours: Chebyshev distance 1
        win = K.largest(label)
        return p.assign(kept=win & (win.mean() >= 0.5))[["g", "id", "kept"]]

    return per_instance(spark, d, run, "g int, id long, kept boolean")


@query("c06_detached_minority")
def detached_minority(spark, d):
    """The tables' clouds are sparse, so clusters may be wider and the rest smaller than by default."""
    def run(p):
        found = K.detached_minority(xyz(p), (0.008, 0.2), least=16, few=1)
        core, gap, wide = found or (None, None, None)
        return pd.DataFrame({"g": [p["g"].iloc[0]], "core": pd.array([core], "Float64"), "gap": pd.array([gap], "Float64"), "diameter": pd.array([wide], "Float64"), "detached": [found is not None]})

    return per_instance(spark, d, run, "g int, core double, gap double, diameter double, detached boolean")


@query("c12_constrained_groups")
def constrained_groups(spark, d):
    """Strongest overlaps first; boxes of one size class must stay apart."""
    b = boxes(spark, d)
    sizes = b.select("brand", "id", (F.col("size") % 4).alias("kind"))
    rows = _pairs(spark, d).select("brand", F.col("truth").alias("a"), F.col("pred").alias("b"), "iou").join(sizes.select(F.col("id").alias("a"), F.col("kind").alias("ka")), "a").join(sizes.select(F.col("id").alias("b"), F.col("kind").alias("kb")), "b")

    def run(p):
        ids = np.unique(p[["a", "b"]].to_numpy())
        kind = dict(zip(p["a"], p["ka"], strict=True)) | dict(zip(p["b"], p["kb"], strict=True))
        i, j = np.searchsorted(ids, p["a"]), np.searchsorted(ids, p["b"])
        apart = {(x, y) for x in range(len(ids)) for y in range(x + 1, len(ids)) if kind[ids[x]] == kind[ids[y]]}
        root = K.constrained_groups(len(ids), list(zip(p["iou"], np.minimum(i, j), np.maximum(i, j), strict=True)), apart)
        return pd.DataFrame({"brand": p["brand"].iloc[0], "id": ids, "component": ids[root]})

    return rows.groupBy("brand").applyInPandas(run, "brand string, id long, component long")


@query("c17_planes")
def planes(spark, d):
    return per_instance(spark, d, lambda p: p.assign(plane=K.peel_planes(xyz(p), 0.03, 6, 3))[["g", "id", "plane"]], "g int, id long, plane long")


@query("c18_circles")
def circles(spark, d):
    def run(p):
        c, r, inl = K.fit_circle(xyz(p)[:, :2], 0.02, 100, 0)
        return pd.DataFrame({"g": [p["g"].iloc[0]], "cx": [c[0]], "cy": [c[1]], "radius": [r], "inliers": [int(inl.sum())]})

    return per_instance(spark, d, run, "g int, cx double, cy double, radius double, inliers long")


@query("c19_rigid_registration")
def rigid_registration(spark, d):
    """Each instance against itself, turned and moved: the recovered motion must undo it."""
    def run(p):
        q = xyz(p)
        turn = np.array([[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1.0]])
        moved = q @ turn.T + [1.5, -2.25, 0.5]
        moved[::10] += 1.0
        r, t, inl = K.rigid_ransac(q, moved, 1e-6, 100, 0)
        return pd.DataFrame({"g": [p["g"].iloc[0]], "inliers": [int(inl.sum())], "error": [float(np.abs(r - turn).max() + np.abs(t - [1.5, -2.25, 0.5]).max())]})

    return per_instance(spark, d, run, "g int, inliers long, error double")


@query("c20_closest_points")
def closest_points(spark, d):
    def run(p):
        q = xyz(p)
        r, t, s = K.icp(q, q * 1.02 + 0.004, keep=0.9, scale=(0.8, 1.25))
        return pd.DataFrame({"g": [p["g"].iloc[0]], "scale": [s], "rms": [float(np.sqrt((K.nearest_index(s * q @ r.T + t, q * 1.02 + 0.004)[1] ** 2).mean()))]})

    return per_instance(spark, d, run, "g int, scale double, rms double")


@query("a21_principal_boxes")
def principal_boxes(spark, d):
    def run(p):
        c, axes, size = K.principal_box(xyz(p))
        return pd.DataFrame({"g": [p["g"].iloc[0]], "centre": [c], "axes": [axes.ravel()], "size": [size]})

    return per_instance(spark, d, run, "g int, centre array<double>, axes array<double>, size array<double>")


@query("a23_upright_boxes")
def upright_boxes(spark, d):
    def run(p):
        c, yaw, size = K.upright_box(xyz(p))
        return pd.DataFrame({"g": [p["g"].iloc[0]], "centre": [c], "yaw": [yaw], "size": [size]})

    return per_instance(spark, d, run, "g int, centre array<double>, yaw double, size array<double>")


@query("a25_mahalanobis_inliers")
def mahalanobis_inliers(spark, d):
    return per_instance(spark, d, lambda p: p.assign(kept=K.mahalanobis(xyz(p)) <= 1.2**2)[["g", "id", "kept"]], "g int, id long, kept boolean")


@query("a35_robust_inliers")
def robust_inliers(spark, d):
    return per_instance(spark, d, lambda p: p.assign(tail=K.mahalanobis(xyz(p)) > K.CHI3_997, robust=K.least_determinant(xyz(p)) <= K.CHI3_997)[["g", "id", "tail", "robust"]], "g int, id long, tail boolean, robust boolean")


@query("t01_tracks")
def tracks(spark, d):
    """Frame by frame in time order, observations join the best track of their scene."""
    return track_batch(obs(spark, d))


@query("p14_axial_trim")
def axial_trim(spark, d):
    """Points of an instance against its own measured axis; the votes are the points' numbers."""
    def run(p):
        q, n = xyz(p), p["id"].to_numpy()
        return p.assign(removed=K.axial_trim(q, q, n % 5, n % 7))[["g", "id", "removed"]]

    return per_instance(spark, d, run, "g int, id long, removed boolean")


@query("p26_regularized")
def regularized(spark, d):
    """Points moved onto the plane of their instance; limits as wide as the tables' clouds are."""
    def run(p):
        q = xyz(p)
        to = K.regularized(q, least=16, tolerance=0.2, share=0.6, span=0.2)
        moved = np.zeros(len(q)) if to is None else np.linalg.norm(to - q, axis=1)
        return p.assign(moved=np.round(moved, 9))[["g", "id", "moved"]]

    return per_instance(spark, d, run, "g int, id long, moved double")
