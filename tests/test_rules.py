"""Rules and kernels against cases worked out by hand, and against dense versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.functions import rules as P
from posegrid.operators import kernels as K
from posegrid.operators import spatial


def test_sparse_suppression_equals_the_dense_one():
    rng = np.random.default_rng(3)
    lo = rng.uniform(0, 3, (120, 3))
    hi = lo + rng.uniform(0, 1.5, (120, 3))
    lo[5], hi[5] = lo[4], hi[4]
    inter = np.clip(np.minimum(hi[:, None], hi[None]) - np.maximum(lo[:, None], lo[None]), 0, None).prod(axis=2)
    vol = (hi - lo).prod(axis=1)
    iou = inter / (vol[:, None] + vol[None] - inter)
    i, j, v = K.box_pairs(lo, hi)
    want = np.triu(inter > 0, 1)
    assert len(i) == want.sum() and want[i, j].all() and np.allclose(v, iou[i, j])
    order = rng.permutation(120)
    assert (K.suppress_pairs(120, i, j, v, order, 0.2) == K.suppress(iou, order, 0.2)).all()
    assert len(K.box_pairs(lo[:0], hi[:0])[0]) == 0


def test_ranking_reasons():
    pairs = {1: [(0.9, 7), (0.6, 8)], 2: [(0.8, 7), (0.5, 8)], 3: [(0.7, 7)], 4: [(0.2, 7)]}
    assert K.ranking_reasons([1, 2, 3, 4, 5], pairs, 0.25) == [(1, 7, "matched"), (2, 8, "matched"), (3, None, "duplicate_competition"), (4, None, "localization_below_threshold"), (5, None, "localization_below_threshold")]


def blob(n, at, spread, seed):
    return np.random.default_rng(seed).uniform(-spread, spread, (n, 3)) + at


def test_detached_minority_measures_the_core():
    core = np.stack(np.meshgrid(*[np.arange(8) * 0.01] * 3), axis=-1).reshape(-1, 3)  # 512 points, 0.121 across
    far, near = blob(20, [0.5, 0, 0], 0.005, 1), blob(20, [0.18, 0, 0], 0.005, 1)
    share, gap, wide = K.detached_minority(np.vstack([core, far]))
    assert share == pytest.approx(512 / 532) and wide == pytest.approx(0.07 * 3**0.5) and gap > 0.4
    assert K.detached_minority(np.vstack([core, near])) is None  # over 0.1 away, not over the core's diameter
    assert K.detached_minority(np.vstack([core, far[:15]])) is None
    assert K.detached_minority(np.vstack([core, np.tile(far, (4, 1)) + blob(80, 0, 0.004, 2)])) is None  # more than a tenth
    assert K.detached_minority(core[:63]) is None and K.detached_minority(np.zeros((0, 3))) is None


def test_axial_trim():
    turn, z = np.meshgrid(np.linspace(0, 2 * np.pi, 60, endpoint=False), np.linspace(0, 0.2, 20))
    cup = np.column_stack([0.05 * np.cos(turn.ravel()), 0.05 * np.sin(turn.ravel()), z.ravel()])
    stray = np.array([[0.09, 0, 0.1], [0, 0.12, 0.05], [-0.2, 0, 0.1]])
    handle = np.column_stack([np.linspace(0.06, 0.09, 40), np.zeros(40), np.full(40, 0.15)])
    prior = np.vstack([cup, stray, handle])
    positive, negative = np.zeros(len(prior), int), np.zeros(len(prior), int)
    removed = K.axial_trim(prior, cup, positive, negative)
    assert np.flatnonzero(removed).tolist() == [1200, 1201, 1202]  # the handle is one attachment of 40 points
    positive[1200:1203], negative[1201] = 3, 9
    assert np.flatnonzero(K.axial_trim(prior, cup, positive, negative)).tolist() == [1201]
    assert not K.axial_trim(prior, blob(400, 0, 0.05, 3), positive, negative).any()  # no circle is proved
    half = cup[cup[:, 0] > 0.03]  # under a third of the turn
    assert not K.axial_trim(prior, half, positive * 0, negative * 0).any()
    assert not K.axial_trim(prior[1200:], cup, positive[1200:] * 0, negative[1200:] * 0)[3:].any()
    assert not K.axial_trim(np.vstack([cup[:5], stray]), cup, np.zeros(8), np.zeros(8)).any()  # more than three tenths


def test_regularized_moves_only_what_is_near_the_plane():
    rng = np.random.default_rng(5)
    flat = np.column_stack([rng.uniform(0, 1, 4500), rng.uniform(0, 0.6, 4500), rng.uniform(-0.002, 0.002, 4500)])
    edge = np.column_stack([rng.uniform(0, 1, 500), np.zeros(500), rng.uniform(0.1, 0.3, 500)])
    to = K.regularized(np.vstack([flat, edge]))
    assert np.abs(to[:4500, 2]).max() < 5e-4 and (to[4500:] == edge).all()
    assert K.regularized(flat[:4000]) is None
    assert K.regularized(flat * [1, 0.5, 1]) is None  # too narrow
    assert K.regularized(np.vstack([flat, np.repeat(edge, 4, axis=0)])) is None  # under four fifths


def test_supported_trim(spark):
    rows = [(1, k, 0, 3, 0.02) for k in range(3)] + [(1, k, 5, 0, 0.02) for k in range(3, 9)] + [(1, 9, None, None, None)]
    rows += [(2, k, 0, 3, 0.02) for k in range(4)] + [(2, k, 9, 0, 0.0) for k in range(4, 10)] + [(None, 0, 0, 9, 1.0)]
    df = spark.createDataFrame(rows, "g long, id long, positive long, negative long, distance double")
    got = {(r["g"], r["id"]): r["removed"] for r in spatial.supported_trim(df, "g").collect()}
    assert len(got) == 21 and {k for k, v in got.items() if v} == {(1, 0), (1, 1), (1, 2)}
    edge = spark.createDataFrame([(1, 0, 2, 3, 0.02), (1, 1, 1, 3, 0.01), (1, 2, 1, 2, 0.5), (1, 3, 9, 0, 0.5)], df.schema)
    assert spatial.supported_trim(edge, "g").where("removed").count() == 0
    assert spatial.supported_trim(df.limit(0), "g").count() == 0


def test_rules_at_their_limits(spark):
    good = {"best": 0.69, "own": 0.24, "extent": 0.65, "support": 2, "features": 2, "baseline": 0.15, "confidence": 0.5, "areas": 2, "points": 64}
    dense = {"points": 1024, "narrow": 0.2, "wide": 0.8, "level": 0.995, "flat": 0.55, "added": 256}
    related = {"semantic": 0.5, "cover": 0.8}

    def verdict(rule, e):
        return spark.range(1).select(rule(lambda k: F.lit(e[k]).cast("double")).alias("v")).first()["v"]

    for rule, e, bad in ((P.witnessed, good, {"best": 0.7, "own": 0.25, "extent": 0.66, "support": 1, "areas": 1, "points": 63}), (P.dense_recovery, dense, {k: v * 0.99 for k, v in dense.items()}), (P.related_surface, related, {"semantic": 0.49, "cover": 0.79})):
        assert verdict(rule, e) is True
        for k, v in bad.items():
            assert verdict(rule, e | {k: v}) is False
            assert verdict(rule, e | {k: None}) is None


def verdicts(spark, rule, good, *changes):
    """The rule over one passing row of evidence and over its changed copies."""
    rows = spark.createDataFrame([{k: float(v) if not isinstance(v, bool) else v for k, v in {**good, **c}.items()} for c in ({}, *changes)])
    return [r.v for r in rows.coalesce(1).select(rule(F.col).alias("v")).collect()]


def test_seams_and_thin_surfaces(spark):
    seam = {"points": 600, "body": 900, "semantic": 0.9, "views": 3, "height": 0.6, "face": 0.5, "contact": 64, "cells": 128, "seam": 0.8, "continuity": 0.9, "mismatch": 0.04, "tilt": 0.05, "dot": 0.1}
    off = [{"body": 600}, {"views": 2}, {"seam": 0.7}, {"dot": 0.2}, {"tilt": 0.1}, {"mismatch": 0.05}]
    assert verdicts(spark, P.enclosure_seam, seam, *off) == [True] + [False] * 6
    thin = {"cohort": 1, "views": 12, "added": 300, "points": 100}
    assert verdicts(spark, P.thin_recovery, thin, {"cohort": 2}, {"views": 11}, {"added": 299}, {"points": 10, "added": 127}, {"points": 10, "added": 128}) == [True, False, False, False, False, True]


def test_parts_rears_and_completions(spark):
    part = {"semantic": 0.8, "compositional": False, "whole": 0, "consensus": 0, "separation": 1}
    viewed = {"semantic": 0.4, "whole": 3, "consensus": 0.6, "separation": 0}
    assert verdicts(spark, P.part_acceptance, part, {"semantic": 0.7}, {"semantic": 0.65, "compositional": True}, viewed, {**viewed, "separation": 1}) == [True, False, True, True, False]
    rear = {"core": 256, "parallel": 0.995, "depth": 0.5, "visual": False}
    assert verdicts(spark, P.rear_boundary, rear, {"visual": True}, {"depth": 0.1}, {"depth": 0.1, "visual": True}, {"depth": 0.8}, {"core": 255}) == [True, False, False, True, False, False]
    shape = {"cover": 0.8, "complete": 0.5, "growth": 3, "conflict": 0.05, "free": 0.03, "added": 32}
    got = verdicts(spark, P.completion, shape, {"cover": 0.7}, {"complete": 0.9}, {"growth": 3.1}, {"conflict": 0.06, "free": 1}, {"free": 0.04}, {"added": 31})
    assert got == ["accepted", "incompatible", "incompatible", "incompatible", "other owner", "free space", "too few"]
