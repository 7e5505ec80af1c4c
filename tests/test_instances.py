"""Scorers, folds and merges of instances on small scenes whose outcome is known."""

import numpy as np
import pytest

from posegrid.operators import instances as I

GRID = np.stack(np.meshgrid(np.arange(8) * 0.02, np.arange(8) * 0.02, [0.0], indexing="ij"), axis=-1).reshape(-1, 3)
E1, E2 = np.array([1.0, 0.0]), np.array([0.0, 1.0])


def one(key, points, text=E1, frame="0", name="cup", visual=E1, parent=None, confidence=0.5, frames=None):
    return I.Instance(key, name, points, text, visual, set(frames or {frame}), confidence, parent)


def test_shared_surface_against_brute_force():
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 0.4, (30, 3)), rng.uniform(0.1, 0.5, (40, 3))
    near = np.linalg.norm(a[:, None] - b[None], axis=2) <= 0.1
    x, y = near.any(axis=1).mean(), near.any(axis=0).mean()
    assert I.shared_surface(a, b) == pytest.approx((2 * x * y / (x + y), x, y))
    assert I.shared_surface(a, b[:0]) == (0.0, 0.0, 0.0) and I.cosine(E1, np.zeros(2)) == 0 == I.cosine(E1, np.zeros(0))


def test_legacy_score_limits():
    half = np.concatenate([GRID[:32], GRID[:32] + 5])  # half of it is shared
    lean = np.array([0.79, np.sqrt(1 - 0.79**2)])
    assert I.legacy_score(one(1, GRID), one(2, GRID)) == pytest.approx(1.0)
    assert I.legacy_score(one(1, GRID), one(2, GRID, lean)) is None
    assert I.legacy_score(one(1, GRID[:32]), one(2, half)) == pytest.approx((1 + 2 / 3) / 2)
    assert I.legacy_score(one(1, GRID), one(2, GRID + 1)) is None


def test_directional_score_needs_another_frame():
    small = GRID[:8]
    assert I.directional_score(one(1, small, frame="0"), one(2, GRID, frame="0")) is None
    assert I.directional_score(one(1, small, frame="0"), one(2, GRID, frame="1")) == pytest.approx(2.0)
    lean = np.array([0.8, 0.6])
    few = np.concatenate([GRID[:16], GRID[:48] + 5])
    score = I.directional_score(one(1, few, lean), one(2, np.concatenate([GRID[:16], GRID[:48] - 5]), frame="1"))
    assert score is None or score >= 1.2


def test_tracks_take_the_first_of_equals_and_keep_the_largest_name():
    seen = [one(1, GRID[:20], frame="0", name="a"), one(2, GRID + 3, frame="0"), one(3, GRID, frame="1", name="b"), one(4, GRID[:4], frame="2"), one(5, GRID, np.zeros(0), visual=np.zeros(0), frame="3")]
    out, told = I.tracks(seen)
    assert [(i, t) for i, t, _ in told] == [(1, 0), (2, 1), (3, 0), (4, 2), (5, 3)]
    assert out[0].name == "b" and out[0].count == 2 and out[0].frames == {"0", "1"} and len(out[0].points) == 84
    big = np.tile(GRID, (100, 1))
    assert len(I.tracks([one(1, big), one(2, big, frame="1")])[0][0].points) == 6400


def test_part_fusion():
    seen = [one(1, GRID, parent=1), one(2, GRID, frame="1", parent=1), one(3, GRID, frame="1", parent=1), one(4, GRID, frame="2", parent=2), one(5, GRID, frame="2", parent=1, name="lid"), one(6, GRID, frame="3", visual=E2, parent=1)]
    out, told = I.tracks(seen, I.part_score, I.fuse)
    assert [t for _, t, _ in told] == [0, 0, 1, 2, 3, 4]
    assert told[1][2] == pytest.approx(2 * (0.4 * 2 + 0.6)) and len(out[0].points) == 64
    red, blue = np.array([[1.0, 0, 0, 0]]), np.array([[0.0, 0, 0, 1]])
    assert I.colour_likeness(red, red) == 1 and I.colour_likeness(red, blue) == pytest.approx(1 / (1 + 3 * 0.75))


def test_mutual_scores():
    assert I.mutual_score(GRID, GRID, 0.4, 0.2, 0.1) == pytest.approx(0.5 + 0.1 + 0.03 + 0.01)
    assert I.mutual_score(GRID, GRID[:8], 1, 1, 1) is None
    wide = np.concatenate([GRID[:16], GRID + 4, GRID + 8])  # a ninth of the visible points is shared
    assert I.mutual_score(GRID[:16], wide, 0, 0, 0) is None
    x = 16 / len(wide)
    assert I.mutual_score(GRID[:16], wide, 0, 0, 0, semantic=1.0) == pytest.approx(0.25 * (2 * x / (1 + x) + 1))
    depth = np.zeros((4, 4))
    depth[2, 2] = 1.0
    points = np.array([[0, 0, 1.0], [0, 0, 1.2], [0, 0, -1.0], [1.0, 0, 1.0]])
    assert I.visible(points, np.eye(4), (2, 2, 2, 2), depth).tolist() == [True, False, False, False]


def test_merges_by_each_rule():
    lean = np.array([0.6, 0.8])
    same = [one(1, GRID), one(2, GRID, E2)]
    assert I.merged(same)[1] == [(2, 1)]  # surface alone
    part = np.concatenate([GRID, GRID + 1])
    assert I.merged([one(1, part), one(2, GRID, E2)])[1] == []  # 2/3 of the surface, other names
    assert I.merged([one(1, part), one(2, GRID)])[1] == [(2, 1)]
    recovered = [one(1, part, frames={"0", "1"}), one(2, GRID, lean, frames={"2", "3"})]
    assert I.merged(recovered)[1] == [(2, 1)]
    assert I.merged([one(1, part, frames={"0", "1"}), one(2, GRID, lean, frames={"1", "3"})])[1] == []
    assert I.merged([one(1, part, frame="0"), one(2, GRID, frame="0")], I.directional_merge)[1] == []
    out, moves = I.merged([one(1, GRID, frame="0"), one(2, part, frame="1", name="jug")], I.directional_merge)
    assert moves == [(2, 1)] and out[0].name == "jug" and out[0].frames == {"0", "1"} and out[0].sources == [1, 2]
    assert I.merged([])[1] == [] and I.merged([one(1, GRID), one(2, GRID + 3)])[1] == []


def test_absorption_by_inclusion():
    big = np.concatenate([GRID, GRID + [0, 0, 0.3]])
    inner = GRID[9:15] + [0, 0, 0.15]  # inside the box, far from the surface
    assert I.absorbed([one(1, big), one(2, GRID[:30])])[1] == [(2, 1)]
    assert I.absorbed([one(1, big), one(2, inner)])[1] == []
    assert I.absorbed([one(1, big), one(2, inner)], lambda a, b: I.Views(3, 0.8))[1] == [(2, 1)]
    assert I.absorbed([one(1, big), one(2, GRID[:30])], lambda a, b: I.Views(3, 0.8, 1))[1] == []  # masks keep them apart
    assert I.absorbed([one(1, big), one(2, GRID[:30], E2)])[1] == []
    assert I.absorbed([one(1, big), one(2, GRID[:30], E2)], lambda a, b: I.Views(3, 0.5))[1] == [(2, 1)]
    assert I.absorbed([one(1, big), one(2, GRID[:30], E2)], lambda a, b: I.Views(3, 0.5), identity=False)[1] == []


def test_agglomeration_measures_again():
    strip = lambda at: np.stack(np.meshgrid(at + np.arange(0, 0.4, 0.02), np.arange(8) * 0.02, [0.0], indexing="ij"), axis=-1).reshape(-1, 3)
    parts = [one(1, strip(0.0), frame="0"), one(2, strip(0.4), frame="1"), one(3, strip(0.8), frame="2"), one(4, strip(3.0), frame="3")]
    strength = {frozenset((1, 2)): 3, frozenset((2, 3)): 5}

    def views(a, b):
        best = max((strength.get(frozenset((x, y)), 0) for x in a.sources for y in b.sources), default=0)
        return I.Views(best, 0.7)

    left, moves = I.agglomerated(parts, views)
    assert moves == [(3, 2), (1, 2)] and sorted(i.key for i in left) == [2, 4]
    chain = lambda a, b: I.Views(3, 0.7, int(a.count + b.count > 2))  # noqa: E731  whole bodies are apart
    assert len(I.agglomerated([one(1, strip(0.0)), one(2, strip(0.4)), one(3, strip(0.8))], chain)[1]) == 1


def test_association_prefers_frames_and_the_best_group():
    groups = [one(1, GRID[:32], frame="0"), one(2, GRID, frames={"0", "1"}), one(3, GRID + 2, frame="0"), one(4, GRID + 2, E2, frame="4", name="other")]
    out, moves = I.associated(groups)
    assert moves == [(1, 2)] and sorted(g.key for g in out) == [2, 3, 4]
    assert I.admissible(one(1, GRID), one(2, GRID), lambda a, b: True) == 0 and I.associated([]) == ([], [])


def test_scenes_are_independent_and_nulls_are_empty(spark):
    flat = GRID.reshape(-1).tolist()
    rows = [("s", 1, 1, "0", "cup", None, 0.5, [1.0, 0.0], [1.0], flat), ("s", 2, 2, "1", None, 1, None, [1.0, 0.0], None, flat), ("t", 1, 1, "0", "cup", None, 0.5, [1.0, 0.0], [1.0], flat), ("t", 2, 2, "0", "cup", None, 0.5, None, None, None), (None, 3, 3, "0", "x", None, 0.1, None, None, None)]
    df = spark.createDataFrame(rows, "scene string, id long, ord long, frame string, name string, parent long, confidence double, text array<double>, visual array<double>, points array<double>")
    got = I.by_scene(df, lambda seen: [(i, t) for i, t, _ in I.tracks(seen)[1]], "id long, track long").collect()
    assert sorted(map(tuple, got)) == [("s", 1, 0), ("s", 2, 0), ("t", 1, 0), ("t", 2, 1)]
    assert I.by_scene(df.limit(0), lambda seen: [], "id long, track long").count() == 0
