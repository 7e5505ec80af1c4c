"""Instances of a scene, built from its observations: scorers, ordered folds and merges.

An observation is a cloud with a name, two embeddings, a frame and a confidence; an instance gathers observations. All of it is
order-dependent, so a scene is one group and its kernel runs in numpy; scenes are independent and spread over the cluster.
A scene's observations bound a task. Rules are functions, so a caller can replace each of them.

Defined results: observations go by `ord`, ties by id; equal scores go to the instance that was opened first; null points or
embeddings are empty, empty clouds share no surface, and the cosine with an empty or zero vector is zero; without observations there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .kernels import nearest_index

# Radii, limits and weights of the rules below decide which results are accepted and must stay as they are.
MATCH_RADIUS = 0.10
PART_RADIUS, PART_VOXEL, PART_OVERLAP, PART_SEMANTIC, PART_LIMIT, COLOUR_WEIGHT = 0.03, 0.01, 0.2, 0.7, 1.5, 0.6
MOST_POINTS = 10_000


@dataclass
class Instance:
    key: int
    name: str
    points: np.ndarray
    text: np.ndarray
    visual: np.ndarray
    frames: set
    confidence: float
    parent: int | None = None
    colour: np.ndarray | None = None
    count: int = 1
    largest: int = 0  # points of the observation that names the instance
    sources: list = field(default_factory=list)

    def __post_init__(self):
        self.largest = self.largest or len(self.points)
        self.sources = self.sources or [self.key]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(a) * np.linalg.norm(b)) if len(a) and len(a) == len(b) else 0.0
    return float(a @ b) / size if size else 0.0


def share_near(a: np.ndarray, b: np.ndarray, radius: float) -> float:
    """Share of the points a with a point of b within the radius."""
    return float((nearest_index(a, b)[1] <= radius).mean()) if len(a) and len(b) else 0.0


def shared_surface(a: np.ndarray, b: np.ndarray, radius: float = MATCH_RADIUS) -> tuple[float, float, float]:
    """(harmonic mean of both shares, share of a, share of b)."""
    x, y = share_near(a, b, radius), share_near(b, a, radius)
    return (2 * x * y / (x + y) if x + y else 0.0), x, y


def cells(points: np.ndarray, size: float) -> np.ndarray:
    """The first point of each cell, in the order of the points."""
    if not len(points):
        return points
    return points[np.sort(np.unique(np.floor(points / size).astype(np.int64), axis=0, return_index=True)[1])]


def box_gap(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.linalg.norm(np.maximum(np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)), 0)))


def inside_box(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the points a inside the box of b."""
    return float(((a >= b.min(axis=0)) & (a <= b.max(axis=0))).all(axis=1).mean())


# Scores of an observation with a track; None where they can't be one.


def legacy_score(seen: Instance, track: Instance) -> float | None:
    semantic = cosine(seen.text, track.text)
    if semantic < 0.8:
        return None
    surface = shared_surface(seen.points, track.points)[0]
    return (semantic + surface) / 2 if surface >= 0.3 else None


def directional_score(seen: Instance, track: Instance) -> float | None:
    semantic = cosine(seen.text, track.text)
    if semantic < 0.8 or seen.frames & track.frames:
        return None
    overlap = max(shared_surface(seen.points, track.points)[1:])
    score = overlap + (semantic + 1) / 2
    return score if overlap >= 0.2 and score >= 1.2 else None


def part_score(seen: Instance, track: Instance, colour_weight: float = COLOUR_WEIGHT) -> float | None:
    """Parts of one name and parent that no frame shows together; geometry and semantics count as much as colour leaves."""
    if (seen.name, seen.parent) != (track.name, track.parent) or seen.frames & track.frames:
        return None
    geometry, semantic = max(shared_surface(seen.points, track.points, PART_RADIUS)[1:]), cosine(seen.visual, track.visual)
    if geometry < PART_OVERLAP or semantic < PART_SEMANTIC:
        return None
    alike = 1.0 if seen.colour is None or track.colour is None else colour_likeness(seen.colour, track.colour)
    score = 2 * ((1 - colour_weight) * (geometry + (semantic + 1) / 2) + colour_weight * alike)
    return score if score >= PART_LIMIT else None


def colour_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From the mean earth mover's distance of histograms over [0, 1], one row a channel."""
    return float(1 / (1 + 3 * np.abs(np.cumsum(a - b, axis=1)).mean(axis=1).mean()))


def visible(points: np.ndarray, pose: np.ndarray, camera: tuple[float, float, float, float], depth: np.ndarray) -> np.ndarray:
    """Which points a frame's depth image shows; camera: fx, fy, cx, cy; depth 0 is unknown."""
    at = (points - pose[:3, 3]) @ pose[:3, :3]
    z, (fx, fy, cx, cy) = at[:, 2], camera
    safe = np.maximum(z, 1e-9)
    u, v = np.rint(at[:, 0] / safe * fx + cx).astype(int), np.rint(at[:, 1] / safe * fy + cy).astype(int)
    inside = (z > 0) & (u >= 0) & (v >= 0) & (u < depth.shape[1]) & (v < depth.shape[0])
    measured = np.zeros(len(points))
    measured[inside] = depth[v[inside], u[inside]]
    return inside & (measured > 0) & (np.abs(z - measured) <= 0.05 + 0.01 * measured)


def mutual_score(seen: np.ndarray, shown: np.ndarray, box_iou: float, cover: float, colour: float, radius: float = MATCH_RADIUS, semantic: float | None = None) -> float | None:
    """Of an observation with the visible points of a track. Without `semantic`, a small share of either side is a veto; with
    it, weak support only counts less."""
    if len(shown) < 16:
        return None
    mutual, *shares = shared_surface(seen, shown, radius)
    if semantic is None:
        return None if min(shares) < 0.25 else 0.5 * mutual + 0.25 * box_iou + 0.15 * cover + 0.1 * colour
    return None if mutual <= 0 else 0.25 * (mutual + (semantic + 1) / 2) + 0.25 * box_iou + 0.15 * cover + 0.1 * colour


# Updates of a track by an observation.


def gather(track: Instance, seen: Instance) -> None:
    """All points, every second one when there are too many; the observation with most points names the track."""
    track.points = np.concatenate([track.points, seen.points])
    track.visual = _mean(track.visual, track.count, seen.visual, 1)
    if track.largest < len(seen.points):
        track.largest, track.name, track.text, track.confidence = len(seen.points), seen.name, seen.text, seen.confidence
    track.count += 1
    track.frames |= seen.frames
    track.sources.append(seen.key)
    if len(track.points) > MOST_POINTS:
        track.points = track.points[::2]


def fuse(track: Instance, seen: Instance) -> None:
    """One point a voxel, a unit mean embedding, a mean confidence and a slowly moving colour."""
    mean = _unit(track.visual) * track.count + _unit(seen.visual) if len(track.visual) == len(seen.visual) else track.visual
    track.visual = _unit(mean)
    track.points = voxels(np.concatenate([track.points, seen.points]), PART_VOXEL)
    if track.colour is not None and seen.colour is not None:
        mixed = 0.7 * track.colour + 0.3 * seen.colour
        track.colour = mixed / mixed.sum(axis=1, keepdims=True)
    track.confidence = (track.confidence * track.count + seen.confidence) / (track.count + 1)
    track.count += 1
    track.frames |= seen.frames
    track.sources.append(seen.key)


def voxels(points: np.ndarray, size: float) -> np.ndarray:
    """The mean of each occupied cell."""
    if not len(points):
        return points
    _, at, n = np.unique(np.floor(points / size).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
    out = np.zeros((len(n), 3))
    np.add.at(out, at.reshape(-1), points)
    return out / n[:, None]


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v) if len(v) else 0.0
    return v / size if size else v


def _mean(a: np.ndarray, m: int, b: np.ndarray, n: int) -> np.ndarray:
    return (a * m + b * n) / (m + n) if len(a) == len(b) else a


def tracks(seen: list[Instance], score: Callable = legacy_score, update: Callable = gather, least: int = 5) -> tuple[list[Instance], list[tuple[int, int, float | None]]]:
    """Folds observations in order: each joins the track of the best score, or opens one. Also (observation, track, score).

    Clouds of under `least` points or without an embedding open tracks of their own.
    """
    out, told = [], []
    for o in seen:
        best, high = None, None
        if len(o.points) >= least and (len(o.text) or len(o.visual)):
            for k, t in enumerate(out):
                s = score(o, t)
                if s is not None and (high is None or s > high):
                    best, high = k, s
        told.append((o.key, len(out) if best is None else best, high))
        if best is None:
            out.append(Instance(o.key, o.name, o.points, o.text, o.visual, set(o.frames), o.confidence, o.parent, o.colour))
        else:
            update(out[best], o)
    return out, told


# Merges of whole instances. Each returns the instances that stay, and (absorbed key, absorbing key) in order.


def legacy_merge(a: Instance, b: Instance) -> bool:
    semantic = cosine(a.text, b.text)
    both, x, y = shared_surface(a.points, b.points)
    if both > 0.7 or semantic > 0.7 and (both > 0.3 or max(x, y) > 0.8):
        return True
    seen_often = min(len(a.frames), len(b.frames)) >= 2 and not a.frames & b.frames
    return seen_often and semantic >= 0.5 and min(x, y) >= 0.5 and max(x, y) >= 0.8


def directional_merge(a: Instance, b: Instance) -> bool:
    if a.frames & b.frames or cosine(a.text, b.text) < 0.8:
        return False
    _, x, y = shared_surface(a.points, b.points)
    return max(x, y) >= 0.7 and min(x, y) >= 0.1


def merged(instances: list[Instance], accept: Callable = legacy_merge, reach: float = 2.0) -> tuple[list[Instance], list[tuple[int, int]]]:
    """Each instance in turn absorbs every other that it accepts, measured as it stands then; centres are those before any merge."""
    centre = np.array([i.points.mean(axis=0) if len(i.points) else np.full(3, np.inf) for i in instances]).reshape(-1, 3)
    gone, moves = set(), []
    for i, a in enumerate(instances):
        for j, b in enumerate(instances):
            if i == j or i in gone or j in gone or not np.linalg.norm(centre[i] - centre[j]) <= reach or not accept(a, b):
                continue
            a.points = np.concatenate([a.points, b.points])
            if a.largest < b.largest:
                a.text, a.name, a.confidence = b.text, b.name, b.confidence
            a.visual = _mean(a.visual, a.count, b.visual, 1)
            a.count, a.largest, a.frames = a.count + b.count, max(a.largest, b.largest), a.frames | b.frames
            a.sources += b.sources
            gone.add(j)
            moves.append((b.key, a.key))
    return [a for i, a in enumerate(instances) if i not in gone], moves


@dataclass
class Views:
    """What whole masks of single frames say about two instances."""

    whole: int = 0
    consensus: float = 0.0
    separation: int = 0


def nothing_seen(a: Instance, b: Instance) -> Views:
    return Views()


def absorbed(instances: list[Instance], views: Callable = nothing_seen, identity: bool = True) -> tuple[list[Instance], list[tuple[int, int]]]:
    """Larger instances absorb those inside their box: strong shared surface, covered surface, or agreeing whole masks.

    With `identity`, names may differ where masks alone prove a contained duplicate.
    """
    order = sorted(instances, key=lambda i: (-len(i.points), i.key))
    gone, moves = set(), []
    for big in order:
        for small in order:
            if big.key in gone or small.key in gone or small is big or len(small.points) > len(big.points) or not len(small.points):
                continue
            inside = inside_box(small.points, big.points)
            if inside < 0.95:
                continue
            semantic = cosine(big.text, small.text)
            if semantic < 0.6 and not identity:
                continue
            _, cover, back = shared_surface(small.points, big.points, 0.03)
            strong = semantic >= 0.8 and min(cover, back) >= 0.5 and max(cover, back) >= 0.8
            seen = views(big, small)
            duplicate = semantic < 0.6 and cover >= 0.99 and seen.whole >= 3 and seen.consensus >= 0.5 and not seen.separation
            if semantic < 0.6 and not duplicate or seen.separation and not strong:
                continue
            if not (duplicate or strong or cover >= 0.99 or seen.whole >= 3 and seen.consensus >= 0.8):
                continue
            if not strong and cover < 0.99:
                big.points = voxels(np.concatenate([big.points, small.points]), 0.01)
            if not duplicate:
                big.text, big.visual = (_mean(getattr(big, n), big.count, getattr(small, n), small.count) for n in ("text", "visual"))
                big.confidence = (big.count * big.confidence + small.count * small.confidence) / (big.count + small.count)
            big.count, big.frames = big.count + small.count, big.frames | small.frames
            big.sources += small.sources
            gone.add(small.key)
            moves.append((small.key, big.key))
    return [i for i in order if i.key not in gone], moves


def agglomerated(instances: list[Instance], views: Callable, least: int = 128, large: float = 0.5, touch: float = 0.03) -> tuple[list[Instance], list[tuple[int, int]]]:
    """The strongest acceptable pair becomes one and is measured anew, until none is acceptable.

    Acceptable: named alike, large together, in contact, never apart, and whole in three frames or more.
    """
    left, moves, known = list(instances), [], {}

    def strength(a: Instance, b: Instance):
        if min(len(a.points), len(b.points)) < least or cosine(a.text, b.text) < 0.8:
            return None
        extent = (np.maximum(a.points.max(axis=0), b.points.max(axis=0)) - np.minimum(a.points.min(axis=0), b.points.min(axis=0))).max()
        if extent < large or box_gap(a.points, b.points) > touch or nearest_index(a.points, b.points)[1].min() > touch:
            return None
        seen = views(a, b)
        return (seen.whole, seen.consensus) if seen.whole >= 3 and seen.consensus >= 0.6 and not seen.separation else None

    while True:
        best = None
        for i, a in enumerate(left):
            for b in left[i + 1 :]:
                name = (a.key, b.key, len(a.points), len(b.points), a.count, b.count)
                if name not in known:
                    known[name] = strength(a, b)
                if known[name] is not None and (best is None or known[name] > best[0]):
                    best = (known[name], a, b)
        if best is None:
            return left, moves
        target, source = best[1:] if len(best[1].points) >= len(best[2].points) else best[:0:-1]
        target.points = cells(np.concatenate([target.points, source.points]), 0.005)
        target.visual = _mean(target.visual, target.count, source.visual, source.count)
        target.confidence = (target.count * target.confidence + source.count * source.confidence) / (target.count + source.count)
        target.count, target.frames = target.count + source.count, target.frames | source.frames
        target.sources += source.sources
        left.remove(source)
        moves.append((source.key, target.key))


def admissible(a: Instance, b: Instance, apart: Callable = lambda a, b: False) -> float:
    """Score of two groups that may be one: the smaller share of surface in common, or 0."""
    if not len(a.points) or not len(b.points) or box_gap(a.points, b.points) > 0.006 or a.name != b.name and cosine(a.text, b.text) < 0.8 or apart(a, b):
        return 0.0
    _, x, y = shared_surface(a.points, b.points, 0.03)
    return min(x, y) if min(x, y) >= 0.15 and max(x, y) >= 0.85 else 0.0


def associated(groups: list[Instance], score: Callable = admissible) -> tuple[list[Instance], list[tuple[int, int]]]:
    """Groups of most frames first, then of most points, each join the best group that stands, or stand themselves."""
    out, moves = [], []
    for g in sorted(groups, key=lambda g: (-len(g.frames), -g.largest, g.key)):
        best, at = max(((score(g, o), i) for i, o in enumerate(out)), default=(0.0, -1))
        if not best:
            out.append(g)
            continue
        old = out[at]
        union = cells(np.concatenate([old.points, g.points]), 0.003)
        old.points = union[:: max(1, len(union) // 2000)]
        old.frames, old.largest, old.count = old.frames | g.frames, max(old.largest, g.largest), old.count + g.count
        old.sources += g.sources
        moves.append((g.key, old.key))
    return out, moves


OBSERVATIONS = "scene, id, ord, frame, name, parent, confidence, text, visual, points"


def observed(rows: pd.DataFrame) -> list[Instance]:
    """Instances of one observation each, in order; points are flat triples."""
    flat = lambda v: np.zeros(0) if v is None else np.asarray(v, float)
    rows = rows.sort_values(["ord", "id"], kind="stable")
    return [
        Instance(int(r.id), r.name_ or "", flat(r.points).reshape(-1, 3), flat(r.text), flat(r.visual), {r.frame}, 0.0 if pd.isna(r.confidence) else float(r.confidence), None if pd.isna(r.parent) else int(r.parent))
        for r in rows.rename(columns={"name": "name_"}).itertuples()
    ]


def by_scene(observations: DataFrame, kernel: Callable[[list[Instance]], list[tuple]], schema: str) -> DataFrame:
    """Rows (scene, ..) that the kernel makes of every scene. schema: of the kernel's rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = observations.schema["scene"].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(kernel(observed(p)), columns=names)
        out.insert(0, "scene", p["scene"].iloc[0])
        return out

    return observations.where("scene IS NOT NULL").select(*OBSERVATIONS.split(", ")).groupBy("scene").applyInPandas(run, f"scene {kind}, {schema}")
