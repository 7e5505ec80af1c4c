"""Ordered, stateful tracking of observations per scene; one kernel for batch and stream.

A frame's observations are scored against the scene's tracks (same label required, closeness of confidence and key), one-to-one
by optimal assignment; those without a partner open tracks. Two observations of one frame never share a track. A track keeps sums, votes and
its frames' number, so its state is bounded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .kernels import assign

TRACKS = "scene long, track long, label string, n long, frames long, mean_conf double, last_frame string"


class Tracker:
    """Tracks of one scene: [label, n, frames, sum of confidence, sum of k, last frame], by label, since labels never mix."""

    def __init__(self, tracks: list | None = None):
        self.tracks = tracks or []
        self.by_label: dict[str, list[int]] = {}
        for i, t in enumerate(self.tracks):
            self.by_label.setdefault(t[0], []).append(i)

    def score(self, own: list[int], conf: list[float], k: list[float], frame: str) -> np.ndarray:
        """Of observations of one label with the tracks `own`."""
        n, c, m = np.array([self.tracks[i][1] for i in own], float), np.array([self.tracks[i][3] for i in own]), np.array([self.tracks[i][4] for i in own])
        free = np.array([self.tracks[i][5] != frame for i in own], bool)
        return np.where(free, 1.2 - np.abs(np.array(conf)[:, None] - c / n) / 50 - np.abs(np.array(k)[:, None] - m / n) / 100, -1.0)

    def frame(self, frame: str, seen: list[tuple[str, float, float]]) -> None:
        """seen: (label, confidence, key) of the frame's observations, in order."""
        by_label: dict[str, list[int]] = {}
        for i, (label, _, _) in enumerate(seen):
            by_label.setdefault(label, []).append(i)
        paired: dict[int, int] = {}
        for label, rows in by_label.items():
            known = self.by_label.get(label)
            if known:
                m = self.score(known, [seen[i][1] for i in rows], [seen[i][2] for i in rows], frame)
                if len(rows) == 1:
                    best = int(m[0].argmax())
                    pairs = [(0, best)] if m[0, best] > 0 else []
                else:
                    pairs = assign(m)
                paired |= {rows[i]: known[j] for i, j in pairs}
        for i, (label, conf, k) in enumerate(seen):
            at = paired.get(i)
            if at is None:
                self.by_label.setdefault(label, []).append(len(self.tracks))
                self.tracks.append([label, 1, 1, conf, k, frame])
            else:
                t = self.tracks[at]
                t[1], t[2], t[3], t[4], t[5] = t[1] + 1, t[2] + 1, t[3] + conf, t[4] + k, frame

    def add(self, rows: pd.DataFrame) -> None:
        order = sorted(zip(rows["frame"].astype(str), rows["event_id"], rows["label"], rows["conf"].astype(float), rows["k"].astype(float), strict=True), key=lambda r: r[:2])
        for frame, own in groupby(order, key=lambda r: r[0]):
            self.frame(frame, [r[2:] for r in own])

    def table(self, scene: int) -> pd.DataFrame:
        t = self.tracks
        return pd.DataFrame({"scene": scene, "track": range(len(t)), "label": [x[0] for x in t], "n": [x[1] for x in t], "frames": [x[2] for x in t], "mean_conf": [round(x[3] / x[1], 9) for x in t], "last_frame": [x[5] for x in t]})


def track_batch(observations: DataFrame) -> DataFrame:
    """All tracks of all scenes; observations: scene, frame, event_id, label, conf, k. A null label is a label of its own."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        tracker = Tracker()
        tracker.add(p.assign(label=p["label"].fillna(""), conf=p["conf"].fillna(0.0), k=p["k"].fillna(0)))
        return tracker.table(int(p["scene"].iloc[0]))

    rows = observations.where("scene IS NOT NULL AND frame IS NOT NULL").select("scene", "frame", "event_id", "label", "conf", "k")
    return rows.groupBy("scene").applyInPandas(run, TRACKS)


def track_stream(observations: DataFrame) -> DataFrame:
    """The same tracks, updated with each micro-batch; frames must not arrive late. Emits a scene's tracks when they change."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker = Tracker(json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches))
        tracker.add(rows.assign(label=rows["label"].fillna(""), conf=rows["conf"].fillna(0.0), k=rows["k"].fillna(0)))
        state.update((json.dumps(tracker.tracks),))
        yield tracker.table(int(key[0]))

    rows = observations.where("scene IS NOT NULL AND frame IS NOT NULL").select("scene", "frame", "event_id", "label", "conf", "k")
    return rows.groupBy("scene").applyInPandasWithState(run, TRACKS, "tracks string", "update", GroupStateTimeout.NoTimeout)
