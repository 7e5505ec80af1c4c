"""Tracks and merges of instances. SQL has no twin for ordered folds; tests hold them against plain cases.

Every vector of `embeddings` is an observation of one of 11 objects of the scene of its label: 20 points, and an embedding. Merges
work on the tracks that the part rules leave, which are one to an object and frame or more.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import instances as I
from .registry import query, table


def observations(spark, d):
    v, i, eleven = F.col("embedding").cast("array<double>"), F.col("vec_id"), F.sequence(F.lit(0), F.lit(10))
    # 11 objects a scene, side by side; their names' embeddings differ, a vector's own components are the noise.
    named = F.transform(eleven, lambda k: F.when(k == i % 11, 1.0).otherwise(0.0) + F.get(v, k) * 0.2)
    points = F.transform(F.slice(v, 1, 60), lambda x, k: x * 0.25 + F.when(k % 3 == 0, (i % 11) * 0.4).otherwise(0.0))
    return table(spark, d, "embeddings").select(
        F.col("label").alias("scene"), i.alias("id"), i.alias("ord"), (F.floor(i / 11) % 7).cast("string").alias("frame"), F.concat(F.lit("n"), (i % 11).cast("string")).alias("name"),
        (i % 2).alias("parent"), ((i % 10) / 10.0).alias("confidence"), named.alias("text"), named.alias("visual"), points.alias("points"),
    )


MATCHES = "id long, track long, score double"
MOVES = "source long, target long"


def _tracks(name: str, score, update, doc: str):
    def run(spark, d):
        return I.by_scene(observations(spark, d), lambda seen: [(i, t, None if s is None else round(s, 9)) for i, t, s in I.tracks(seen, score, update)[1]], MATCHES)

    run.__doc__ = doc
    return query(name)(run)


_tracks("j11_legacy_matches", I.legacy_score, I.gather, "Every observation with its track: semantics and shared surface.")
_tracks("j12_directional_matches", I.directional_score, I.gather, "The same with the larger share of surface, and one observation a frame.")
_tracks("t04_part_fusion", I.part_score, I.fuse, "Parts of one name and parent, fused frame by frame.")


@query("t02_legacy_tracks")
def legacy_tracks(spark, d):
    """What the tracks have become."""
    kernel = lambda seen: [(t.key, t.name, len(t.points), t.count, len(t.frames), round(t.confidence, 9)) for t in I.tracks(seen)[0]]
    return I.by_scene(observations(spark, d), kernel, "id long, name string, points long, observations long, frames long, confidence double")


def _moves(name: str, merge, doc: str):
    def run(spark, d):
        return I.by_scene(observations(spark, d), lambda seen: merge(I.tracks(seen, I.part_score, I.fuse)[0])[1], MOVES)

    run.__doc__ = doc
    return query(name)(run)


def frames_agree(a: I.Instance, b: I.Instance) -> I.Views:
    """Stands for measured masks, which the tables lack: observations of one frame are apart, others support each other."""
    return I.Views(a.count + b.count + 1, 0.9, len(a.frames & b.frames))


_moves("c07_instance_merge", lambda seen: I.merged(seen), "Who absorbs whom, by the legacy rules.")
_moves("c07_directional_merge", lambda seen: I.merged(seen, I.directional_merge), "Who absorbs whom, by the directional rule.")
_moves("c09_inclusion", lambda seen: I.absorbed(seen, frames_agree), "Instances inside the box of a larger one.")
_moves("c11_agglomeration", lambda seen: I.agglomerated(seen, frames_agree, least=16, large=0.1), "Strongest pair first, measured anew after each merge; the tables' objects are small.")
_moves("c13_association", lambda seen: I.associated(seen), "Groups that join one that stands.")
