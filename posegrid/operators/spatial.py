"""Spatial joins as grid equi-joins, and voxel aggregations.

A distance predicate alone plans as a nested loop over all pairs. Here the smaller radius of interest becomes a grid: one
side is copied into its 27 neighbouring cells, the join is on (scene, cell), and the exact distance follows. Crowded
cells are split by adaptive skew handling, since both sides enter the join through plain exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AXES, cell, distance
from . import graphs


def with_cells(points: DataFrame, size: float, prefix: str = "c") -> DataFrame:
    return points.withColumns({f"{prefix}{a}": cell(F.col(a), size) for a in AXES})


def neighbours(prefix: str = "c") -> Column:
    """The 27 cells around a row's own."""
    steps = F.array(*[F.lit(v) for v in (-1, 0, 1)])
    return F.flatten(
        F.transform(steps, lambda dx: F.flatten(F.transform(steps, lambda dy: F.transform(steps, lambda dz: F.struct((F.col(f"{prefix}x") + dx).alias("cx"), (F.col(f"{prefix}y") + dy).alias("cy"), (F.col(f"{prefix}z") + dz).alias("cz"))))))
    )


def range_join(left: DataFrame, right: DataFrame, radius: float, keys: list[str] = (), inclusive: bool = True) -> DataFrame:
    """Pairs within the radius. Both sides have x, y, z and the keys; other columns must differ. Adds `dist`; the right
    side's coordinates become rx, ry, rz."""
    around = with_cells(left, radius).withColumn("near", F.explode(neighbours())).drop("cx", "cy", "cz").select("*", "near.*").drop("near")
    home = with_cells(right, radius).withColumnsRenamed({a: f"r{a}" for a in AXES})
    pairs = around.join(home, [*keys, "cx", "cy", "cz"]).drop("cx", "cy", "cz")
    pairs = pairs.withColumn("dist", distance([F.col(a) for a in AXES], [F.col(f"r{a}") for a in AXES]))
    return pairs.where(F.col("dist") <= radius if inclusive else F.col("dist") < radius)


def near_pairs(nodes: DataFrame, threshold: float, id_col: str, keys: list[str] = (), least: float | None = None) -> DataFrame:
    """Pairs a < b of one table closer than the threshold (and farther apart than `least`): keys, a, b, distance."""
    a = nodes.select(*keys, F.col(id_col).alias("a"), *AXES)
    b = nodes.select(*keys, F.col(id_col).alias("b"), *AXES)
    pairs = range_join(a, b, threshold, keys, inclusive=False).where("a < b")
    if least is not None:
        pairs = pairs.where(F.col("dist") > least)
    direction = F.array(*[(F.col(f"r{x}") - F.col(x)) / F.col("dist") for x in AXES])
    return pairs.select(*keys, "a", "b", F.col("dist").alias("distance"), direction.alias("direction"))


def nearest(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, keys: list[str] = ()) -> DataFrame:
    """Nearest right row of each left row within the radius, nulls where none is; ties go to the smaller id."""
    pairs = range_join(left.select(*keys, left_id, *AXES), right.select(*keys, right_id, *AXES), radius, keys)
    best = pairs.groupBy(left_id).agg(F.min(F.struct("dist", right_id)).alias("m")).select(left_id, F.col("m.dist").alias("dist"), F.col(f"m.{right_id}").alias(right_id))
    return left.select(*keys, left_id).join(best, left_id, "left")


def nearest_any(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Nearest right row of each left row at any distance (left_id, dist, right_id); ties go to the smaller id, no right row: no rows.

    Grid joins whose radius doubles: a hit within the radius is exact, so only rows without one go on to the next round, and those
    lie far from everything. The first radius expects about one right row in a cell, if those are spread evenly. Rows with non-finite coordinates take no part.
    """
    finite = lambda df: df.where(" AND ".join(f"abs({a}) < double('inf')" for a in AXES))
    rest, targets = finite(left.select(left_id, *AXES)), finite(right.select(right_id, *AXES))
    ends = [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    t, r = targets.agg(F.count("*").alias("n"), *ends).first(), rest.agg(*ends).first()
    if not t["n"] or r["lox"] is None:
        return rest.select(left_id, F.lit(None).cast("double").alias("dist")).join(targets.select(right_id).limit(0), F.lit(True))
    widths = [t[f"hi{a}"] - t[f"lo{a}"] for a in AXES]
    reach = sum((max(t[f"hi{a}"], r[f"hi{a}"]) - min(t[f"lo{a}"], r[f"lo{a}"])) ** 2 for a in AXES) ** 0.5
    radius, done = max(max(widths) / t["n"] ** (1 / 3) or reach, reach / 2**20, 1e-12), None
    while True:
        hits = graphs.settled(nearest(rest, targets, radius, left_id, right_id))
        found = hits.where(F.col("dist").isNotNull())
        done = found if done is None else done.unionByName(found)
        if radius > reach or hits.where("dist IS NULL").isEmpty():
            return done.select(left_id, "dist", right_id)
        rest = rest.join(hits.where("dist IS NULL").select(left_id), left_id, "left_semi")
        radius *= 2


def covered(left: DataFrame, right: DataFrame, radius: float, left_id: str, keys: list[str] = ()) -> DataFrame:
    """left_id of the rows that have a right row within the radius, once each."""
    return range_join(left.select(*keys, left_id, *AXES), right.select(*keys, *AXES), radius, keys).select(left_id).distinct()


def reached(left: DataFrame, right: DataFrame, radius: float, ids: list[str], keys: list[str] = ()) -> DataFrame:
    """ids of the left rows that have a right row of their keys within the radius, once each, without meeting every such row.

    Cells of half the radius are narrower than it, so a right row in a left row's own cell is near: a join on occupied cells settles
    crowds. Only the rest meets points, copies of which count once."""
    names = list(dict.fromkeys([*ids, *keys]))
    rows, r = with_cells(left.select(*names, *AXES), radius / 2), right.select(*keys, *AXES).distinct()
    full = with_cells(r, radius / 2).select(*keys, "cx", "cy", "cz").distinct()
    sure = rows.join(full, [*keys, "cx", "cy", "cz"], "left_semi").select(*ids).distinct()
    rest = left.select(*names, *AXES).join(sure, list(ids), "left_anti")
    return sure.unionByName(range_join(rest, r, radius, keys).select(*ids)).distinct()


def coverage(points: DataFrame, group: str, id_col: str, radius: float, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of groups: shares of a's points near b, of b's near a, and their harmonic mean."""
    p = points.select(group, id_col, *AXES)
    wanted = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    hits = range_join(p.withColumnRenamed(group, "a").withColumnRenamed(id_col, "p"), p.withColumnRenamed(group, "b").withColumnRenamed(id_col, "q"), radius)
    near = hits.join(wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("p").alias("near"))
    sizes = p.groupBy(F.col(group).alias("a")).agg(F.count("*").alias("size"))
    share = wanted.join(near, ["a", "b"], "left").join(sizes, "a").select("a", "b", (F.coalesce("near", F.lit(0)) / F.col("size")).alias("share"))
    back = share.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("share").alias("back"))
    both = pairs.select("a", "b").join(share, ["a", "b"]).join(back, ["a", "b"])
    return both.withColumn("symmetric", F.when(F.col("share") + F.col("back") > 0, 2 * F.col("share") * F.col("back") / (F.col("share") + F.col("back"))).otherwise(F.lit(0.0)))


def residual(left: DataFrame, right: DataFrame, radius: float, left_id: str, keys: list[str] = ()) -> DataFrame:
    """Rows of left that no right row is near."""
    return left.join(covered(left, right, radius, left_id, keys), left_id, "left_anti")


def voxel_centroids(points: DataFrame, size: float, keys: list[str] = ()) -> DataFrame:
    """Mean point and count of each occupied cell; non-finite rows are dropped."""
    finite = [~F.isnan(a) & (F.abs(a) != float("inf")) for a in AXES]
    rows = points.where(finite[0] & finite[1] & finite[2])
    return with_cells(rows, size).groupBy(*keys, "cx", "cy", "cz").agg(*[F.avg(a).alias(a) for a in AXES], F.count("*").alias("n"))


def first_in_cell(points: DataFrame, size: float, id_col: str, keys: list[str] = ()) -> DataFrame:
    """The row of least id in each cell, with its own coordinates."""
    return with_cells(points, size).groupBy(*keys, "cx", "cy", "cz").agg(F.min_by(F.struct(id_col, *AXES), id_col).alias("r")).select(*keys, "cx", "cy", "cz", "r.*")


def bounds(points: DataFrame, group: str) -> DataFrame:
    return points.groupBy(group).agg(*[f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES], F.count("*").alias("n"))


def strided(points: DataFrame, group: list[str], order: str, most: int) -> DataFrame:
    """Every (n div most)-th row of each group, in order."""
    w = Window.partitionBy(*group)
    place = F.row_number().over(w.orderBy(order)) - 1
    return points.withColumn("__i", place).withColumn("__n", F.count("*").over(w)).where("__i % greatest(1, __n div {0}) = 0".format(most)).drop("__i", "__n")


def supported_trim(points: DataFrame, group: str, ratio: float = 0.4, least: int = 3, beyond: float = 0.01, most: float = 0.3) -> DataFrame:
    """points with `removed`: votes (positive, negative) speak against the point and it lies `distance` off the measured ones;
    none of a group is removed where that would be more than the share `most`. Points without votes stay."""
    share = F.col("positive") / F.greatest(F.col("positive") + F.col("negative"), F.lit(1.0))
    out = F.coalesce((share < ratio) & (F.col("negative") >= least) & (F.col("distance") > beyond), F.lit(False))
    marked = points.withColumn("removed", out)
    all_ = marked.groupBy(F.col(group).alias("__group")).agg(F.avg(F.col("removed").cast("int")).alias("__share"))
    joined = marked.join(all_, F.col(group).eqNullSafe(F.col("__group")), "left")
    return joined.withColumn("removed", F.col("removed") & (F.col("__share") <= most)).drop("__group", "__share")
