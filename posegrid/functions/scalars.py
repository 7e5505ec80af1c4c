"""Column functions: geometry of boxes and frames, confidence fusion, text and id codecs.

All are built from JVM expressions, so they stay inside generated code and can be pushed into scans.
Boxes are struct columns with fields lox, loy, loz, hix, hiy, hiz. Unknown stays null: three-valued logic carries it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
EPS = 1e-12


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def product(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, columns)


def quotient(a: Column, b: Column) -> Column:
    """Of doubles, as IEEE 754 has it: infinite or NaN where b is zero, which plain division makes an error."""
    return F.when(b == 0, a * float("inf")).otherwise(a / b)


def box(lo: list, hi: list) -> Column:
    named = [F.lit(v) if isinstance(v, (int, float)) else v for v in (*lo, *hi)]
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(named, [f"lo{a}" for a in AXES] + [f"hi{a}" for a in AXES], strict=True)])


def box_volume(b: Column) -> Column:
    return product([F.greatest(b[f"hi{a}"] - b[f"lo{a}"], F.lit(0.0)) for a in AXES])


def box_intersection(a: Column, b: Column) -> Column:
    return product([F.greatest(F.least(a[f"hi{x}"], b[f"hi{x}"]) - F.greatest(a[f"lo{x}"], b[f"lo{x}"]), F.lit(0.0)) for x in AXES])


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two empty boxes."""
    inter = box_intersection(a, b)
    return inter / F.greatest(box_volume(a) + box_volume(b) - inter, F.lit(EPS))


def box_share(a: Column, b: Column) -> Column:
    """Intersection over the volume of a."""
    return box_intersection(a, b) / F.greatest(box_volume(a), F.lit(EPS))


def max_volume_overlap(a: Column, b: Column) -> Column:
    return box_intersection(a, b) / F.greatest(box_volume(a), box_volume(b), F.lit(EPS))


def box_gap(a: Column, b: Column) -> Column:
    """Length of the separating vector, 0 when the boxes meet: a cheap lower bound for any distance between them."""
    return F.sqrt(total([F.pow(F.greatest(a[f"lo{x}"] - b[f"hi{x}"], b[f"lo{x}"] - a[f"hi{x}"], F.lit(0.0)), 2) for x in AXES]))


def inside(b: Column, x: Column, y: Column, z: Column, slack: float = 0.0) -> Column:
    return reduce(lambda p, q: p & q, [(v >= b[f"lo{a}"] - slack) & (v <= b[f"hi{a}"] + slack) for a, v in zip(AXES, (x, y, z), strict=True)])


def rect_iou(a: tuple, b: tuple) -> Column:
    """Of image boxes (left, top, right, bottom)."""
    area = lambda r: F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))
    inter = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(EPS))


def distance(a: list, b: list) -> Column:
    return F.sqrt(total([(p - q) * (p - q) for p, q in zip(a, b, strict=True)]))


def cylinder_half(radius: Column, height: Column, axis: Column) -> Column:
    """Half extent of a cylinder along a world axis whose cosine with the cylinder's axis is `axis`."""
    return radius * F.sqrt(F.greatest(1 - axis * axis, F.lit(0.0))) + height / 2 * F.abs(axis)


def rotated_half(row: list, size: list) -> Column:
    """Half extent of a turned box along one axis: the absolute row of its rotation times its half sizes."""
    return total([F.abs(r) * s / 2 for r, s in zip(row, size, strict=True)])


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation of a unit quaternion."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def matrix_quaternion(m: list[list[Column]]) -> Column:
    """(w, x, y, z) of a rotation, through its largest component, which keeps every divisor away from zero."""
    trace = m[0][0] + m[1][1] + m[2][2]
    part = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) / 2
    w, x = part(1 + trace), part(1 + m[0][0] - m[1][1] - m[2][2])
    y, z = part(1 - m[0][0] + m[1][1] - m[2][2]), part(1 - m[0][0] - m[1][1] + m[2][2])
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    d, e, f = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    q = lambda *v: F.struct(*[c_.alias(n) for n, c_ in zip("wxyz", v, strict=True)])
    most = F.greatest(w, x, y, z)
    return (
        F.when(w == most, q(w, a / (4 * w), b / (4 * w), c / (4 * w)))
        .when(x == most, q(a / (4 * x), x, d / (4 * x), e / (4 * x)))
        .when(y == most, q(b / (4 * y), d / (4 * y), y, f / (4 * y)))
        .otherwise(q(c / (4 * z), e / (4 * z), f / (4 * z), z))
    )


def transformed(pose: list, p: list) -> list[Column]:
    """Row-major 4 x 4 pose (first twelve entries are used) times a point."""
    return [pose[4 * i] * p[0] + pose[4 * i + 1] * p[1] + pose[4 * i + 2] * p[2] + pose[4 * i + 3] for i in range(3)]


def unprojected(u: Column, v: Column, depth: Column, scale: float, camera: dict) -> list[Column]:
    """Camera coordinates of a depth pixel."""
    z = depth / F.lit(float(scale))
    return [(u - camera["cx"]) * z / camera["fx"], (v - camera["cy"]) * z / camera["fy"], z]


def projected(p: list, camera: dict) -> list[Column]:
    """Pixel (u, v) of camera coordinates, and their depth; null behind the camera."""
    ahead = F.when(p[2] > 0, p[2])
    return [camera["fx"] * p[0] / ahead + camera["cx"], camera["fy"] * p[1] / ahead + camera["cy"], p[2]]


def visibility_weight(z: Column, d: Column, base: float = 0.025, slope: float = 0.01) -> Column:
    """Soft agreement of a point's depth with the measured one; null where nothing was measured."""
    return F.when(d > 0, F.greatest(F.lit(0.0), 1 - F.abs(z - d) / (base + slope * d)))


def sampling_resolution(extent: Column) -> Column:
    """Small objects are sampled finely, others at a centimetre."""
    return F.when(extent < 0.25, F.least(F.greatest(extent / 80, F.lit(0.002)), F.lit(0.005))).otherwise(F.lit(0.01))


def association_radius(extent: Column) -> Column:
    return F.when(extent < 0.25, F.least(F.greatest(0.08 * extent, F.lit(0.006)), F.lit(0.02))).otherwise(F.lit(0.1))


def logit_fusion(score: Column, margin: Column, weight: float) -> Column:
    p = F.least(F.greatest(score, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(weight * F.log(p / (1 - p)) + (1 - weight) * margin)))


def count_error(found: Column, truth: Column) -> Column:
    """|log(found / truth)|; null, never infinite, where it is undefined."""
    return F.when((found > 0) & (truth > 0), F.abs(F.log(found / truth)))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("bigint")


VOXEL_BITS, VOXEL_OFFSET = 21, 1 << 20


def voxel_key(cells: list[Column]) -> Column:
    """Three cells of 21 bits, offset by 2**20, in one long; an error outside the range."""
    fits = reduce(lambda p, q: p & q, [(c >= -VOXEL_OFFSET) & (c < VOXEL_OFFSET) for c in cells])
    x, y, z = [c.cast("bigint") + VOXEL_OFFSET for c in cells]
    packed = F.shiftleft(x, 2 * VOXEL_BITS).bitwiseOR(F.shiftleft(y, VOXEL_BITS)).bitwiseOR(z)
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("voxel outside the packed range")).cast("bigint"))


def voxel_cells(key: Column) -> list[Column]:
    mask = F.lit((1 << VOXEL_BITS) - 1)
    return [F.shiftright(key, s).bitwiseAND(mask) - VOXEL_OFFSET for s in (2 * VOXEL_BITS, VOXEL_BITS, 0)]


def id_colour(i: Column) -> list[Column]:
    """Base-255 colour of an id."""
    return [(i % 255).cast("int"), (F.floor(i / 255) % 255).cast("int"), (F.floor(i / 65025) % 255).cast("int")]


def colour_id(r: Column, g: Column, b: Column) -> Column:
    return (F.rint(r) + 255 * F.rint(g) + 65025 * F.rint(b)).cast("bigint")


def mask_bit(byte: Column, u: Column) -> Column:
    """Bit of pixel u in its byte, the leftmost pixel highest."""
    return (F.floor(byte / F.pow(F.lit(2), 7 - u % 8)) % 2).cast("int")


def normal_name(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(s, "_", " ")), r"\s+", " "))


def tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_name(s), "[^a-z0-9]+"), lambda t: t != ""))


def strict_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(b) > F.size(a))


def without_fence(s: Column) -> Column:
    """A reply without its byte-order mark and one complete code fence."""
    bare = F.trim(F.regexp_replace(s, "^﻿", ""))
    inner = F.regexp_extract(bare, r"(?s)^```(?:json)?\s*\n(.*)\n```$", 1)
    return F.when(inner != "", inner).otherwise(bare)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Of two array columns; null for arrays of different width, 0 for empty or zero ones."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot / F.greatest(norm(a) * norm(b), F.lit(eps)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Unit vector; an error for a zero or non-finite one."""
    n = norm(a)
    ok = (n > 0) & (n < float("inf"))
    return F.when(ok, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.raise_error(F.lit("vector without direction")).cast("array<double>"))
