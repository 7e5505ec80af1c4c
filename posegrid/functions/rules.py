"""Acceptance rules as column expressions over measured evidence.

Unknown evidence is null and makes a rule null: it neither accepts nor rejects. `e` maps a name of evidence to its column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Evidence = Callable[[str], Column]


def every(*rules: Column) -> Column:
    return reduce(lambda a, b: a & b, rules)


def any_of(*rules: Column) -> Column:
    return reduce(lambda a, b: a | b, rules)


def at_least(e: Evidence, **limits: float) -> Column:
    return every(*[e(k) >= v for k, v in limits.items()])


# The thresholds below decide which results are accepted and must stay as they are.


def contained_duplicate(e: Evidence) -> Column:
    return at_least(e, inclusion=0.95, cover=0.99, support=3, consensus=0.5) & (e("separation") == 0)


def granularity(e: Evidence) -> Column:
    """`duplicate` shares the owner's surface; `transfer` moves a detached region to its only owner."""
    duplicate = at_least(e, inclusion=0.95, cover=0.8, semantic=0.6, whole=5, consensus=0.5) & (e("separation") == 0)
    transfer = at_least(e, gap=0.03, inclusion=0.95, cover=0.65, semantic=0.6, joint=8, owner=0.7, baseline=0.08) & (e("support") <= 0.25 * e("joint"))
    return F.when(duplicate, "duplicate").when(transfer, "transfer").otherwise("none")


def background_rejection(e: Evidence) -> Column:
    return at_least(e, views=5, supported=0.5) & (e("background") > 0.5) & (e("extent") > 3)


def planar_rejection(e: Evidence) -> Column:
    """Only a level and flat surface is judged at all."""
    return at_least(e, level=0.95, flat=0.9, views=5, supported=0.5) & (e("background") > 0.8)


def confirmed_existence(e: Evidence) -> Column:
    return (e("mixed") <= 0.1) & at_least(e, support=5, supported=0.65, baseline=0.08)


def confirmed_core(e: Evidence) -> Column:
    """A stable core may stand for the whole: its two longest sides must keep most of their length."""
    sides = F.array_sort(F.array(*[e(f"keep{k}") for k in range(3)]))
    return (e("mixed") <= 0.1) & at_least(e, support=5, baseline=0.08, core=128) & (e("core") >= 0.3 * e("points")) & (sides[2] >= 0.8) & (sides[1] >= 0.6)


def hierarchy(e: Evidence) -> Column:
    return at_least(e, whole=5, consensus=0.65, baseline=0.1)


def native_merge(e: Evidence) -> Column:
    return at_least(e, extent=0.5, semantic=0.8, whole=3, consensus=0.6) & (e("gap") <= 0.03) & (e("separation") == 0)


def whole_object(e: Evidence) -> Column:
    """Role of a merge, or null; visible evidence is needed, invisibility never votes against."""
    free = e("separation") == 0
    shared = at_least(e, iou=0.9, cover=0.8, semantic=0.6, whole=5, consensus=0.5) & free
    complement = e("visual") & at_least(e, iou=0.6, whole=3, consensus=0.8) & (e("gap") <= 0.04) & free
    terminal = e("visual") & e("aligned") & at_least(e, whole=1, joint=2, consensus=0.5) & (e("gap") <= 0.05) & (e("separation") <= 1)
    return F.when(shared, "shared_measured_surface").when(complement, "complementary_measured_body").when(terminal, "aligned_measured_terminal_face")


def contradicted(e: Evidence) -> Column:
    return at_least(e, views=5, visible=0.6, against=0.8) & (e("own") < 0.05) & (e("weighted") < 0.2)


def rejection_reasons(e: Evidence) -> Column:
    """All reasons that apply; semantic ones only where the geometry isn't reliable."""
    reliable = e("supported") >= 0.6
    rules = {
        "mixed": (e("joint") >= 3) & (e("mixed") > 0.2),
        "undetected": (e("views") >= 5) & (e("detected") < 0.2),
        "below class mean": (e("margin") < 0) & ~reliable,
        "no contrast": (e("margin") < 0.02) & ~reliable,
        "background": background_rejection(e),
    }
    return F.array_join(F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()])), ", ")


def compact(e: Evidence) -> Column:
    """Why a candidate isn't a compact consensus, or `accepted`."""
    weak = any_of(e("points") < 64, e("baseline") < 0.1, e("confidence") < 0.75, e("features") < 3)
    return F.when(e("views") < 4, "too few frames").when(weak, "weak surface").when(e("extent") > 0.65, "too large").otherwise("accepted")


def proposal(e: Evidence) -> Column:
    """More frames may be of lower quality."""
    quality = F.when(e("views") >= 6, 0.55).otherwise(0.75)
    return at_least(e, views=4, features=3, baseline=0.15, points=64) & (e("confidence") >= quality) & (e("extent") <= 3)


def admissible_pair(e: Evidence) -> Column:
    """Score of two groups that may be one, else 0."""
    low, high = F.least(e("cover"), e("inclusion")), F.greatest(e("cover"), e("inclusion"))
    return F.when((e("gap") <= 0.006) & (e("same") | (e("semantic") >= 0.8)) & (e("separation") == 0) & (low >= 0.15) & (high >= 0.85), low).otherwise(0.0)


def related_surface(e: Evidence) -> Column:
    """A related name doesn't make an owned surface a new object."""
    return at_least(e, semantic=0.5, cover=0.8)


def admission(e: Evidence) -> Column:
    """Branch by which a group is admitted, or null: two views must be better than many."""
    two = (e("views") == 2) & at_least(e, confidence=0.75, best=0.9)
    many = at_least(e, views=3, features=2, confidence=0.65, best=0.8)
    seen = at_least(e, baseline=0.15, features=1)
    return F.when(seen & two, "strict_two_view").when(seen & many, "multiview")


def existence_rejection(e: Evidence) -> Column:
    eligible = every(e("linear") < 0.02, e("margin") < -0.02, e("views") >= 5, e("visible") >= 0.8, e("own") < 0.05, e("background") >= 0.9, e("weighted") < 0.35)
    return eligible & at_least(e, joint=5, baseline=0.15)


def isolated_fragment(e: Evidence) -> Column:
    return (e("views") >= 2) & (e("joint") < 3) & (e("views") / F.greatest(e("views") + e("joint"), F.lit(1.0)) >= 0.6) & (e("baseline") >= 0.15)


def witnessed(e: Evidence) -> Column:
    """A weak proposal (`best`: its strongest mask) on a free surface (`own`: the share that others own) that `support` frames tell
    apart from others of its kind, `features` frames show, and whose mask has 128 pixels or more in `areas` frames."""
    weak = (e("best") < 0.7) & (e("own") < 0.25) & (e("extent") <= 0.65)
    return weak & at_least(e, support=2, features=2, baseline=0.15, confidence=0.5, areas=2, points=64)


def support_surface(e: Evidence) -> Column:
    return at_least(e, views=3, cover=0.7, purity=0.6)


def planar(e: Evidence) -> Column:
    return at_least(e, points=4096, flat=0.8, extent=0.5)


def dense_recovery(e: Evidence) -> Column:
    """A broad level surface (`narrow`, `wide`: its horizontal extents) to which views add enough samples off the old ones."""
    return at_least(e, points=1024, narrow=0.2, wide=0.8, level=0.995, flat=0.55, added=256)


def part_acceptance(e: Evidence) -> Column:
    """Words alone, words with a compositional name, or weak words that many views confirm."""
    viewed = at_least(e, semantic=0.4, whole=3, consensus=0.6) & (e("separation") == 0)
    return (e("semantic") >= 0.8) | (e("compositional") & (e("semantic") >= 0.65)) | viewed


def anchored_part(e: Evidence) -> Column:
    """`purity` of the inspected frames show the part in its parent; `mixed` is its volume against the body's."""
    return at_least(e, support=5, purity=0.5, joint=3, points=32, body=32, inclusion=0.98) & (e("mixed") <= 0.5) & (e("gap") <= 0.015)


def coobserved(e: Evidence) -> Column:
    """One frame that shows both objects, each mostly under its own mask."""
    return at_least(e, points=16, body=16, cover=0.6, visible=0.6)


def enclosure_seam(e: Evidence) -> Column:
    """Two closed bodies meet in a corner: upright faces at a right angle and contact along nearly the whole height."""
    measured = at_least(e, points=512, semantic=0.85, views=3, height=0.5, face=0.4, contact=64, cells=128, seam=0.8, continuity=0.8)
    return measured & (e("points") < e("body")) & (e("mismatch") <= 0.04) & (e("tilt") <= 0.08) & (e("dot") <= 0.15)


def rear_boundary(e: Evidence) -> Column:
    """A detached face has an observed parallel rear at a depth that its kind allows (`visual`: a support, else storage)."""
    deep = F.when(e("visual"), (e("depth") > 0.04) & (e("depth") < 0.22)).otherwise((e("depth") > 0.12) & (e("depth") < 0.8))
    return at_least(e, core=256, parallel=0.995) & deep


def completion(e: Evidence) -> Column:
    """Why a completed shape is refused, or 'accepted'."""
    unfit = (e("cover") < 0.8) | ~e("complete").between(0.1, 0.85) | (e("growth") > 3)
    return F.when(unfit, "incompatible").when(e("conflict") > 0.05, "other owner").when(e("free") > 0.03, "free space").when(e("added") < 32, "too few").otherwise("accepted")


def open_layers(e: Evidence) -> Column:
    return (e("layers") >= 3) & (e("closed") <= 0.6) & e("kept").between(0.25, 0.95)


def dense_crossbar(e: Evidence) -> Column:
    return at_least(e, views=3, added=64)


def thin_recovery(e: Evidence) -> Column:
    """Only one accepted instance of its kind, and far more verified new surface than it had."""
    return (e("cohort") == 1) & (e("views") >= 12) & (e("added") >= F.greatest(F.lit(128), 3 * e("points")))


def fixture_part(e: Evidence) -> Column:
    """`purity`: the share of inspected frames that show the part in its parent; `same`: the name begins with the parent's."""
    return e("same") & at_least(e, views=3, support=3, purity=0.5)


def evidence_rank(e: Evidence) -> Column:
    return e("confidence") * F.sqrt(e("cover"))


RULES = {
    "p01_contained_duplicate": contained_duplicate, "p02_granularity": granularity, "p03_background_rejection": background_rejection, "p04_planar_rejection": planar_rejection,
    "p05_confirmed_existence": confirmed_existence, "p05_confirmed_core": confirmed_core, "p06_hierarchy": hierarchy, "p07_native_merge": native_merge, "p08_whole_object": whole_object,
    "p09_contradicted": contradicted, "p10_rejection_reasons": rejection_reasons, "p11_compact": compact, "p12_proposal": proposal, "p12_admissible_pair": admissible_pair, "p12_related_surface": related_surface, "p13_admission": admission,
    "p15_existence_rejection": existence_rejection, "p16_isolated_fragment": isolated_fragment, "p17_witnessed": witnessed, "p24_support_surface": support_surface,
    "p18_part_acceptance": part_acceptance, "p18_anchored_part": anchored_part, "p19_coobserved": coobserved, "p20_enclosure_seam": enclosure_seam, "p22_rear_boundary": rear_boundary, "p23_completion": completion,
    "p25_open_layers": open_layers, "p28_dense_crossbar": dense_crossbar, "p29_thin_recovery": thin_recovery, "p30_fixture_part": fixture_part,
    "p26_planar": planar, "p27_dense_recovery": dense_recovery,
}
