"""Named profiles: lists of DataFrame transforms, edited step by step from one version to the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spatial

Step = Callable[[DataFrame], DataFrame]


class Registry:
    """Replaceable steps by role; a profile is a list of roles and changes to the steps behind them."""

    def __init__(self, steps: dict[str, Step], order: list[str]):
        self.steps, self.order = dict(steps), list(order)

    def with_step(self, role: str, step: Step) -> Registry:
        if role not in self.steps:
            raise KeyError(role)
        return Registry(self.steps | {role: step}, self.order)

    def without(self, role: str) -> Registry:
        return Registry(self.steps, [r for r in self.order if r != role])

    def run(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, role: d.transform(self.steps[role]), self.order, df)


BASE = Registry(
    {
        "sample": lambda p: spatial.first_in_cell(p, 0.05, "id", ["g"]),
        "filter": lambda p: p.where(F.abs("x") < 1),
        "nodes": lambda p: spatial.bounds(p, "g"),
        "publish": lambda n: n.where("n >= 2"),
    },
    ["sample", "filter", "nodes", "publish"],
)
PROFILES = {"v1": BASE, "v2": BASE.with_step("sample", lambda p: spatial.first_in_cell(p, 0.1, "id", ["g"])), "v3": BASE.without("filter")}
