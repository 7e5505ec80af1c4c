"""The query catalogue: importing it registers every query."""

from . import aggregates, composites, geometry, instances, joins, kernels, ranking, rules, sources  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
