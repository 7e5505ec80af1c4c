"""Vector columns: which rows take part, and their binary form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width_of(rows: DataFrame, col: str) -> int:
    """The commonest length of the arrays, the greater of equals; vectors of another length take no part. 0 without rows."""
    sizes = rows.where(F.col(col).isNotNull()).groupBy(F.size(col).alias("n")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return int(first["n"]) if first else 0


def takes_part(col: str, width: int) -> Column:
    """Whole, of that length, finite, not zero."""
    x = F.col(col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(x) == width) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow array column whose rows all have `width` components, as doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def exact_kind(rows: DataFrame, col: str):
    """The numpy type that holds the components without loss: that of the column, if they are floats, else double."""
    return np.float32 if rows.schema[col].dataType.elementType.simpleString() == "float" else np.float64


def from_bytes(column, width: int, kind=np.float64) -> np.ndarray:
    """Doubles, from rows of components of that kind."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.float64)


def to_bytes(x: np.ndarray, kind=np.float64) -> list[bytes]:
    raw = np.ascontiguousarray(x, kind)
    step, raw = raw.itemsize * x.shape[1], raw.tobytes()
    return [raw[i : i + step] for i in range(0, len(raw), step)]
