"""Frame geometry over Columns: bounds, affine transforms, bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _numbers(c: Column) -> Column:
    return F.transform(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x.cast("double"))


def transform_of(c: Column) -> Column:
    """The six numbers of an item transform; the identity if there are not six."""
    n = _numbers(c)
    return F.when(F.size(n) == 6, n).otherwise(F.array(*[F.lit(v) for v in _IDENTITY]))


def bounds_of(c: Column) -> Column:
    """``y1 x1 y2 x2`` as struct(x1, y1, x2, y2); zeros if absent."""
    n = _numbers(c)
    pick = lambda i: F.when(F.size(n) == 4, n[i]).otherwise(F.lit(0.0))
    return F.struct(pick(1).alias("x1"), pick(0).alias("y1"), pick(3).alias("x2"), pick(2).alias("y2"))


def bounding_box(bounds: Column, transform: Column) -> Column:
    """struct(x, y, width, height) of the box around the four transformed corners."""
    b, t = bounds_of(bounds), transform_of(transform)
    corners = [(b[x], b[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs = [t[0] * x + t[2] * y + t[4] for x, y in corners]
    ys = [t[1] * x + t[3] * y + t[5] for x, y in corners]
    x, y = F.least(*xs), F.least(*ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(*xs) - x).alias("width"), (F.greatest(*ys) - y).alias("height"))
