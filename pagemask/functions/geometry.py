"""Rectangle algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Area of the intersection of two rectangles; 0 if they only touch."""
    w = F.least(ax1, bx1) - F.greatest(ax0, bx0)
    h = F.least(ay1, by1) - F.greatest(ay0, by0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def area(x0, y0, x1, y1) -> Column:
    return (x1 - x0) * (y1 - y0)


def coverage(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Share of rectangle a that rectangle b covers; 0 for an empty a."""
    own = area(ax0, ay0, ax1, ay1)
    return F.when(own > 0, overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) / own).otherwise(F.lit(0.0))


def rect(x0, y0, x1, y1) -> Column:
    """Struct x, y, w, h of two corners."""
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
