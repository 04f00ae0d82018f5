"""Box arithmetic on x1, y1, x2, y2 columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")]


def area(b: list[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; 0 when the union is not positive."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    shared = width * height
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def clipped(width: Column, height: Column, prefix: str = "") -> list[Column]:
    """The box cut to the image."""
    x1, y1, x2, y2 = box(prefix)
    return [F.greatest(F.lit(0.0), x1), F.greatest(F.lit(0.0), y1),
            F.least(width.cast("double"), x2), F.least(height.cast("double"), y2)]
