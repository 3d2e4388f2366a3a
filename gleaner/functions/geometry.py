"""Boxes as column expressions.  Corner form has x0, y0, x1, y1; percent form has x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap_area(a, b) -> Column:
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def intersection(a, b) -> Column:
    """The common box as a struct, null if the boxes only touch or don't meet."""
    box = [F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])]
    return F.when((box[2] > box[0]) & (box[3] > box[1]), F.struct(*(v.alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1")))))


def iou(a, b) -> Column:
    both = overlap_area(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(F.lit(0.0))


def intersection_ratio(a, b) -> Column:
    """Share of box a inside box b; 0 for a box without area."""
    return F.when(area(a) > 0, overlap_area(a, b) / area(a)).otherwise(F.lit(0.0))


def mostly_inside(a, b, threshold: float = 0.5) -> Column:
    return intersection_ratio(a, b) > threshold


def from_xywh(x: Column, y: Column, w: Column, h: Column):
    return x, y, x + w, y + h


def to_percent(b, page_w: Column, page_h: Column):
    """Percent form of a box in points; y isn't flipped.  Pages without a size raise an error."""
    ok = (page_w > 0) & (page_h > 0)
    w, h = (F.when(ok, v).otherwise(F.raise_error(F.lit("page dimensions must be positive")).cast("double")) for v in (page_w, page_h))
    return b[0] / w * 100, b[1] / h * 100, (b[2] - b[0]) / w * 100, (b[3] - b[1]) / h * 100


def flip_y(b, page_h: Column):
    return b[0], page_h - b[3], b[2], page_h - b[1]


def page_size_class(w: Column, h: Column, slack: float = 10) -> Column:
    near = lambda a, b: (F.abs(w - a) < slack) & (F.abs(h - b) < slack)
    out = F.when(near(595, 842), "A4 Portrait").when(near(842, 595), "A4 Landscape").when(near(612, 792), "Letter Portrait").when(near(792, 612), "Letter Landscape")
    return out.otherwise(F.concat(F.lit("Other ("), F.bround(w).cast("long").cast("string"), F.lit("x"), F.bround(h).cast("long").cast("string"), F.lit(")")))


def valid_table_size(b, page_w: Column, page_h: Column, rows: Column, cols: Column) -> Column:
    share = area(b) / (page_w * page_h)
    return (rows >= 3) & (cols >= 2) & share.between(0.05, 0.95)
