"""Boxes on a page as arithmetic expressions; a box is an array (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The page of the corpus, in points.
WIDTH, HEIGHT = 600.0, 800.0


def side(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def bounded(box: Column, width: float = WIDTH, height: float = HEIGHT) -> Column:
    """Corners inside the page and in order; a box of another arity is the whole page."""
    def at(i: int, most: float) -> Column:
        v = F.nanvl(side(box, i), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.when(F.abs(v) == float("inf"), 0.0).otherwise(v), F.lit(most)))

    x0, y0, x1, y1 = at(0, width), at(1, height), at(2, width), at(3, height)
    inside = F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
    return F.when(F.size(box) == 4, inside).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(width), F.lit(height)))


def relative(box: Column, width: float = WIDTH, height: float = HEIGHT, pad: float = 1.5) -> Column:
    """A padded box in fractions of the page: x, y, width, height."""
    x0, y0 = F.greatest(F.lit(0.0), side(box, 0) - pad), F.greatest(F.lit(0.0), side(box, 1) - pad)
    x1, y1 = F.least(F.lit(width), side(box, 2) + pad), F.least(F.lit(height), side(box, 3) + pad)
    part = lambda v, whole: F.bround(v / whole, 6)
    return F.struct(
        part(x0, width).alias("x"), part(y0, height).alias("y"),
        part(F.greatest(F.lit(1.0), x1 - x0), width).alias("width"), part(F.greatest(F.lit(1.0), y1 - y0), height).alias("height"),
    )


def absolute(x: Column, y: Column, w: Column, h: Column, width: float = WIDTH, height: float = HEIGHT) -> Column:
    """A relative box in points; null where it is narrower than 4 % or lower than 1.5 % of the page."""
    clip = lambda v, low: F.least(F.lit(1.0), F.greatest(low, v))
    left, top = clip(x, F.lit(0.0)), clip(y, F.lit(0.0))
    right, bottom = clip(left + w, left), clip(top + h, top)
    box = F.array(left * width, top * height, right * width, bottom * height)
    return F.when((right - left >= 0.04) & (bottom - top >= 0.015), box)


def horizontal_overlap(a: Column, b: Column) -> Column:
    both = F.greatest(F.lit(0.0), F.least(side(a, 2), side(b, 2)) - F.greatest(side(a, 0), side(b, 0)))
    return both / F.greatest(F.lit(1.0), F.least(side(a, 2) - side(a, 0), side(b, 2) - side(b, 0)))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), side(box, 2) - side(box, 0)) * F.greatest(F.lit(0.0), side(box, 3) - side(box, 1))


def overlap_share(a: Column, b: Column) -> Column:
    """The intersection as a share of the first box."""
    w = F.greatest(F.lit(0.0), F.least(side(a, 2), side(b, 2)) - F.greatest(side(a, 0), side(b, 0)))
    h = F.greatest(F.lit(0.0), F.least(side(a, 3), side(b, 3)) - F.greatest(side(a, 1), side(b, 1)))
    return w * h / F.greatest(F.lit(1.0), area(a))


def centre_inside(inner: Column, outer: Column) -> Column:
    x, y = (side(inner, 0) + side(inner, 2)) / 2, (side(inner, 1) + side(inner, 3)) / 2
    return x.between(side(outer, 0), side(outer, 2)) & y.between(side(outer, 1), side(outer, 3))


def margin_text(box: Column, text: Column, width: float = WIDTH, height: float = HEIGHT) -> Column:
    """Side bars, running heads and feet, and preprint stamps along the left edge."""
    w, h = side(box, 2) - side(box, 0), side(box, 3) - side(box, 1)
    sidebar = ((side(box, 2) < width * 0.10) | (side(box, 0) > width * 0.90)) & (h > w * 2)
    band = (side(box, 3) < height * 0.055) | (side(box, 1) > height * 0.93)
    stamp = text.rlike(r"(?i)arXiv:\s*[0-9]{4}\.[0-9]+") & (side(box, 2) < width * 0.14)
    return sidebar | band | stamp
