"""Boxes as columns. A box is four columns x1, y1, x2, y2 with an optional suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(a: str, n: str) -> Column:
    return F.col(n + a)


def area(a: str = "") -> Column:
    return (_c(a, "x2") - _c(a, "x1")) * (_c(a, "y2") - _c(a, "y1"))


def inter(a: str, b: str) -> Column:
    w = F.least(_c(a, "x2"), _c(b, "x2")) - F.greatest(_c(a, "x1"), _c(b, "x1"))
    h = F.least(_c(a, "y2"), _c(b, "y2")) - F.greatest(_c(a, "y1"), _c(b, "y1"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 without overlap or with an empty union."""
    i = inter(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def iou_integer(a: str, b: str) -> Column:
    """The variant with a union of at least 1, which differs for tiny boxes."""
    i = inter(a, b)
    return i / F.greatest(F.lit(1.0), area(a) + area(b) - i)


def iou_1d(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    i = F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))
    u = F.greatest(a2, b2) - F.least(a1, b1)
    return F.when(u > 0, i / u).otherwise(0.0)


def clip(w: Column, h: Column) -> list[Column]:
    """A box kept on its page, at least a pixel wide at the far edges."""
    lim = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), hi)
    return [lim(F.col("x1"), 0.0, w - 1).alias("x1"), lim(F.col("y1"), 0.0, h - 1).alias("y1"), lim(F.col("x2"), 1.0, w).alias("x2"), lim(F.col("y2"), 1.0, h).alias("y2")]


def from_centre(cx: Column, cy: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> list[Column]:
    """Normalised centre and size to pixel corners."""
    return [((cx - w / 2) * page_w).alias("x1"), ((cy - h / 2) * page_h).alias("y1"), ((cx + w / 2) * page_w).alias("x2"), ((cy + h / 2) * page_h).alias("y2")]


def to_centre(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Pixel corner and size to a normalised centre box; null without a size or with the centre off the page; sizes at most 1."""
    cx, cy = (x + w / 2) / page_w, (y + h / 2) / page_h
    ok = (w > 0) & (h > 0) & (page_w > 0) & (page_h > 0) & cx.between(0, 1) & cy.between(0, 1)
    return F.when(ok, F.struct(cx.alias("cx"), cy.alias("cy"), F.least(F.lit(1.0), w / page_w).alias("w"), F.least(F.lit(1.0), h / page_h).alias("h")))


def rotate_quadrant(turns: int, w: Column, h: Column) -> list[Column]:
    """A box on its page turned by quarters counter-clockwise."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    a, b, c, d = [(x1, y1, x2, y2), (y1, w - x2, y2, w - x1), (w - x2, h - y2, w - x1, h - y1), (h - y2, x1, h - y1, x2)][turns % 4]
    return [a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")]


def width32(w: Column, h: Column) -> Column:
    """Width at height 32, half to even, at least 8; null with a missing or empty size."""
    return F.when((w > 0) & (h > 0), F.greatest(F.lit(8), F.bround(w * F.lit(32.0) / h).cast("int")))


def ctc_length(w: Column) -> Column:
    """Time steps a width leaves after two halvings less one, at least one."""
    return F.greatest(F.lit(1), F.floor(F.floor(w / 2) / 2) - 1).cast("int")


def reclassified(kind: Column, w: Column, h: Column, cy: Column, page_w: float = 1.0, page_h: float = 1.0) -> Column:
    """Figures that are stamps (about square, small, not at the top) or signatures (wide, small, not at the top)."""
    aspect, rel = w / F.nullif(h, F.lit(0.0)), w * h / (page_w * page_h)
    low = cy / page_h > 0.35
    ok = (kind == "figure") & (w > 0) & (h > 0) & low
    return F.when(ok & aspect.between(0.6, 1.7) & (rel < 0.08), "stamp_seal").when(ok & (aspect > 1.8) & (rel < 0.04), "signature").otherwise(kind)


def crop_rect(w: Column, h: Column) -> Column:
    """The whole-pixel rectangle of a box clipped to its page, half to even; null if nothing is left."""
    x1, y1, x2, y2 = (F.bround(c).cast("int") for c in clip(w, h))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def offset(dx: Column, dy: Column) -> list[Column]:
    """A box moved from its region's coordinates to the page's."""
    return [(F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2")]


def region_by_place(w: Column, h: Column) -> Column:
    """A rough class of a box by its size and place on the page; the first rule that holds."""
    bw, bh, top = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("y1") / h
    part, aspect = bw * bh / (w * h), bw / F.greatest(bh, F.lit(1.0))
    # The rules in their order, with their limits.
    rules = [
        ("header", (top < 0.08) & (aspect > 3)),
        ("footer", (top > 0.88) & (aspect > 3)),
        ("page_number", (top > 0.85) & (bw < w * 0.2)),
        ("stamp_seal", (part < 0.015) & (aspect < 1.5)),
        ("table", (bh > h * 0.25) & (bw > w * 0.6)),
        ("title", (bh < h * 0.06) & (top < 0.20) & (bw > w * 0.3)),
        ("caption", (bh < h * 0.06) & (aspect > 5)),
        ("signature", part < 0.02),
    ]
    out = F.lit("text")
    for name, ok in reversed(rules):
        out = F.when(ok, name).otherwise(out)
    return out
