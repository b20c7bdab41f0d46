"""Reading order, gaps and profiles of pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Types that stand outside the flow of a page, and types that carry no text.
FURNITURE = ("header", "footer", "page_number")
NO_TEXT = ("figure", "stamp_seal", "signature")

Box = tuple[float, float, float, float, int]


def topdown(regions: DataFrame, page: list[str], kind: str = "type", key: str = "region_id") -> DataFrame:
    """Regions with `reading_order`: body by (y1, x1), then furniture likewise; ties by key."""
    w = Window.partitionBy(*page).orderBy(F.col(kind).isin(*FURNITURE).cast("int"), "y1", "x1", key)
    return regions.withColumn("reading_order", F.row_number().over(w) - 1)


def widest_gap(spans: list[tuple[float, float]], least: float) -> tuple[float, float] | None:
    """(middle, size) of the widest gap, of at least `least`, between merged intervals; touching ones merge; the first of equals."""
    best, end = None, None
    for a, b in sorted(spans):
        if end is not None and a > end and a - end >= least and (best is None or a - end > best[1]):
            best = ((a + end) / 2, a - end)
        end = b if end is None else max(end, b)
    return best


def xy_cut(boxes: list[Box], gap_x: float, gap_y: float, depth: int = 12) -> list[int]:
    """Keys of boxes in reading order: cut at the relatively wider of the widest gaps, upright cuts first on ties, until none is left."""
    flat = lambda bs: [b[4] for b in sorted(bs, key=lambda b: (b[1], b[0]))]
    out: list[int] = []
    stack = [(boxes, depth)]
    while stack:
        bs, left = stack.pop()
        x = y = None
        if len(bs) > 1 and left > 0:
            x, y = widest_gap([(b[0], b[2]) for b in bs], gap_x), widest_gap([(b[1], b[3]) for b in bs], gap_y)
        if x is None and y is None:
            out += flat(bs)
            continue
        upright = y is None or x is not None and x[1] / gap_x >= y[1] / gap_y
        at = x[0] if upright else y[0]
        first = [b for b in bs if (b[0] + b[2] if upright else b[1] + b[3]) / 2 < at]
        rest = [b for b in bs if (b[0] + b[2] if upright else b[1] + b[3]) / 2 >= at]
        if first and rest:
            stack += [(rest, left - 1), (first, left - 1)]
        else:
            out += flat(bs)
    return out


def column_aware(boxes: list[Box], width: float, tolerance: float = 0.15) -> list[int]:
    """Keys by columns: a column takes the boxes whose centres lie within the tolerance right of its leftmost one; columns by their left edges, boxes downwards."""
    if not boxes:
        return []
    b = np.array(sorted(boxes, key=lambda x: x[0] + x[2]), dtype=object)
    x1, y1, mid = b[:, 0].astype(float), b[:, 1].astype(float), (b[:, 0] + b[:, 2]).astype(float) / 2
    heads = [0]
    while (nxt := int(np.searchsorted(mid, mid[heads[-1]] + width * tolerance, side="right"))) < len(mid):
        heads.append(nxt)
    left = np.minimum.reduceat(x1, heads)
    column = np.argsort(np.argsort(left, kind="stable"))[np.searchsorted(heads, np.arange(len(mid)), side="right") - 1]
    return [int(k) for k in b[np.lexsort((y1, column)), 4]]


def ordered(regions: DataFrame, page: list[str], method: str = "xy_cut", kind: str = "type", key: str = "region_id", gap: float = 0.02) -> DataFrame:
    """(page..., key, reading_order) by `xy_cut` or `column_aware`; furniture comes last, downwards.

    The page's size is taken from the columns page_width and page_height, or from its boxes. Regions
    with a null corner come last of all. One page is one group, gathered as an array in the JVM.
    """
    if method not in ("xy_cut", "column_aware"):
        raise ValueError(f"no such order: {method}")
    size = [F.col(c) if c in regions.columns else F.lit(None).cast("double") for c in ("page_width", "page_height")]
    box = F.struct("x1", "y1", "x2", "y2", F.col(key).cast("long").alias("k"), F.col(kind).isin(*FURNITURE).alias("f"))
    pages = regions.groupBy(*page).agg(F.collect_list(box).alias("b"), F.max(F.coalesce(size[0], F.col("x2"))).alias("w"), F.max(F.coalesce(size[1], F.col("y2"))).alias("h"))

    @F.pandas_udf("array<long>")
    def run(b: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for bs, pw, ph in zip(b, w, h):
            rows = sorted(((x["x1"], x["y1"], x["x2"], x["y2"], x["k"], bool(x["f"])) for x in bs), key=lambda r: r[4])
            ok = [r for r in rows if not any(v is None or v != v for v in r[:4])]
            body = [r[:5] for r in ok if not r[5]]
            got = xy_cut(body, max(1.0, pw * gap), max(1.0, ph * gap)) if method == "xy_cut" else column_aware(body, pw)
            got = got + [r[4] for r in sorted((r for r in ok if r[5]), key=lambda r: (r[1], r[0]))]
            out.append(got + [r[4] for r in rows if r not in ok])
        return pd.Series(out)

    return pages.select(*page, F.posexplode(run("b", F.coalesce("w", F.lit(0.0)), F.coalesce("h", F.lit(0.0)))).alias("reading_order", key))


def gaps(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by..., gap_from, gap_to, size): gaps between merged intervals of each group; touching intervals merge."""
    w = Window.partitionBy(*by).orderBy(start, end)
    d = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    d = d.withColumn("gap_from", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return d.filter(F.col(start) > F.col("gap_from")).select(*by, "gap_from", F.col(start).alias("gap_to"), (F.col(start) - F.col("gap_from")).alias("size"))


def order_accuracy(rows: DataFrame, by: list[str], got: str, want: str, key: str | None = None) -> DataFrame:
    """(by, n, accuracy): share of pairs of a group in the right order; 1 for groups of fewer than two. Pairs are within one page, which bounds them.

    A pair is taken in the order of `key` (of `want` without one), which decides how equal positions count.
    """
    item = F.struct(F.col(key or want).alias("k"), F.col(want).alias("w"), F.col(got).alias("g"))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("a"))
    same = F.aggregate(F.transform("a", lambda x, i: F.size(F.filter(F.slice("a", i + 2, F.greatest(F.size("a") - i - 1, F.lit(0))), lambda y: (x["g"] < y["g"]) == (x["w"] < y["w"])))), F.lit(0), lambda s, v: s + v)
    return n.select(*by, "n", F.when(F.col("n") < 2, 1.0).otherwise(same / (F.col("n") * (F.col("n") - 1) / 2)).alias("accuracy"))


def runs(profile: DataFrame, by: list[str], at: str, on: Column, least: int = 1) -> DataFrame:
    """(by..., run_from, run_to, length): stretches of neighbouring positions where `on` holds, of at least `least`."""
    d = profile.filter(on).withColumn("_g", F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at)))
    r = d.groupBy(*by, "_g").agg(F.min(at).alias("run_from"), F.max(at).alias("run_to"))
    return r.withColumn("length", F.col("run_to") - F.col("run_from") + 1).filter(F.col("length") >= least).drop("_g")


def smoothed(profile: DataFrame, by: list[str], at: str, value: str, width: int) -> DataFrame:
    """Moving mean over `width` positions, missing ones as zero."""
    half = width // 2
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-half, width - 1 - half)
    return profile.withColumn("smooth", F.sum(value).over(w) / width)
