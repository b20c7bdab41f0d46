"""Cutting oversized line crops at blank runs (problem 6).

A crop is a tree: the line, its phrases (by the punctuation of its text), their words (between blank
runs). Sibling subtrees are merged bottom-up while they fit the limit; only a node that is too large is
opened, and only a word wider than the limit is cut inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENDS = tuple(",;:।.!?)|")


def width32(width: Column, height: Column, stored: Column, at: int = 32) -> Column:
    """A crop's width at height 32, at least 8; the stored width where a size is missing or zero; null with neither."""
    ok = (width > 0) & (height > 0)
    return F.when(ok, F.greatest(F.lit(8), F.bround(width * F.lit(float(at)) / height).cast("int"))).otherwise(F.when(stored > 0, stored))


def scale(width: int | None, height: int | None, w32: int, gaps: list[int], text: str | None, at: int = 32) -> float:
    """Factor from original pixels to height 32. With neither size known, the original width is judged from where the last blank stands in the text."""
    if height and height > 0:
        return at / height
    if width and width > 0:
        return w32 / width
    t = (text or "").rstrip()
    cut = t.rfind(" ")
    if gaps and cut > 0:
        return w32 / max(gaps[-1] * len(t) / (cut + 0.5), gaps[-1] + 1)
    return 1.0


def tree(bounds: list[float], text: str | None) -> list[list[tuple[float, float]]]:
    """Phrases of words, as spans. Where the blanks don't tell words as the text does, the line is one phrase."""
    words = list(zip(bounds, bounds[1:]))
    said = (text or "").split()
    if len(said) != len(words):
        return [words]
    out: list[list[tuple[float, float]]] = [[]]
    for span, w in zip(words, said):
        out[-1].append(span)
        if w.endswith(_ENDS):
            out.append([])
    return [p for p in out if p]


def ends(node: object) -> tuple[float, float]:
    """Where a subtree begins and ends."""
    return node if isinstance(node, tuple) else (ends(node[0])[0], ends(node[-1])[1])


def widest(node: object) -> float:
    """The width of the widest leaf."""
    return node[1] - node[0] if isinstance(node, tuple) else max(map(widest, node))


def pack(nodes: list, room: float, first: float) -> list[tuple[float, float, bool]]:
    """Spans of pieces, and if their end is cut inside a word. `room` is the limit less the overlap, `first` that of the first piece.

    A node is a span, or a list of nodes. Bottom-up: a subtree that fits is one piece; of one that doesn't,
    the children's pieces are put together, neighbours merged while they fit; a leaf too wide is cut.
    """
    start = ends(nodes)[0]
    most = lambda a: (first if a == start else room) + 1e-9

    def packed(n: object) -> list[tuple[float, float, bool]]:
        a, b = ends(n)
        if b - a <= most(a):
            return [(a, b, False)]
        if isinstance(n, tuple):
            out = []
            while b - a > most(a):
                r = most(a) - 1e-9
                out.append((a, a + r, True))
                a += r
            return [*out, (a, b, False)]
        out = []
        for piece in (p for child in n for p in packed(child)):
            if out and not out[-1][2] and piece[1] - out[-1][0] <= most(out[-1][0]):
                out[-1] = (out[-1][0], piece[1], piece[2])
            else:
                out.append(piece)
        return out

    return packed(nodes)


def cut_row(w32: int, width: int | None, height: int | None, gaps: list[int] | None, text: str | None, limit: int, overlap: int) -> tuple[str, list[tuple[float, float, str]]]:
    """The kind of cut a too wide crop needs and its pieces at height 32, each starting `overlap` before the last one's end.

    Gaps that are null, outside the crop or repeated are passed over. `hard`: two neighbouring
    boundaries lie further apart than the limit. The end of a piece is `blank`, `inside` or `end`.
    """
    gaps = sorted({int(g) for g in gaps if g is not None and g > 0}) if gaps is not None else []
    k = scale(width, height, w32, gaps, text)
    right = width * k if width and width > 0 else float(w32)
    bounds = [0.0, *[g * k for g in gaps if g * k < right], right]
    nodes = tree(bounds, text)
    kind = "hard" if widest(nodes) > limit + 1e-9 else "gap"
    spans = pack(nodes, limit - overlap, limit)
    return kind, [(max(0.0, a - (overlap if i else 0)), b, "end" if i == len(spans) - 1 else "inside" if inside else "blank") for i, (a, b, inside) in enumerate(spans)]


def pieces(rows: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(measure_id, cut_kind, piece, x_from, x_to, ends_at) of every crop wider than `limit` at height 32.

    Crops without a usable width, and null ids, give no row; repeated rows count once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    cols = ["measure_id", "original_width", "original_height", "height32_width_before_cap", "gap_x", "text"]
    wide = rows.select(*cols).filter("measure_id is not null").withColumn("w32", width32(*[F.col(c) for c in cols[1:4]])).filter(F.col("w32") > limit)
    wide = wide.dropDuplicates(["measure_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        num = lambda x: None if pd.isna(x) else int(x)
        for b in batches:
            out = []
            for i, w, h, g, t, w32 in zip(b.measure_id, b.original_width, b.original_height, b.gap_x, b.text, b.w32):
                kind, spans = cut_row(int(w32), num(w), num(h), None if g is None else list(g), t, limit, overlap)
                out += [(i, kind, k, *s) for k, s in enumerate(spans)]
            if out:
                yield pd.DataFrame(out, columns=["measure_id", "cut_kind", "piece", "x_from", "x_to", "ends_at"])

    return wide.mapInPandas(run, "measure_id long, cut_kind string, piece int, x_from double, x_to double, ends_at string")
