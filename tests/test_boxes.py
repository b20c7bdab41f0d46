import math
import random

import pytest
from pyspark.sql import functions as F

from shabdika.functions import geometry as g
from shabdika.operators import detection, layout, ranks

BOX = "page string, cls long, seq long, score double, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = w * h if w > 0 and h > 0 else 0.0
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0.0


def boxes(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.uniform(0, 60), r.uniform(0, 60)
        out.append((f"p{i % 3}", i % 2, i, round(r.random(), 2), x, y, x + r.uniform(5, 40), y + r.uniform(5, 40)))
    return out


def test_suppression_against_brute_force(spark):
    rows = boxes(90, 1) + [("p0", 0, 900, None, 1.0, 1.0, 2.0, 2.0)]
    got = {(r.page, r.seq) for r in detection.suppressed(spark.createDataFrame(rows, BOX), threshold=0.3).collect()}
    want = set()
    for p in ("p0", "p1", "p2"):
        kept = []
        for b in sorted((b for b in rows if b[0] == p and b[3] is not None), key=lambda b: (-b[3], b[2])):
            if all(iou(b[4:], k[4:]) < 0.3 for k in kept):
                kept.append(b)
        want |= {(p, b[2]) for b in kept}
    assert got == want
    assert detection.suppressed(spark.createDataFrame([], BOX)).count() == 0


def brute_ap(pred, gt, t):
    out = {}
    for c in {b[1] for b in gt}:
        pages = {b[0] for b in gt if b[1] == c}
        flags = []
        for p in sorted(pages):
            used = set()
            for b in sorted((b for b in pred if b[0] == p and b[1] == c), key=lambda b: (-b[3], b[2])):
                best = max(((iou(b[4:], q[4:]), -q[2]) for q in gt if q[0] == p and q[1] == c and q[2] not in used and iou(b[4:], q[4:]) >= t), default=None)
                if best:
                    used.add(-best[1])
                flags.append((-b[3], p, b[2], best is not None))
        flags.sort()
        n, tp, prec, rec = sum(b[1] == c for b in gt), 0, [], []
        for k, f in enumerate(flags, 1):
            tp += f[3]
            prec.append(tp / k)
            rec.append(tp / n)
        ap, last = 0.0, 0.0
        for k in range(len(prec)):
            ap += (rec[k] - last) * max(prec[k:])
            last = rec[k]
        out[c] = ap
    return out


@pytest.mark.parametrize("seed", [2, 3])
def test_average_precision_against_brute_force(spark, seed):
    gt, pred = boxes(40, seed), [(*b[:4], *(v + 2 for v in b[4:])) for b in boxes(40, seed)] + [(b[0], b[1], b[2] + 500, *b[3:]) for b in boxes(30, seed + 9)]
    p, t = spark.createDataFrame(pred, BOX), spark.createDataFrame(gt, BOX)
    got = {(r.cls, r.threshold): r.ap for r in detection.average_precision(p, t, [0.5, 0.7]).collect()}
    for th in (0.5, 0.7):
        for c, ap in brute_ap(pred, gt, th).items():
            assert math.isclose(got[c, th], ap, abs_tol=1e-9)


def test_perfect_and_disjoint(spark):
    a = spark.createDataFrame([("p", 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0)], BOX)
    b = spark.createDataFrame([("p", 0, 1, 0.9, 50.0, 50.0, 60.0, 60.0)], BOX)
    assert detection.mean_ap(detection.average_precision(a, a, [0.5])).first().map50 == 1.0
    assert detection.mean_ap(detection.average_precision(b, a, [0.5])).first().map50 == 0.0


def test_two_columns_then_furniture(spark):
    rows = [("d", 1, "text", 0.0, 20.0, 45.0, 40.0), ("d", 2, "text", 0.0, 45.0, 45.0, 60.0), ("d", 3, "text", 0.0, 65.0, 45.0, 90.0), ("d", 4, "text", 55.0, 20.0, 100.0, 50.0), ("d", 5, "text", 55.0, 55.0, 100.0, 90.0), ("d", 6, "header", 0.0, 0.0, 100.0, 10.0), ("d", 7, "footer", 0.0, 95.0, 100.0, 100.0), ("d", 8, "text", None, 1.0, 2.0, 3.0)]
    d = spark.createDataFrame(rows, "doc string, region_id long, type string, x1 double, y1 double, x2 double, y2 double")
    for how in ("xy_cut", "column_aware"):
        got = [r.region_id for r in layout.ordered(d, ["doc"], how).orderBy("reading_order").collect()]
        assert got == [1, 2, 3, 4, 5, 6, 7, 8], how
    with pytest.raises(ValueError):
        layout.ordered(d, ["doc"], "no")


def test_widest_gap_merges_touching():
    assert layout.widest_gap([(0, 1), (1, 2), (5, 6), (9, 10)], 1) == (3.5, 3)
    assert layout.widest_gap([(0, 1)], 1) is None


def test_order_accuracy(spark):
    d = spark.createDataFrame([("a", 0, 0), ("a", 2, 1), ("a", 1, 2), ("b", 0, 0)], "p string, got int, want int")
    assert {r.p: round(r.accuracy, 6) for r in layout.order_accuracy(d, ["p"], "got", "want").collect()} == {"a": round(2 / 3, 6), "b": 1.0}


def test_runs_and_smoothing(spark):
    d = spark.createDataFrame([("p", i, v) for i, v in enumerate([0, 1, 1, 0, 1, 0])], "p string, at long, v int")
    assert sorted((r.run_from, r.run_to) for r in layout.runs(d, ["p"], "at", F.col("v") > 0).collect()) == [(1, 2), (4, 4)]
    assert [round(r.smooth, 3) for r in layout.smoothed(d, ["p"], "at", "v", 3).orderBy("at").collect()] == [0.333, 0.667, 0.667, 0.667, 0.333, 0.333]


def test_quantile_indexes(spark):
    v = [5, 1, 4, 4, 2, 9, 7]
    d = spark.createDataFrame([("g", x) for x in v] + [("g", None)], "g string, v int")
    r = ranks.at_index(d, ["g"], "v", {"f": ranks.floor_index(0.5), "s": ranks.scaled_index(0.9), "top": ranks.floor_index(1.0)}).first()
    s = sorted(v)
    assert (r.f, r.s, r.top) == (s[3], s[5], s[6])


def test_geometry_columns(spark):
    d = spark.createDataFrame([(10.0, 0.0)], "w double, h double")
    assert d.select(g.width32(F.col("w"), F.col("h")).alias("x")).first().x is None
    d = spark.createDataFrame([(1.0, -5.0, 900.0, 20.0)], "x1 double, y1 double, x2 double, y2 double")
    assert tuple(d.select(*g.clip(F.lit(800.0), F.lit(1000.0))).first()) == (1.0, 0.0, 800.0, 20.0)
