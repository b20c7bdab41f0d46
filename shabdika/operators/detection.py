"""Boxes of predictions and ground truth: suppression, matching, average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..session import cut

_BOX = ["x1", "y1", "x2", "y2"]


def _fold_iou(k: Column, b: Column) -> Column:
    w = F.least(k["x2"], b["x2"]) - F.greatest(k["x1"], b["x1"])
    h = F.least(k["y2"], b["y2"]) - F.greatest(k["y1"], b["y1"])
    i = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
    u = (k["x2"] - k["x1"]) * (k["y2"] - k["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - i
    return F.when(u > 0, i / u).otherwise(F.lit(0.0))


def suppressed(boxes: DataFrame, page: str = "page", score: str = "score", key: str = "seq", threshold: float = 0.75) -> DataFrame:
    """(page, key, region_id) of the boxes kept: best score first, a box stays if it overlaps none kept by the threshold.

    A page's boxes are folded in one array, as pages are what is bounded; ties go to the smaller key.
    Boxes with a null corner or score are left out.
    """
    b = boxes.filter(" and ".join(f"{c} is not null" for c in [*_BOX, score]))
    item = F.struct((-F.col(score)).alias("o"), F.col(key).alias("key"), *_BOX)
    arr = b.groupBy(page).agg(F.array_sort(F.collect_list(item)).alias("a"))
    empty = F.slice("a", 1, 0)
    kept = F.aggregate("a", empty, lambda acc, x: F.when(F.forall(acc, lambda k: _fold_iou(k, x) < threshold), F.concat(acc, F.array(x))).otherwise(acc))
    return arr.select(page, F.posexplode(kept).alias("region_id", "b")).select(page, F.col("b.key").alias(key), "region_id")


def pairs(pred: DataFrame, gt: DataFrame, page: str = "page", cls: str = "cls", least: float = 0.0) -> DataFrame:
    """Overlapping prediction and ground truth of one page and class, with their IoU."""
    p = pred.select(page, cls, F.col("seq").alias("pseq"), "score", *[F.col(c).alias(f"{c}p") for c in _BOX])
    t = gt.select(page, cls, F.col("seq").alias("gseq"), *[F.col(c).alias(f"{c}g") for c in _BOX])
    j = p.join(t, [page, cls])
    return j.withColumn("iou", g.iou("p", "g")).filter(F.col("iou") > least).select(page, cls, "pseq", "score", "gseq", "iou")


def matched(pred: DataFrame, gt: DataFrame, thresholds: list[float], page: str = "page", cls: str = "cls") -> DataFrame:
    """For each threshold, every prediction with the ground truth it takes (or null): by score, each the best free one at the threshold or above, the first on ties.

    Candidates come from one equi-join on page and class for all thresholds; the greedy choice is a fold
    over one page and class. Predictions of a class with no ground truth on its page are kept with null.
    """
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    own = [page, cls, "threshold"]
    c = pairs(pred, gt, page, cls).filter(F.col("iou") >= min(thresholds)).withColumn("threshold", each).filter("iou >= threshold")
    one = c.groupBy(*own, "pseq").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), "gseq"))).alias("gs"))
    arr = one.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("pseq"), F.col("gs")))).alias("a"))
    start = F.struct(F.array().cast("array<long>").alias("used"), F.array().cast("array<struct<p:long,g:long>>").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(x["gs"], lambda y: ~F.array_contains(acc["used"], y["gseq"].cast("long")))
        got = F.try_element_at(free, F.lit(1))["gseq"].cast("long")
        hit = F.struct(F.concat(acc["used"], F.array(got)).alias("used"), F.concat(acc["hits"], F.array(F.struct(x["pseq"].cast("long").alias("p"), got.alias("g")))).alias("hits"))
        return F.when(F.size(free) > 0, hit).otherwise(acc)

    hits = arr.select(*own, F.explode(F.aggregate("a", start, step)["hits"]).alias("h")).select(*own, F.col("h.p").alias("seq"), F.col("h.g").alias("gseq"))
    return pred.select(page, cls, F.col("seq").cast("long").alias("seq"), "score").withColumn("threshold", each).join(hits, [*own, "seq"], "left")


def average_precision(pred: DataFrame, gt: DataFrame, thresholds: list[float], page: str = "page", cls: str = "cls") -> DataFrame:
    """(class, threshold, n_gt, n_pred, ap): all-point AP. As in the usual tool of this field, predictions on pages without ground truth of their class are passed over.

    Running counts over predictions ordered by score, page and key are made in two levels, over score
    buckets and within one, so that no class is sorted in one task.
    """
    n = gt.groupBy(cls).agg(F.count("*").alias("n_gt"))
    has = gt.select(page, cls).distinct()
    rows = cut(matched(pred.join(has, [page, cls], "left_semi"), gt, thresholds, page, cls))  # read several times
    own = [cls, "threshold"]
    r = rows.join(n, cls).withColumn("hit", F.col("gseq").isNotNull().cast("int"))
    r = r.withColumn("k", F.floor((1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))) * 1000))
    sums = r.groupBy(*own, "k").agg(F.sum("hit").alias("h"), F.count("*").alias("c"))
    up = Window.partitionBy(*own).orderBy("k")
    sums = sums.select(*own, "k", (F.sum("h").over(up) - F.col("h")).alias("h0"), (F.sum("c").over(up) - F.col("c")).alias("c0"))
    w = Window.partitionBy(*own, "k").orderBy(F.desc("score"), page, "seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    r = r.join(sums, [*own, "k"]).withColumn("prec", (F.col("h0") + F.sum("hit").over(run)) / (F.col("c0") + F.count("*").over(run)))
    later = r.groupBy(*own, "k").agg(F.max("prec").alias("m"))
    later = later.select(*own, "k", F.max("m").over(up.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    best = F.greatest(F.max("prec").over(w.rowsBetween(0, Window.unboundedFollowing)), F.coalesce("after", F.lit(0.0)))
    r = r.join(later, [*own, "k"]).withColumn("best", best)
    ap = r.groupBy(*own).agg(F.count("*").alias("n_pred"), F.sum(F.col("hit") / F.col("n_gt") * F.col("best")).alias("ap"))
    grid = n.crossJoin(pred.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double"))  # classes x thresholds
    return grid.join(ap, [cls, "threshold"], "left").select(cls, "threshold", "n_gt", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_ap(ap: DataFrame) -> DataFrame:
    """One row: mAP at 0.50, at 0.75 and over all thresholds of `ap`."""
    at = lambda t: F.avg(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap")))
    return ap.agg(at(0.5).alias("map50"), at(0.75).alias("map75"), F.avg("ap").alias("map"))


def single_point(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, cls: str = "cls") -> DataFrame:
    """(class, n_pred, n_gt, precision, recall, ap): precision times recall at one operating point, as an older evaluation had it. Both are 0 without predictions."""
    m = matched(pred, gt, [threshold], cls=cls).groupBy(cls).agg(F.count("*").alias("n_pred"), F.count("gseq").alias("tp"))
    g_ = gt.groupBy(cls).agg(F.count("*").alias("n_gt")).join(m, cls, "left").na.fill(0)
    p, r = F.coalesce(F.try_divide("tp", "n_pred"), F.lit(0.0)), F.col("tp") / F.col("n_gt")
    return g_.select(cls, "n_pred", "n_gt", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(p * r, 6).alias("ap"))


def eleven_point(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap): mean over recalls 0, 0.1 ... 1 of the best precision at that recall or beyond, 0 where there is none. `curve` has precision and recall."""
    grid = [F.coalesce(F.max(F.when(F.col("recall") >= i / 10, F.col("precision"))), F.lit(0.0)) for i in range(11)]
    return curve.groupBy(*by).agg((sum(grid[1:], grid[0]) / 11).alias("ap"))


def suppressed_1d(spans: DataFrame, by: list[str], start: str, end: str, key: str, threshold: float = 0.5) -> DataFrame:
    """(by, key) of the spans kept: by position (not by score), a span stays if it overlaps no kept one by more than the threshold. A group's spans are folded in one array; ties go to the smaller key."""
    arr = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("double").alias("a"), F.col(key).alias("k"), F.col(end).cast("double").alias("b")))).alias("s"))

    def overlap(x: Column, y: Column) -> Column:
        i = F.greatest(F.lit(0.0), F.least(x["b"], y["b"]) - F.greatest(x["a"], y["a"]))
        u = x["b"] - x["a"] + y["b"] - y["a"] - i
        return F.when(u > 0, i / u).otherwise(0.0)

    kept = F.aggregate("s", F.slice("s", 1, 0), lambda acc, x: F.when(F.forall(acc, lambda k: overlap(k, x) <= threshold), F.concat(acc, F.array(x))).otherwise(acc))
    return arr.select(*by, F.explode(kept).alias("s")).select(*by, F.col("s.k").alias(key))


# Which labels of a table model are rows and which columns.
TABLE_ROWS, TABLE_COLUMNS = ("table row", "table column header", "table projected row header"), ("table column",)


def table_bands(boxes: DataFrame, table: list[str], width: Column, height: Column, least_score: float = 0.5, least: float = 2.0) -> DataFrame:
    """(table, axis, number, lo, hi) of a table model's rows and columns: sure enough, clipped to the image, at least `least` wide and high, overlapping ones suppressed, numbered in order."""
    x1, y1, x2, y2 = F.greatest(F.lit(0.0), "x1"), F.greatest(F.lit(0.0), "y1"), F.least(width, F.col("x2")), F.least(height, F.col("y2"))
    axis = F.when(F.col("label").isin(*TABLE_ROWS), "row").when(F.col("label").isin(*TABLE_COLUMNS), "column")
    b = boxes.filter(F.col("score") >= least_score).withColumn("axis", axis).filter((x2 - x1 >= least) & (y2 - y1 >= least) & F.col("axis").isNotNull())
    b = b.select(*table, "axis", "seq", F.when(F.col("axis") == "row", y1).otherwise(x1).alias("lo"), F.when(F.col("axis") == "row", y2).otherwise(x2).alias("hi"))
    kept = b.join(suppressed_1d(b, [*table, "axis"], "lo", "hi", "seq"), [*table, "axis", "seq"], "left_semi")
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(*table, "axis").orderBy("lo", "seq")) - 1).select(*table, "axis", "number", "lo", "hi")


def table_cells(bands: DataFrame, table: list[str], least: float = 4.0) -> DataFrame:
    """(table, row, column, x1, y1, x2, y2): every row band of a table with every column band of the same table, without cells under the least size. A table's bands bound the product."""
    r = bands.filter("axis = 'row'").select(*table, F.col("number").alias("row"), F.col("lo").alias("y1"), F.col("hi").alias("y2"))
    c = bands.filter("axis = 'column'").select(*table, F.col("number").alias("column"), F.col("lo").alias("x1"), F.col("hi").alias("x2"))
    return r.join(c, table).filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least)).select(*table, "row", "column", "x1", "y1", "x2", "y2")


def boundaries(pred: DataFrame, true: DataFrame, line: str, threshold: float = 0.5) -> DataFrame:
    """One row (n_lines, precision, recall, f1, exact_count_rate) of spans (line, seq, a, b): by line, each predicted span in order takes the best free true one at the threshold or above, the first on ties.

    Lines of either side count. A line's spans are folded in one array.
    """
    side = lambda d, n: d.groupBy(line).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))).alias(n))
    none = F.array().cast("array<struct<seq:long,a:double,b:double>>")
    cast = lambda c: F.coalesce(F.col(c).cast("array<struct<seq:long,a:double,b:double>>"), none)
    j = side(pred, "p").join(side(true, "t"), line, "full_outer").select(line, cast("p").alias("p"), cast("t").alias("t"))

    def iou(x: Column, y: Column) -> Column:
        i = F.greatest(F.lit(0.0), F.least(x["b"], y["b"]) - F.greatest(x["a"], y["a"]))
        u = x["b"] - x["a"] + y["b"] - y["a"] - i
        return F.when(u > 0, i / u).otherwise(0.0)

    def step(free: Column, x: Column) -> Column:
        fit = F.array_sort(F.filter(F.transform(free, lambda y: F.struct((-iou(x, y)).alias("o"), y["seq"].alias("seq"))), lambda z: (z["o"] <= -threshold)))
        got = F.try_element_at(fit, F.lit(1))["seq"]
        return F.when(F.size(fit) > 0, F.filter(free, lambda y: y["seq"] != got)).otherwise(free)

    j = j.select(F.size("p").alias("np"), F.size("t").alias("nt"), (F.size("t") - F.size(F.aggregate("p", F.col("t"), step))).alias("tp"))
    s = j.agg(F.count("*").alias("n_lines"), F.coalesce(F.try_divide(F.sum("tp"), F.sum("np")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.sum("tp"), F.sum("nt")), F.lit(0.0)).alias("recall"), F.coalesce(F.avg((F.col("np") == F.col("nt")).cast("int")), F.lit(0.0)).alias("exact_count_rate"))
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
