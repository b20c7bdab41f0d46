"""Scoring runs over two tables: pairing by id with its checks, breakdowns, and comparisons of reported with recomputed figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edit


def paired(references: DataFrame, hypotheses: DataFrame, key: str = "id") -> DataFrame:
    """(key, reference, hypothesis, ...) of the ids that both sides have: never by position. Other columns of the references stay; null ids pair with nothing. See `unpaired` for what is left out."""
    h = hypotheses.filter(F.col(key).isNotNull()).select(key, F.col("text").alias("hypothesis"))
    return references.withColumnRenamed("text", "reference").join(h, key)


def unpaired(references: DataFrame, hypotheses: DataFrame, key: str = "id") -> DataFrame:
    """(rule, key, detail) of what keeps a run from being scored: ids of one side only, and ids that stand more than once on a side. Empty if sides agree."""
    side = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    both = side(references, "r").join(side(hypotheses, "h"), key, "full_outer").na.fill(0, ["r", "h"])
    rule = F.when(F.col("h") == 0, "no_hypothesis").when(F.col("r") == 0, "no_reference").when((F.col("r") > 1) | (F.col("h") > 1), "repeated")
    return both.withColumn("rule", rule).filter("rule is not null").select("rule", F.col(key).cast("string").alias("key"), F.concat_ws(",", F.col("r"), F.col("h")).alias("detail"))


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs of (reference, hypothesis) with errors, size, word errors and words, and whether they are the same."""
    from ..functions.text import words

    r, h = words(F.col("reference")), words(F.col("hypothesis"))
    return pairs.withColumns({"errors": edit.char_distance(F.col("reference"), F.col("hypothesis")), "size": F.length("reference"), "word_errors": edit.word_distance(r, h), "words": F.size(r), "same": F.col("reference") == F.col("hypothesis")})


def rates(rows: DataFrame, *by: str) -> DataFrame:
    """Corpus CER, WER and exact share of scored rows per group: sums first, divided last."""
    s = lambda c: F.sum(c).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), s("errors").alias("errors"), F.round(F.try_divide(F.sum("errors"), F.sum("size")), 6).alias("cer"), F.round(F.try_divide(F.sum("word_errors"), F.sum("words")), 6).alias("wer"), F.round(F.avg(F.col("same").cast("int")), 6).alias("exact"))


def corpus_swapped(pairs: DataFrame, *by: str) -> DataFrame:
    """The rate of a training log: (hypothesis, reference) in that order, so that errors are divided by the hypotheses' characters."""
    return edit.corpus(pairs.withColumnsRenamed({"reference": "_r", "hypothesis": "reference"}).withColumnRenamed("_r", "hypothesis"), *by)


def complete(runs: DataFrame, pages: DataFrame, run: str, page: str) -> DataFrame:
    """Rows of the runs that have every page of `pages`, and those pages only; a run that lacks one is left out whole."""
    n = pages.select(page).distinct().agg(F.count("*").alias("_n"))
    own = runs.join(pages.select(page).distinct(), page, "left_semi")
    full = own.groupBy(run).agg(F.count_distinct(page).alias("_k")).crossJoin(n).filter("_k = _n").select(run)  # one row
    return own.join(full, run, "left_semi")


def confusion(rows: DataFrame, truth: str, told: str, labels: list[str]) -> DataFrame:
    """(label, one column a told label, n, recall) and nothing divided by zero; accuracy is the diagonal's share, see `accuracy`."""
    c = rows.filter(F.col(truth).isin(*labels)).groupBy(F.col(truth).alias("label")).pivot(told, labels).count().na.fill(0)
    n = sum((F.col(x) for x in labels), F.lit(0))
    hit = sum((F.when(F.col("label") == x, F.col(x)).otherwise(0) for x in labels), F.lit(0))
    return c.withColumn("n", n).withColumn("recall", F.round(hit / F.greatest(n, F.lit(1)), 6))


def accuracy(rows: DataFrame, truth: str, told: str) -> DataFrame:
    """(n, accuracy); 0 without rows."""
    return rows.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg((F.col(truth) == F.col(told)).cast("int")), F.lit(0.0)), 6).alias("accuracy"))


def run_rates(runs: DataFrame, lines: DataFrame, by: list[str], value: str, least: list[int]) -> DataFrame:
    """For each least run length: runs of it and longer, a line and a hundred pixels. `runs` has (by, value), `lines` (by, width); groups without lines are left out."""
    r = runs.withColumn("least", F.explode(F.array(*[F.lit(x) for x in least]))).filter(F.col(value) >= F.col("least")).groupBy(*by, "least").agg(F.count("*").alias("runs"))
    n = lines.groupBy(*by).agg(F.count("*").alias("n_lines"), F.sum("width").cast("double").alias("_w")).withColumn("least", F.explode(F.array(*[F.lit(x) for x in least])))
    runs_ = F.coalesce("runs", F.lit(0))
    return n.join(r, [*by, "least"], "left").select(*by, "least", runs_.alias("runs"), F.round(runs_ / F.col("n_lines"), 6).alias("per_line"), F.round(F.try_divide(runs_, F.col("_w") / 100), 6).alias("per_100px"))


def segment_stats(segments: DataFrame, vocabulary: DataFrame, by: list[str], line: str) -> DataFrame:
    """Per group: segments a line, lexical ones, the share of those in the vocabulary by word and by character, of fragments (two letters at most), and the mean width. `segments` has text and width, `vocabulary` word."""
    from ..functions import text

    w, n = text.strip_punctuation(F.col("text")), text.devanagari_count(text.strip_punctuation(F.col("text")))
    s = segments.withColumn("_w", w).withColumn("_n", n)
    s = s.join(vocabulary.select(F.col("word").alias("_w"), F.lit(True).alias("_known")).distinct(), "_w", "left")
    lex, known = F.col("_n") > 0, F.coalesce("_known", F.lit(False))
    n_lex = F.count_if(lex)
    return s.groupBy(*by).agg(F.count("*").alias("n_segments"), F.round(F.count("*") / F.count_distinct(line), 3).alias("segments_per_line"), n_lex.alias("n_lexical"), F.round(F.coalesce(F.try_divide(F.count_if(lex & known), n_lex), F.lit(0.0)), 4).alias("in_vocab_rate"), F.round(F.coalesce(F.try_divide(F.sum(F.when(lex & known, F.col("_n")).otherwise(0)), F.sum(F.when(lex, F.col("_n")))), F.lit(0.0)), 4).alias("char_in_vocab_rate"), F.round(F.coalesce(F.try_divide(F.count_if(lex & (F.col("_n") <= 2)), n_lex), F.lit(0.0)), 4).alias("fragment_rate"), F.round(F.coalesce(F.avg(F.when(lex, F.col("width"))), F.lit(0.0)), 1).alias("mean_width"))


def off_reference(figures: DataFrame, expected: DataFrame, key: str, value: str, within: float) -> DataFrame:
    """(key, value, expected) of figures that are absent or differ from those of an earlier run by more than the tolerance; `curate.required` makes them an error."""
    j = expected.select(key, F.col(value).alias("expected")).join(figures.select(key, value), key, "left")
    return j.filter(F.col(value).isNull() | (F.abs(F.col(value) - F.col("expected")) > within)).select(key, value, "expected")


def compared(reported: DataFrame, recomputed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, reported, recomputed, difference) over the keys of either side."""
    j = reported.select(key, F.col(value).alias("reported")).join(recomputed.select(key, F.col(value).alias("recomputed")), key, "full_outer")
    return j.withColumn("difference", F.round(F.col("recomputed") - F.col("reported"), 9))


def two_means(per_class: DataFrame, value: str, count: str, classes: int) -> DataFrame:
    """The mean over classes that are present and over all: tells which of them was reported."""
    return per_class.agg(F.round(F.avg(F.when(F.col(count) > 0, F.col(value))), 6).alias("mean_present"), F.round(F.coalesce(F.sum(F.when(F.col(count) > 0, F.col(value))), F.lit(0.0)) / classes, 6).alias("mean_all"))


def histogram_shape(bins: DataFrame, by: list[str], low: int = 6, high: int = 8, factor: float = 1.2) -> DataFrame:
    """(by, mode1, mode2, valley, valley_ratio, second_hump) of histograms (by, bin, n): the highest bin below `low`, the highest from `high` on, and the lowest between them; first ones on ties.

    A second hump is `factor` times the valley or more, or has an empty valley. Without bins from `high` on there is none; without bins between the modes the valley is null and counts 0.
    """
    at = lambda ok, n, best: best(F.struct("bin", "n"), F.when(ok, F.struct(n, F.col("bin"))))
    high_ = lambda ok: F.max_by(F.struct("bin", "n"), F.when(ok, F.struct("n", -F.col("bin"))))
    m = bins.groupBy(*by).agg(high_(F.col("bin") < low).alias("m1"), high_(F.col("bin") >= high).alias("m2"))
    b = bins.join(m, by) if by else bins.crossJoin(m)  # one row
    v = b.filter((F.col("bin") > F.col("m1.bin")) & (F.col("bin") < F.col("m2.bin"))).groupBy(*by).agg(at(F.lit(True), F.col("n"), F.min_by).alias("v"))
    j = m.join(v, by, "left") if by else m.join(v, F.lit(True), "left")
    low_n = F.coalesce(F.col("v.n"), F.lit(0))
    hump = F.col("m2").isNotNull() & ((low_n == 0) | (F.col("m2.n") >= factor * low_n))
    return j.select(*by, F.col("m1.bin").alias("mode1"), F.when(hump, F.col("m2.bin")).alias("mode2"), F.col("v.bin").alias("valley"), F.round(F.try_divide(low_n.cast("double"), F.col("m2.n")), 4).alias("valley_ratio"), hump.alias("second_hump"))


def best_of(sweep: DataFrame, by: list[str], score: Column, params: list[str]) -> DataFrame:
    """The parameters of the highest score in each group, the first on ties by the parameters' order: chosen on one part, to be reported on another."""
    return sweep.withColumn("_s", score).groupBy(*by).agg(F.max_by(F.struct(*params), F.struct("_s", *[-F.col(p) for p in params])).alias("_p"), F.max("_s").alias("score")).select(*by, "_p.*", "score")
