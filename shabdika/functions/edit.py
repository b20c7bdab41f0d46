"""Edit distances and the error rates made of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _columns(ref: Sequence, hyp: Sequence) -> list[tuple[int, int]]:
    """The table of distances column by column, as bits: where a cell is one more, and one less, than the cell above it.

    A whole column is a few operations on long integers, so a pair of texts costs one round per unit of
    the hypothesis.
    """
    full, where = (1 << len(ref)) - 1, {}
    for i, x in enumerate(ref):
        where[x] = where.get(x, 0) | 1 << i
    more, less = full, 0
    out = [(more, less)]
    for y in hyp:
        eq = where.get(y, 0)
        keep = (((eq & more) + more) ^ more) | eq
        right, left = (less | ~(keep | more)) << 1 | 1, (more & keep) << 1
        more, less = (left | ~(eq | less | right)) & full, right & (eq | less) & full
        out.append((more, less))
    return out


def _at(cols: list[tuple[int, int]], i: int, j: int) -> int:
    """The distance of the first i units of the reference and j of the hypothesis."""
    low = (1 << i) - 1
    return j + (cols[j][0] & low).bit_count() - (cols[j][1] & low).bit_count()


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences of hashable units."""
    return _at(_columns(a, b), len(a), len(b))


def operations(ref: Sequence, hyp: Sequence) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of one best path, traced back diagonal first, then deletion, then insertion."""
    cols, i, j = _columns(ref, hyp), len(ref), len(hyp)
    s = d = k = 0
    while i and j:
        here, other = _at(cols, i, j), ref[i - 1] != hyp[j - 1]
        if here == _at(cols, i - 1, j - 1) + other:
            s, i, j = s + other, i - 1, j - 1
        elif cols[j][0] >> i - 1 & 1:
            d, i = d + 1, i - 1
        else:
            k, j = k + 1, j - 1
    return s, d + i, k + j


@F.pandas_udf(IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distance of two arrays of words; null counts as empty."""
    e: list = []
    return pd.Series([distance(list(x) if x is not None else e, list(y) if y is not None else e) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in "sdi"]))
def edit_ops(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Substitutions, deletions and insertions of two strings; null counts as empty."""
    return pd.DataFrame([operations(x or "", y or "") for x, y in zip(a, b)], columns=["s", "d", "i"])


def char_distance(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b))


def rate(errors: Column, reference: Column, hypothesis_empty: Column) -> Column:
    """Errors per reference unit; with an empty reference 0 if the hypothesis is empty too, else 1."""
    return F.when(reference == 0, F.when(hypothesis_empty, 0.0).otherwise(1.0)).otherwise(errors / reference)


def corpus(pairs: DataFrame, *by: str) -> DataFrame:
    """Corpus CER of (reference, hypothesis) per group: errors over reference characters, and the mean of the documents' own rates.

    Texts must be in scoring form. Rows with a null text are left out. A group whose references are
    all empty has a null corpus rate; its rows still count in the mean.
    """
    p = pairs.filter("reference is not null and hypothesis is not null")
    p = p.withColumn("_e", char_distance(F.col("reference"), F.col("hypothesis"))).withColumn("_n", F.length("reference"))
    p = p.withColumn("_r", rate(F.col("_e"), F.col("_n"), F.col("hypothesis") == ""))
    agg = [F.count("*").alias("n_docs"), F.sum("_e").cast("long").alias("errors"), F.sum("_n").cast("long").alias("ref_chars"), F.round(F.sum("_e") / F.nullif(F.sum("_n"), F.lit(0)), 6).alias("cer"), F.round(F.avg("_r"), 6).alias("mean_doc_cer")]
    return p.groupBy(*by).agg(*agg)


def bootstrap(pairs: DataFrame, *by: str, rounds: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Interval of the corpus rate by resampling (errors, size) rows, per group: (low, high).

    Poisson resampling: each row's weight in each round is drawn from the row's own key, so partial sums
    are made where the rows are and only rounds x groups sums are shuffled. `pairs` has id, errors, size.
    """
    shape = ", ".join(f"{c} string" for c in by) + (", " if by else "") + "round int, e double, n double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        import numpy as np

        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for i, e, n, *g in zip(b["id"], b["errors"], b["size"], *[b[c] for c in by]):
                w = np.random.default_rng([seed, zlib.crc32(str(i).encode())]).poisson(1.0, rounds)
                s = sums.setdefault(tuple(g), np.zeros((2, rounds)))
                s[0] += w * e
                s[1] += w * n
        for g, s in sums.items():
            yield pd.DataFrame({**dict(zip(by, g)), "round": np.arange(rounds, dtype="int32"), "e": s[0], "n": s[1]})

    per = pairs.mapInPandas(run, shape).groupBy(*by, "round").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).withColumn("r", F.try_divide("e", "n"))
    lo, hi = int(alpha / 2 * rounds), min(rounds - 1, int((1 - alpha / 2) * rounds))
    x = per.groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("x"))  # `rounds` values a group
    return x.select(*by, F.try_element_at("x", F.lit(lo + 1)).alias("low"), F.try_element_at("x", F.lit(hi + 1)).alias("high"))
