"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every executor; a parameter of all that counts tokens.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters encoded at once: token lists are large, and only their lengths are kept.
AT_ONCE = 400_000


def lengths(sp, texts: list[str]) -> list[int]:  # noqa: ANN001
    """Tokens of each text; texts are encoded a few at a time, a long one alone and whole."""
    out: list[int] = []
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= AT_ONCE:
            out += [len(x) for x in sp.encode(part, num_threads=1)]
            part, size = [], 0
    return out + ([len(x) for x in sp.encode(part, num_threads=1)] if part else [])


def counted(df: DataFrame, text: str = "text", out: str = "tokens", head: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """`df` without its text, with the number of tokens of the whole text; null and empty texts have 0.

    With `head`, that column gets the tokens of the first line, for those texts of more than one line; else 0.
    """

    @F.pandas_udf("n int, h int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        for s in parts:
            texts = [t or "" for t in s]
            n = lengths(sp, texts)
            h = [0] * len(n)
            if head:
                h = [min(x, k) for x, k in zip(lengths(sp, [t.partition("\n")[0] if "\n" in t else "" for t in texts]), n)]
            yield pd.DataFrame({"n": n, "h": h})

    d = df.withColumn("_c", count(F.col(text))).drop(text).withColumn(out, F.col("_c.n"))
    if head:
        d = d.withColumn(head, F.col("_c.h"))
    return d.drop("_c")
