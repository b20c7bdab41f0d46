"""Filling containers of fixed capacity with whole items (problem 8).

Vector bin packing: an item has tokens, one segment, and loss-bearing tokens; a container limits all
three. Within a group of items a container is filled with the item whose demand has the largest dot
product with what is left, until none fits. Groups are made by a hash and packed side by side; items of
containers that stayed too empty are packed once more in fewer groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], step: int = 32) -> np.ndarray:
    """Container number of each item. Every item must fit an empty container.

    Items are pooled by (tokens, loss rounded up to `step`), so an argmax runs over kinds, not items.
    Ties go to the kind that sorts last; items of a kind are taken in order.
    """
    cap, segments, lossy = limits
    n = len(tokens)
    out = np.full(n, -1, dtype=np.int64)
    if not n:
        return out
    up = np.minimum(-(-loss // step) * step, lossy)
    order = np.lexsort((np.arange(n), up, tokens))
    t, l = tokens[order], up[order]
    new = np.r_[True, (np.diff(t) != 0) | (np.diff(l) != 0)]
    first = np.flatnonzero(new)
    kt, kl, left = t[first].astype(np.int64), l[first].astype(np.int64), np.diff(np.r_[first, n])
    ft, fl, fs = kt / cap, kl / max(1, lossy), 1 / segments
    at, placed, box = first.copy(), 0, 0
    while placed < n:
        rt, rs, rl = cap, segments, lossy
        while rs > 0:
            # kinds are sorted by tokens: those that fit by tokens are a prefix
            hi = int(np.searchsorted(kt, rt, side="right"))
            ok = (left[:hi] > 0) & (kl[:hi] <= rl)
            if not ok.any():
                break
            score = np.where(ok, ft[:hi] * (rt / cap) + fl[:hi] * (rl / max(1, lossy)) + fs * (rs / segments), -1.0)
            k = hi - 1 - int(np.argmax(score[::-1]))
            # as many of this kind as stay the best choice only if they are empty items
            m = min(int(left[k]), rs) if kt[k] == 0 else 1
            out[order[at[k] : at[k] + m]] = box
            at[k] += m
            left[k] -= m
            placed += m
            rt, rs, rl = rt - m * int(kt[k]), rs - m, rl - m * int(kl[k])
        box += 1
        if not left.all():
            live = left > 0
            if live.sum() * 2 < len(left):
                kt, kl, left, at, ft, fl = kt[live], kl[live], left[live], at[live], ft[live], fl[live]
    return out


def chunks(items: DataFrame, capacity: int) -> DataFrame:
    """Items larger than the capacity cut into parts of the capacity and a rest; all others are one part."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    d = items.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    size = F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity)
    return d.withColumn("from_token", F.col("part") * capacity).withColumn("loss", F.greatest(F.lit(0), size - F.greatest(F.lit(0), F.col("head") - F.col("from_token")))).withColumn("tokens", size.cast("int")).drop("head")


def filled(items: DataFrame, limits: tuple[int, int, int], group: int = 20000, full: float = 0.98, seed: int = 17) -> DataFrame:
    """(doc_id, part, from_token, tokens, container): every part of every item in one container.

    `items` has doc_id, tokens and head. `limits` are tokens, segments and loss-bearing tokens of a
    container; a whole container of loss-bearing tokens must be allowed, else a lone item may not fit.
    Texts without tokens take a segment and no room. Null ids and negative sizes are left out. Items
    with equal ids are told apart by nothing but their size, so ids should be unique.
    `group` bounds what one task packs at once; the number of groups follows the number of items.
    """
    cap, _, lossy = limits
    if lossy < cap:
        raise ValueError("a container must allow as many loss-bearing tokens as tokens")
    spark = items.sparkSession
    parts = cut(chunks(items.filter("doc_id is not null and tokens >= 0"), cap))
    whole = parts.filter(F.col("tokens") == cap)
    rest = parts.filter(F.col("tokens") < cap)

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "part"], kind="stable")
        box = pack(b.tokens.to_numpy(), b.loss.to_numpy(), limits)
        fill = np.bincount(box, weights=b.tokens.to_numpy()) if len(b) else np.zeros(0)
        return b.assign(box=box, fill=fill[box] if len(b) else []).drop(columns="loss").assign(loss=b.loss)

    schema = "doc_id long, part int, from_token int, tokens int, g long, box long, fill double, loss long"

    def packed(d: DataFrame, groups: int) -> DataFrame:
        d = d.select("doc_id", "part", "from_token", "tokens", F.col("loss").cast("long").alias("loss"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "part"), F.lit(groups)).alias("g"))
        return d.groupBy("g").applyInPandas(run, schema)

    n = rest.count()
    one = cut(packed(rest, max(1, -(-n // group))))
    loose = one.filter(F.col("fill") < full * cap)
    m = loose.count()
    named = lambda d, tag: d.select("doc_id", "part", "from_token", "tokens", F.concat_ws("-", F.lit(tag), "g", "box").alias("container"))
    done = named(one.filter(F.col("fill") >= full * cap), "a")
    if m:
        done = done.unionByName(named(packed(loose, max(1, -(-m // group))), "b"))
    alone = whole.select("doc_id", "part", "from_token", "tokens", F.concat_ws("-", F.lit("w"), "doc_id", "part").alias("container"))
    return done.unionByName(alone)
