"""Same or near-same records across splits (problem 1).

Edit-distance segment join. A text that takes part in at most k edits is cut into k + 1 segments, one of
which survives unchanged in any partner. The cuts of an evaluation text are laid so that each segment
holds as rare a core of Q characters as possible (counts over all training texts); training texts meet a
segment by its core, have to hold the whole segment, and at an allowed position: before the i-th segment
there are at most i - 1 edits, after it k + 1 - i. What meets is verified by banded dynamic programming.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, gathered
from . import lookalike

#: Edits allowed, in percent of the longer text's code points.
PERCENT = 7
#: Characters of a segment's core. Every text of 14 and more characters, from where on edits are allowed, has room for k + 1 of them.
Q = 5
#: Texts beyond this length are cut evenly, each segment at its own rarest core; shorter ones so that all cores together are rarest.
LONG = 240
#: Bits of the table of core counts (2 MB), and least and most bits of the map of stored cores, by their number: both bound what is broadcast.
COUNT_BITS, MAP_BITS = 19, (16, 25)
#: Stored segments up to which they are matched where the training texts are (32 bytes each, 40 MB in all); beyond that cores are joined by a shuffle. Both give the same pairs.
INDEX = 1_000_000
#: 64-bit words of a text's set of hashed pairs of letters. One edit changes at most four members.
WORDS = 8
#: Candidates compared at once.
AT_ONCE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Forms:
    """Comparable forms of many texts at once: letters, marks and digits in one form, and the numbers in order.

    What can be told of a code point is kept in tables that fill as code points are met. Only texts with
    a member of a look-alike class, or a letter whose folded case is several, are rewritten one by one.
    """

    KNOWN, KEEP, DIGIT, ODD, FIRST, NEXT = 1, 2, 4, 8, 16, 32

    def __init__(self, mapping: dict[str, str]) -> None:
        self.form = lookalike.Rewriter(mapping)
        self.odd = {k for k in mapping if len(k) == 1}
        self.first, self.next = {k[0] for k in mapping if len(k) > 1}, {k[1] for k in mapping if len(k) > 1}
        self.pairs = np.array(sorted({ord(k[0]) << 21 | ord(k[1]) for k in mapping if len(k) > 1}), np.int64)
        self.kind, self.value = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint32)

    def _codes(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        for x in np.unique(c[self.kind[c] == 0]).tolist():
            ch = chr(x)
            low, cat = ch.casefold(), unicodedata.category(ch)
            self.kind[x] = self.KNOWN | self.KEEP * (cat[0] in "LMN") | self.DIGIT * (cat == "Nd") | self.ODD * (ch in self.odd or len(low) > 1) | self.FIRST * (ch in self.first) | self.NEXT * (ch in self.next)
            self.value[x] = 48 + unicodedata.digit(ch) if cat == "Nd" else ord(low) if len(low) == 1 else x
        return c

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[str]]:
        """Forms and numbers of the texts; both empty for null and blank texts and those without letters or digits."""
        t = [x or "" for x in texts]
        if not t:
            return [], []
        c = self._codes("\n".join(t) + "\n")
        starts = np.cumsum([0, *(len(x) + 1 for x in t[:-1])])
        k = self.kind[c]
        hit = (k & self.ODD) > 0
        two = np.flatnonzero(((k[:-1] & self.FIRST) > 0) & ((k[1:] & self.NEXT) > 0))
        hit[two[np.isin(c[two].astype(np.int64) << 21 | c[two + 1], self.pairs)]] = True
        hard = np.flatnonzero(np.logical_or.reduceat(hit, starts))
        if len(hard):
            for i in hard.tolist():
                t[i] = (self.form(t[i]) or "").casefold()
            c = self._codes("\n".join(t) + "\n")
            starts = np.cumsum([0, *(len(x) + 1 for x in t[:-1])])
            k = self.kind[c]
        v, keep, digit = self.value[c], (k & self.KEEP) > 0, (k & self.DIGIT) > 0
        gap = np.r_[False, digit[:-1]] & ~digit  # where a number has ended
        return _cut_up(v, keep, starts), [x.rstrip(" ") for x in _cut_up(np.where(digit, v, 32), digit | gap, starts)]


def _cut_up(values: np.ndarray, mask: np.ndarray, starts: np.ndarray) -> list[str]:
    whole = values[mask].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(np.add.reduceat(mask.astype(np.int64), starts)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def comparable(text: str | None, mapping: dict[str, str]) -> tuple[str, str]:
    """The comparable form of one text and its numbers."""
    f, n = Forms(mapping)([text])
    return f[0], n[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class Hashes:
    """64-bit hashes of substrings of many texts, from sums of powers over all of them laid end to end."""

    def __init__(self, texts: list[str]) -> None:
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
        n = len(c)
        self.sums = np.zeros(n + 1, _U)
        up, self.down = np.full(n, _BASE, _U), np.full(n + 1, _INVERSE, _U)
        if n:
            up[0] = 1
        self.down[0] = 1
        up, self.down = np.cumprod(up, dtype=_U), np.cumprod(self.down, dtype=_U)
        np.cumsum(_mixed((c + _U(1)) * _U(0xC2B2AE3D27D4EB4F)) * up, out=self.sums[1:], dtype=_U)

    def __call__(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]


def edits(n: int) -> int:
    """Most edits between a text of n characters and any partner, which may be longer."""
    return PERCENT * n // (100 - PERCENT)


def _spread(forms: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, where it lies in all texts end to end) of every substring of q characters."""
    lens = np.array([len(x) for x in forms], np.int64)
    n = np.maximum(lens - q + 1, 0)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(forms)), n), pos, np.repeat(np.cumsum(lens) - lens, n) + pos


def _numbers(nums: list[str]) -> np.ndarray:
    import xxhash

    seen: dict[str, int] = {}
    return np.fromiter((seen[x] if x in seen else seen.setdefault(x, xxhash.xxh64_intdigest(x)) for x in nums), _U, len(nums))


def _slot(core: np.ndarray) -> np.ndarray:
    return (core >> _U(64 - COUNT_BITS)).astype(np.int64)


def signatures(forms: list[str]) -> np.ndarray:
    """The set of hashed pairs of neighbouring letters of each text, in WORDS 64-bit words."""
    i, _, at = _spread(forms, 2)
    b = np.zeros((len(forms), WORDS * 64), np.uint8)
    b[i, (_mixed(Hashes(forms)(at, np.full(len(at), 2))) % _U(WORDS * 64)).astype(np.int64)] = 1
    return np.packbits(b, axis=1).view("<i8")


def cores(weight: np.ndarray, n: int, k: int, q: int = Q) -> np.ndarray:
    """Positions of k + 1 disjoint substrings of q characters with the least total weight, for each row of weights of texts of n characters."""
    t = len(weight)
    best, args = np.zeros((t, n + 1)), []
    for _ in range(k + 1):
        use = np.full((t, n + 1), float(1 << 60))
        use[:, q:] = best[:, : n + 1 - q] + weight
        best = np.minimum.accumulate(use, axis=1)
        new = np.concatenate([np.ones((t, 1), bool), use[:, 1:] < best[:, :-1]], axis=1)
        args.append(np.maximum.accumulate(np.where(new, np.arange(n + 1), 0), axis=1))
    out, e = np.zeros((t, k + 1), np.int64), np.full(t, n)
    for i in range(k, -1, -1):
        out[:, i] = args[i][np.arange(t), e] - q
        e = out[:, i]
    return out


def stored(forms: list[str], nums: list[str], counts: np.ndarray) -> pd.DataFrame:
    """The segments of the texts: text, number of the segment, key of its core, the core's place, the segment's start, length and hash. Texts that allow no edit have none."""
    h, z = Hashes(forms), _numbers(nums)
    lens = np.array([len(x) for x in forms], np.int64)
    starts, out = np.cumsum(lens) - lens, []
    for n in np.unique(lens).tolist():
        k = edits(n)
        if k < 1:
            continue
        for at in np.array_split(np.flatnonzero(lens == n), -(-int((lens == n).sum()) * n // AT_ONCE) or 1):
            core = _mixed(h(starts[at][:, None] + np.arange(n - Q + 1), np.full(n - Q + 1, Q)))
            w = counts[_slot(core)].astype(np.float64)
            if n <= LONG:
                c = cores(w, n, k)
            else:
                edge = np.arange(k + 2) * n // (k + 1)
                c = np.stack([a + np.argmin(w[:, a : b - Q + 1], axis=1) for a, b in zip(edge, edge[1:])], axis=1)
            a = np.concatenate([np.zeros((len(at), 1), np.int64), (c[:, :-1] + Q + c[:, 1:]) // 2], axis=1)  # cuts lie half-way between cores
            size = np.concatenate([a[:, 1:], np.full((len(at), 1), n)], axis=1) - a
            key = _mixed(core[np.arange(len(at))[:, None], c] ^ z[at][:, None])
            whole = h((starts[at][:, None] + a).ravel(), size.ravel())
            out.append(pd.DataFrame({"text": np.repeat(at, k + 1), "i": np.tile(np.arange(k + 1), len(at)), "g": key.ravel(), "p": c.ravel(), "a": a.ravel(), "size": size.ravel(), "whole": whole}))
    return pd.concat(out) if out else pd.DataFrame({x: np.zeros(0, np.int64) for x in ("text", "i", "g", "p", "a", "size", "whole")})


def looked_up(forms: list[str], nums: list[str], known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """(text, key, position) of all cores of the texts whose key is `known`."""
    i, pos, at = _spread(forms, Q)
    g = _mixed(_mixed(Hashes(forms)(at, np.full(len(at), Q))) ^ _numbers(nums)[i])
    on = known(g)
    return i[on], g[on], pos[on]


class Index:
    """Stored segments, to be met by the texts of a batch."""

    def __init__(self, keys: pd.DataFrame, sets: pd.DataFrame) -> None:
        self.fid = sets.fid.to_numpy()
        self.n = sets.n.to_numpy(dtype=np.int64)
        self.sets = np.ascontiguousarray(sets[[f"s{x}" for x in range(WORDS)]].to_numpy(dtype=np.int64))
        order = np.argsort(self.fid, kind="stable")
        who = order[np.searchsorted(self.fid[order], keys.fid.to_numpy())]
        g = keys.g.to_numpy(dtype=np.int64).view(_U)
        by = np.argsort(g, kind="stable")
        self.g, self.who = g[by], who[by].astype(np.int32)
        self.i, self.p, self.a, self.size = (keys[x].to_numpy(dtype=np.int32)[by] for x in ("i", "p", "a", "size"))
        self.whole = keys.whole.to_numpy(dtype=np.int64).view(_U)[by]

    def met(self, forms: list[str], nums: list[str], known) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """(stored text, text) that share a whole segment at an allowed position and don't differ in more pairs of letters than edits allow."""
        text, g, pos = looked_up(forms, nums, known)
        lo, hi = np.searchsorted(self.g, g), np.searchsorted(self.g, g, side="right")
        lens = np.array([len(x) for x in forms], np.int64)
        starts, h, sets, out = np.cumsum(lens) - lens, Hashes(forms), signatures(forms), []
        for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(np.cumsum(hi - lo) // AT_ONCE)) + 1):
            n = (hi - lo)[part]
            at = np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            t, p = np.repeat(text[part], n), np.repeat(pos[part], n)
            who = self.who[at]
            far, more = p - self.p[at], lens[t] - self.n[who]
            k = PERCENT * self.n[who] // (100 - PERCENT)
            a = self.a[at] + far
            ok = (np.abs(far) <= self.i[at]) & (np.abs(far - more) <= k - self.i[at]) & (a >= 0) & (a + self.size[at] <= lens[t]) & (np.abs(more) <= PERCENT * np.maximum(lens[t], self.n[who]) // 100)
            at, t, a, who = at[ok], t[ok], a[ok], who[ok]
            ok = h(starts[t] + a, self.size[at]) == self.whole[at]
            pair = np.unique(who[ok].astype(np.int64) << 32 | t[ok])
            who, t = pair >> 32, pair & 0xFFFFFFFF
            apart = np.bitwise_count((self.sets[who] ^ sets[t]).view(_U)).sum(axis=1, dtype=np.int64)
            ok = apart <= 4 * (PERCENT * np.maximum(lens[t], self.n[who]) // 100)
            out.append(who[ok] << 32 | t[ok])
        pair = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return pair >> 32, pair & 0xFFFFFFFF


def _places(g: Column, bits: int) -> list[Column]:
    """Three places of a key in the map."""
    low = F.lit((1 << bits) - 1)
    return [F.shiftrightunsigned(g, 64 - bits), F.shiftrightunsigned(g, 20).bitwiseAND(low), g.bitwiseAND(low)]


def _forms(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rows with their comparable form; rows that have none are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = Forms(mapping)
        for b in batches:
            f, n = forms(list(b.text))
            yield pd.DataFrame({"row_id": b.row_id, "split": b.split, "form": f, "nums": n})

    d = df.select("row_id", "split", "text").mapInPandas(run, "row_id long, split string, form string, nums string")
    return d.filter("form <> ''").withColumn("fid", F.xxhash64("form", "nums"))


def _core_counts(tr: DataFrame) -> np.ndarray:
    """How often cores stand in all training texts, in 2^COUNT_BITS slots."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            forms = list(b.form)
            _, _, at = _spread(forms, Q)
            n += np.bincount(_slot(_mixed(Hashes(forms)(at, np.full(len(at), Q)))), minlength=len(n))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"k": at.astype(np.int32), "n": n[at]})

    got = gathered(tr.select("form").mapInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")))
    out = np.zeros(1 << COUNT_BITS, np.float32)
    out[got.k.to_numpy(dtype=np.int64)] = got.n.to_numpy(dtype=np.float32)
    return out


def _map(keys: DataFrame, bits: int) -> np.ndarray:
    at = keys.select(F.explode(F.array(*_places(F.col("g"), bits))).alias("at"))
    words = gathered(at.groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("v")))
    marks = np.zeros(1 << (bits - 5), np.uint32)
    marks[words.w.to_numpy(dtype=np.int64)] = words.v.to_numpy(dtype=np.int64).astype(np.uint32)
    return marks


def _looker(marks: np.ndarray, bits: int):  # noqa: ANN202
    low = _U((1 << bits) - 1)

    def look(g: np.ndarray) -> np.ndarray:
        """Which keys may be stored: where all three places of the map are taken."""
        on = np.arange(len(g))
        for far in (64 - bits, 20, 0):
            x = ((g[on] >> _U(far)) & low).astype(np.int64)
            on = on[((marks[x >> 5] >> (x & 31).astype(np.uint32)) & np.uint32(1)) > 0]
        return on

    return look


def near_forms(ev: DataFrame, tr: DataFrame) -> DataFrame:
    """(ev, tr): ids of all pairs of different forms within the allowed edits that have the same numbers, given (fid, form, nums), which may repeat.

    Forms of 13 characters and less allow no edit.
    """
    sc = ev.sparkSession.sparkContext
    own = ["fid", "form", "nums"]
    longs = ", ".join(f"s{x} long" for x in range(WORDS))
    counts = sc.broadcast(_core_counts(tr))

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates("fid")
            s = stored(list(b.form), list(b.nums), counts.value)
            if len(s):
                yield s.assign(fid=b.fid.to_numpy()[s.text], n=b.form.str.len().to_numpy()[s.text], g=s.g.to_numpy().view(np.int64), whole=s.whole.to_numpy().view(np.int64)).drop(columns="text").astype({x: np.int32 for x in ("i", "p", "a", "size", "n")})[["fid", "n", "i", "g", "p", "a", "size", "whole"]]

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates("fid")
            s = signatures(list(b.form))
            yield pd.DataFrame({"fid": b.fid.to_numpy(), "n": b.form.str.len().to_numpy(dtype=np.int32), **{f"s{x}": s[:, x] for x in range(WORDS)}})

    x = ev.select(*own).dropDuplicates(["fid"])
    keys = cut(x.mapInPandas(store, "fid long, n int, i int, g long, p int, a int, size int, whole long"))
    size = keys.count()
    bits = min(MAP_BITS[1], max(MAP_BITS[0], (40 * size).bit_length()))
    marks = sc.broadcast(_map(keys, bits))
    letters = x.mapInPandas(sets, f"fid long, n int, {longs}")
    if size <= INDEX:
        index = sc.broadcast(Index(gathered(keys), gathered(letters)))

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            look = _looker(marks.value, bits)
            for b in batches:
                b = b.drop_duplicates("fid")
                e, t = index.value.met(list(b.form), list(b.nums), look)
                yield b.iloc[t].assign(ev=index.value.fid[e]).rename(columns={"fid": "tr"})

        pairs = tr.select(*own).mapInPandas(match, "ev long, tr long, form string, nums string").filter("ev <> tr").dropDuplicates(["ev", "tr"]).withColumnsRenamed({"form": "ft", "nums": "nt"})
    else:

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            look = _looker(marks.value, bits)
            for b in batches:
                b = b.drop_duplicates("fid")
                forms = list(b.form)
                i, g, p = looked_up(forms, list(b.nums), look)
                s, n = signatures(forms), np.array([len(f) for f in forms], np.int32)
                yield pd.DataFrame({"fid": b.fid.to_numpy()[i], "n": n[i], "g": g.view(np.int64), "p": p.astype(np.int32), **{f"s{x}": s[i, x] for x in range(WORDS)}})

        named = lambda d, tag, *more: d.select("g", F.col("fid").alias(tag), F.col("n").alias(f"n{tag}"), F.col("p").alias(f"p{tag}"), *[F.col(f"s{x}").alias(f"s{x}{tag}") for x in range(WORDS)], *more)
        a = named(keys.join(letters.drop("n"), "fid"), "ev", "i")
        b = named(tr.select(*own).mapInPandas(meet, f"fid long, n int, g long, p int, {longs}"), "tr")
        k, far, more = F.floor(F.col("nev") * PERCENT / (100 - PERCENT)), F.col("ptr") - F.col("pev"), F.col("ntr") - F.col("nev")
        apart: Column = sum((F.bit_count(F.col(f"s{x}ev").bitwiseXOR(F.col(f"s{x}tr"))) for x in range(WORDS)), F.lit(0))
        hit = (F.col("ev") != F.col("tr")) & (F.abs(far) <= F.col("i")) & (F.abs(far - more) <= k - F.col("i")) & (apart <= 4 * F.floor(F.greatest("nev", "ntr") * PERCENT / 100))
        y = tr.select(F.col("fid").alias("tr"), F.col("form").alias("ft"), F.col("nums").alias("nt")).dropDuplicates(["tr"])
        pairs = a.join(b, "g").filter(hit).select("ev", "tr").distinct().join(y, "tr")
    most = f"cast(floor(greatest(length(fe), length(ft)) * {PERCENT} / 100) as int)"
    z = x.select(F.col("fid").alias("ev"), F.col("form").alias("fe"), F.col("nums").alias("ne"))
    return pairs.join(z, "ev").filter("ne = nt").filter(F.expr(f"levenshtein(fe, ft, {most}) >= 0")).select("ev", "tr")


def overlaps(index: DataFrame, line: Column) -> DataFrame:
    """Distinct (row_id_a, row_id_b, by_crop, by_text): pairs of one training row and one of val or test that hold the same crop or line, smaller id first.

    `line` is the crop's key, null where the name has none. Null ids and splits, null and blank texts and
    names without a key match nothing; re-deliveries count once. Forms are compared once however many
    rows have them; rows come back in by a join at the end. A form is known by a 64-bit hash of it and
    its numbers.
    """
    d = index.filter("row_id is not null and split in ('train', 'val', 'test')")
    text = d.select("row_id", "split", "text").filter("text is not null")
    forms = cut(_forms(text, lookalike.classes(lookalike.character_counts([text]))))
    ev, tr = forms.filter("split <> 'train'"), forms.filter("split = 'train'")
    near = near_forms(ev, tr)
    rows = lambda f, fid, out: f.select(F.col("fid").alias(fid), F.col("row_id").alias(out)).distinct()
    e, t = rows(ev, "ev", "e"), rows(tr, "tr", "t")
    by_text = near.join(e, "ev").join(t, "tr").select("e", "t").unionByName(e.join(t, F.col("ev") == F.col("tr")).select("e", "t"))
    crop = d.select("row_id", "split", line.alias("line")).filter("line is not null")
    x = crop.filter("split <> 'train'").select("line", F.col("row_id").alias("e")).distinct()
    y = crop.filter("split = 'train'").select("line", F.col("row_id").alias("t")).distinct()
    both = by_text.select("e", "t", F.lit(False).alias("crop")).unionByName(x.join(y, "line").select("e", "t", F.lit(True).alias("crop")))
    return both.groupBy(F.least("e", "t").alias("row_id_a"), F.greatest("e", "t").alias("row_id_b")).agg(F.max("crop").alias("by_crop"), F.max(~F.col("crop")).alias("by_text"))
