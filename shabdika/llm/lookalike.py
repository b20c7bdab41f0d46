"""One consistent form for texts that look the same (problem 3).

Links between code points and short strings that are drawn alike are closed transitively by
union-find; each class is represented by the member that the corpus uses most, and texts are
rewritten greedily, leftmost and longest first, by an Aho-Corasick automaton of the other members.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets drawn like Latin ones.
CYRILLIC = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y"}
GREEK = {"ο": "o", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
# Devanagari spellings drawn like one letter or sign, and signs drawn like others.
DEVANAGARI = {"अा": "आ", "अॉ": "ऑ", "अो": "ओ", "अौ": "औ", "आॅ": "ऑ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ", "अॅ": "ॲ"}
SIGNS = {"‐": "-", "‑": "-", "|": "।"}
# Code points that draw nothing though they aren't format characters.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"


#: Known without being counted: both spellings of letters with an accent (a corpus may have only the parts), full-width forms, ligatures, and what is blank or unseen.
COMMON = {chr(c) for c in [*range(0xC0, 0x180), *range(0x900, 0x980), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]} | {c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Cf", "Zs", "Zl", "Zp")}


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def link(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.up):
            out.setdefault(self.find(x), []).append(x)
        return [g for g in out.values() if len(g) > 1]


def links(chars: Iterable[str]) -> list[tuple[str, str]]:
    """Pairs of strings drawn alike, for the given code points: fixed pairs and those that Unicode's data imply."""
    out = [p for t in (CYRILLIC, GREEK, DEVANAGARI, SIGNS) for p in t.items()]
    for c in chars:
        kind, made = unicodedata.category(c), unicodedata.decomposition(c)
        if kind == "Cf" or c in UNSEEN:
            out.append((c, ""))
        elif kind in ("Zs", "Zl", "Zp") or c in "\t\n\r\x0b\x0c\x85":
            out.append((c, " "))
        elif made:
            tag, _, _ = made.rpartition(">")
            parts = "".join(chr(int(x, 16)) for x in made.rpartition(">")[2].split())
            if not tag:
                out.append((c, unicodedata.normalize("NFD", c)))
            elif tag in ("<wide", "<narrow") or tag == "<compat" and parts.isalpha():
                out.append((c, unicodedata.normalize("NFKC", c)))
    return out


def classes(counts: dict[str, int]) -> dict[str, str]:
    """Member -> representative, for all classes over the code points of a corpus.

    `counts` says how often the corpus has a code point (or a linked string). The empty string and the
    blank stand for their own classes whatever their counts; ties go to the plain (NFKC) form, then the
    shorter, then the smaller string.
    """
    uf = Classes()
    known = {c for c in counts if len(c) == 1} | COMMON
    for a, b in links(sorted(known)):
        uf.link(a, b)
    # a string of several characters that wasn't counted stands at most as often as its rarest one
    often = lambda x: counts.get(x, 0) if len(x) == 1 or x in counts else min(counts.get(c, 0) for c in x)
    out = {}
    for g in uf.groups():
        best = "" if "" in g else " " if " " in g else min(g, key=lambda x: (-often(x), x != unicodedata.normalize("NFKC", x), len(x), x))
        out |= {x: best for x in g if x != best}
    return out


class Rewriter:
    """Rewrites texts to the representatives. Built once in each worker from the plain mapping."""

    def __init__(self, mapping: dict[str, str]) -> None:
        import ahocorasick

        self.first = {ord(k): v for k, v in mapping.items() if len(k) == 1 and v in ("", " ")}
        self.first |= {ord(" "): " "}
        self.auto = ahocorasick.Automaton()
        for k, v in mapping.items():
            if ord(k[0]) not in self.first:
                self.auto.add_word(k, (len(k), v))
        self.auto.make_automaton()
        # texts without a member need no rewriting but of their blanks; two classes in a row are found far faster than the members themselves
        some = lambda chars: f"[{re.escape(''.join(sorted(chars)))}]"
        more = [k for k in mapping if len(k) > 1]
        self.one = re.compile(some({k for k in mapping if len(k) == 1}) if any(len(k) == 1 for k in mapping) else "(?!)")
        self.two = re.compile(some({k[0] for k in more}) + some({k[1] for k in more}) if more else "(?!)")

    def __call__(self, text: str | None) -> str | None:
        """The one form. Null stays null; a text of blanks and invisible characters becomes empty.

        Rewriting goes on until nothing changes. Should texts ever come round again, the least of those in
        the circle is the form, so that all of them have the same.
        """
        if text is None:
            return None
        if not self.one.search(text) and not self.two.search(text):
            return " ".join(text.split())
        if not text.isascii():
            text = text.translate(self.first)
        text = " ".join(text.split())
        seen: list[str] = []
        while text not in seen:
            seen.append(text)
            out, at = [], 0
            for end, (n, v) in self.auto.iter_long(text):
                a = end - n + 1
                out += [text[at:a], v]
                at = end + 1
            if out:
                text = "".join([*out, text[at:]])
        return min(seen[seen.index(text) :])


def character_counts(dfs: list[DataFrame], text: str = "text") -> dict[str, int]:
    """How often each code point, and each fixed string of several, stands in the texts of all tables.

    Counted in the workers per batch; what reaches the driver is bounded by the number of code points.
    """
    pairs = [k for k in DEVANAGARI] + [v for v in DEVANAGARI.values() if len(v) > 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, c = np.zeros(0x110000, np.int64), Counter()
        for b in batches:
            # the null character keeps strings of two texts apart
            whole = "\0".join(t for t in b[text] if t)
            got = np.bincount(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4"))
            n[: len(got)] += got
            for p in pairs:
                c[p] += whole.count(p)
        n[0] = 0
        at = np.flatnonzero(n)
        c.update({chr(x): int(n[x]) for x in at if not 0xD800 <= x < 0xE000})
        if c:
            yield pd.DataFrame({"s": list(c), "n": list(c.values())})

    one = dfs[0].select(text)
    for d in dfs[1:]:
        one = one.unionByName(d.select(text))
    return {r.s: r.n for r in one.mapInPandas(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}


def one_form(df: DataFrame, mapping: dict[str, str], text: str = "text", out: str = "one_form") -> DataFrame:
    """`df` with the column `out`: the text in its one form; null for null. A column of that name is replaced."""

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Rewriter(mapping)
        for s in parts:
            yield pd.Series([r(t) for t in s], dtype=object)

    return df.withColumn(out, rewrite(F.col(text)))


def alike_pairs(a: DataFrame, a_id: str, b: DataFrame, b_id: str, text: str = "text") -> DataFrame:
    """Distinct pairs of ids whose texts are drawn alike but aren't the same characters.

    Texts equal to their one form carry no second copy through the join. Null texts, and texts that
    draw nothing, are in no pair. Repeated rows and re-deliveries come out once. Both sides keep only
    the two columns they need, so other columns may clash.
    """
    mapping = classes(character_counts([a, b], text))

    def side(df: DataFrame, key: str, raw: str) -> DataFrame:
        d = one_form(df.select(F.col(key).alias(key), F.col(text).alias("_t")).filter("_t is not null"), mapping, "_t", "_f")
        return d.filter("_f <> ''").select(key, "_f", F.when(F.col("_t") != F.col("_f"), F.col("_t")).alias(raw))

    x, y = side(a, a_id, "_ra"), side(b, b_id, "_rb")
    return x.join(y, "_f").filter(~F.col("_ra").eqNullSafe(F.col("_rb"))).select(a_id, b_id).distinct()
