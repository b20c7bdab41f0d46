"""Texts decoded with the wrong character encoding (problem 10).

Characters are mapped back to the bytes of a legacy code page, an automaton over byte classes finds
the maximal spans that are well-formed multi-byte UTF-8, and those spans alone are decoded again.
This repeats, as a text may have been garbled more than once. Plain characters are never touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte code pages tried, in this order when they explain a text equally well.
CODE_PAGES = ("cp1252", "latin-1", "iso8859-15", "cp850", "cp437", "mac_roman", "cp1251", "cp1250", "cp866", "koi8-r")

#: A garbled span is a run of two or more characters outside ASCII and Devanagari; "?" may stand for a byte lost on the way.
_RUN = re.compile("[^\x00-\x7f\u0900-\u097f](?:[^\x00-\x7f\u0900-\u097f]|\\?)+")

#: A text can hold garbling only if it has such a run, or the sign of a lost character.
SUSPICIOUS = "[^\\x00-\\x7f\\u0900-\\u097f]{2}|\\ufffd"

#: What a decoded character may be for its span to count: Devanagari, Latin-1 letters and signs, punctuation, currency.
_MEANT = re.compile("[ -ſऀ-ॿ‐-‧‰-›₠-₿™​-‍﻿]")

#: The automaton for well-formed multi-byte sequences, over byte values written as characters; its lost-byte twin lets U+FFFD stand for one continuation byte.
_SEQ = "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}"
_LOST = "\xe0(?:[\xa0-\xbf]�|�[\x80-\xbf])|[\xe1-\xef](?:[\x80-\xbf]�|�[\x80-\xbf])|\xc3�|\xe0[\xa4\xa5]\\?"
_SPAN = re.compile(f"(?:{_SEQ}|{_LOST})+")
_ONE = re.compile(f"({_SEQ})|{_LOST}")


def _tables() -> dict[str, dict[int, int]]:
    """For each code page, the translation of characters to bytes >= 0x80 (as characters); anything else above ASCII becomes U+FFFF.

    C1 controls stand for their own byte in every page: decoders that don't refuse undefined bytes leave them so.
    """
    out = {}
    for page in CODE_PAGES:
        t = {b: b for b in range(0x80, 0xA0)}
        for b in range(0x80, 0x100):
            try:
                t[ord(bytes([b]).decode(page))] = b
            except UnicodeDecodeError:
                pass
        out[page] = t
    return out


class _Map(dict):
    def __missing__(self, k: int) -> int:
        self[k] = k if k < 0x80 or k == 0xFFFD else 0xFFFF
        return self[k]


_TABLES = {page: _Map(t) for page, t in _tables().items()}


def _decode(span: str) -> str:
    return _ONE.sub(lambda m: m[0].encode("latin-1").decode("utf-8") if m[1] else "�", span)


def _spans(runs: list[tuple[int, str]], page: str) -> tuple[int, list[tuple[int, int, str]]]:
    """The spans under a code page, and how many characters they explain."""
    found, n, t = [], 0, _TABLES[page]
    for at, run in runs:
        for m in _SPAN.finditer(run.translate(t)):
            plain = _decode(m[0])
            if plain.strip("�"):
                found.append((at + m.start(), at + m.end(), plain))
                n += m.end() - m.start()
    return n, found


def restore(text: str | None) -> tuple[str | None, int, int]:
    """The text with garbled spans decoded, the number of spans and of characters lost for good.

    Null stays null. A text without garbling comes back as it is, with 0 spans. A span counts only if
    at least one character it leads to, in the last round, is one that is written in such texts;
    accents and signs written on purpose never form a well-formed sequence of such characters.
    """
    if not text:
        return text, 0, 0
    now, spans = text, 0
    while True:  # each round shortens the text, so it ends
        runs = [(m.start(), m[0]) for m in _RUN.finditer(now)]
        if not runs:
            break
        whole = sum(len(r) for _, r in runs)
        best: tuple[int, list] = (0, [])
        for page in CODE_PAGES:
            n, found = _spans(runs, page)
            if n > best[0]:
                best = (n, found)
            if n >= 0.98 * whole:
                break
        if not best[0]:
            break
        nxt, at = [], 0
        for a, b, plain in best[1]:
            nxt += [now[at:a], plain]
            at = b
        after = "".join([*nxt, now[at:]])
        if not spans and not any(_MEANT.search(p) for _, _, p in best[1]) and restore(after)[1] == 0:
            break
        spans, now = max(spans, len(best[1])), after
    lost = now.count("�")
    if not spans and lost:
        return text, text.count("�"), lost
    return now, spans, lost


def restored(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `text` restored and the columns `garbled_spans` and `lost_chars` added.

    Null and blank texts pass unchanged with 0 spans. Only rows with a suspicious character go
    through Python; all others stay in the JVM. Names that clash are replaced.
    """
    keep = [c for c in df.columns if c not in ("garbled_spans", "lost_chars")]
    df = df.select(*keep)
    odd = F.coalesce(F.col(text).rlike(SUSPICIOUS), F.lit(False))
    plain = df.filter(~odd).withColumns({"garbled_spans": F.lit(0), "lost_chars": F.lit(0)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = [restore(t) for t in b[text]]
            yield b.assign(**{text: [x[0] for x in r], "garbled_spans": [x[1] for x in r], "lost_chars": [x[2] for x in r]})

    ts = {f.name for f in df.schema if f.dataType.typeName() == "timestamp"}
    hard = df.filter(odd)
    if not ts:
        return plain.unionByName(hard.mapInPandas(run, plain.schema))
    # timestamps cross as microseconds: pandas would clip far dates
    wire = hard.select(*[F.unix_micros(c).alias(c) if c in ts else F.col(c) for c in keep])
    back = wire.mapInPandas(run, wire.withColumns({"garbled_spans": F.lit(0), "lost_chars": F.lit(0)}).schema)
    return plain.unionByName(back.withColumns({c: F.timestamp_micros(c) for c in ts}))
