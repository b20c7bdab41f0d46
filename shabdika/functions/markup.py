"""Text of HTML tables and blocks as columns: tags become marks, and what a mark comes to depends on what stands before it.

All of it runs in the JVM but the resolution of character references, and that only where there are any.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The tags that start a line in a block, and those that set a cell apart.
LINE_TAGS = "br|p|div|li|tr|h1|h2|h3"
CELL_TAGS = "td|th"

_REST = r"(?:\s[^>]*)?"


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def _plain(c: Column) -> Column:
    """Without the tags left, and with character references resolved."""
    c = F.regexp_replace(c, r"</?[A-Za-z][^>]*>|<[!?][^>]*>", "")
    return F.when(F.contains(c, F.lit("&")), _unescaped(c)).otherwise(c)


def _marked(c: Column) -> Column:
    """Without comments, and without the characters that serve as marks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"[\x01-\x03]", "")


def settled(c: Column) -> Column:
    """Line marks (U+0001) and cell marks (U+0002) as line breaks and tabs: none at the start or after a line break, no tab after a tab."""
    for pattern, to in (("(^|\n)[\x01\x02]+", "$1"), ("\t\x02*\x01[\x01\x02]*", "\t\n"), ("\t\x02+", "\t"), ("\x02+\x01[\x01\x02]*", "\t\n"), ("\x01[\x01\x02]*", "\n"), ("\x02+", "\t")):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, "^\n+|\n+$", "")


def table_text(c: Column) -> Column:
    """Rows on lines, cells apart by tabs; breaks inside cells are line breaks, empty cells leave nothing, and what stands outside cells stays. Null stays null."""
    c = F.regexp_replace(_marked(c), rf"(?i)<tr{_REST}/?>", "\x03")
    c = F.regexp_replace(c, rf"(?i)</tr{_REST}>|</table{_REST}>|<br{_REST}/?>", "\x01")
    c = F.regexp_replace(c, rf"(?i)<(?:{CELL_TAGS}){_REST}/?>", "\x02")
    # a row's first cell has nothing before it
    c = F.regexp_replace(F.concat(F.lit("\x03"), _plain(c)), "(\x03[^\x02\x03]*)\x02", "$1")
    return settled(F.translate(c, "\x03", "\x01"))


def block_text(c: Column) -> Column:
    """Blocks on lines of their own, a blank on either side of a cell, no markup, both ends trimmed. Null stays null."""
    c = _marked(c)
    for tags, mark in ((LINE_TAGS, "\n"), (CELL_TAGS, " ")):
        c = F.regexp_replace(c, rf"(?i)<(?:{tags}){_REST}/>", mark * 2)
        c = F.regexp_replace(c, rf"(?i)</?(?:{tags}){_REST}>", mark)
    return F.regexp_replace(_plain(c), r"(?U)^\s+|\s+$", "")
