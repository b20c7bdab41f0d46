"""File names of pages and line crops, brought to document, page and line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: series, language code, document number, page (with or without "p"), and for crops a line ("l").
_NAME = r"^([a-z]+)[^a-z0-9]+([a-z]+)[^a-z0-9]+0*([0-9]+)[^a-z0-9]+p?0*([0-9]+)(?:[^a-z0-9]+l0*([0-9]+))?(?:[^0-9].*)?$"


def _base(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"^.*[/\\]", ""))


def _part(path: Column, i: int) -> Column:
    return F.regexp_extract(_base(path), _NAME, i)


def doc_key(path: Column) -> Column:
    """Series, language and number without leading zeros, lower case, joined by underscores; null if the name says none."""
    p = [_part(path, i) for i in (1, 2, 3)]
    return F.when(p[0] != "", F.concat_ws("_", *p))


def page_key(path: Column) -> Column:
    """The document key with the page number; null if the name says none."""
    return F.when(_part(path, 1) != "", F.concat_ws("_", *[_part(path, i) for i in (1, 2, 3, 4)]))


def line_key(path: Column) -> Column:
    """The page key with the line number; null if the name says none."""
    return F.when(_part(path, 5) != "", F.concat_ws("_", *[_part(path, i) for i in (1, 2, 3, 4, 5)]))


def spelt_doc(path: Column) -> Column:
    """The part of a name that spells the document, as it is written: what stands before page and line."""
    base = F.regexp_replace(path, r"^.*[/\\]", "")
    return F.when(_part(path, 1) != "", F.regexp_extract(base, r"^([A-Za-z]+[^A-Za-z0-9]+[A-Za-z]+[^A-Za-z0-9]+[0-9]+)", 1))
