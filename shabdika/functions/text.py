"""Text repair and scoring forms as columns. Only Unicode composition, mojibake and markup need Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The eight letters with a nukta and their parts.
NUKTA = {"\u0958": "\u0915\u093c", "\u0959": "\u0916\u093c", "\u095a": "\u0917\u093c", "\u095b": "\u091c\u093c", "\u095c": "\u0921\u093c", "\u095d": "\u0922\u093c", "\u095e": "\u092b\u093c", "\u095f": "\u092f\u093c"}
#: Devanagari consonants, and signs that combine with a letter before them.
CONSONANT = "[\u0915-\u0939\u0958-\u095f]"
MARK = "[\u0900-\u0903\u093a-\u093c\u093e-\u094f\u0955-\u0957\u0962\u0963]"


@F.pandas_udf(StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Canonical composition; plain ASCII never leaves the JVM. Null stays null."""
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(_compose(c))


def canonicalize_nukta(c: Column) -> Column:
    for k, v in NUKTA.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_control(c: Column) -> Column:
    """Drop control characters but tab, line feed and carriage return."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def strip(c: Column) -> Column:
    """Both ends without white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def repair_shirorekha_splits(c: Column) -> Column:
    """Join a consonant with virama to the consonant that a blank or joiner parts from it, and a consonant to its mark."""
    c = F.regexp_replace(c, rf"(?U)({CONSONANT}\x{{94d}})[\s‌‍]+(?={CONSONANT})", "$1")
    return F.regexp_replace(c, rf"(?U)({CONSONANT})\s+(?={MARK})", "$1")


def drop_orphan_marks(c: Column) -> Column:
    """Drop marks at the start of the text or after white space."""
    return F.regexp_replace(c, rf"(?U)(?:(?<=\s)|^){MARK}+", "")


def fix_punctuation_spacing(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)\s+([,;:!?.।॥])", "$1")
    return F.regexp_replace(c, r"(?U)([,;:।॥])(?=\S)", "$1 ")


def collapse_whitespace(c: Column) -> Column:
    """Runs of two and more blanks and tabs as one blank (a lone tab stays), at most one blank line, no blanks at the ends of lines or text."""
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"(?U)[^\S\n]+(?=\n)", ""))


def clean_text(c: Column, split_repair: bool = True, nukta: bool = True, spaces: bool = True) -> Column:
    """The whole repair chain; marks and punctuation are always repaired."""
    c = nfc(strip_control(c))
    if nukta:
        c = canonicalize_nukta(c)
    if split_repair:
        c = repair_shirorekha_splits(c)
    c = fix_punctuation_spacing(drop_orphan_marks(c))
    return nfc(collapse_whitespace(c) if spaces else c)


def normalize_for_scoring(c: Column) -> Column:
    """The form in which texts are compared: it never repairs an error."""
    c = canonicalize_nukta(nfc(strip_control(c)))
    c = F.regexp_replace(c, "[‌‍]", "")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """White-space words; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


# What the first bytes of Devanagari look like when UTF-8 is read as Latin-1, and the code pages that are tried in turn.
MOJIBAKE, CODE_PAGES = ("à¤", "à¥", "à¦", "à§"), ("latin-1", "cp1252")
_NATIVE = re.compile("[\u0900-\u097f]")


def repair_mojibake(text: str | None) -> str | None:
    """UTF-8 read in a one-byte code page, restored as a whole: the first reading that is Devanagari and has fewer of the marks; else the text as it is. Texts that have Devanagari already are left alone."""

    def marks(t: str) -> int:
        return sum(map(t.count, MOJIBAKE))

    def reading(page: str) -> str:
        try:
            return text.encode(page).decode()
        except UnicodeError:
            return ""

    if not text or not marks(text) or _NATIVE.search(text):
        return text
    return next((t for t in map(reading, CODE_PAGES) if _NATIVE.search(t) and marks(t) < marks(text)), text)


@F.pandas_udf(StringType())
def _repaired(s: pd.Series) -> pd.Series:
    return s.map(repair_mojibake)


def mojibake_column(c: Column) -> Column:
    """The text restored; only texts with a mark leave the JVM."""
    return F.when(c.rlike("à[¤¥¦§]"), _repaired(c)).otherwise(c)


# Punctuation that words are freed of.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~।॥‘’“”–—"


def strip_punctuation(c: Column) -> Column:
    """Both ends without punctuation."""
    return F.trim(c, F.lit(PUNCTUATION))


def devanagari_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\x{0900}-\x{097F}]"))


def lexical(c: Column) -> Column:
    """Whether a word has a Devanagari letter once its punctuation is gone."""
    return devanagari_count(strip_punctuation(c)) > 0


# --- scripts -------------------------------------------------------------------------------------

DEVA = r"[\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}]"


def script_of_text(c: Column) -> tuple[Column, Column]:
    """(script, confidence) by the share of Devanagari among Devanagari and ASCII letters: 0.85 and more deva, 0.15 and less latin, between them mixed; none of both is unknown with 0."""
    d = F.regexp_count(c, F.lit(DEVA)).cast("double")
    a = F.regexp_count(c, F.lit("[A-Za-z]")).cast("double")
    share = d / F.nullif(d + a, F.lit(0.0))
    kind = F.when(share.isNull(), "unknown").when(share >= 0.85, "deva").when(share <= 0.15, "latin").otherwise("mixed")
    conf = F.when(share.isNull(), 0.0).when(share >= 0.85, share).when(share <= 0.15, 1 - share).otherwise(1 - 2 * F.abs(share - 0.5))
    return kind, conf


def script_rule_two(c: Column) -> Column:
    """hindi if more Devanagari than other letters, english if any letter, else mixed."""
    d = F.regexp_count(c, F.lit(r"[\x{0900}-\x{097F}]"))
    a = F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(d > a, "hindi").when(a > 0, "english").otherwise("mixed")


def has_devanagari(c: Column, threshold: float = 0.3) -> Column:
    """Devanagari characters per letter reach the threshold; marks count above but not below the line, so the ratio can pass 1."""
    d = F.regexp_count(c, F.lit(r"[\x{0900}-\x{097F}]")).cast("double")
    letters = F.regexp_count(c, F.lit(r"\p{L}")).cast("double")
    return F.coalesce(d / F.nullif(letters, F.lit(0.0)) >= threshold, F.lit(False))


def valid_line(c: Column, least: int = 4, share: float = 0.3) -> Column:
    """Long enough, two letters or digits at least, and those a fair share."""
    t = strip(c)
    n = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]"))
    return (F.length(t) >= least) & (n >= 2) & (n / F.greatest(F.lit(1), F.length(t)) >= share)


def filename_parts(c: Column) -> Column:
    """prefix, language, number and suffix of a page's file name, as a struct; empty strings where it has another form."""
    p = r"^([A-Za-z]+)_([A-Za-z]+)_(\d+)(?:_(.+))?\.[A-Za-z]+$"
    return F.struct(*[F.regexp_extract(c, p, i + 1).alias(n) for i, n in enumerate(("prefix", "language", "number", "suffix"))])


def safe_stem(c: Column) -> Column:
    """A name for files: the base name without its type, anything else than letters and digits as an underscore; a hash where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[^.]*$", ""), "[^A-Za-z0-9]", "_")
    return F.when(s.rlike("[A-Za-z0-9]"), s).otherwise(F.concat(F.lit("x"), F.substring(F.md5(c), 1, 12)))


def redact(c: Column, secret: str) -> Column:
    return F.replace(c, F.lit(secret), F.lit("***")) if secret else c
