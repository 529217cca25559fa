"""Tokens, chunks, similarity and guards of texts, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Java's regex engine has it under (?U).
UNICODE_SPACE = r"(?U)\s"
INVALID_XML = r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
# The limits of the guards.
MIN_RATIO, MAX_RATIO, MAX_FROM_EMPTY = 0.2, 4.0, 5000
SHORT_ORIGINAL, SHORT_FACTOR, SHORT_LEAST = 40, 6, 60
GAP_MIN_VISIBLE, GAP_SHARE, GAP_MOST = 20, 0.75, 25


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(text: str | Column) -> Column:
    """Null, empty, or Unicode white space only."""
    return F.coalesce(col(text), F.lit("")).rlike(r"(?U)^\s*$")


def strip_space(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def word_tokens(text: str | Column) -> Column:
    """Runs of letters and digits; every other character on its own."""
    return F.regexp_extract_all(col(text), F.lit(r"[\p{L}\p{Nd}]+|(?s:.)"), 0)


def group_tokens(text: str | Column) -> Column:
    """Like word_tokens, with runs of white space as one token."""
    return F.regexp_extract_all(col(text), F.lit(r"(?U)[\p{L}\p{Nd}]+|\s+|[^\p{L}\p{Nd}\s]"), 0)


def similarity_tokens(text: str | Column) -> Column:
    """Distinct lower-cased words of two characters and more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{Nd}]+"), 0), lambda w: F.length(w) > 1))


def dice(left: Column, right: Column) -> Column:
    """Twice the common tokens over all tokens; 0 where either side has none."""
    common, all_tokens = F.size(F.array_intersect(left, right)), F.size(left) + F.size(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(2.0 * common / all_tokens)


def chunks(text: str | Column, most: int) -> Column:
    """Whole if short enough; else cut after the last sentence end or line end in reach, else after the last white space, else hard.  One pattern says so, as its alternatives are tried in order and each takes as much as it can."""
    pattern = rf"(?sU).{{1,{most}}}\z|.{{1,{most - 1}}}[.!?\r\n]|.{{1,{most - 1}}}\s|.{{{most}}}"
    return F.regexp_extract_all(col(text), F.lit(pattern), 0)


def invalid_xml_removed(text: str | Column) -> Column:
    return F.regexp_replace(col(text), INVALID_XML, "")


def length_safe(original: str | Column, corrected: str | Column) -> Column:
    n, m = F.length(col(original)), F.length(col(corrected))
    ratio = m / n
    return F.when(n == 0, m <= MAX_FROM_EMPTY).otherwise((ratio >= MIN_RATIO) & (ratio <= MAX_RATIO))


def translation_length_safe(original: str | Column, translated: str | Column) -> Column:
    n, m = F.length(col(original)), F.length(col(translated))
    return F.when(n < SHORT_ORIGINAL, m <= F.greatest(n * SHORT_FACTOR, F.lit(SHORT_LEAST))).otherwise(length_safe(original, translated))


def extraction_gap(visible: Column, extracted: Column) -> Column:
    """Percent of visible characters that were not extracted, where that is worth a warning; else null."""
    return F.when((visible >= GAP_MIN_VISIBLE) & (extracted < visible * GAP_SHARE), (100 - F.bround(extracted * 100.0 / visible)).cast("long"))


def truncated(text: str | Column, most: int, marker: str = "...") -> Column:
    t = col(text)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit(marker))).otherwise(t)


def html_escaped(text: str | Column) -> Column:
    out = col(text)
    # The ampersand first, so that entities aren't escaped again.
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def word_count(text: str | Column) -> Column:
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != "")).cast("long")


def up_to_last_sentence(text: str | Column) -> Column:
    """What a reader sees while a text still grows: up to its last sentence end; all of it where there is none."""
    found = F.regexp_extract(col(text), r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(found == "", col(text)).otherwise(found)
