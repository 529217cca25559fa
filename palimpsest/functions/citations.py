"""Page citations such as "S. 12 f." and the space before their marker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

NBSP = "\u00a0"
_CITATION = r"(?i)(s\.[\s\u00A0]*\d+)[\s\u00A0]*(ff|f)(\.)"


def style_counts(text: str | Column) -> tuple[Column, Column]:
    """(citations with a space or no-break space before the marker, citations without)."""
    found = F.regexp_extract_all(col(text), F.lit(_CITATION), 0)
    spaced = F.size(F.filter(found, lambda m: m.rlike(r"(?i)[ \u00A0](ff|f)\.$")))
    return spaced.cast("long"), (F.size(found) - spaced).cast("long")


def style(spaced: Column, close: Column) -> Column:
    return F.when(spaced >= close, F.lit("with_space")).otherwise(F.lit("without_space"))


def style_mode(raw: Column) -> Column:
    """Names of the setting; whatever is unknown is 'auto'."""
    low = F.lower(F.trim(raw))
    known = F.when(low.isin("off", "auto"), low).when(low.rlike("^with[_-]?space$"), "with_space").when(low.rlike("^without[_-]?space$"), "without_space")
    return F.coalesce(known, F.lit("auto"))


def resolved_style(mode: Column, spaced: Column, close: Column) -> Column:
    """The style that holds for a text with so many citations of either kind; null where nothing is to be done."""
    return F.when(mode == "auto", style(spaced, close)).when(mode != "off", mode)


def normalized(text: str | Column, wanted: Column) -> Column:
    t = col(text)
    return F.when(wanted == "with_space", F.regexp_replace(t, _CITATION, "$1" + NBSP + "$2$3")).when(wanted == "without_space", F.regexp_replace(t, _CITATION, "$1$2$3")).otherwise(t)
