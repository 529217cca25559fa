"""Names, keys, paths, versions and the like, as Spark expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, is_blank



def _unmarked() -> dict[str, str]:
    """Letters with marks, of all Latin blocks, to the letters under the marks."""
    table = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]):
            table[c] = base[0]
    return table


_UNMARKED = _unmarked()
#: Longest slug.
SLUG = 24
#: Languages with display names of their own.
LOCALES = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "cs", "sk", "hu", "ro", "bg", "el", "da", "sv", "fi", "et", "lv", "lt", "sl", "hr", "ga", "mt")


def slug(name: str | Column, fold: bool = True) -> Column:
    """Lower case, anything but a-z and 0-9 as one dash, at most 24 characters; "target" where nothing is left.  fold: letters lose their marks first."""
    low = F.lower(F.trim(col(name)))
    if fold:
        low = F.regexp_replace(F.translate(low, "".join(_UNMARKED), "".join(_UNMARKED.values())), r"\p{Mn}+", "")
    dashed = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.left(dashed, F.lit(SLUG)), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("target")).otherwise(cut)


def output_name(stem: Column, mode: Column, language: Column, ts: Column, ext: Column) -> Column:
    suffix = F.when(mode == "translate", F.concat(F.lit("_translated_"), slug(language))).when(mode == "correct", F.lit("_corrected")).otherwise(F.lit("_revised"))
    return F.concat(stem, suffix, F.lit("_"), F.date_format(ts, "yyyyMMddHHmm"), ext)


def file_name_sanitized(name: str | Column) -> Column:
    clean = F.left(F.regexp_replace(col(name), r'[\x00-\x1f<>:"/\\|?*]', "_"), F.lit(100))
    return F.when(is_blank(clean), F.lit("document")).otherwise(clean)


def path_normalized(path: str | Column) -> Column:
    """Quotes off, file:// off with its escapes resolved, escaped blanks as blanks."""
    t = F.regexp_replace(F.trim(col(path)), "^[\"']|[\"']$", "")
    t = F.when(F.lower(t).startswith("file://"), F.url_decode(F.regexp_replace(F.regexp_replace(t, "(?i)^file://", ""), r"\+", "%2B"))).otherwise(t)
    return F.replace(t, F.lit("\\ "), F.lit(" "))


def input_key(path: str | Column) -> Column:
    return F.left(F.sha2(col(path), 256), F.lit(12))


def run_fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts by line; null as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def locale(raw: str | Column) -> Column:
    base = F.lower(F.split(F.trim(col(raw)), "[-_]")[0])
    return F.when(base.isin(*LOCALES), base).otherwise(F.lit("en"))


def version_numbers(raw: str | Column) -> Column:
    """A leading v off, cut at the first dash; parts that aren't numbers count 0."""
    t = F.split(F.regexp_replace(F.trim(col(raw)), "^[vV]", ""), "-")[0]
    return F.transform(F.split(t, r"\."), lambda x: F.coalesce(F.when(x.rlike("^[0-9]+$"), x.cast("long")), F.lit(0)))


def version_compare(left: str | Column, right: str | Column) -> Column:
    """-1, 0 or 1; missing parts count 0."""
    a, b = version_numbers(left), version_numbers(right)
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(x, i), F.lit(0)))
    return F.aggregate(F.arrays_zip(pad(a).alias("a"), pad(b).alias("b")), F.lit(0), lambda acc, p: F.when(acc != 0, acc).otherwise(F.signum((p["a"] - p["b"]).cast("double")).cast("int")))


def style_key(name: str | Column) -> Column:
    return F.lower(F.replace(col(name), F.lit(" "), F.lit("")))


def is_directory_style(name: str | Column) -> Column:
    return style_key(name).rlike("^((toc|index)[1-9]|tableoffigures)$")


def endpoint(base: str | Column, tail: str = "chat/completions") -> Column:
    """The base as it is where it ends in the tail; else the tail is added, after /v1 where no version stands."""
    t = F.regexp_replace(F.trim(col(base)), "/+$", "")
    return F.when(F.lower(t).endswith(tail), t).when(t.rlike("(?i)/v[0-9]+$"), F.concat(t, F.lit(f"/{tail}"))).otherwise(F.concat(t, F.lit(f"/v1/{tail}")))


def editor_endpoint(base: str | Column, local: Column) -> Column:
    """The editor's own rule: the base holds its version already; a local server has a path of its own."""
    t = F.regexp_replace(F.trim(col(base)), "/+$", "")
    return F.concat(t, F.when(local, F.lit("/api/chat")).otherwise(F.lit("/chat/completions")))


def memory_tier(gib: Column) -> Column:
    return F.when(gib >= 16, F.lit("large")).when(gib >= 8, F.lit("medium")).otherwise(F.lit("small"))


def epoch_text(seconds: Column) -> Column:
    """Date, hour and minute; years as they are counted, with four digits at least from 0 on: the pattern's own would be those of an era, with a sign beyond 9999."""
    at = F.timestamp_seconds(seconds)
    year = F.year(at).cast("string")
    return F.concat(F.when(F.year(at).between(0, 999), F.lpad(year, 4, "0")).otherwise(year), F.date_format(at, "-MM-dd HH:mm"))
