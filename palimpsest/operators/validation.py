"""Settings rows checked by ordered rules; the first that fails is told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import locale
from ..plans.settings import SCOPES

SETTINGS = (
    "provider string, api_url string, model string, custom_prompt string, system_prompt string, ui_language string, correction_language string, active_preset string, presets array<struct<id:string,name:string,value:string,locale:string>>,"
    "provider_keys map<string,string>, compare_mode string, font_size string, citation_style string, temperature double, batch_chars int, chunk_size int, editor_chunk_size int, batch_paragraphs int, batching_parts array<string>, reasoning_effort string,"
    "scope array<string>, parallel int, speed string, rpm int, mode string, target_language string, translation_prompt string, translation_presets array<struct<id:string,name:string,main_prompt:string>>"
)
# What settings may name.
PROVIDERS = ("openai", "ollama", "openrouter", "huggingface", "google", "custom", "mistral", "none")
COMPARE_MODES = ("openxml", "word-native", "libreoffice-uno")
FONT_SIZES = ("small", "default", "large", "xl", "xxl")
CITATION_STYLES = ("auto", "with_space", "without_space")
REASONING_EFFORTS = ("low", "medium", "high")
RUN_MODES = ("correction", "translation")


def first_failed(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose check isn't true; null where all are."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


def named(value: Column, known: tuple[str, ...]) -> Column:
    """Whether a value is one of known names, in either case, blanks around it or not."""
    return F.lower(F.trim(value)).isin(*known)


def first_preset_problem(presets: Column, prefix: str, rules: Callable[[Column], list[tuple[str, Column]]]) -> Column:
    """What is wrong with the first preset that isn't right: it has no id, one that an earlier preset has too, or breaks one of the rules; null where all are right or there are none."""
    ids = F.transform(presets, lambda p: F.lower(p["id"]))
    filled = lambda x: F.trim(x) != ""

    def one(p: Column, i: Column) -> Column:
        first = [("id", filled(p["id"])), ("ids differ", ~F.array_contains(F.slice(ids, F.lit(1), i), F.lower(p["id"])))]
        return first_failed([(f"{prefix} {name}", ok) for name, ok in [*first, *rules(p)]])

    return F.get(F.filter(F.transform(presets, one), lambda x: x.isNotNull()), F.lit(0))


def settings_problem() -> Column:
    """The first rule that a row of SETTINGS breaks.  Fields that settings may leave out are right as null."""
    c = F.col
    filled = lambda x: F.trim(x) != ""
    own = lambda x: locale(x) == F.lower(F.trim(x))
    absent_or = lambda name, ok: c(name).isNull() | ok
    every = lambda name, known: F.forall(name, lambda x: named(x, known))
    translating = F.coalesce(named(c("mode"), ("translation",)), F.lit(False))
    before = [
        ("provider", named(c("provider"), PROVIDERS)), ("api_url", filled("api_url")), ("model", filled("model")), ("custom_prompt", filled("custom_prompt")), ("system_prompt", filled("system_prompt")), ("presets", F.size("presets") > 0),
        ("ui_language", own("ui_language")), ("correction_language", own("correction_language")), ("active_preset", filled("active_preset")),
    ]
    after = [
        ("active_preset exists", F.array_contains(F.transform("presets", lambda p: F.lower(p["id"])), F.lower("active_preset"))),
        ("provider_keys known", F.forall(F.map_keys("provider_keys"), lambda k: k.isin(*PROVIDERS))), ("provider_keys complete", F.size("provider_keys") >= len(PROVIDERS) - 1),
        ("compare_mode", named(c("compare_mode"), COMPARE_MODES)), ("font_size", named(c("font_size"), FONT_SIZES)), ("citation_style", named(c("citation_style"), CITATION_STYLES)), ("temperature", ~F.isnan("temperature") & c("temperature").between(0, 2)),
        ("batch_chars", c("batch_chars").between(500, 50_000)), ("chunk_size", c("chunk_size").between(500, 50_000)), ("editor_chunk_size", absent_or("editor_chunk_size", c("editor_chunk_size").between(500, 50_000))),
        ("batch_paragraphs", c("batch_paragraphs").between(1, 100)), ("batching_parts", F.size("batching_parts") > 0), ("batching_parts known", every("batching_parts", SCOPES)), ("reasoning_effort", absent_or("reasoning_effort", named(c("reasoning_effort"), REASONING_EFFORTS))),
        ("scope", F.size("scope") > 0), ("scope parts", every("scope", SCOPES)), ("parallel", c("parallel").between(1, 16)), ("speed", named(c("speed"), ("auto", "manual"))), ("rpm", absent_or("rpm", c("rpm") >= 0)),
        ("mode", absent_or("mode", named(c("mode"), RUN_MODES))), ("target_language", ~translating | filled("target_language")), ("translation_prompt", absent_or("translation_prompt", filled("translation_prompt"))),
    ]
    presets = first_preset_problem(c("presets"), "preset", lambda p: [("name", filled(p["name"])), ("value", filled(p["value"])), ("locale", own(p["locale"]))])
    translations = first_preset_problem(c("translation_presets"), "translation preset", lambda p: [("name", filled(p["name"])), ("main_prompt", filled(p["main_prompt"]))])
    return F.coalesce(first_failed(before), presets, first_failed(after), translations)


def clamped(value: Column, bounds: tuple[float, float, float]) -> Column:
    """A number within (default, low, high): the default for null and what isn't finite."""
    default, low, high = map(F.lit, bounds)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.least(F.greatest(value, low), high)).otherwise(default)


def resolved_key(raw: Column, environment: dict[str, str]) -> Column:
    """A key as it is, trimmed, or that of the variable that it names as ENV:name; empty where there is none."""
    known = F.create_map(*[F.lit(x) for pair in environment.items() for x in pair]) if environment else F.create_map().cast("map<string,string>")
    named_by = F.when(F.upper(F.left(raw, F.lit(4))) == "ENV:", F.trim(F.substr(raw, F.lit(5))))
    return F.coalesce(F.when(named_by.isNotNull(), F.coalesce(known[named_by], F.lit(""))).otherwise(F.trim(raw)), F.lit(""))


def checked(rows: DataFrame) -> DataFrame:
    """Rows of SETTINGS with problem.  Without a provider nothing else matters."""
    return rows.withColumn("problem", F.when(named(F.col("provider"), ("none",)), F.lit(None)).otherwise(settings_problem()))


def from_json(lines: DataFrame, col: str = "value") -> DataFrame:
    return lines.select(F.from_json(F.col(col), SETTINGS).alias("s")).select("s.*")
