"""Lookups: memo of answers, names with fall-backs, presets, remembered hints, checkpoints, free file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def once_each(rows: DataFrame, text_col: str, work: Callable[[DataFrame], DataFrame], answer_col: str = "corrected") -> DataFrame:
    """rows with answer_col: work is given each distinct text once (a digest and the text), and its answers go back to every row that has the text."""
    keyed = rows.withColumn("_key", F.sha2(F.col(text_col), 256))
    distinct = keyed.select("_key", F.col(text_col).alias("text")).dropDuplicates(["_key"])
    answers = work(distinct).select("_key", F.col(answer_col).alias(answer_col))
    return keyed.join(answers, "_key", "left").drop("_key")


def display_names(rows: DataFrame, names: DataFrame, language_col: str, ui_col: str) -> DataFrame:
    """rows with display_name, from names (ui, target, name); what has none shows as it is, trimmed.  names is a fixed table of known size."""
    hit = rows.join(F.broadcast(names.select(F.col("ui").alias("_ui"), F.col("target").alias("_target"), F.col("name").alias("_name"))), (F.col(ui_col) == F.col("_ui")) & (F.lower(F.trim(language_col)) == F.col("_target")), "left")
    return hit.withColumn("display_name", F.coalesce("_name", F.trim(F.col(language_col)))).drop("_ui", "_target", "_name")


# The languages that names are known of and known in.
LANGUAGES = "bg cs da de el en es et fi fr ga hr hu it lt lv mt nl pl pt ro sk sl sv".split()


def language_names(spark: SparkSession, languages: list[str] = LANGUAGES) -> DataFrame:
    """ui, target, name: each of the languages as each of them calls it, by the locale data of the JVM."""
    of = {c: spark._jvm.java.util.Locale.forLanguageTag(c) for c in languages}
    return spark.createDataFrame([(ui, c, of[c].getDisplayLanguage(of[ui])) for ui in languages for c in languages], "ui string, target string, name string")


def language_display_names(rows: DataFrame, language_col: str, ui_col: str) -> DataFrame:
    """rows with display_name: a language as the reader's language calls it, or as English does where that isn't one of LANGUAGES; what isn't one of them itself shows as it is, trimmed."""
    reader = F.when(F.col(ui_col).isin(*LANGUAGES), F.col(ui_col)).otherwise(F.lit("en"))
    return display_names(rows.withColumn("_reader", reader), language_names(rows.sparkSession), language_col, "_reader").drop("_reader")


def messages(rows: DataFrame, texts: DataFrame, key_col: str, language_col: str, fallback: str = "en") -> DataFrame:
    """rows with message, from texts (key, language, text): in the row's language, else in the fallback, else the key itself."""

    def of(language: Column, name: str) -> DataFrame:
        return texts.where(language).groupBy("key", "language").agg(F.min("text").alias(name)).withColumnsRenamed({"key": "_key", "language": "_language"})

    own, other = of(F.lit(True), "_own"), of(F.col("language") == fallback, "_other").drop("_language").withColumnRenamed("_key", "_key2")
    out = rows.join(own, (F.col(key_col) == F.col("_key")) & (F.col(language_col) == F.col("_language")), "left").join(other, F.col(key_col) == F.col("_key2"), "left")
    return out.withColumn("message", F.coalesce("_own", "_other", F.col(key_col))).drop("_own", "_other", "_key", "_key2", "_language")


def first_by_priority(rows: DataFrame, key: list[str], priority: Column, tie: list[str]) -> DataFrame:
    """Of each key the row of least priority; null priorities don't count."""
    w = Window.partitionBy(*key).orderBy("_p", *tie)
    return rows.withColumn("_p", priority).where(F.col("_p").isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_p", "_n")


def active_presets(asked: DataFrame, presets: DataFrame, key: list[str], default: Column) -> DataFrame:
    """key, language, preset_id, value, added: of each row of asked (key, language, active_id) the preset that holds.

    presets: key, n (their order), id, locale, value.  Of those of the asked
    language, the one with the active id, else the one called default-<language>,
    else the first; ids in either case, blanks around the active one or not.
    Where there is none, one called default-<language> is added, its value
    default, a column over asked.  One partial aggregate, no sort.
    """
    of = asked.select(*key, "language", F.lower(F.trim("active_id")).alias("_active"), default.alias("_default"))
    own = presets.select(*key, F.col("locale").alias("language"), F.struct("n", "id", "value").alias("_own"))
    name = F.concat(F.lit("default-"), F.col("language"))
    found = F.lower("_own.id")
    rank = F.when(found == F.col("_active"), 0).when(found == name, 1).otherwise(2)
    best = of.join(own, [*key, "language"], "left").groupBy(*key, "language", "_active").agg(
        F.min_by("_own", F.when(F.col("_own").isNotNull(), F.struct(rank, F.col("_own.n")))).alias("_own"), F.first("_default").alias("_default"))
    none = F.col("_own").isNull()
    return best.select(*key, "language", F.when(none, name).otherwise(F.col("_own.id")).alias("preset_id"), F.when(none, F.col("_default")).otherwise(F.col("_own.value")).alias("value"), none.alias("added"))


def last_values(events: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """key and the newest value: one partial aggregate, no sort."""
    return events.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def checkpoint_rows(rows: DataFrame, key: list[str], label: str, batches: str) -> DataFrame:
    """key, completed_labels (distinct, sorted), completed_batches (label -> count above 0)."""
    counts = rows.groupBy(*key, label).agg(F.max(batches).alias("n"))
    return counts.groupBy(*key).agg(
        F.array_sort(F.collect_set(F.when(F.col("n") >= 0, F.col(label)))).alias("completed_labels"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct(F.col(label), F.col("n").cast("int")))))).alias("completed_batches"),
    )


def to_resume(parts: DataFrame, checkpoint: DataFrame, key: list[str]) -> DataFrame:
    """Parts that the checkpoint of an active run with the same fingerprint doesn't name."""
    done = checkpoint.where("is_active and fingerprint is not null").select(*key, "fingerprint", F.explode("completed_labels").alias("label"))
    return parts.join(done, [*key, "fingerprint", "label"], "left_anti")


def free_names(files: DataFrame, folder: str, stem: str, ext: str, order: str) -> DataFrame:
    """files with name: of equal names in a folder, the second gets -2, the third -3."""
    n = F.row_number().over(Window.partitionBy(folder, stem, ext).orderBy(order))
    return files.withColumn("name", F.concat(F.col(stem), F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.lit("")), F.col(ext)))


def distinct_ignoring_case(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The first spelling of each value."""
    w = Window.partitionBy(*key, F.lower(F.trim(value))).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
