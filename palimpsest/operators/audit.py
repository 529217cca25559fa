"""Counts and checks of documents: coverage, fields, citation styles, integrity, latency."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import style, style_counts
from .fields import DIRECTORY_FIELDS

# Field types that may be written over.
SAFE_FIELDS = ("HYPERLINK", "SYMBOL", "QUOTE", "PAGE", "NUMPAGES", "SECTION", "SECTIONPAGES", "PAGEREF")
#: Weight of the newest latency.
EMA_WEIGHT = 0.3


def coverage(paras: DataFrame, key: str = "doc_id", part: str = "part_kind") -> DataFrame:
    """Paragraphs by part, and by document with part null."""
    return paras.rollup(key, part).agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars")).where(F.col(key).isNotNull())


def field_histogram(fields: DataFrame, key: str, type_col: str = "field_type") -> DataFrame:
    """key, is_safe, histogram: upper-cased first words of field instructions with their counts, most frequent first."""
    kind = F.upper(F.regexp_extract(F.trim(F.col(type_col)), r"^(\S+)", 1))
    counts = fields.select(key, kind.alias("kind")).groupBy(key, "kind").count()
    rows = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("kind").alias("k"))))
    out = counts.groupBy(key, F.col("kind").isin(*SAFE_FIELDS).alias("is_safe")).agg(rows.alias("h"))
    return out.select(key, "is_safe", F.array_join(F.transform("h", lambda x: F.concat(x["k"], F.lit(":"), (-x["n"]).cast("string"))), ", ").alias("histogram"))


def is_unsafe(field_types: Column, elements: Column) -> Column:
    """Whether a paragraph must not be written over: foreign content, mathematics, or a field of another type."""
    bad = F.exists(elements, lambda e: e.isin("altChunk", "customXml", "oMath", "oMathPara"))
    return bad | F.exists(field_types, lambda t: ~F.upper(t).isin(*SAFE_FIELDS))


def citation_styles(paras: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, spaced, close, style: the more frequent style over all paragraphs; a tie, or none at all, is with_space."""
    spaced, close = style_counts(text_col)
    out = paras.select(key, spaced.alias("s"), close.alias("c")).groupBy(key).agg(F.sum("s").alias("spaced"), F.sum("c").alias("close"))
    return out.withColumn("style", style(F.col("spaced"), F.col("close")))


def integrity(before: DataFrame, after: DataFrame, key: list[str], protected: Column, required: Column) -> DataFrame:
    """Entries (key, entry, content) of two packages compared: a row for each breach, protected entries that changed and required ones that are missing."""
    a = before.select(*key, "entry", F.sha2("content", 256).alias("old"))
    b = after.select(*key, "entry", F.sha2("content", 256).alias("new"))
    both = a.join(b, [*key, "entry"], "full")
    breach = F.when(protected & F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")), "changed").when(required & F.col("new").isNull(), "missing")
    return both.withColumn("breach", breach).where(F.col("breach").isNotNull()).select(*key, "entry", "breach")


def latency_average(values: Column) -> Column:
    """Ordered latencies folded: the first starts it, each later one weighs 0.3, those not above 0 are passed over."""
    return F.aggregate(F.filter(values, lambda v: v > 0), F.lit(None).cast("double"), lambda acc, v: F.when(acc.isNull(), v).otherwise(v * EMA_WEIGHT + acc * (1 - EMA_WEIGHT)))


def directories(by_field: DataFrame, by_style: DataFrame, key: list[str], part: str | None = None) -> DataFrame:
    """The keys of paragraphs in directories, told by a field or by their style; part: of the main body only."""
    both = [d.where(F.col(part) == "main") if part else d for d in (by_field, by_style)]
    return both[0].select(*key).union(both[1].select(*key)).distinct()


def in_order_of_place(marks: DataFrame, key: list[str], offset: str = "offset", order: str = "seq") -> DataFrame:
    """Marks with turn, their place among all of a paragraph from 0: by offset, those at one offset as they came."""
    return marks.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(offset, order)) - 1)


def without_directories(paras: DataFrame, directories: DataFrame, key: list[str]) -> DataFrame:
    return paras.join(directories, key, "left_anti")


def newest(rows: DataFrame, most: int, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """The last most rows, in a whole table by a bounded sort, or in each group."""
    if not within:
        return rows.orderBy(*order).limit(most)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def running_progress(layers: DataFrame, key: str, order: str, digest: str, done: str, total: str) -> DataFrame:
    """Percent of a download in layers that never falls: of each event, bytes of all layers seen, the last of each."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(key, digest).orderBy(order)
    steps = layers.withColumns({"_d": F.col(done) - F.coalesce(F.lag(done).over(own), F.lit(0)), "_t": F.col(total) - F.coalesce(F.lag(total).over(own), F.lit(0))})
    now = F.floor(100.0 * F.sum("_d").over(w) / F.sum("_t").over(w))
    return steps.withColumn("_p", now).withColumn("percent", F.max("_p").over(w).cast("long")).drop("_d", "_t", "_p")


def content_counters(elements: DataFrame, key: list[str], kind: str = "kind") -> DataFrame:
    """key and how many comments, foreign parts, directories, charts, diagrams, embedded objects and old drawings a document has."""
    # Counters, and the kinds of elements they count.
    counters = {"comments": ("comment",), "foreign": ("altChunk", "customXml"), "directories": DIRECTORY_FIELDS, "charts": ("chart",), "diagrams": ("diagram",), "objects": ("oleObject",), "drawings": ("vml",)}
    return elements.groupBy(*key).agg(*[F.count_if(F.col(kind).isin(*kinds)).alias(name) for name, kinds in counters.items()])


def resume_baseline(batches: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """key, chars, paragraphs of the batches that a checkpoint (key, prefix) says are done."""
    return batches.join(done, key).where(F.col("batch") < F.col("prefix")).groupBy(*key).agg(F.sum("len").alias("chars"), F.count(F.lit(1)).alias("paragraphs"))


def latency_averages(events: DataFrame, key: str, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """key and the average of its latencies in order, as in latency_average.

    Rows are dealt by ranges of key and order, so a key with many rows lies in
    several tasks, and are folded as they come.  A part's rows after its first
    make of any average v what a * v + b is; a key's parts, of which no task
    has more than one, are put together in their order.  Keys without a latency
    above 0, and rows without a key, are left out.  parts: how many tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made = None, None  # of the key: task, first value, a, b
        names = ["k", "task", "first", "a", "b"]
        for batch in batches:
            done = []
            for k, task, v in zip(batch["k"], batch["task"], batch["v"], strict=True):
                if made is not None and k == now:
                    made[2] *= 1 - EMA_WEIGHT
                    made[3] = v * EMA_WEIGHT + made[3] * (1 - EMA_WEIGHT)
                    continue
                if made is not None:
                    done.append((now, *made))
                now, made = k, [task, v, 1.0, 0.0]
            yield pd.DataFrame(done, columns=names)
        if made is not None:
            yield pd.DataFrame([(now, *made)], columns=names)

    rows = events.where((F.col(value) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    places = ["k", *(f"o{i}" for i in range(len(order)))]
    dealt = (rows.repartitionByRange(*places) if parts is None else rows.repartitionByRange(parts, *places)).sortWithinPartitions(*places)
    kind = events.schema[key].dataType.simpleString()
    folded = dealt.select("k", F.spark_partition_id().alias("task"), "v").mapInPandas(run, f"k {kind}, task int, first double, a double, b double")
    own = F.array_sort(F.collect_list(F.struct("task", "first", "a", "b")))  # one for each task that has rows of the key
    after = lambda acc, x: F.when(acc.isNull(), x["first"]).otherwise(x["first"] * EMA_WEIGHT + acc * (1 - EMA_WEIGHT)) * x["a"] + x["b"]
    return folded.groupBy("k").agg(F.aggregate(own, F.lit(None).cast("double"), after).alias("ema")).select(F.col("k").alias(key), "ema")
