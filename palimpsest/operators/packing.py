"""Which paragraphs go out, and how they are packed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_label_only
from ..functions.text import is_blank

#: Limits of a batch, and what each paragraph costs on top of its text.
MOST_CHARACTERS, MOST_PARAGRAPHS, OVERHEAD = 7500, 10, 16


def in_need(paras: DataFrame) -> DataFrame:
    """Paragraphs that aren't blank and aren't bare labels."""
    return paras.where(~is_blank("text") & ~is_label_only("text"))


def first_occurrences(paras: DataFrame, within: list[str], text_col: str = "text", order_col: str = "pos") -> DataFrame:
    """Of equal texts in a scope the first.  Rows are keyed by the text's SHA-256, so they are sorted and compared by digests."""
    first = Window.partitionBy(*within, F.sha2(F.col(text_col), 256)).orderBy(order_col)
    return paras.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def batch_numbers(lengths, most_characters: int = MOST_CHARACTERS, most_paragraphs: int = MOST_PARAGRAPHS) -> list[int]:
    """Batch of each paragraph, greedily: a batch is closed when it is full or the next paragraph would make it too long."""
    out, batch, n, chars = [], -1, 0, 0
    for length in lengths:
        if batch < 0 or n >= most_paragraphs or chars + length + OVERHEAD > most_characters:
            batch, n, chars = batch + 1, 1, length
        else:
            n, chars = n + 1, chars + length + OVERHEAD
        out.append(batch)
    return out


def batches(paras: DataFrame, key: list[str], most_characters: int = MOST_CHARACTERS, most_paragraphs: int = MOST_PARAGRAPHS) -> DataFrame:
    """key, pos, len, batch, is_batch: paragraphs too long for any batch go alone and are numbered apart.  Only places and lengths are shuffled; the fold takes one step for each paragraph."""

    @F.pandas_udf("array<int>")
    def fold(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: batch_numbers(x, most_characters, most_paragraphs))

    sized = paras.select(*key, "pos", F.length("text").alias("len"))
    packed = sized.where(F.col("len") <= most_characters).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("items"))
    numbered = packed.withColumn("batches", fold(F.col("items.len")))
    small = numbered.select(*key, F.explode(F.arrays_zip("items", "batches")).alias("x")).select(*key, "x.items.pos", "x.items.len", F.col("x.batches").alias("batch"), F.lit(True).alias("is_batch"))
    alone = sized.where(F.col("len") > most_characters).withColumn("batch", F.row_number().over(Window.partitionBy(*key).orderBy("pos")) - 1).withColumn("is_batch", F.lit(False))
    return small.unionByName(alone)


def completed_prefix(flags: DataFrame, key: list[str], order_col: str, done_col: str) -> DataFrame:
    """key, prefix: how many units from the first on are done without a gap."""
    missing = F.min(F.when(~F.col(done_col), F.col(order_col)))
    return flags.groupBy(*key).agg(F.coalesce(missing, F.max(order_col) + 1).cast("long").alias("prefix"))


def progress(parts: DataFrame, order_col: str, weight_col: str, done: Column, total: Column) -> DataFrame:
    """parts with percent: where its part starts, and its share of the part's weight, held under the next one's start."""
    before = F.coalesce(F.sum(weight_col).over(Window.partitionBy("doc_id").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    exact = F.bround(before + F.col(weight_col) * (done / total))
    return parts.withColumn("percent", F.greatest(before, F.least(exact, before + F.col(weight_col) - 1)).cast("long"))


def minutes_left(elapsed: Column, percent: Column) -> Column:
    """Whole minutes, at least 1; null before 3 and from 100 percent on."""
    return F.when((percent >= 3) & (percent < 100), F.greatest(F.lit(1), F.floor(elapsed * (100 - percent) / percent / 60 + 0.5))).cast("long")


def parallelism(latency_ms: Column, interval_ms: Column, most: Column) -> Column:
    return F.when(interval_ms <= 0, most).when(latency_ms <= 0, F.lit(1)).otherwise(F.least(most, F.greatest(F.lit(1), F.ceil(latency_ms / interval_ms)))).cast("long")
