"""The whole run over documents: read, filter, pack, correct, compare, sum up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.correct import Corrector, corrected
from ..operators.packing import in_need
from ..operators.revisions import compared, statistics
from ..sources.tables import paragraphs, table


def revised_paragraphs(docs: DataFrame, corrector: Corrector | None = None, prompt: str = "", mode: str = "correct") -> DataFrame:
    """doc_id, pos, original, corrected, status, ops of every paragraph that needs work."""
    work = corrected(in_need(paragraphs(docs)), corrector, prompt, mode)
    return compared(work.select("doc_id", "pos", F.col("text").alias("original"), "corrected"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents corrected by the built-in rules, with what changed in each."""
    return statistics(revised_paragraphs(table(spark, sf_dir, "documents")), ["doc_id"])
