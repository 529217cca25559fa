"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet in the shared folder and read again as the next stage's docs.  All but
the last return the columns of documents.  Stages judge every row they are
given: rows with null ids or texts, repeated rows and empty tables go through
as the operators of palimpsest.llm define it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decon, langid, pii, simhash
from palimpsest.llm.common import Workspace, read

#: Least score of a language.  It is there for texts in which none of four stands out (chance is 0.25): a clean text of one short word still
#: gets 0.44, the least of 10,000.  Most of what the stage rejects has no letters at all.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found stay; those without text or letters go."""
    return langid.identified(docs, read(spark, sf_dir, "documents"), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least doc_id.  Rows that share an id are judged each by its text."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decon.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked in the texts; n_chars follows the text."""
    return pii.masked(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, digested: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.bpe_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL can't express the language model's decisions or the merges; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            work.drop(before)
        before = docs
    return docs
