"""A run in steps that goes on where it was stopped.

The paragraphs in need of work are written once, packed into batches, dealt to
files by document.  A stream takes so many files a step; each step's answers
are written under its number, which a step that is run again replaces.  What is
committed is the stream's own progress, so a run that is started again asks
only what hasn't been answered: at most the step that broke off is asked twice.
All of it lies under the run's fingerprint: other settings or other inputs
start afresh.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packing import batches, completed_prefix, in_need
from ..sources.sinks import promoted, recovered
from ..streaming.replay import session

Work = Callable[[DataFrame], DataFrame]

RESULTS = "doc_id long, part_kind string, batch int, is_batch boolean, pos int, corrected string"


class Stopped(Exception):
    """The run was asked to stop."""


class Run:
    """A run over paragraphs (doc_id, part_kind, pos, text); path: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, fingerprint: str):
        self.spark, self.base = spark, f"{path.rstrip('/')}/{fingerprint}"

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def prepared(self, paras: DataFrame, files: int) -> None:
        """The work of the run, written when it is started for the first time."""
        recovered(self.spark, f"{self.base}/work")
        if not self._there(f"{self.base}/work"):
            key = ["doc_id", "part_kind"]
            need = in_need(paras)
            packed = need.join(batches(need, key), [*key, "pos"]).select(*key, "batch", "is_batch", "pos", "text")
            promoted(packed.repartition(files, "doc_id"), f"{self.base}/work")

    def work(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/work")

    def results(self) -> DataFrame:
        """RESULTS of all committed steps, with the number of the step."""
        path = f"{self.base}/results"
        if not self._there(path):
            return self.spark.createDataFrame([], f"{RESULTS}, step long")
        return self.spark.read.schema(f"{RESULTS}, step long").parquet(path)

    def start(self, paras: DataFrame, work: Work, files: int = 64, files_a_step: int = 8, stop: Callable[[int], bool] = lambda step: False) -> bool:
        """Runs until all is done, or until stop says so before a step; True when it is done.  work adds corrected to rows that have a text."""
        self.prepared(paras, files)
        own = session(self.spark)
        stream = own.readStream.schema(self.work().schema).option("maxFilesPerTrigger", files_a_step).parquet(f"{self.base}/work")

        def step(rows: DataFrame, number: int) -> None:
            if stop(number):
                raise Stopped
            made = work(rows).select(*(f.split(" ")[0] for f in RESULTS.split(", ")))
            made.write.mode("overwrite").parquet(f"{self.base}/results/step={number}")

        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.base}/progress").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            if "Stopped" in str(e):
                return False
            raise
        return True

    def progress(self) -> DataFrame:
        """doc_id, part_kind, prefix: how many batches from the first on are answered, and total."""
        key = ["doc_id", "part_kind"]
        answered = self.results().where("is_batch").select(*key, "batch").distinct().withColumn("done", F.lit(True))
        flags = self.work().where("is_batch").select(*key, "batch").distinct().join(answered, [*key, "batch"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
        return completed_prefix(flags, key, "batch", "done").join(flags.groupBy(*key).agg(F.count("*").alias("total")), key)

    def output(self, paras: DataFrame) -> DataFrame:
        """paras with corrected: what isn't in need of work or isn't answered yet is as it was."""
        key = ["doc_id", "part_kind", "pos"]
        done = self.results().select(*key, "corrected")
        return paras.join(done, key, "left").withColumn("corrected", F.coalesce("corrected", "text"))
