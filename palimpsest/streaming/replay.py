"""Streams run to their end over rows that are handed to them bit by bit."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that processors with timers need; no more partitions of state than cores."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def replayed(slices: Iterable[DataFrame], base: str, build: Callable[[DataFrame], DataFrame], mode: str, state_rows: Callable[[int], None] | None = None) -> DataFrame:
    """What a stream emits that is started anew for each slice, goes on from its checkpoint, and ends when it has read it all; with _batch, the number of the trigger.

    base is a folder that driver and executors share.  Rows of a trigger are
    written under its number, so that one that is run again after a failure
    replaces what it had written.  state_rows is told how many rows of state each
    start has left.
    """
    spark = None
    for rows in slices:
        spark = spark or rows.sparkSession
        rows.write.mode("append").parquet(f"{base}/in")
        stream = build(session(spark).readStream.schema(rows.schema).parquet(f"{base}/in"))
        schema = stream.schema

        def kept(df: DataFrame, number: int) -> None:
            df.write.mode("overwrite").parquet(f"{base}/out/_batch={number}")

        query = stream.writeStream.outputMode(mode).foreachBatch(kept).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        if state_rows and query.lastProgress:
            state_rows(sum(s.numRowsTotal for s in query.lastProgress.stateOperators))
    return spark.read.schema(schema.add("_batch", "long")).parquet(f"{base}/out")


def last_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the rows of its last trigger."""
    values = [c for c in rows.columns if c not in (key, "_batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(key, "v.*")
