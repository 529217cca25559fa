"""Where results go: event logs, run state, corrected texts, and what is kept when a step fails."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the event log from which it is turned over, and how many old ones are kept.
LOG_BYTES, LOGS_KEPT = 5 << 20, 3


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def promoted(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Written beside its place and moved there when it is whole.  The old table is moved aside first and deleted last: whatever breaks off in between, one of the two is whole and `recovered` finds it.  A place has one writer at a time: of two promotions at once each could take the other's old table for its own."""
    spark, base = df.sparkSession, path.rstrip("/")
    draft, aside = f"{base}.{uuid.uuid4().hex}", f"{base}.old"
    df.write.format(fmt).save(draft)
    recovered(spark, base)
    fs, target = _fs(spark, base)
    old, new = _fs(spark, aside)[1], _fs(spark, draft)[1]
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        recovered(spark, base)
        raise OSError(f"{draft} can't be moved to {path}")
    fs.delete(old, True)


def recovered(spark: SparkSession, path: str) -> None:
    """Puts a table in its place again that a broken off promotion had moved aside."""
    fs, target = _fs(spark, path.rstrip("/"))
    old = _fs(spark, f"{path.rstrip('/')}.old")[1]
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            fs.rename(old, target)


def log_events(events: DataFrame, path: str) -> None:
    """Events (ts_ms, event, details) appended as JSON lines; a log that has grown too large is turned over first."""
    spark = events.sparkSession
    fs, now = _fs(spark, f"{path}/current")
    if fs.exists(now) and fs.getContentSummary(now).getLength() >= LOG_BYTES:
        for k in range(LOGS_KEPT, 0, -1):
            old, new = (_fs(spark, f"{path}/{x}")[1] for x in ("current" if k == 1 else f"old-{k - 1}", f"old-{k}"))
            if fs.exists(old):
                fs.delete(new, True)
                fs.rename(old, new)
    events.write.mode("append").json(f"{path}/current")


def logged(spark: SparkSession, path: str, schema: str = "event_id long, ts_ms long, event string, details string") -> DataFrame:
    """The lines of the current log and of those that were turned over and are kept."""
    there = [p for p in (f"{path}/{x}" for x in ("current", *(f"old-{k}" for k in range(1, LOGS_KEPT + 1)))) if (lambda fs, x: fs.exists(x))(*_fs(spark, p))]
    return spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)


def salvaged(steps: DataFrame, compared: Column, corrected: Column, error: Column, may_fall_back: Column) -> DataFrame:
    """steps with result and status: what was compared, else the corrected text where that may stand for it, never no row."""
    status = F.when(error.isNull(), "compared").when(may_fall_back, "corrected_only").otherwise("failed")
    result = F.when(error.isNull(), compared).when(may_fall_back, corrected)
    return steps.withColumns({"result": result, "status": status})
