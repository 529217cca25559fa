"""Queries by streams: rows handed over bit by bit, each stream stopped and started again in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pacing
from ..operators.correct import rules
from ..sources import shared, tables
from ..sources.tables import table
from ..streaming import pacing as pacing_stream
from ..streaming import replay
from ..streaming import tokens as token_stream
from . import resumed
from .paragraph_queries import _label_token
from .record_queries import pacing_events
from .registry import PARAS, SQL, query

#: How often a stream is stopped and started again.
TRIGGERS = 3


def _by_trigger(rows: DataFrame, trigger: Column, base: str) -> list[DataFrame]:
    """rows in slices, written once, by the trigger that they are handed over in."""
    rows.withColumn("trigger", trigger.cast("int")).write.partitionBy("trigger").parquet(f"{base}/rows")
    kept = rows.sparkSession.read.parquet(f"{base}/rows")
    return [kept.where(F.col("trigger") == k).drop("trigger") for k in range(TRIGGERS)]


_REQUESTS = """WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n, text FROM conversations),
t AS (SELECT conv_id, string_agg(CASE WHEN conv_id % 3 = 1 AND k > n // 2 THEN '' WHEN conv_id % 3 = 1 AND k = n // 2 THEN left(text, length(text) // 2) ELSE text END, '' ORDER BY k) AS x FROM r GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS request_id, CASE WHEN conv_id % 3 = 1 AND trim(x) = '' THEN 'original ' || conv_id ELSE x END AS text, CASE WHEN conv_id % 3 = 1 THEN 'cancelled' ELSE 'done' END AS status FROM t"""


def _request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as requests, a chunk for each turn in two lines and an end; some are cancelled in the middle; after the end come a line and a cancellation more.  trigger: the turn in which they arrive, each request's with borders of its own."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id")
    c = c.select("conv_id", (F.row_number().over(w.orderBy("turn")) - 1).alias("k"), F.count("*").over(w).cast("int").alias("n"), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    said = lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices"))))
    event = lambda at, kind, line, of=None: F.struct(at.cast("long").alias("seq"), F.lit(kind).alias("kind"), (F.lit(None) if of is None else of).cast("int").alias("of"), line.cast("string").alias("line"))
    at, done = F.col("k") * 30 + 10, F.lit("data: [DONE]")
    turns = F.array(event(at, "line", said(F.left("text", half))), event(at + 10, "line", said(F.substr("text", half + 1))), event(at + 20, "line", done))
    cancel = F.when((F.col("conv_id") % 3 == 1) & (F.col("k") == F.floor(F.col("n") / 2)), F.array(event(at + 5, "cancel", F.lit(None))))
    end = F.col("n") * 30 + 10
    ends = F.when(F.col("k") == 0, F.array(event(F.lit(0), "open", F.concat(F.lit("original "), F.col("conv_id").cast("string")), F.col("n")), event(end, "line", said(F.lit("late"))), event(end + 1, "cancel", F.lit(None))))
    rows = c.select("conv_id", "n", F.explode(F.concat(turns, F.coalesce(cancel, F.array().cast(_EVENTS)), F.coalesce(ends, F.array().cast(_EVENTS)))).alias("e"))
    trigger = F.floor((F.col("e.seq") + F.col("conv_id") % 7 * 4) * TRIGGERS / (end + 30)).cast("int")
    return rows.select(F.col("conv_id").cast("string").alias("request_id"), "e.*", trigger.alias("trigger"))


_EVENTS = "array<struct<seq:long,kind:string,of:int,line:string>>"


def _request_texts(results: DataFrame) -> DataFrame:
    return results.select("request_id", token_stream.text_of(F.col("chunks"), F.col("original"), F.col("status"), cleaned=False).alias("text"), "status")


@query(_REQUESTS)
def request_texts(spark, sf_dir):
    """Requests in chunks, some cancelled, with late lines and late cancellations."""
    return _request_texts(token_stream.requests(_request_events(spark, sf_dir).drop("trigger")))


@query(_REQUESTS)
def streamed_requests(spark, sf_dir):
    """The same events by a stream that is stopped and started again between triggers: each request's last state."""
    base = shared.folder(spark, "requests")
    events = _request_events(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("trigger") * 10))
    slices = _by_trigger(events, F.col("trigger"), base)
    out = replay.replayed(slices, f"{base}/stream", lambda s: token_stream.streamed(s, "at"), "update")
    return _request_texts(replay.last_of_each(out, "request_id"))


@query(SQL["adaptive_pacing"])
def streamed_pacing(spark, sf_dir):
    """The pacer as a stream over the events of adaptive_pacing, by time."""
    base = shared.folder(spark, "pacing")
    rows = pacing_events(spark, sf_dir)
    first, last = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    trigger = F.floor((F.col("ts_ms") - F.lit(first or 0.0)) / F.lit(((last or 0.0) - (first or 0.0) + 1) / TRIGGERS))
    never = 400 * 24 * 3600 * 1000  # the events lie within a year
    return replay.replayed(_by_trigger(rows, trigger, base), f"{base}/stream", lambda s: pacing_stream.paced(s, idle_ms=never), "append").select(*pacing.STATES_COLUMNS)


_CHANGES = """WITH e AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ms, lag(epoch_us(CAST(ts AS TIMESTAMP)) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE event_type = 'error' AND user_id IS NOT NULL),
s AS (SELECT user_id, ms, sum(CASE WHEN p IS NULL OR ms >= p + 12000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM e),
n AS (SELECT user_id, min(ms) AS a, max(ms) + 12000 AS b, count(*) AS n FROM s GROUP BY user_id, k)
SELECT CAST(user_id AS VARCHAR) AS key, 'shown' AS change, make_timestamp_ms(a) AS at, CAST(1 AS BIGINT) AS refusals FROM n UNION ALL SELECT CAST(user_id AS VARCHAR), 'hidden', make_timestamp_ms(b), n FROM n"""


@query(_CHANGES)
def notice_changes(spark, sf_dir):
    """When notices of refusals are shown and hidden."""
    return pacing_stream.changes_of(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id")


@query(_CHANGES)
def streamed_notices(spark, sf_dir):
    """The same by a stream with timers; an event long after all others lets the last timers run out."""
    base = shared.folder(spark, "notices")
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    first, last = rows.agg(F.unix_millis(F.min("ts")), F.unix_millis(F.max("ts"))).first()
    trigger = F.floor((F.unix_millis("ts") - F.lit(first or 0)) / F.lit(((last or 0) - (first or 0) + 1) / TRIGGERS))
    after = rows.limit(0).unionByName(spark.createDataFrame([(-1, (last or 0) + 3_600_000)], "user_id long, ms long").select("user_id", F.timestamp_millis("ms").alias("ts")))
    slices = [*_by_trigger(rows, trigger, base), after]
    return replay.replayed(slices, f"{base}/stream", lambda s: pacing_stream.notice_changes(s, "user_id"), "append").where("key <> '-1'").select("key", "change", "at", "refusals")


@query(f"""WITH {PARAS}, t AS (SELECT *, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS tokens FROM paras),
l AS (SELECT doc_id, pos, text, NOT regexp_full_match(text, '[\\s\\x{{00A0}}]*') AND NOT (NOT regexp_matches(text, '\\p{{L}}') OR (length(trim(text)) <= 32 AND len(tokens) <= 6 AND len(list_filter(tokens, lambda x: NOT {_label_token("x", "len(tokens) > 1")})) = 0)) AS need FROM t)
SELECT doc_id, pos, sha256(CASE WHEN need THEN regexp_replace(regexp_replace(text, '!{{2,}}', '!', 'g'), ' {{2,}}', ' ', 'g') ELSE text END) AS corrected_sha256, CAST(need AS BIGINT) AS asked FROM l""")
def resumed_run(spark, sf_dir):
    """A run over all paragraphs, stopped before its third step and started again: every paragraph in need is asked once."""
    paras = tables.parts(tables.paragraphs(table(spark, sf_dir, "documents")))
    run = resumed.Run(spark, shared.folder(spark, "run"), "one")
    work = lambda rows: rows.withColumn("corrected", rules(F.col("text")))
    run.start(paras, work, files=16, files_a_step=4, stop=lambda step: step >= 2)
    run.start(paras, work)
    asked = run.results().groupBy("doc_id", "pos").agg(F.count("*").alias("asked"))
    return run.output(paras).join(asked, ["doc_id", "pos"], "left").select("doc_id", "pos", F.sha2("corrected", 256).alias("corrected_sha256"), F.coalesce("asked", F.lit(0)).alias("asked"))
