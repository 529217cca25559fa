"""Replies that come in pieces: server-sent events and JSON lines, joined as they grow.

A request is a state machine.  It may be opened with its original text and the
number of chunks that it is asked in; each chunk's reply comes in lines, the
last of which ends the chunk; the last chunk's end or a cancellation ends the
request.  What comes after the end changes nothing.  A cancelled request has
what had come by then, or its original text where that is blank.

The batch form (`requests`) and the stream form (`streamed`) say the same.  The
stream form remembers an ended request for a while, so that late lines find it
ended, and then forgets it; a request that falls silent is given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.growth import editor_diff, editor_html
from ..functions.replies import editor_markdown_stripped
from ..functions.text import is_blank

DONE = "[DONE]"
OPEN, LINE, CANCEL = "open", "line", "cancel"
GROWING, ENDED, CANCELLED, GIVEN_UP = "growing", "done", "cancelled", "expired"
#: of: an opening's number of chunks; line: a line, or an opening's original text.
EVENTS = "request_id string, seq long, kind string, of int, line string"
RESULTS = "request_id string, chunks array<string>, original string, status string"

#: How long a request may be silent, and how long an ended one is remembered, in milliseconds.
IDLE_MS, REMEMBERED_MS = 10 * 60_000, 60 * 60_000


def delta(line: Column) -> Column:
    """The text that a line adds: of an event line "data: {...}", or of a JSON line; null where it adds none."""
    body = F.when(line.startswith("data: "), F.trim(F.substr(line, F.lit(7)))).when(line.startswith("{"), line)
    text = F.coalesce(*[F.get_json_object(body, p) for p in ("$.choices[0].delta.content", "$.choices[0].text", "$.message.content")])
    return F.when(body != DONE, text)


def is_last(line: Column) -> Column:
    return F.coalesce((F.trim(line) == f"data: {DONE}") | (F.get_json_object(line, "$.done") == "true"), F.lit(False))


def joined(lines: DataFrame, key: str = "request_id", order: str = "seq") -> DataFrame:
    """request_id, text, done of whole requests of one chunk; what follows the last line of one doesn't count."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    live = lines.withColumn("_over", F.coalesce(F.max(is_last(F.col("line")).cast("int")).over(w), F.lit(0))).where("_over = 0")
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(delta(F.col("line")), F.lit("")).alias("t"))))
    return live.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"), F.max(is_last(F.col("line"))).alias("done"))


def events_of(lines: DataFrame, key: str = "request_id", order: str = "seq") -> DataFrame:
    """Lines of requests of one chunk as EVENTS, with their other columns."""
    rest = [c for c in lines.columns if c not in (key, order, "line")]
    return lines.select(F.col(key).cast("string").alias("request_id"), F.col(order).cast("long").alias("seq"), F.lit(LINE).alias("kind"), F.lit(None).cast("int").alias("of"), "line", *rest)


def _read(events: DataFrame, *more: str) -> DataFrame:
    """Events with what their lines say."""
    line = F.when(F.col("kind") == LINE, F.col("line"))
    return events.where("request_id is not null").select("request_id", "seq", "kind", "of", F.when(F.col("kind") == OPEN, F.col("line")).alias("original"), delta(line).alias("t"), is_last(line).alias("last"), *more)


def text_of(chunks: Column, original: Column, status: Column, cleaned: bool = True) -> Column:
    """A request's text: its chunks' replies, each cleaned for itself."""
    parts = F.transform(chunks, editor_markdown_stripped) if cleaned else chunks
    whole = F.array_join(parts, "")
    return F.when((status == CANCELLED) & is_blank(whole), F.coalesce(original, F.lit(""))).otherwise(whole)


def requests(events: DataFrame) -> DataFrame:
    """The batch form: EVENTS to RESULTS, a row for each request, in the order of seq.

    Windows are of one request each; a request's chunks are joined before they
    are gathered.
    """
    w = Window.partitionBy("request_id").orderBy("seq")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _read(events).withColumns({"of": F.coalesce(F.last("of", ignorenulls=True).over(upto), F.lit(1)), "chunk": F.coalesce(F.sum(F.col("last").cast("int")).over(before), F.lit(0))})
    end = F.when(F.col("kind") == CANCEL, CANCELLED).when(F.col("last") & (F.col("chunk") + 1 >= F.col("of")), ENDED)
    rows = rows.withColumn("end", end)
    rows = rows.withColumn("over", F.coalesce(F.max(F.col("end").isNotNull().cast("int")).over(before), F.lit(0))).where("over = 0")
    pieces = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("seq", "t"))))
    chunks = rows.groupBy("request_id", "chunk").agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("t"), F.max_by("original", F.when(F.col("original").isNotNull(), F.col("seq"))).alias("original"), F.max("end").alias("end"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "t"))), lambda c: c["t"])
    out = chunks.groupBy("request_id").agg(text.alias("chunks"), F.max_by("original", F.when(F.col("original").isNotNull(), F.col("chunk"))).alias("original"), F.coalesce(F.max("end"), F.lit(GROWING)).alias("status"))
    return out.withColumn("chunks", F.when((F.size("chunks") > 1) & (F.element_at("chunks", -1) == "") & (F.col("status") != ENDED), F.slice("chunks", 1, F.size("chunks") - 1)).otherwise(F.col("chunks")))


class Requests(StatefulProcessor):
    """State of a request: its replies by chunk, how many chunks there are, its original text, its status, and the timer that is set."""

    STATE = "chunks array<string>, of int, original string, status string, timer long"

    def __init__(self, idle_ms: int, remembered_ms: int):
        self.idle_ms, self.remembered_ms = idle_ms, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", self.STATE)

    def _kept(self, state: tuple, timer: int | None, after: int) -> None:
        """The state with another timer; none of a request is left without one."""
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(after)
        self.request.update((*state, after))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = pd.concat(rows).sort_values("seq", kind="stable")
        chunks, of, original, status, timer = self.request.get() if self.request.exists() else ([], 1, None, GROWING, None)
        if status != GROWING:
            return  # ended: what comes late changes nothing, nor does it keep the request remembered
        chunks = list(chunks)
        for r in come.itertuples(index=False):
            if r.kind == OPEN:
                of, original = (of if pd.isna(r.of) else int(r.of)), r.original if isinstance(r.original, str) else original
            elif r.kind == CANCEL:
                status = CANCELLED
            else:
                if not chunks:
                    chunks = [""]
                if isinstance(r.t, str):
                    chunks[-1] += r.t
                if r.last:
                    status = ENDED if len(chunks) >= of else GROWING
                    if status == GROWING:
                        chunks.append("")
            if status != GROWING:
                break
        now = max(int(come["at"].max().value // 1_000_000), timerValues.getCurrentWatermarkInMs())
        self._kept((chunks, of, original, status), timer, now + (self.idle_ms if status == GROWING else self.remembered_ms))
        yield self._row(key, chunks, original, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.request.exists():
            return
        chunks, of, original, status, timer = self.request.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return  # another has been set since
        if status != GROWING:
            self.request.clear()
            return
        self._kept((list(chunks), of, original, GIVEN_UP), None, timerValues.getCurrentWatermarkInMs() + self.remembered_ms)
        yield self._row(key, list(chunks), original, GIVEN_UP)

    @staticmethod
    def _row(key, chunks: list[str], original, status: str) -> pd.DataFrame:
        kept = chunks[:-1] if len(chunks) > 1 and not chunks[-1] and status != ENDED else chunks or [""]
        return pd.DataFrame({"request_id": [key[0]], "chunks": [kept], "original": [original], "status": [status]})

    def close(self) -> None:
        pass


def streamed(events: DataFrame, at: str = "at", lateness: str = "1 minute", idle_ms: int = IDLE_MS, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """The stream form: after each trigger, RESULTS of the requests that changed (update mode; needs the RocksDB state store).

    Events of a request come in order of seq across triggers.  Silence and
    remembering are measured by the column at, behind a watermark.  A request without an event for idle_ms is given
    up, with the text that it has; remembered_ms after its end its state goes,
    so no state stays for good.
    """
    rows = _read(events.withWatermark(at, lateness), F.col(at).alias("at"))
    return rows.groupBy("request_id").transformWithStateInPandas(Requests(idle_ms, remembered_ms), RESULTS, "update", "EventTime")


def growing(lines: DataFrame, key: str = "request_id", order: str = "seq", at: str = "at") -> DataFrame:
    """request_id, text, done after each trigger of the requests of one chunk that grew."""
    out = streamed(events_of(lines, key, order), at)
    kind = lines.schema[key].dataType
    return out.select(F.col("request_id").cast(kind).alias("request_id"), F.array_join("chunks", "").alias("text"), (F.col("status") == ENDED).alias("done"))


def shown(results: DataFrame) -> DataFrame:
    """request_id, status, html of RESULTS, of a batch or after each trigger: what an editor shows, the original, up to its last sentence end while the request grows, against the reply so far.  A request without an original has an empty one."""
    original, status = F.coalesce("original", F.lit("")), F.col("status")
    cut = F.regexp_extract(original, r"(?sU)^.*[.!?](?:\s|\z)", 0)
    old = F.when((status == GROWING) & (cut != ""), cut).otherwise(original)
    return results.select("request_id", "status", editor_html(editor_diff(old, text_of(F.col("chunks"), F.col("original"), status))).alias("html"))
