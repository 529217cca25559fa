"""The pacer as a stateful stream, and notices of throttling, which end by themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pacing import LIMITS, STATE, STATES, Limits, State, follow

#: A notice stays for so long after the last refusal.
NOTICE_MS = 12_000
NOTICE = f"{NOTICE_MS // 1000} seconds"
#: A key without events for so long is forgotten, in milliseconds.
IDLE_MS = 24 * 3600 * 1000
#: Keys are dealt to so many shards, the same for as long as a stream goes on.  Each holds its share of the keys that aren't over.
SHARDS = 1024

CHANGES = "key string, change string, at timestamp, refusals long"
SHOWN, HIDDEN = "shown", "hidden"


class Sharded(StatefulProcessor):
    """Keys by shards: what is held of a shard's keys is one value, and one timer stands for the key whose time is up first, so what a trigger costs goes by shards and rows, not by keys."""

    #: What is held of each key: fields of a struct, of which the first is the key and the last the time when it is up.
    HELD = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shard = handle.getValueState("shard", f"held array<struct<{self.HELD}>>, timer long")

    def _held(self) -> tuple[dict[str, tuple], int | None]:
        held, timer = self.shard.get() if self.shard.exists() else ([], None)
        return {key: tuple(values) for key, *values in held}, timer

    def _keep(self, held: dict[str, tuple], timer: int | None) -> None:
        """The shard with the timer that it has; a shard of no keys leaves nothing."""
        due = min((values[-1] for values in held.values()), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.shard.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.shard.update(([(key, *values) for key, values in held.items()], due))

    def _up(self, timerValues, expiredTimerInfo) -> dict[str, tuple]:
        """Keys whose time is up, which go."""
        held, timer = self._held()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return {}  # another has been set since
        now = max(timer, timerValues.getCurrentWatermarkInMs())
        self._keep({key: values for key, values in held.items() if values[-1] > now}, None)
        return {key: values for key, values in held.items() if values[-1] <= now}

    def close(self) -> None:
        pass


def _sharded(rows: DataFrame, shards: int):
    return rows.withColumn("_shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("_shard")


class Pacer(Sharded):
    """Keys' pacing states, and when they go."""

    HELD = "key string, " + STATE + ", due long"

    def __init__(self, limits: Limits, idle_ms: int):
        self.limits, self.idle_ms = limits, idle_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        come = pd.concat(rows).sort_values(["key", "seq"])
        states = {k: State(*values[:-1]) for k in come["key"].unique() if (values := held.get(k))}
        out = follow(self.limits, states, come, self.idle_ms)
        now = timerValues.getCurrentWatermarkInMs()
        self._keep(held | {k: (*s, max(int(s.last_ms), now) + self.idle_ms) for k, s in states.items()}, timer)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._up(timerValues, expiredTimerInfo)
        yield from ()


def paced(events: DataFrame, limits: Limits = LIMITS["auto"], idle_ms: int = IDLE_MS, lateness: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """Events in order across triggers to the states after each (append mode; needs the RocksDB state store).

    The state of a key goes when the watermark, which follows ts_ms, is idle_ms
    past its last event; a key that comes after that is as new, here as in
    the batch form.
    """
    timed = events.where("key is not null").withColumn("_at", F.timestamp_millis(F.col("ts_ms").cast("long"))).withWatermark("_at", lateness)
    return _sharded(timed, shards).transformWithStateInPandas(Pacer(limits, idle_ms), STATES, "append", "EventTime")


class Notices(Sharded):
    """Of each notice that is shown, how many refusals there were, the last of them, and when it is hidden."""

    HELD = "key string, refusals long, last long, due long"

    def _out(self, changes: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(changes, columns=["key", "change", "at", "refusals"])
        return out.assign(at=pd.to_datetime(out["at"], unit="ms"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        come = pd.concat(rows).sort_values(["key", "ms"])
        changes = []
        for k, at in zip(come["key"].tolist(), come["ms"].tolist(), strict=True):
            refusals, last, due = held.get(k) or (0, None, None)
            if last is not None and at >= due:
                changes.append((k, HIDDEN, due, refusals))
                last = None
            if last is None:
                changes.append((k, SHOWN, at, 1))
                refusals, last = 0, at
            last = max(at, last)
            held[k] = (refusals + 1, last, last + NOTICE_MS)
        self._keep(held, timer)
        if changes:
            yield self._out(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if up := self._up(timerValues, expiredTimerInfo):
            yield self._out([(k, HIDDEN, due, refusals) for k, (refusals, _, due) in up.items()])


def notice_changes(refusals: DataFrame, key: str, ts: str = "ts", lateness: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """The stream form: CHANGES, a notice shown at its first refusal at once, and hidden when 12 seconds have gone by since the last (append mode; needs the RocksDB state store).  Hidden notices leave no state; times are milliseconds."""
    rows = refusals.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).alias("_at"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms")).withWatermark("_at", lateness)
    return _sharded(rows, shards).transformWithStateInPandas(Notices(), CHANGES, "append", "EventTime")


def changes_of(refusals: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The batch form: CHANGES."""
    w = Window.partitionBy("key").orderBy("ms")
    rows = refusals.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    new = F.coalesce(F.col("ms") >= F.lag("ms").over(w) + NOTICE_MS, F.lit(True)).cast("int")
    rows = rows.withColumn("new", new).withColumn("turn", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = rows.groupBy("key", "turn").agg(F.min("ms").alias("a"), F.max("ms").alias("b"), F.count("*").alias("n"))
    change = lambda kind, at, n: F.struct(F.lit(kind).alias("change"), F.timestamp_millis(at).alias("at"), n.cast("long").alias("refusals"))
    return both.select("key", F.explode(F.array(change(SHOWN, F.col("a"), F.lit(1)), change(HIDDEN, F.col("b") + NOTICE_MS, F.col("n")))).alias("c")).select("key", "c.*")


def notices(refusals: DataFrame, key: str, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """key, started, ended, refusals: runs of refusals with less than 12 seconds between them, told when they are over."""
    rows = refusals.withWatermark(ts, watermark) if watermark else refusals
    w = F.session_window(ts, NOTICE)
    return rows.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("refusals")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "refusals")
