"""The stream forms give what the batch forms give, wherever the triggers' borders are, and keep no state for good."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import pacing as batch_pacing
from palimpsest.streaming import pacing, replay, tokens


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def run_stream(spark, base, schema, slices, build, mode):
    """All that a stream emits over slices, and how many rows of state are left at the end."""
    left = []
    frames = [spark.createDataFrame(rows, schema).coalesce(1) for rows in slices]
    rows = replay.replayed(frames, f"file://{base}", build, mode, left.append).collect()
    return rows, left[-1]


def said(text):
    return f'data: {{"choices":[{{"delta":{{"content":"{text}"}}}}]}}'


LINES = [
    [(1, 0, said("Hel")), (2, 0, '{"message":{"content":"A"},"done":false}')],
    [(1, 1, said("lo")), (1, 2, ": ping"), (2, 1, '{"message":{"content":"b"},"done":true}')],
    [(1, 3, "data: [DONE]"), (1, 4, said("late"))],
    [(1, 5, said("later")), (2, 2, '{"message":{"content":"c"},"done":true}')],
]


def test_finished_requests_stay_finished(spark, tmp_path):
    schema = "request_id int, seq int, line string"
    slices = [[(*x, at(k)) for x in rows] for k, rows in enumerate(LINES)]
    got, _ = run_stream(spark, tmp_path, f"{schema}, at timestamp", slices, tokens.growing, "update")
    assert {(r.request_id, r.text, r.done) for r in got} == {(1, "Hel", False), (2, "A", False), (1, "Hello", False), (2, "Ab", True), (1, "Hello", True)}
    whole = tokens.joined(spark.createDataFrame([x for t in LINES for x in t], schema))
    assert {(r.request_id, r.text, r.done) for r in whole.collect()} == {(1, "Hello", True), (2, "Ab", True)}


def some_events(rng, requests):
    """Requests with late lines, late cancellations, cancellations before any text, and openings that lack; each in order."""
    out = {}
    for k in range(requests):
        chunks, rows = rng.randint(1, 3), []
        if rng.random() < 0.8:
            rows.append(("open", chunks, f"original {k}"))
        else:
            chunks = 1
        for _ in range(chunks):
            rows += [("line", None, said(rng.choice(["a", "**b**", " ", ""]))) for _ in range(rng.randint(0, 3))] + [("line", None, "data: [DONE]")]
        if rng.random() < 0.4:
            rows.insert(rng.randint(1, len(rows)), ("cancel", None, None))
        if rng.random() < 0.5:
            rows += [("line", None, said("late")), ("cancel", None, None)][: rng.randint(1, 2)]
        if rng.random() < 0.2:
            rows = rows[: rng.randint(1, len(rows))]
        out[str(k)] = [(str(k), i, kind, of, line) for i, (kind, of, line) in enumerate(rows)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_requests_over_random_borders(spark, tmp_path, seed):
    rng, slices = random.Random(seed), [[], [], []]
    events = some_events(rng, 40)
    for rows in events.values():
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(2))
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            slices[k] += [(*r, at(k * 5)) for r in rows[a:b]]
    # so long after that all timers have run out, those too that have been set when silent requests were given up
    slices += [[("end", 0, "line", None, "data: [DONE]", at(10**6))], [("last", 0, "line", None, "data: [DONE]", at(2 * 10**6))]]
    schema = f"{tokens.EVENTS}, at timestamp"
    got, left = run_stream(spark, tmp_path, schema, slices, lambda s: tokens.streamed(s, "at"), "update")
    last = {r.request_id: r for r in sorted(got, key=lambda r: r._batch)}
    batch = {r.request_id: r for r in tokens.requests(spark.createDataFrame([x for rows in events.values() for x in rows], tokens.EVENTS)).collect()}
    for k, r in batch.items():
        status = "expired" if r.status == "growing" else r.status
        assert (last[k].chunks, last[k].original, last[k].status) == (r.chunks, r.original, status), k
    assert left == 1  # the last event's own request; all others are forgotten


def test_texts_of_requests(spark):
    rows = [("a", ["**x** ", "y"], "o", "done"), ("b", [" "], "whole", "cancelled"), ("c", [""], None, "cancelled"), ("d", ["", "t"], "o", "cancelled")]
    df = spark.createDataFrame(rows, tokens.RESULTS)
    text = lambda cleaned: {r.request_id: r.t for r in df.select("request_id", tokens.text_of(F.col("chunks"), F.col("original"), F.col("status"), cleaned).alias("t")).collect()}
    assert text(True) == {"a": "xy", "b": "whole", "c": "", "d": "t"} and text(False) == {"a": "**x** y", "b": "whole", "c": "", "d": "t"}


def test_pacing_forgets_idle_keys(spark, tmp_path):
    rng = random.Random(5)
    idle = 60_000
    rows, now = [], {f"k{i}": 0.0 for i in range(12)}
    for i in range(400):
        key = rng.choice(list(now))
        now[key] = max(now[key] + rng.choice([10.0, 500.0, 2_000.0]), i * 100.0) + (100_000.0 if rng.random() < 0.03 else 0.0)
        rows.append((key, i, 1.7e12 + now[key], rng.choice(["success", "throttled"]), rng.choice([None, 2]), rng.choice([None] * 9 + [30.0]), 0.5))
    rows.sort(key=lambda r: r[2])  # each key's order and the clock's
    rows = [(*r[:1], i, *r[2:]) for i, r in enumerate(rows)]
    cuts = sorted(rng.randint(0, len(rows)) for _ in range(2))
    slices = [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :], [("end", 10**6, 1.7e12 + 1e9, "success", None, None, 0.5)]]
    got, left = run_stream(spark, tmp_path, batch_pacing.EVENTS, slices, lambda s: pacing.paced(s, idle_ms=idle, lateness="1 hour"), "append")
    want = batch_pacing.paced(spark.createDataFrame([r for s in slices for r in s], batch_pacing.EVENTS), idle_ms=idle).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(map(tuple, want)) and left == 1
    never = batch_pacing.paced(spark.createDataFrame(rows, batch_pacing.EVENTS)).collect()
    assert sorted(map(tuple, never)) != sorted(tuple(r) for r in want if r.key != "end")


def test_notices_end_by_themselves(spark, tmp_path):
    rng, rows, now = random.Random(6), [], 0.0
    for _ in range(200):
        now += rng.choice([0.0, 1.0, 4.0, 11.999, 12.0, 13.0])
        rows.append((rng.choice("abc"), at(now)))
    cuts = sorted(rng.randint(0, len(rows)) for _ in range(2))
    slices = [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :], [("end", at(now + 10**5))]]
    got, left = run_stream(spark, tmp_path, "k string, ts timestamp", slices, lambda s: pacing.notice_changes(s, "k"), "append")
    want = pacing.changes_of(spark.createDataFrame(rows, "k string, ts timestamp"), "k").collect()
    assert sorted((r.key, r.change, r.at, r.refusals) for r in got if r.key != "end") == sorted(map(tuple, want)) and left == 1


def test_keys_share_states_of_shards(spark, tmp_path):
    """Forty keys in three shards: three rows of state, and what the batch forms say."""
    keys = [f"k{i}" for i in range(40)]
    slices = [[(k, at(i % 5)) for i, k in enumerate(keys)], [(k, at(5 + i % 7)) for i, k in enumerate(keys)]]
    got, left = run_stream(spark, tmp_path / "notices", "k string, ts timestamp", slices, lambda s: pacing.notice_changes(s, "k", shards=3), "append")
    want = pacing.changes_of(spark.createDataFrame([x for s in slices for x in s], "k string, ts timestamp"), "k").where("change = 'shown'").collect()
    assert sorted(r.key for r in got) == sorted(r.key for r in want) == sorted(keys) and left == 3
    slices = [[(k, n, 1.7e12 + n * 100.0 + i, "throttled" if i % 3 else "success", None, None, 0.5) for i, k in enumerate(keys)] for n in range(2)]
    got, left = run_stream(spark, tmp_path / "paced", batch_pacing.EVENTS, slices, lambda s: pacing.paced(s, shards=3), "append")
    want = batch_pacing.paced(spark.createDataFrame([x for s in slices for x in s], batch_pacing.EVENTS)).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(map(tuple, want)) and left == 3


def test_shown_while_they_grow(spark, tmp_path):
    """After each trigger the editor's view of a request; the batch form shows what the last trigger does."""
    rows = [("a", 0, "open", 1, "One cat. Two"), ("a", 1, "line", None, said("One dog")), ("b", 0, "line", None, said("new")), ("a", 2, "line", None, said(". Two")), ("a", 3, "line", None, "data: [DONE]"), ("c", 0, "open", 1, "kept"), ("c", 1, "cancel", None, None)]
    schema = tokens.EVENTS + ", at timestamp"
    slices = [[(*x, at(k)) for x in part] for k, part in enumerate((rows[:3], rows[3:]))]
    got, _ = run_stream(spark, tmp_path, schema, slices, lambda df: tokens.shown(tokens.streamed(df)), "update")
    gone, new = '<span class="diff-deleted">cat</span> ', '<span class="diff-inserted">dog</span>'
    assert [tuple(r[k] for k in ("request_id", "status", "html")) for r in sorted(got, key=lambda r: (r._batch, r.request_id))] == [
        ("a", "growing", f'One <span class="diff-deleted">cat.</span>  {new}'), ("b", "growing", '<span class="diff-inserted">new</span>'),
        ("a", "done", f"One {gone}{new}. Two"), ("c", "cancelled", "kept"),
    ]
    whole = tokens.shown(tokens.requests(spark.createDataFrame([x for part in slices for x in part], schema))).collect()
    assert sorted((r.request_id, r.html) for r in whole) == [("a", f"One {gone}{new}. Two"), ("b", '<span class="diff-inserted">new</span>'), ("c", "kept")]
