"""Diffs, packing, alignment, revisions, pacing, lookups."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import diff as d
from palimpsest.operators import align, audit, correct, fields, lookup, packing, pacing, revisions
from palimpsest.plans import settings as run_settings

TOKENS = st.lists(st.sampled_from("abcd "), max_size=18)


def plain_diff(a, b):
    n, m = len(a), len(b)
    dp = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            dp[i][j] = dp[i + 1][j + 1] + 1 if a[i] == b[j] else max(dp[i + 1][j], dp[i][j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(("equal", a[i]))
            i, j = i + 1, j + 1
        elif dp[i + 1][j] >= dp[i][j + 1]:
            out.append(("delete", a[i]))
            i += 1
        else:
            out.append(("insert", b[j]))
            j += 1
    return out + [("delete", t) for t in a[i:]] + [("insert", t) for t in b[j:]]


@settings(max_examples=400, deadline=None)
@given(TOKENS, TOKENS)
def test_diff_is_the_table_walk(a, b):
    assert d.diff(a, b) == plain_diff(a, b)


def test_large_input_falls_back():
    a, b = ["s"] + list("ab") * 1000 + ["e"], ["s"] + list("cd") * 1000 + ["e"]
    ops = d.merged(d.diff(a, b))
    assert [k for k, _ in ops] == ["equal", "delete", "insert", "equal"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab c", max_size=8), min_size=1, max_size=4), st.text("abc d", max_size=24))
def test_write_back_keeps_the_text(runs, corrected):
    out = d.write_back(runs, corrected)
    assert len(out) == len(runs)
    assert "".join(out) == corrected  # nothing is lost, wherever it was put in


def test_write_back_keeps_runs_at_words():
    assert d.write_back(["Hello ", "bold", " world"], "Hello brave bold worlds") == ["Hello ", "brave bold", " worlds"]
    assert d.write_back(["alpha beta gamma"], "New alpha beta gamma") == ["New alpha beta gamma"]
    assert d.write_back(["alpha ", "beta"], "New alpha beta") == ["New alpha ", "beta"]
    assert d.write_back(["on", "ly this"], "only that", [True, False]) == ["on", "ly that"] and d.write_back(["on", "ly this"], "only that") == ["only", " that"]
    assert d.write_back(["", ""], "text") == ["text", ""] and d.write_back(["gone"], "") == [""]


def test_places():
    parts = d.pieces("the old cat", "the very old dog")
    assert sum(x for _, x, _ in parts) == 11 and sum(y for *_, y in parts) == 16
    assert d.places(parts, [0, 3, 11]) == [0, 3, 16]
    assert d.places(d.pieces("abcd", "xyabcd"), [0, 1, 4]) == [2, 3, 6]  # what is put in lies before
    assert d.places([(False, 4, 2)], [0, 1, 2, 3, 4]) == [0, 0, 1, 2, 2]
    assert d.likeness("", "") == 1 and d.likeness("abcd", "abxd") == 0.75 and d.likeness("a", "") == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=30))
def test_batches(lengths):
    got = packing.batch_numbers(lengths, 100, 4)
    assert got == sorted(got) and len(got) == len(lengths)
    for b in set(got):
        own = [n for n, k in zip(lengths, got, strict=True) if k == b]
        assert len(own) <= 4 and (len(own) == 1 or sum(own) + packing.OVERHEAD * (len(own) - 1) <= 100)


def test_alignment():
    asked = ["the red house stands here", "a blue boat sails away", "green grass grows tall"]
    assert align.aligned(["an unrelated remark"] + asked, asked) == [1, 2, 3]
    assert align.aligned([asked[0], asked[2]], asked) == [0, -1, 1]
    assert align.aligned(["entirely different words"], asked[:2]) == [-1, -1]
    assert align.aligned([], asked) == [-1] * 3


def test_answered_statuses(spark):
    rows = [(1, ["aa bb", "cc dd"], "aa bc\n\ncc de"), (2, ["aa bb cc", "dd ee ff"], "dd ee fg"), (3, ["aa", "bb"], "zz"), (4, ["aa"], ""), (5, ["aa"], None)]
    got = align.answered(spark.createDataFrame(rows, "id int, asked array<string>, reply string"), ["id"]).collect()
    assert {(r.id, r.item): (r.status, r.corrected) for r in got} == {
        (1, 0): ("ok", "aa bc"), (1, 1): ("ok", "cc de"), (2, 0): ("partial", None), (2, 1): ("partial", "dd ee fg"), (3, 0): ("count_mismatch", None), (3, 1): ("count_mismatch", None), (4, 0): ("empty", None), (5, 0): ("empty", None),
    }


@pytest.mark.parametrize(
    ("reply", "original", "chosen"),
    [("One line", "x", "One line"), ("The answer here\n\nHope that helps", "The anser here", "The answer here"), ("Sure!\n\nThe answer is this one", "The anser is this one", "The answer is this one"), ("\n\nText", "x", None), ("The quick\nbrown fox", "The quick brown fox", "The quick brown fox"), ("a\n", "a", "a")],
)
def test_block_selection(reply, original, chosen):
    assert align.select_block(reply, original) == chosen


def test_corrector_run(spark):
    rows = [(1, 0, "Wrogn text here."), (1, 1, "Fine."), (2, 0, "Wrogn text here."), (2, 1, "Keep me as I am, please do")]
    paras = spark.createDataFrame(rows, "doc_id int, pos int, text string")
    asked = correct.scripted({"Wrogn text here.": "**Wrong** text here.", "Keep me as I am, please do": "No"})
    got = {(r.doc_id, r.pos): r.corrected for r in correct.corrected(paras, asked).collect()}
    assert got == {(1, 0): "Wrong text here.", (1, 1): "Fine.", (2, 0): "Wrong text here.", (2, 1): "Keep me as I am, please do"}


def test_retries():
    def service(*answers):
        """Answers or errors, one after the other; the last for good."""
        left, calls, waits = list(answers), [], []

        def ask(prompts, texts):
            calls.append(len(texts))
            now = left.pop(0) if len(left) > 1 else left[0]
            if isinstance(now, Exception):
                raise now
            return [t.upper() for t in texts]

        got = correct.with_retries(ask, wait=waits.append)
        return (lambda *texts: got(["p"] * len(texts), list(texts))), calls, waits

    no, broken = correct.Throttled(), OSError()
    ask, calls, waits = service(broken, broken, "ok")
    assert ask("t") == ["T"] and calls == [1, 1, 1] and waits == []
    ask, calls, _ = service(broken)
    assert ask("t") == [None] and calls == [1] * 3
    ask, calls, waits = service(no, correct.Throttled(7), "ok")
    assert ask("a", "b") == ["A", "B"] and calls == [2, 2, 2] and waits == [0.5, 7]
    ask, calls, _ = service(no)
    assert ask("a", "b") == [None, None] and calls == [2] * 3  # refusals don't send a batch's texts one by one
    ask, calls, _ = service(no)
    assert ask("a") == [None] and calls == [1] * 20
    ask, calls, _ = service(broken, "ok")
    assert ask("a", "b") == ["A", "B"] and calls == [2, 1, 1]
    ask, calls, _ = service(broken, no, "ok", broken)
    assert ask("a", "b") == ["A", None] and calls == [2, 1, 1, 1, 1, 1]


def entries(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id int, seq int, kind string, token string")


def test_nbsp_restored(spark):
    nb = " "
    rows = entries(spark, ("delete", f"a{nb}b"), ("insert", "a b"), ("delete", f"a{nb}"), ("insert", "a "), ("delete", f"c{nb}"), ("equal", "x"), ("insert", "d "), ("delete", f"d{nb}"), ("delete", f"e{nb}f"), ("insert", "e g"))
    got = [(r.kind, r.token) for r in revisions.nbsp_restored(rows, ["doc_id"]).orderBy("seq").collect()]
    assert got == [("equal", f"a{nb}b"), ("equal", f"a{nb}"), ("delete", f"c{nb}"), ("equal", "x"), ("equal", f"d{nb}"), ("delete", f"e{nb}f"), ("insert", "e g")]
    again = revisions.nbsp_restored(revisions.nbsp_restored(rows, ["doc_id"]), ["doc_id"])
    assert [(r.kind, r.token) for r in again.orderBy("seq").collect()] == got


def test_nbsp_restored_sorts_once(spark):
    plan = revisions.nbsp_restored(entries(spark, ("delete", "a"), ("insert", "b")), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_trailing_spaces(spark):
    rows = entries(spark, ("delete", " "), ("equal", "word"), ("insert", " "), ("equal", " "), ("delete", "  "))
    got = [(r.kind, r.token) for r in revisions.trailing_spaces_rejected(rows, ["doc_id"]).orderBy("seq").collect()]
    assert got == [("delete", " "), ("equal", "word"), ("equal", " "), ("equal", "  ")]


def walked(events: list[tuple]) -> list[int]:
    """(para, kind, text) in order to the paragraphs in a directory field, one event after the other."""
    found, stack = set(), []  # of (paragraph it began in, instruction so far, whether a directory)
    for para, kind, text in events:
        if kind == "paragraph":
            if any(f[2] for f in stack):
                found.add(para)
        elif kind == "begin":
            stack.append([para, "", False])
        elif kind == "code" and stack and not stack[-1][2]:
            top = stack[-1]
            top[1] += text or ""
            word = top[1].lstrip()
            cut = min((word.find(c) for c in ' \\"\t' if c in word), default=-1)
            if cut >= 0 and word[:cut].upper() in fields.DIRECTORY_FIELDS:
                top[2] = True
                found.add(top[0])
        elif kind == "end":
            if not stack:
                return []
            stack.pop()
    return [] if stack else sorted(found)


def test_directory_walk():
    w = walked
    toc = [(1, "paragraph", None), (2, "paragraph", None), (2, "begin", None), (2, "code", ' TOC \\o "1-3"'), (3, "paragraph", None), (3, "begin", None), (3, "code", "PAGEREF x "), (3, "end", None), (4, "paragraph", None), (4, "end", None), (5, "paragraph", None)]
    assert w(toc) == [2, 3, 4]
    assert w(toc[:-2]) == []  # never closed
    assert w([(1, "paragraph", None), (1, "end", None)]) == []
    assert w([(1, "paragraph", None), (1, "begin", None), (1, "code", " T"), (1, "code", "OC "), (2, "paragraph", None), (2, "end", None)]) == [1, 2]


def test_directories_in_stretches(spark):
    """Random events of documents, one of which has a third of all, against the plain walk; null keys are a document too."""
    rng, rows, asked = random.Random(7), [], {}
    for doc in [None, *range(200)]:
        events, depth, para = [], 0, 0
        for seq in range(rng.choice([0, 3, 12, 40]) if doc != 5 else 600):
            k = rng.choice(["paragraph", "paragraph", "begin", "code", "code", "end"])
            if k == "end" and not depth and rng.random() < 0.98:
                k = "paragraph"
            depth, para = depth + (k == "begin") - (k == "end"), para + (k == "paragraph")
            events.append((seq, para, k, rng.choice([" T", "OC ", "toc\\x", "IN", "DEX", '"', "", None, "PAGE ", "TOA\t"]) if k == "code" else None))
        events += [(len(events) + i, para, "end", None) for i in range(depth if rng.random() < 0.9 else 0)]
        asked[doc] = walked([e[1:] for e in events])
        rows += [(doc, *e) for e in events]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc int, seq long, para int, kind string, text string")
    for width in (4, 1 << 14):
        got = {}
        for r in fields.directory_paragraphs(df, ["doc"], width).collect():
            got.setdefault(r.doc, []).append(r.para)
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in asked.items() if v}
    assert sum(map(bool, asked.values())) > 15 and fields.directory_paragraphs(df.limit(0), ["doc"]).collect() == []


def test_documents_without_whole_fields_are_not_ordered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fields.shared, "folder", lambda *_: str(tmp_path))
    rows = [(doc, 0, 1, "paragraph", None) for doc in range(50)] + [(1, 1, 1, "begin", None), (2, 1, 1, "begin", None), (2, 2, 1, "code", "TOC "), (2, 3, 1, "end", None), (3, 1, 1, "end", None)]
    df = spark.createDataFrame(rows, "doc int, seq long, para int, kind string, text string")
    assert fields.directory_paragraphs(df, ["doc"]).collect() == [(2, 1)]
    assert [r.doc for r in spark.read.parquet(f"{tmp_path}/steps").select("_key.doc").distinct().collect()] == [2]


AUTO = pacing.LIMITS["auto"]


def events_of(limits, state, *events):
    starts = []
    for e in events:
        state, start = pacing.step(limits, state, pacing.Event(*e) if isinstance(e, tuple) else e)
        starts.append(start)
    return state, starts


def test_pacing_plateaus_over_the_servers_limit():
    """A server takes one request in 1000 ms; the last hundred of 400 requests meet few refusals."""
    state, now, free_at, refused = pacing.first(AUTO), 0.0, 0.0, []
    for _ in range(400):
        ok = now >= free_at
        if ok:
            free_at = now + 1000
        refused.append(not ok)
        state, now = pacing.step(AUTO, state, pacing.Event(now, "success" if ok else "throttled"))
    assert sum(refused[-100:]) <= 5 and 1000 <= state.interval_ms <= 2000


def test_pacing_rules():
    ok = [(1e6, "success")]
    s, _ = events_of(AUTO, pacing.first(AUTO), (0, "throttled"), (10, "throttled"))  # the second is of the same burst
    assert (s.interval_ms, s.learned_ms) == (1000, 1000)
    s, starts = events_of(AUTO, s, (2000, "throttled", 5))
    assert s.interval_ms == 2000 and starts == [7000]
    s, _ = events_of(AUTO, s, *ok * 19)
    assert s.interval_ms == 2000
    s, _ = events_of(AUTO, s, *ok)
    assert s.interval_ms == 1850
    s, _ = events_of(AUTO, s, *ok * 400)
    assert 0 < s.interval_ms < 1850
    stated, _ = events_of(AUTO, pacing.first(AUTO), (0, None, None, 60.0))
    assert stated.interval_ms == 1050
    stated, _ = events_of(AUTO, stated, (0, "throttled"))
    assert (stated.interval_ms, stated.learned_ms) == (1575, 0)
    assert events_of(AUTO, stated, *ok * 5)[0].interval_ms == 1050
    by_hand = pacing.manual(60)
    s, _ = events_of(by_hand, pacing.first(by_hand), (0, "throttled"))
    assert s.interval_ms == 2000 and events_of(by_hand, s, *ok * 200)[0].interval_ms == 1000
    assert events_of(by_hand, s, (1e6, None, None, 1.0))[0].stated_ms == 0  # what a service states doesn't count here
    assert pacing.first(pacing.manual(None)).interval_ms == 0 and events_of(pacing.manual(None), pacing.State(0.0), (0, "throttled"))[0].interval_ms == 250
    seeded = pacing.first(AUTO, 1000)
    assert {round(events_of(AUTO, seeded, (0, None, None, None, j))[0].free_ms) for j in (0, 1)} == {750, 1250}
    assert pacing.first(AUTO, 1e9).interval_ms == 15_000
    local = pacing.LIMITS["local"]
    assert events_of(local, pacing.first(local), (5, "throttled"), (6, None)) == (pacing.first(local), [5, 6])
    floor, _ = events_of(AUTO, pacing.State(2000.0, 2000.0), *ok * 20)
    assert floor.interval_ms == 1850 and events_of(AUTO, floor, *ok * 20)[0].interval_ms == 1700


def test_paced_is_step_by_step(spark):
    rng = random.Random(1)
    rows = [(f"k{k}", i, float(i * 400), rng.choice(["success", "success", "throttled"]), rng.choice([None, 2]), rng.choice([None] * 9 + [30.0]), 0.5) for k in range(3) for i in range(60)]
    got = {(r.key, r.seq): (r.interval_ms, r.slot_ms) for r in pacing.paced(spark.createDataFrame(rows + [(None, 0, 0.0, "success", None, None, 0.5)], pacing.EVENTS)).collect()}
    assert len(got) == 180
    for k in range(3):
        s = pacing.first(AUTO)
        for r in [r for r in rows if r[0] == f"k{k}"]:
            s, start = pacing.step(AUTO, s, pacing.Event(*r[2:]))
            assert got[(r[0], r[1])] == (s.interval_ms, start)


def test_parallelism(spark):
    rows = [(3000.0, 1000.0, 8, 3), (3000.0, 3000.0, 8, 1), (30000.0, 1000.0, 8, 8), (3000.0, 0.0, 8, 8), (0.0, 1000.0, 8, 1)]
    df = spark.createDataFrame(rows, "l double, i double, m int, e int")
    assert all(r.v == r.e for r in df.select("e", packing.parallelism(F.col("l"), F.col("i"), F.col("m")).alias("v")).collect())


def test_completed_prefix(spark):
    rows = [(1, 0, True), (1, 1, False), (1, 2, True), (2, 0, True), (2, 1, True), (3, 0, False)]
    got = packing.completed_prefix(spark.createDataFrame(rows, "k int, i int, done boolean"), ["k"], "i", "done")
    assert {r.k: r.prefix for r in got.collect()} == {1: 1, 2: 2, 3: 0}


def test_each_text_is_worked_on_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(prompts, texts):
        seen.add(len(texts))
        return texts

    paras = spark.createDataFrame([(i, 0, t) for i, t in enumerate("ARBRA")], "doc_id int, pos int, text string")
    assert lookup.once_each(paras, "text", lambda x: correct.replies(x, count, "").select("_key", F.col("reply").alias("corrected"))).count() == 5
    assert seen.value == 3


def test_settings(monkeypatch):
    s = run_settings.from_json('{"chunkChars": 9, "batchParagraphs": 1e9, "parallel": "x", "requestsPerMinute": 0, "citationStyle": "odd", "extra": 1}')
    assert (s.chunk_chars, s.batch_paragraphs, s.parallel, s.requests_per_minute, s.citation_style) == (500, 100, 4, None, "auto")
    for bad in ('{"mode": "dance"}', '{"mode": "translate"}', '{"scope": ["attic"]}'):
        with pytest.raises(ValueError):
            run_settings.from_json(bad)
    monkeypatch.setenv("SOME_KEY", "k")
    assert run_settings.from_json('{"apiKey": "ENV:SOME_KEY"}').key == "k"


def test_segments():
    from palimpsest.operators.segments import dealt, nearest_boundary

    assert dealt([10, 20], "one two three four five six") == ["one two ", "three four five six"]
    assert dealt([0, 0], "abc") == ["", "abc"] and dealt([5], "abc") == ["abc"]
    assert nearest_boundary("hello world", 8) == 6 and nearest_boundary("hello world", 9) == 11 and nearest_boundary("ab", 0) == 0
    for lengths in ([1, 2, 3], [9, 0, 1], [1] * 6):
        assert "".join(dealt(lengths, "a bb ccc dddd")) == "a bb ccc dddd"


def test_sinks(spark, tmp_path, monkeypatch):
    from palimpsest.sources import sinks

    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        sinks.promoted(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    (tmp_path / "t").rename(tmp_path / "t.old")  # a promotion that broke off
    sinks.recovered(spark, path)
    assert spark.read.parquet(path).count() == 5
    sinks.promoted(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.old").exists()
    monkeypatch.setattr(sinks, "LOG_BYTES", 1)
    log = f"file://{tmp_path}/log"
    for i in range(6):
        sinks.log_events(spark.createDataFrame([(i, "e", {"k": "v"})], "ts_ms long, event string, details map<string,string>"), log)
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["current", "old-1", "old-2", "old-3"]
    assert [spark.read.json(f"{log}/{p}").first().ts_ms for p in ("current", "old-1", "old-3")] == [5, 4, 2]


def test_latency_averages(spark):
    rows = [(k, i, v) for k in (1, 2, None) for i, v in enumerate([4.0, 0.0, 2.0, -1.0, 10.0])] + [(3, 0, 0.0)]
    got = audit.latency_averages(spark.createDataFrame(rows, "k int, i int, v double"), "k", ["i"], "v").collect()
    want = spark.createDataFrame([([4.0, 0.0, 2.0, -1.0, 10.0],)], "vs array<double>").select(audit.latency_average(F.col("vs")).alias("v")).first().v
    assert {r.k: round(r.ema, 9) for r in got} == {1: round(want, 9), 2: round(want, 9)} and round(want, 9) == round((4 * 0.7 + 2 * 0.3) * 0.7 + 3, 9)


def test_deadline(spark):
    from palimpsest.plans.deadline import within

    assert within(spark, 60, lambda: spark.range(3).count()) == 3
    with pytest.raises(TimeoutError):
        within(spark, 1.0, lambda: spark.range(4 * 10**10).selectExpr("sum(sqrt(id))").collect())
    with pytest.raises(ValueError):
        within(spark, 60, lambda: int("x"))
    assert spark.range(3).count() == 3


def test_scope(spark):
    from palimpsest.sources.tables import scoped

    rows = spark.createDataFrame([(1, "main"), (2, "headers")], "doc_id int, part_kind string")
    assert [r.doc_id for r in scoped(rows, ["main"]).collect()] == [1]
    with pytest.raises(ValueError):
        scoped(rows, ["footnotes"])


def test_revision_runs():
    ops = [("equal", "ab"), ("delete", "cd"), ("insert", "XY"), ("equal", "e")]
    got = revisions.runs_of(ops, [(3, "p"), (2, "q")], [(3, "n"), (2, "m")], [0, 3, 5])
    assert got == [("mark", "", 0, None), ("equal", "ab", 0, "p"), ("delete", "c", 2, "p"), ("mark", "", 3, None), ("delete", "d", 3, "q"), ("insert", "X", 4, "n"), ("insert", "Y", 4, "m"), ("equal", "e", 4, "q"), ("mark", "", 5, None)]
    assert revisions.runs_of([("insert", "new")], [], [(3, "n")], [0]) == [("mark", "", 0, None), ("insert", "new", 0, "n")]
    assert revisions.runs_of([], [], [], [0]) == [("mark", "", 0, None)]


def test_latency_averages_of_a_key_in_many_tasks(spark):
    """One key has most rows; they lie in several tasks, and the average is that of one after the other."""
    rng = random.Random(12)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 5), i, rng.choice([-1.0, 0.0, rng.random() * 1000])) for i in range(3000)] + [(None, 1, 5.0)]
    want = {}
    for k, _, v in rows:
        if k is not None and v > 0:
            want[k] = v if k not in want else v * 0.3 + want[k] * 0.7
    events = spark.createDataFrame(rows, "k int, i int, v double").repartition(3)
    for parts in (1, 7):
        got = {r.k: r.ema for r in audit.latency_averages(events, "k", ["i"], "v", parts).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    tasks = events.where("k = 0").repartitionByRange(7, "k", "i").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 3
    assert audit.latency_averages(events.limit(0), "k", ["i"], "v").collect() == []


def test_spans_as_of(spark):
    """Against all spans of a key, also where one key has a third of all rows; nothing is gathered."""
    rng = random.Random(9)
    spans, asked = [], []
    for key in [*range(20), None]:
        at = rng.randint(0, 30)
        for _ in range(300 if key == 0 else rng.randint(0, 6)):
            size = rng.randint(1, 9)
            spans.append((key, at, at + size, f"{key}:{at}"))
            at += size + rng.choice([0, 0, 5])
        asked += [(key, rng.choice([None, rng.randint(0, at + 20)]) if rng.random() < 0.1 else rng.randint(0, at + 20)) for _ in range(400 if key == 0 else 20)]
    left, right = spark.createDataFrame(asked, "k int, x long"), spark.createDataFrame(spans, "k int, a long, b long, v string")

    def plainly(k, x):
        own = sorted(s[1:] for s in spans if s[0] == k)
        if k is None or x is None or not own:
            return None
        inside, before = [v for a, b, v in own if a <= x < b], [v for _, b, v in own if b <= x]
        return inside[0] if inside else before[-1] if before else own[0][2]

    for width in (7, 64, 1 << 16):
        out = revisions.spans_at(left, right, ["k"], "x", "a", ["v"], width)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(((k, x, plainly(k, x)) for k, x in asked), key=repr)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_parts_reached(spark):
    from palimpsest.operators import graph

    rng = random.Random(10)
    edges = [(rng.randrange(30), rng.randrange(40)) for _ in range(60)] + [(5, 5), (1, 2), (2, 1)]
    want, step = {1: 0, 3: 0}, [1, 3]
    for depth in range(1, 40):
        step = sorted({b for a, b in edges if a in step and b < 30} - set(want))
        want |= dict.fromkeys(step, depth)
    frames = [spark.createDataFrame([(x,) for x in rows], "part long") for rows in ([1, 3, 3, 99], range(30))]
    relations = spark.createDataFrame(edges, "source long, target long")
    assert {r.part: r.depth for r in graph.reached(frames[0], relations, frames[1]).collect()} == want
    assert {r.part for r in graph.reached(frames[0], relations, frames[1], 1).collect()} == {k for k, d in want.items() if d <= 1}
    assert graph.reached(frames[0].limit(0), relations, frames[1]).collect() == []


@settings(max_examples=200, deadline=None)
@given(TOKENS, TOKENS)
def test_whole_diffs_in_stretches_are_the_table_walk(a, b):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(d, "STANDING", 0)
        assert [(k, t) for k, part in d._parts(a, b, True) for t in part] == plain_diff(a, b)


def test_whole_diffs_of_large_tables():
    rng = random.Random(9)
    a, b = ([rng.choice("abcd") for _ in range(n)] for n in (1500, 1450))
    assert [(k, t) for k, part in d._parts(a, b, True) for t in part] == plain_diff(a, b) != d.diff(a, b)
    a = [str(k) for k in range(20000)]
    b = [t for t in a if t[-2:] != "77"]
    assert [(k, len(part)) for k, part in d._parts(a, b, True) if k != "equal"] == [("delete", 1)] * 200
