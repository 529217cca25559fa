"""Labels, chunks, replies and other expressions on cases of their own."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import citations, labels, names, replies
from palimpsest.functions import text as tx

NB = " "


def evaluate(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()


LABELS = ["12", "(3)", "2.3.4", "A.", "IV.", "bb)", "[c]", "α)", "A. I. 1. b)", "– 17 –", "§ 12", "1.000", "III.2", "((a))", f"A.{NB}II.", "12345678901234567890123456789012345678901234567890"]
OTHERS = ["", "   ", "S. 42", "A", "and", "Section", "A. Introduction", "I think so.", "e.g.", "p. 5", "a.b", f"{NB}", "A. B. C. D. E. F. G.", "x" * 40 + "."]


def test_label_only(spark):
    got = evaluate(spark, [(t,) for t in LABELS + OTHERS], "t string", v=labels.is_label_only("t"))
    assert [r.v for r in got] == [True] * len(LABELS) + [False] * len(OTHERS)


@pytest.mark.parametrize(
    ("text", "label"),
    [("1. Text here", "1. "), (f"a){NB}Text", f"a){NB}"), ("S. 42 shows", ""), ("1.", ""), ("", ""), ("IV.  More", "IV.  "), ("Word and more", ""), ("2. 3", ""), (" 1. x", "")],
)
def test_leading_label(spark, text, label):
    assert evaluate(spark, [(text,)], "t string", v=labels.leading_label("t"))[0].v == label


def test_label_restored(spark):
    rows = [("1. Old text", "New text"), ("1. Old text", "2. New text"), ("Old text", "New")]
    assert [r.v for r in evaluate(spark, rows, "o string, c string", v=labels.label_restored("o", "c"))] == ["1. New text", "2. New text", "New"]


def chunks_by_rule(text, most):
    out, start = [], 0
    while start < len(text):
        if len(text) - start <= most:
            out.append(text[start:])
            break
        window = text[start : start + most]
        cut = max((i for i, c in enumerate(window) if c in ".!?\n\r" and i > 0), default=-1)
        if cut < 0:
            cut = max((i for i, c in enumerate(window) if c.isspace() and i > 0), default=-1)
        end = cut + 1 if cut > 0 else most
        out.append(window[:end])
        start += end
    return out


def test_chunks(spark):
    texts = ["", "short", "One. Two! Three? Four", "word " * 30, "x" * 55, "a.b" * 20, "line\nline\nline without stop " * 4, "é ü ß. " * 9]
    for most in (5, 10, 25):
        got = evaluate(spark, [(t,) for t in texts], "t string", v=tx.chunks("t", most))
        for t, r in zip(texts, got, strict=True):
            assert "".join(r.v) == t and all(len(c) <= most for c in r.v)
            assert r.v == chunks_by_rule(t, most)


def test_replies(spark):
    cases = [
        ("  Good text. ", "Good text", "Good text."), ("**Bold** and `code`", "x", "Bold and code"), ('"Quoted."', "x", "Quoted."), ("1. First\n2. Second", "First\nSecond", "First\nSecond"),
        ("1. First\n2. Second", "1. A\n2. B", "1. First\n2. Second"), ("1. First\n2. Second\n3. Third", "1. A", "1. First\nSecond\nThird"), ("Text\n2. Second", "a", "Text\n2. Second"),
        ("```\nfenced line\n```", "x", "fenced line"), ("[link](http://x)", "x", "link"), ("(Note: I changed it) Result.", "x", "Result."), ("# Head", "x", "Head"), ("   ", "x", ""), ("Note: nothing", "x", "Note: nothing"), (None, "x", ""),
    ]
    got = evaluate(spark, [(a, b) for a, b, _ in cases], "r string, o string", v=replies.sanitized("r", "o"))
    assert [r.v for r in got] == [c for _, _, c in cases]


def test_durations_and_retries(spark):
    rows = [("6s",), ("1.5s",), ("600ms",), ("0s",), ("x",), ("",), (None,), ("7",)]
    assert [r.v for r in evaluate(spark, rows, "d string", v=replies.duration_seconds(F.col("d")))] == [6, 2, 1, 1, None, None, None, 7]
    bodies = [(None, '{"error":{"details":[{"x":1},{"retryDelay":"6s"}]}}', 6), ("3", "{}", 3), ("soon", "not json", None), (None, "", None)]
    assert [r.v for r in evaluate(spark, [(h, b) for h, b, _ in bodies], "h string, b string", v=replies.retry_seconds(F.col("h"), F.col("b")))] == [s for *_, s in bodies]


def test_retry_dates(spark):
    rows = [("Sun, 06 Nov 1994 08:49:37 GMT", 37), ("Sun, 06 Nov 1994 08:48:00 GMT", 1), ("soon", None), ("06 Nov 1994", None)]
    now = F.timestamp_seconds(F.lit(784111740))
    assert [r.v for r in evaluate(spark, [(h,) for h, _ in rows], "h string", v=replies.retry_seconds(F.col("h"), F.lit("{}"), now))] == [s for _, s in rows]


def test_completion_text(spark):
    cases = [
        ('{"choices":[{"message":{"content":"a"}}]}', "a"), ('{"choices":[{"text":"b"}]}', "b"), ('{"output":[{"content":[{"text":"c"},{"text":"d"}]},{"content":[{"text":{"value":"e"}}]}]}', "cde"),
        ('{"message":{"content":[{"type":"text","text":{"value":"f"}},"g"]}}', "fg"), ('{"output_text":"h"}', "h"), ("{}", None), ('{"output":[{"content":"i"}]}', "i"),
        ("no json", None), (None, None), ('{"output_text":"[1]"}', "[1]"), ('{"output_text":null,"output":[1,true,"x",null,{"content":null,"value":"y"},{"other":1}]}', "1truexy"), ('{"message":{"content":{"other":1}}}', ""),
        *(('{"output":' + '[{"content":' * n + '"deep"' + "}]" * n + "}", "deep") for n in (1, 4, 5, 12, 30, 200)),
    ]
    assert [r.v for r in evaluate(spark, [(p,) for p, _ in cases], "p string", v=replies.completion_text(F.col("p")))] == [t for _, t in cases]


def test_citations(spark):
    rows = [("S. 1 ff. and S. 2ff.", "with_space"), ("S. 1ff. s.2 f.", "without_space"), (f"S. 5{NB}f.", "without_space"), ("none", "with_space")]
    got = evaluate(spark, rows, "t string, w string", v=citations.normalized("t", F.col("w")), n=F.struct(*citations.style_counts("t")))
    assert [r.v for r in got] == [f"S. 1{NB}ff. and S. 2{NB}ff.", "S. 1ff. s.2f.", "S. 5f.", "none"]
    assert [tuple(r.n) for r in got] == [(1, 1), (1, 1), (1, 0), (0, 0)]


def test_edges_and_guards(spark):
    rows = [("  a ", "b"), ("a", " b"), ("   ", "b"), ("", "b"), (" a", "")]
    assert [r.v for r in evaluate(spark, rows, "o string, c string", v=replies.edge_spaces_restored("o", "c"))] == ["  b ", " b", "   b", "b", ""]
    rows = [("x" * 10, "x" * 60), ("x" * 10, "x" * 61), ("x" * 50, "x" * 9), ("", "x" * 5000), ("", "x" * 5001)]
    assert [r.v for r in evaluate(spark, rows, "o string, c string", v=tx.translation_length_safe("o", "c"))] == [True, False, False, False, False]
    assert [r.v for r in evaluate(spark, rows[3:], "o string, c string", v=tx.length_safe("o", "c"))] == [True, False]


def test_names(spark):
    rows = [("Français", "francais"), ("  ", "target"), ("Chinese (Simplified, Taiwan etc)", "chinese-simplified-taiwa"), ("日本語", "target"), (None, "target"), ("Ṩàrdū cafe\u0301", "sardu-cafe")]
    assert [r.v for r in evaluate(spark, [(a,) for a, _ in rows], "t string", v=names.slug("t"))] == [b for _, b in rows]
    rows = [("v1.2.3", "1.2.3", 0), ("1.2", "1.10", -1), ("2.0-rc1", "1.9.9", 1), ("1.x", "1.0", 0)]
    assert [r.v for r in evaluate(spark, [r[:2] for r in rows], "a string, b string", v=names.version_compare("a", "b"))] == [r[2] for r in rows]
    rows = [("de-DE", "de"), ("pl_PL", "pl"), ("tlh", "en"), ("", "en")]
    assert [r.v for r in evaluate(spark, [(a,) for a, _ in rows], "t string", v=names.locale("t"))] == [b for _, b in rows]


def test_epoch_text_of_any_year(spark, duck):
    seconds = [0, -1, 253402300799, 253402300800, 518400000000, 4102444800000, -62135596801, -62167219201, -99999999999, -377705116801]
    got = spark.createDataFrame([(s,) for s in seconds], "s long").select("s", names.epoch_text(F.col("s")).alias("at"))
    told = duck.sql(f"SELECT strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M') FROM (SELECT unnest({seconds}) AS s)").fetchall()
    assert [r["at"] for r in got.collect()] == [x for (x,) in told]


def test_diffs_take_equal_stretches_at_once():
    """A diff's steps are stretches: of equal texts one, not one for each character; the tokens are those of the steps."""
    from palimpsest.functions import diff

    text = " ".join(f"w{k}" for k in range(300))
    assert diff.steps(text, text) == [("equal", len(text)), ("delete", 0), ("insert", 0)]
    assert len([s for s in diff.steps(text, text[3:]) if s[1]]) <= 5
    assert diff.merged(diff.diff(list(text), list(text + " end"))) == [("equal", text), ("insert", " end")]
