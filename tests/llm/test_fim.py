"""Rearranged texts against a plain version, and back."""

import hashlib
import re

import numpy as np

from palimpsest.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rate=50, first=80):
    tokens = TOKEN.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text or ""
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["a b", " a  b\n", "\n\n", "x", "é😀 日本 ü", "a <P> b", "<S>", "x<M>", "<P", "S> <", "<<", "a\x1cb\x85c d", "> M> <", "word " * 3000]


def test_against_the_plain_version(spark, small, odd, empty):
    texts = spark.createDataFrame([(k * 100 + i, t) for k in range(30) for i, t in enumerate(TEXTS)] + [(None, "a b c d"), (None, None)], "doc_id long, text string")
    for docs in (small, odd, texts):
        for how, options in ((fim.Rearrangement(), {}), (fim.Rearrangement(rearranged=100, suffix_first=50), {"rate": 100, "first": 50})):
            want = sorted((str(r.doc_id), *plainly(r.doc_id, r.text, **options)) for r in docs.collect())
            got = fim.fill_in_middle(docs, how).cache()
            assert sorted(((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()), key=repr) == sorted(want, key=repr)
            back = got.select("doc_id", how.restored(got.output, got.form).alias("text")).collect()
            assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert fim.fill_in_middle_digest(empty).collect() == [] and fim.fill_in_middle(empty).collect() == []


def test_all_forms_occur(spark, small):
    assert {r.form for r in fim.fill_in_middle(small).collect()} == {"plain", "psm", "spm"}


def test_markers_of_any_signs(spark):
    how = fim.Rearrangement(rearranged=100, suffix_first=0, prefix="[\\E", suffix="(|", middle="$1")
    docs = spark.createDataFrame([(i, "one two three \\Q four") for i in range(20)], "`a.b` long, `t.x` string")
    made = fim.fill_in_middle(docs, how, "a.b", "t.x")
    assert {r.text for r in made.select(how.restored(made.output, made.form).alias("text")).collect()} == {"one two three \\Q four"}
    assert {r.form for r in made.collect()} == {"psm"} and made.columns[0] == "a.b"


def test_ends_of_tokens():
    for t in TEXTS:
        points = np.frombuffer(t.encode("utf-32-le"), "<u4")
        assert fim.token_ends(points).tolist() == np.cumsum([len(x) for x in TOKEN.findall(t)]).tolist()
