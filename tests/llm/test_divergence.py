"""The audit of sources against plain counts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from palimpsest.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plainly(rows, least, most_terms=50):
    rows = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(text or "")]) for lang, source, text in rows]
    in_docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        in_docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {x[0] for x in rows}:
        kept = [w for w, n in in_docs[lang].items() if n >= least]
        sources = sorted({s for a, s, _ in rows if a == lang})
        whole = Counter({w: sum(counts[lang, s][w] for s in sources) for w in kept})

        def share(found):
            total = sum(found[w] for w in kept)
            return {w: 1 + 10**9 * (found[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, most_terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def some_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "b", "A", "ab", "é", "É", "日本", "x1y", "c-d", "z" * 30, "ÀB", "\x00", "\u2028", "\u00a0", "ß", "_", "@", "`", "\x7f", "\x80"]
    return [(rng.choice(["en", "fr", None, ""]), rng.choice(["s", "t", "u", None, "é", "Z"]), None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for _ in range(n)] + [("lone", "s", "one"), ("two", "b", "@"), ("two", "a", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_counts(spark, seed, monkeypatch):
    rows = some_rows(seed)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    want = plainly(rows, 4)
    assert rows_of(divergence.audit(docs, least=4)) == want
    # several automata, chunks and blocks, tables handed on early
    for name, value in (("CHUNK", 3), ("BLOCK", 2), ("ENTRIES", 5)):
        monkeypatch.setattr(divergence, name, value)
    assert rows_of(divergence.audit(docs, least=4, automaton_bytes=9, most_terms=2)) == plainly(rows, 4, 2)


def test_odd_tables(spark, odd, empty):
    assert divergence.audit(empty).collect() == []
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert rows_of(divergence.audit(odd, least=2)) == plainly(rows, 2)
    none = divergence.audit(odd, least=1000).collect()
    assert none and {(r.part, r.value) for r in none} == {("pair", 0)}


def test_shares_are_exact_at_any_size(spark):
    n, total, terms = 9_223_372_036_854_775_000, 9_223_372_036_854_775_807, 2_000_000_000_000
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, V long").selectExpr(divergence._share("n", "total", "V") + " AS p")
    assert df.first().p == 1 + 10**9 * (n + 5) // (total + 5 * terms)
