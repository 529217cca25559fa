"""Diffs of growing texts against brute force."""

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import growth
from palimpsest.operators.growth import PIECES, shown


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


TEXT = st.text("ab .\n\r", max_size=10)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT, st.booleans()), min_size=1, max_size=5), st.sampled_from([1, 9, 40, 1 << 20]))
def test_growths_are_fresh_diffs_and_shortest(steps, cells):
    grown, old, new = growth.Growing(cells), "", ""
    for more_old, more_new, anew in steps:
        old, new = old + more_old, more_new if anew else new + more_new
        ops = grown.texts(old, new)
        assert ops == growth.Growing(cells).texts(old, new)
        assert "".join(t for k, t in ops if k != "insert") == old and "".join(t for k, t in ops if k != "delete") == new
        a, b = growth.tokens(old), growth.tokens(new)
        script = grown._script() if grown.rows else growth._halved(a, b, cells)
        assert sum(k == "equal" for k, _ in script) == common(a, b)


def test_fifty_growths_cost_less_than_two_diffs():
    old = " ".join(f"w{k % 97}" for k in range(3000))
    new = old.replace("w13", "other")
    once, grown = growth.Growing(), growth.Growing()
    once.texts(old, new)
    for k in range(1, 51):
        grown.texts(old, new[: len(new) * k // 50])
    assert grown.worked <= 2 * once.worked


def test_stretches_are_taken_at_once(monkeypatch):
    """Texts that are equal but for an end, and those that come in before their originals: steps by stretches, not by tokens."""
    calls = []
    for name in ("_run", "_rising"):
        monkeypatch.setattr(growth, name, lambda *a, f=getattr(growth, name): calls.append(1) or f(*a))
    old = " ".join(f"w{k}" for k in range(2000))
    assert growth.Growing().texts(old, old + " end") == [("equal", old), ("insert", " end")]
    assert growth.Growing().texts(old, old.partition(" ")[2]) == [("delete", "w0 "), ("equal", old[3:])]
    assert growth.Growing().texts("w0.", old) == [("equal", "w0"), ("delete", "."), ("insert", old[2:])]
    assert len(calls) < 4 * 4000  # a few for each row, of which the last has 4,000 with 5 places each


def test_very_unlike_texts_by_halves():
    old, new = " ".join(f"a{k}" for k in range(3000)), " ".join(f"b{k}" if k % 3 else f"a{k}" for k in range(3000))
    ops = growth.Growing(100_000).texts(old, new)
    assert "".join(t for k, t in ops if k != "insert") == old and "".join(t for k, t in ops if k != "delete") == new
    assert sum(t.startswith("a") or t.startswith(" a") for k, t in ops if k == "equal") == 1000


def test_html():
    ops = growth.Growing().texts("A cat <sat>.", "A dog sat.\n")
    assert growth.marked(ops) == 'A <span class="diff-deleted">cat</span> <span class="diff-inserted">dog</span> <span class="diff-deleted">&lt;</span>sat<span class="diff-deleted">&gt;</span>.\n'
    assert growth.marked([]) == "" and growth.to_last_sentence("One. Two? Thr") == "One. Two? " and growth.to_last_sentence("One") == "One"


def test_rows_of_keys(spark):
    rows = [("a", 0, "One two. Thr", "One", False), ("a", 1, None, None, None), ("a", 2, None, " too. Three", True), ("a", 3, None, "late", False), ("b", 0, None, "x", True), ("c", 0, "", "", True), (None, 0, "x", "x", True)]
    out = shown(spark.createDataFrame(rows, f"doc string, {PIECES}"), ["doc"]).orderBy("doc", "seq").collect()
    said = [(r.doc, r.seq, r.chars, r.done, [(o.kind, o.token) for o in r.ops]) for r in out]
    assert said == [
        ("a", 0, 3, False, [("equal", "One"), ("delete", " two. ")]),
        ("a", 1, 3, False, [("equal", "One"), ("delete", " two. ")]),
        ("a", 2, 14, True, [("equal", "One "), ("delete", "two"), ("insert", "too"), ("equal", ". "), ("delete", "Thr"), ("insert", "Three")]),
        ("b", 0, 1, True, [("insert", "x")]),
        ("c", 0, 0, True, []),
    ]
    assert shown(spark.createDataFrame([], f"doc string, {PIECES}"), ["doc"]).collect() == []
