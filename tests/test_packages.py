"""Revisions written into packages, and the data source that keeps packages."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import markup
from palimpsest.functions.diff import diff, merged, words
from palimpsest.operators.revisions import runs_of
from palimpsest.sources import packages

from .test_office import rels

W = f'xmlns:w="{markup.SPACE}"'
ITALIC = "<w:rPr><w:i/></w:rPr>"


def document(body):
    return f"<w:document {W}><w:body>{body}<w:sectPr/></w:body></w:document>"


def texts(content):
    return ["".join(t.text for t in p.texts) for p in markup.part_of(content).paragraphs]


def compare(part, new, first=1):
    """The part with its paragraphs compared with new texts by place."""
    read, writer, edits = markup.part_of(part), markup.Writer("w", "A & B", "d", first), []
    for p, text in zip(read.paragraphs, new, strict=True):
        if text is None:
            edits += markup.deleted(p, writer)
        elif (old := "".join(t.text for t in p.texts)) != text:
            ops = merged(diff(words(old), words(text)))
            edits += markup.revised(p, runs_of(ops, [(len(t.text), t.props) for t in p.texts], [(len(text), ITALIC)], []), writer)
    return markup.edited(part, [(a, b, x.encode()) for a, b, x in edits])


BODY = (
    '<w:p><w:pPr><w:jc w:val="a>b"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">Hello  wor</w:t><w:tab/><w:t>ld!!</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r><w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink></w:p>'
    "<w:p/><w:p></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell &amp; &lt;x&gt;</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    "<w:p><w:pPr><w:rPr><w:b/></w:rPr><w:sectPr/></w:pPr><w:r><w:pict><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:pict></w:r><w:r><w:t>host</w:t></w:r></w:p>"
    "<w:p><w:pPr/><w:r><w:t>é日😀 end</w:t></w:r></w:p>"
)
OLD = ["Hello  world!! link", "", "", "cell & <x>", "host", "box", "é日😀 end"]


@pytest.mark.parametrize("wide", [False, True])
def test_revisions_in_a_part(wide):
    part = document(BODY).encode("utf-16") if wide else document(BODY).encode()
    assert texts(part) == OLD
    for new in (["Hello world! linked", "new one", "", "cells & <y>", "hosts", "box!", "é日 ends"], OLD, ["", "a", "b", "", "", "", ""], [None, "", None, None, "host", "box", None]):
        made = compare(part, new)
        assert texts(markup.resolved(made, False)) == OLD
        # a deleted paragraph goes with its mark; in a cell, and where the properties hold a section, it stays and is empty
        assert texts(markup.resolved(made, True)) == (["", "", "", "host", "box"] if None in new else new)
        assert (made == part) == (new == OLD)
        raw = markup.narrow(made)[0].decode()
        assert raw.count("footnoteReference") == 1 and raw.count("<w:tab/>") == 1 and raw.count("<w:sectPr/>") == 2
        ids = [int(x) for x in re.findall(r'<w:(?:ins|del) w:id="(\d+)"', raw)]
        assert sorted(ids) == list(range(1, len(ids) + 1))


def test_random_paragraphs():
    rng = random.Random(4)
    letters = "ab  .!é&<\r\n\t"
    some = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
    for _ in range(400):
        writer = markup.Writer("w", "", "", 1)
        old = [[some() for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 4))]
        body = "".join(f"<w:p>{''.join(writer.run(t, rng.choice(['', ITALIC])) if rng.random() < 0.7 else f'<w:r>{writer.text(t)}<w:br/>{writer.text(t)}</w:r>' for t in p)}</w:p>" for p in old)
        part = document(body).encode()
        before = texts(part)
        new = [some() if rng.random() < 0.5 else t + some() for t in before]
        made = compare(part, new)
        assert texts(markup.resolved(made, True)) == new and texts(markup.resolved(made, False)) == before


def test_resolving_other_revisions():
    change = "<w:rPrChange w:id='4'><w:rPr><w:b/></w:rPr></w:rPrChange>"
    body = (
        f"<w:p><w:r><w:rPr><w:i/>{change}</w:rPr><w:t>f</w:t></w:r><w:moveFrom w:id='1'><w:r><w:t>m</w:t></w:r></w:moveFrom><w:moveTo w:id='2'><w:r><w:t>n</w:t></w:r></w:moveTo></w:p>"
        "<w:tbl><w:tr><w:trPr><w:ins w:id='9'/></w:trPr><w:tc><w:p><w:r><w:t>row</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        "<w:p><w:pPr><w:rPr><w:ins w:id='7'/></w:rPr></w:pPr><w:ins w:id='8'><w:r><w:t>all new</w:t></w:r></w:ins></w:p>"
        "<w:p><w:pPr><w:rPr><w:del w:id='17'/></w:rPr></w:pPr><w:r><w:t>kept</w:t></w:r></w:p><w:moveFromRangeStart w:id='3'/>"
    )
    part = document(body).encode()
    accepted, rejected = markup.resolved(part, True), markup.resolved(part, False)
    assert texts(accepted) == ["fn", "row", "all new", "kept"] and texts(rejected) == ["fm", "kept"]
    assert b"<w:i/>" in accepted and b"<w:b/>" not in accepted and b"<w:b/>" in rejected and b"<w:i/>" not in rejected
    for out in (accepted, rejected):
        assert not re.search(rb"w:(ins|del|moveFrom|moveTo|rPrChange)\b", out) and markup.resolved(out, True) == out
    assert markup.part_of(part).largest_id == 17
    assert markup.resolved(b"no xml", True) == b"no xml" and markup.part_of(b"<a") is None


def package(body, notes="", header="Head"):
    out = io.BytesIO()
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", rels(("officeDocument", "word/document.xml")))
        z.writestr("word/_rels/document.xml.rels", rels(("footnotes", "footnotes.xml"), ("header", "header1.xml")))
        z.writestr("word/document.xml", document(body))
        z.writestr("word/footnotes.xml", f"<w:footnotes {W}>{notes}</w:footnotes>")
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
        z.writestr("word/media/x.bin", bytes(range(256)) + kind.encode())
    return out.getvalue()


def p(*texts_):
    return "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts_)


def note(number, text):
    return f'<w:footnote w:id="{number}"><w:p><w:r><w:footnoteRef/></w:r><w:r><w:t>{text}</w:t></w:r></w:p></w:footnote>'


def test_packages_compared(spark):
    schema = "path string, content binary, extra int"
    tracked = '<w:p><w:ins w:id="41"><w:r><w:t>was in</w:t></w:r></w:ins></w:p>'
    old = spark.createDataFrame([("a", package(p("one", "two") + tracked, note(1, "first") + note(2, "gone") + note(3, "third")), 1), ("b", package(p("same")), 2), ("c", b"no zip", 3), ("d", package(p("x", "y", "z")), 4), ("e", package(p("only here")), 5)], schema)
    new = spark.createDataFrame([("a", package(p("one!", "two") + tracked, note(3, "third one") + note(1, "First"), "Heads"), 1), ("b", package(p("same")), 2), ("c", b"no zip", 3), ("d", package(p("x", "Y") + p("z", "more", "&amp;")), 4)], schema)
    found = packages.revisions(old, new, "A", "d").cache()
    rows = {(r.path, r.entry, r.note, r.pos): r for r in found.collect()}
    assert set(rows) == {("a", "word/document.xml", "", 0), ("a", "word/footnotes.xml", "1", 0), ("a", "word/footnotes.xml", "3", 0), ("a", "word/header1.xml", "", 0), ("d", "word/document.xml", "", 1), ("d", "word/document.xml", "", 3), ("d", "word/document.xml", "", 4)}
    assert [r.first_id for r in sorted((r for k, r in rows.items() if k[0] == "a"), key=lambda r: r.first_id)] == [42, 43, 45, 46] and rows["a", "word/document.xml", "", 0].first_id == 42
    made = packages.redlined(old, found)
    assert made.columns == old.columns and made.count() == 5
    out = {r.path: r for r in made.select("*", packages.resolved("content", True).alias("yes"), packages.resolved("content", False).alias("no")).collect()}
    inside = lambda c: {n: zipfile.ZipFile(io.BytesIO(bytes(c))).read(n) for n in zipfile.ZipFile(io.BytesIO(bytes(c))).namelist()}
    assert bytes(out["c"].content) == b"no zip" and bytes(out["b"].content) == bytes(old.where("path = 'b'").first().content)
    yes, no, mine = inside(out["a"].yes), inside(out["a"].no), inside(out["a"].content)
    assert texts(yes["word/document.xml"]) == ["one!", "two", "was in"] and texts(yes["word/footnotes.xml"]) == ["First", "gone", "third one"] and texts(yes["word/header1.xml"]) == ["Heads"]
    assert texts(no["word/document.xml"]) == ["one", "two", ""] and texts(no["word/footnotes.xml"]) == ["first", "gone", "third"]
    assert all(x["word/media/x.bin"] == bytes(range(256)) + mine["word/media/x.bin"][256:] for x in (yes, no, mine))
    assert texts(inside(out["d"].yes)["word/document.xml"]) == ["x", "Y", "z", "more", "&"] and texts(inside(out["d"].no)["word/document.xml"]) == ["x", "y", "z"]
    assert texts(inside(out["e"].yes)["word/document.xml"]) == ["only here"]


def test_files_written_and_read(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.createDataFrame([(f"{i}.docx", package(p(f"text {i}"))) for i in range(7)], packages.FILES).repartition(3)
    packages.write(rows, path)
    assert {r.name: bytes(r.content) for r in packages.files(spark, path).collect()} == {r.name: bytes(r.content) for r in rows.collect()}
    packages.write(rows.limit(2).selectExpr("concat('new-', name) AS name", "content"), path)
    assert packages.files(spark, path).count() == 9
    packages.write(rows.limit(1), path, "overwrite")
    assert packages.files(spark, path).count() == 1 and not [x for x in (tmp_path / "out").rglob("*") if "_draft" in str(x)]
    for bad in ([("a/b", b"x")], [(None, b"x")], [("a", None)], [("a", b"x"), ("a", b"y")]):
        with pytest.raises(Exception, match="no name for a file"):
            packages.write(spark.createDataFrame(bad, packages.FILES).coalesce(1), path)
        assert packages.files(spark, path).count() == 1 and not [x for x in (tmp_path / "out").rglob("*") if "_draft" in str(x)]


def test_parts_out_of_scope_are_not_inflated(spark, tmp_path, monkeypatch):
    packages.write(spark.createDataFrame([("a.docx", package(p("one"), note(1, "n"))), ("b.docx", package(p("two"))), ("bad.docx", b"no zip")], packages.FILES), str(tmp_path / "in"))
    every = packages.parts(spark, str(tmp_path / "in"))
    assert sorted((r.part_kind, r.label) for r in every.collect()) == [("footnotes", "footnotes")] * 2 + [("headers", "headers 1")] * 2 + [("main", "main")] * 2
    some = every.where(F.col("part_kind").isin("footnotes", "endnotes"))
    assert {r.entry for r in some.collect()} == {"word/footnotes.xml"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)  # nothing is left to be filtered after the scan
    opened = []
    real = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **b: (opened.append(getattr(name, "filename", name)), real(self, name, *a, **b))[1])
    reader = packages.Reader(str(tmp_path / "in"))
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    left = list(reader.pushFilters([IsNotNull(("part_kind",)), In(("part_kind",), ("headers", "main")), EqualTo(("part_kind",), "headers"), EqualTo(("path",), "x")]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"]
    got = [b for share in reader.partitions() for b in reader.read(share)]
    assert len(got) == 2 and {x for x in opened if not x.endswith(".rels")} == {"word/header1.xml"}


def test_revisions_of_long_paragraphs_are_whole_diffs(spark):
    """Three words of a paragraph whose table has 36 million cells: three deletions and three insertions, nothing else."""
    old = [f"w{k}" for k in range(3000)]
    new = [f"new{k}" if k in (10, 1500, 2990) else w for k, w in enumerate(old)]
    rows = [("a.docx", [[(" ".join(t), None)]]) for t in (old, new)]
    none = F.lit(None).cast("array<array<struct<text:string,props:string>>>")
    a, b = (spark.createDataFrame([r], "path string, p array<array<struct<text:string,props:string>>>").select("path", packages.packed("p", none, none).alias("content")) for r in rows)
    found = packages.revisions(a, b, "A", "d").collect()
    assert [(r.status, r.n_ids) for r in found] == [("changed", 6)]
    marked = re.findall(r"<w:delText[^>]*>([^<]*)|<w:ins [^>]*><w:r><w:t [^>]*>([^<]*)", found[0].edits[0].xml)
    assert [x or y for x, y in marked] == ["w10", "new10", "w1500", "new1500", "w2990", "new2990"]


def test_resolved_texts_are_those_of_resolved_parts():
    """Any nesting, also of marks that only the pass by pass way knows; most need no second parser."""
    rng, plain = random.Random(4), 0
    leaves = ["<w:t>a&#13;b</w:t>", "<w:t>é😀</w:t>", "<w:delText>gone</w:delText>", "<w:tab/>", "<w:br/>", "<w:instrText>7</w:instrText>", "<w:rPr><w:b/></w:rPr>", "<w:t/>", "<v:t>other</v:t>"]
    marks = ["", "<w:pPr/>", '<w:pPr><w:rPr><w:ins w:id="1"/></w:rPr></w:pPr>', '<w:pPr><w:rPr><w:del w:id="2"/></w:rPr></w:pPr>', '<w:pPr><w:rPr><w:del w:id="2"/><w:ins w:id="3"/></w:rPr></w:pPr>']
    odd = ['<w:moveFrom w:id="4"><w:r><w:t>moved</w:t></w:r></w:moveFrom>', "<w:r><w:ins><w:t>in</w:t></w:ins></w:r>", "<w:t>bare</w:t>", '<w:pPr><w:pPrChange w:id="5"><w:pPr/></w:pPrChange></w:pPr>', "<w:r><w:delInstrText>x</w:delInstrText></w:r>"]

    def run(deep):
        box = f"<w:pict><w:txbxContent>{paragraph(deep + 1)}</w:txbxContent></w:pict>" if deep < 2 and rng.random() < 0.1 else ""
        return f"<w:r>{''.join(rng.choices(leaves, k=rng.randint(0, 2)))}{box}</w:r>"

    def inner(deep):
        tag = rng.choice(["ins", "del", "hyperlink", "", "", ""])
        body = inner(deep + 1) if deep < 3 and rng.random() < 0.2 else run(deep)
        return f'<w:{tag} w:id="9">{body}</w:{tag}>' if tag else body

    def paragraph(deep=0):
        p = f"<w:p>{rng.choice(marks)}{''.join(inner(deep) for _ in range(rng.randint(0, 3)))}{rng.choice(odd) if rng.random() < 0.03 else ''}</w:p>"
        around = rng.choice(["", "", "", "", "ins", "del", "tc", "tr"])
        return f"<w:tbl><w:tr>{rng.choice(['', '', '<w:trPr><w:del/></w:trPr>']) if around == 'tr' else ''}<w:tc>{p}</w:tc></w:tr></w:tbl>" if around in ("tc", "tr") else f"<w:{around}>{p}</w:{around}>" if around else p

    for k in range(1500):
        body = "".join(paragraph() for _ in range(rng.randint(0, 3)))
        notes = "".join(f'<w:footnote w:id="{i}">{paragraph()}{paragraph()}</w:footnote>' for i in range(2))
        part = (f'<w:document {W} xmlns:v="v"><w:body>{body}</w:body></w:document>' if k % 3 else f'<w:footnotes {W} xmlns:v="v">{notes}</w:footnotes>').encode("utf-16" if k % 7 == 0 else "utf-8")
        parts = [markup.part_of(markup.resolved(part, accept)) for accept in (True, False)]
        assert markup.resolved_texts(part) == tuple([(p.note, p.pos, "".join(t.text for t in p.texts)) for p in x.paragraphs] for x in parts), part
        try:
            markup._plain_texts(part)
            plain += 1
        except markup._Odd:
            pass
    assert plain > 900
    for part in (b"no xml", b"", b"<w:p", b'<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'):
        assert markup.resolved_texts(part) == ([], [])


def test_packages_without_revisions_are_not_packed_again(spark):
    """Packages that hold nothing to resolve come back byte by byte, and texts are those that the places have."""
    marked, plain = (packages._zipped([("_rels/.rels", rels(("officeDocument", "word/document.xml")).encode()), ("word/document.xml", document(body).encode())]) for body in ('<w:p><w:del w:id="1"><w:r><w:delText>x</w:delText></w:r></w:del></w:p>', BODY))
    kept = plain[:-2] + b"\x03\x00odd"  # a comment of the package, which packing it again would lose
    df = spark.createDataFrame([(1, marked), (2, kept), (3, b"none"), (4, None)], "n int, content binary")
    got = {r.n: r.content for r in df.select("n", packages.resolved("content", True).alias("content")).collect()}
    assert got[2] == kept and got[3] == b"none" and got[4] is None and got[1] != marked
    for part in (document(BODY).encode(), document(BODY).encode("utf-16"), b"<w:p"):
        whole = markup.part_of(part)
        assert markup.texts_in(part) == ([(p.note, p.pos, "".join(t.text for t in p.texts)) for p in whole.paragraphs] if whole else [])
