"""Packages made here, read with Spark."""

import zipfile

from pyspark.sql import functions as F

from palimpsest.operators.audit import integrity
from palimpsest.operators.correct import corrected_as_a_whole
from palimpsest.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(*targets):
    return f'<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Id="r{i}" Type="{KIND}/{k}" Target="{t}"/>' for i, (k, t) in enumerate(targets)) + "</Relationships>"


def package(path, body, notes="<w:p><w:r><w:footnoteRef/></w:r><w:r><w:t> Note.</w:t></w:r></w:p>"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("_rels/.rels", rels(("officeDocument/x/document", "word/document.xml")))
        z.writestr("word/_rels/document.xml.rels", rels(("footnotes", "footnotes.xml"), ("header", "header1.xml"), ("header", "broken.xml"), ("footnotes", "footnotes.xml")))
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {W}>{notes}</w:footnotes>")
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
        z.writestr("word/broken.xml", "<w:hdr")


BODY = (
    '<w:p><w:pPr><w:pStyle w:val="TOC1"/></w:pPr><w:r><w:t>Plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p>'
    "<w:p><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:r><w:tab/></w:r></w:p>"
    '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:t>after</w:t></w:r>'
    "<w:r><w:t>x</w:t></w:r></w:p><w:p/>"
)


def test_reader(spark, tmp_path):
    package(tmp_path / "a.docx", BODY)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    files = office.packages(spark, str(tmp_path))
    assert files.count() == 2
    rows = office.read_paragraphs(files).select("part_kind", "label", "pos", "style", office.editable_text(F.col("runs")).alias("text"), office.visible_characters(F.col("runs")).alias("n"), office.has_tracked_changes(F.col("runs")).alias("tracked")).collect()
    main = [tuple(r)[2:] for r in rows if r.part_kind == "main"]
    assert main == [(0, "TOC1", "Plain bold", 10, False), (1, None, "new", 3, True), (2, None, "afterx", 6, False), (3, None, "", 0, False)]
    assert [(r.label, r.text) for r in rows if r.part_kind != "main"] == [("footnotes", " Note."), ("headers 1", "Head")]


def test_templates_and_labels(spark, tmp_path):
    package(tmp_path / "a.DOTX", "<w:p><w:r><w:t>1.</w:t></w:r><w:r><w:tab/></w:r><w:r><w:t>Text</w:t></w:r></w:p>")
    package(tmp_path / "b.dotm", BODY)
    files = office.packages(spark, str(tmp_path))
    assert files.count() == 2
    row = office.read_paragraphs(files.where("lower(path) like '%dotx'")).where("part_kind = 'main'").select(office.visible_characters(F.col("runs")).alias("n"), office.editable_text(F.col("runs")).alias("text"), office.follows_mark(F.col("runs")).alias("mark")).first()
    assert (row.n, row.text, row.mark) == (4, "Text", False)
    notes = office.read_paragraphs(files.where("lower(path) like '%dotx'")).where("part_kind = 'footnotes'").select(office.follows_mark(F.col("runs")).alias("mark")).first()
    assert notes.mark


def test_comments_pass_through(spark):
    schema = "doc int, entry string, content binary"
    old = spark.createDataFrame([(1, "word/comments.xml", b"old"), (1, "word/document.xml", b"a"), (2, "word/document.xml", b"b"), (3, "word/comments.xml", b"gone")], schema)
    new = spark.createDataFrame([(1, "word/comments.xml", b"new"), (1, "word/document.xml", b"A"), (2, "word/document.xml", b"B"), (2, "word/comments.xml", b"own")], schema)
    got = sorted((r.doc, r.entry, bytes(r.content)) for r in office.with_comments(new, old, ["doc"]).collect())
    assert got == [(1, "word/comments.xml", b"old"), (1, "word/document.xml", b"A"), (2, "word/comments.xml", b"own"), (2, "word/document.xml", b"B")]


def test_integrity_of_packages(spark, tmp_path):
    (tmp_path / "old").mkdir(), (tmp_path / "new").mkdir()
    package(tmp_path / "old" / "a.docx", BODY)
    package(tmp_path / "new" / "a.docx", BODY.replace("bold", "BOLD"), notes="")
    old, new = (office.entries(office.packages(spark, str(tmp_path / d))).withColumn("doc", F.lit(1)) for d in ("old", "new"))
    got = integrity(old, new, ["doc"], F.col("entry").isin("word/footnotes.xml", "word/header1.xml"), F.col("entry") == "word/document.xml")
    assert [(r.entry, r.breach) for r in got.collect()] == [("word/footnotes.xml", "changed")]


A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def embedding(path, chart):
    with zipfile.ZipFile(path, "w") as z:
        types = (("charts/chart1", "drawingml.chart"), ("diagrams/data1", "drawingml.diagramData"), ("charts/lost", "drawingml.chart"))
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">' + "".join(f'<Override PartName="/word/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for n, t in types) + "</Types>")
        z.writestr("_rels/.rels", rels(("officeDocument", "word/document.xml")))
        z.writestr("word/_rels/document.xml.rels", rels(("chart", "charts/chart1.xml"), ("diagramData", "diagrams/data1.xml")))
        z.writestr("word/document.xml", f"<w:document {W}/>")
        z.writestr("word/charts/chart1.xml", chart)
        z.writestr("word/charts/lost.xml", chart)
        z.writestr("word/diagrams/data1.xml", f"<x {A}><a:t>one  two</a:t><b:t xmlns:b='o'>not this</b:t><a:t/></x>")


def test_texts_of_charts_and_diagrams(spark, tmp_path):
    chart = f"<?xml version='1.0' encoding='utf-8'?><c:c xmlns:c='c' {A} c:odd='a&gt;b'><!-- <a:t>no</a:t> --><a:t>one  two</a:t><a:t> </a:t><a:t xml:space=\"preserve\">Grün &amp;  &lt;x&gt;</a:t><a:t><![CDATA[keep]]></a:t></c:c>"
    embedding(tmp_path / "a.docx", chart.encode())
    embedding(tmp_path / "b.docx", b"<broken")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    parts = office.embedded_parts(office.packages(spark, str(tmp_path))).withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))
    texts = office.embedded_texts(parts)
    assert sorted((r.path, r.kind, r.node, r.text) for r in texts.collect()) == [
        ("a.docx", "chart", 0, "one  two"), ("a.docx", "chart", 2, "Grün &  <x>"), ("a.docx", "chart", 3, "keep"), ("a.docx", "diagram", 0, "one  two"), ("b.docx", "diagram", 0, "one  two"),
    ]
    asked = corrected_as_a_whole(texts, lambda prompts, said: [" " if t == "keep" else t.replace("  ", " ") for t in said])
    new = office.embedded_replaced(parts, asked, ["path", "entry"])
    assert new.columns == parts.columns
    got = {(r.path, r.kind): bytes(r.content).decode() for r in new.collect()}
    assert got["a.docx", "chart"] == chart.replace(">one  two<", ">one two<").replace("Grün &amp;  &lt;", "Gr&#252;n &amp; &lt;")
    assert got["b.docx", "chart"] == "<broken"
    assert [r.text for r in office.embedded_texts(new).where("path = 'a.docx' and kind = 'chart'").orderBy("node").collect()] == ["one two", "Grün & <x>", "keep"]


def test_texts_of_odd_parts(spark):
    parts = spark.createDataFrame([(1, None, "x"), (2, b"", "x"), (3, f"<x {A}><a:t>é</a:t></x>".encode("utf-16"), "x")], "id int, content binary, `odd.name` string")
    texts = office.embedded_texts(parts)
    assert texts.columns == ["id", "odd.name", "node", "text"]
    assert [r.text for r in texts.collect()] == ["é"]
    new = office.embedded_replaced(parts, texts.withColumn("corrected", F.lit("ü<")), ["id"])
    assert [r.text for r in office.embedded_texts(new).collect()] == ["ü<"]


def test_relations_of_equal_bytes_are_parsed_once():
    content = rels(("header", "a.xml"), ("header", "../b.xml"), ("header", "/c/d.xml")).encode()
    office._parsed.cache_clear()
    found = [office._related(folder, content) for folder in ("word", "word", "", "word")]
    assert found[0] == (("header", "word/a.xml"), ("header", "b.xml"), ("header", "c/d.xml")) == found[1] and found[2][0] == ("header", "a.xml")
    assert office._parsed.cache_info().misses == 2
    assert office._related("word", b"no xml") == () == office._related("word", None)
    office._related("word", content + b" " * office._REMEMBERED)
    assert office._parsed.cache_info().misses == 3  # large ones aren't remembered


def test_paragraph_batches_hold_empty_runs(spark, tmp_path):
    body = "<w:p/><w:p><w:r><w:t>a</w:t></w:r><w:r><w:tab/></w:r></w:p><w:p/>"
    package(tmp_path / "a.docx", body)
    rows = office.read_paragraphs(office.packages(spark, str(tmp_path))).where("part_kind = 'main'").orderBy("pos").collect()
    assert [[(x.run_id, x.text, x.has_tab) for x in r.runs] for r in rows][:3] == [[], [(0, "a", False), (1, "", True)], []]
