"""The run over packages: revisions that are there, correctors, parts in scope, formats."""

import io
import zipfile

import pytest

from palimpsest.plans import package_run
from palimpsest.sources import packages

from .test_packages import note, p, package

BOLD = '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">Some  bold</w:t></w:r><w:r><w:t xml:space="preserve"> and plain  text</w:t></w:r></w:p>'
TRACKED = '<w:p><w:r><w:t xml:space="preserve">It was </w:t></w:r><w:del w:id="7" w:author="x" w:date="d"><w:r><w:delText>once</w:delText></w:r></w:del><w:ins w:id="8" w:author="x" w:date="d"><w:r><w:t>twice  so</w:t></w:r></w:ins></w:p>'
BODY = BOLD + TRACKED + p("1.") + p("") + p("As it is")


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a", package(BODY, note(2, "A  note")), 1), ("b", package(p("As it is")), 2), ("c", b"no package", 3), ("d", None, 4)]
    return spark.createDataFrame(rows, "path string, content binary, size int")


def texts(df, accept=None):
    df = df if accept is None else df.withColumn("content", packages.resolved("content", accept))
    return {(r.path, r.label, r.note, r.pos): r.text for r in packages.texts_of(df).collect()}


def test_inspected_and_accepted(files):
    assert {r.path: r.has_tracked_changes for r in package_run.inspected(files).collect()} == {"a": True, "b": False, "c": False, "d": False}
    done = package_run.accepted(files)
    assert not any(r.has_tracked_changes for r in package_run.inspected(done).collect())
    assert "It was twice  so" in texts(done).values() and bytes(done.where("path = 'c'").first().content) == b"no package"


def test_corrected_with_revisions(files):
    out = package_run.corrected_packages(files, "A", "2024-01-01T00:00:00Z").cache()
    assert out.columns == files.columns
    before, after, back = texts(package_run.accepted(files)), texts(out, True), texts(out, False)
    assert back == before and after == {k: v.replace("  ", " ") for k, v in before.items()}
    assert {r.path: r.has_tracked_changes for r in package_run.inspected(out).collect()} == {"a": True, "b": False, "c": False, "d": False}
    rows = {r.path: r.content for r in out.collect()}
    assert rows["d"] is None and bytes(rows["c"]) == b"no package"
    part = zipfile.ZipFile(io.BytesIO(bytes(rows["a"]))).read("word/document.xml").decode()
    assert part.count("<w:del ") == 3 and part.index("<w:b/>") < part.index("<w:del ") and 'w:author="x"' not in part


def test_scope_and_corrector(files):
    asked = files.sparkSession.sparkContext.accumulator(0)

    def loud(prompts, said):
        asked.add(len(said))
        return [None if t == "As it is" else t.replace("note", "remark") for t in said]

    out = package_run.corrected_packages(files, "A", "2024-01-01T00:00:00Z", loud, "prompt", scope=["footnotes"])
    before, after = texts(package_run.accepted(files)), texts(out, True)
    assert {k: v for k, v in after.items() if before[k] != v} == {k: "A  remark" for k, v in before.items() if v == "A  note"} and asked.value == 1
    kept = package_run.corrected_packages(files.where("path <> 'a'"), "A", "2024-01-01T00:00:00Z", loud)
    assert texts(kept) == texts(files.where("path <> 'a'"))


def test_revisions_inside_older_ones(files):
    out = package_run.corrected_packages(files, "A", "2024-01-01T00:00:00Z", accept_existing=False)
    part = zipfile.ZipFile(io.BytesIO(bytes(out.where("path = 'a'").first().content))).read("word/document.xml").decode()
    assert 'w:author="x"' in part and "It was twice so" in texts(out, True).values()


def test_no_packages(files):
    assert package_run.corrected_packages(files.limit(0), "A", "2024-01-01T00:00:00Z").collect() == []
