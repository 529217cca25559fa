"""Work by rows and by packages: what is held, what is read, and how often."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.functions import diff, rows
from palimpsest.operators.correct import replies
from palimpsest.plans import package_run
from palimpsest.plans.queries import QUERIES
from palimpsest.sources import office, packages

from .conftest import DATA
from .test_packages import p, package


def many(path, n, text="As it is"):
    content = package(p(text))
    path.mkdir()
    for i in range(n):
        (path / f"{i}.docx").write_bytes(content)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_packages_are_dealt_to_tasks(tmp_path):
    many(tmp_path / "in", 2500)
    reader = packages.Reader(str(tmp_path / "in"))
    shares = reader.partitions()
    assert len(shares) >= 2 and sum(len(s.paths) for s in shares) == 2500


def test_scans_of_small_packages_have_few_tasks(spark, tmp_path):
    many(tmp_path / "in", 2000)
    found = packages.files(spark, str(tmp_path / "in"))
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and found.count() == 2000


def test_texts_with_revisions_resolved(spark):
    tracked = '<w:p><w:r><w:t>It was </w:t></w:r><w:del w:id="7"><w:r><w:delText>once</w:delText></w:r></w:del><w:ins w:id="8"><w:r><w:t>twice</w:t></w:r></w:ins></w:p>'
    files = spark.createDataFrame([("a", package(tracked + p("Same"))), ("b", b"no package"), ("c", None)], "path string, content binary")
    got = {(r.path, r.accepted, r.label, r.note, r.pos, r.text) for r in packages.resolved_texts(files).collect()}
    told = {(r.path, accept, r.label, r.note, r.pos, r.text) for accept in (True, False) for r in packages.texts_of(files.withColumn("content", packages.resolved("content", accept))).collect()}
    assert got == told and {x[-1] for x in got} >= {"It was twice", "It was once", "Same"}


def test_packages_are_opened_once_to_be_read(spark):
    assert plan(QUERIES["read_packages"](spark, f"{DATA}/sf0.001")).count("binaryFile") == 1


def test_revisions_are_accepted_once(spark):
    files = spark.createDataFrame([("a", package(p("Some  text")))], "path string, content binary")
    assert "resolve(" not in plan(package_run.corrected_packages(files, "A", "2024-01-01T00:00:00Z")) and "resolve(" in plan(package_run.accepted(files))


def test_few_rows_are_objects_at_once():
    seen = []
    f = rows.by_rows("string")(lambda x: seen.append(x) or x)
    column = pa.array([str(i) if i % 7 else None for i in range(1000)])
    assert f.func(column).equals(column) and len(seen) == 1000 and f.func(column[:0]).equals(column[:0])


def test_correctors_are_asked_for_few_texts_at_once(spark):
    most = spark.sparkContext.accumulator(0)

    def counted(prompts, texts):
        most.add(len(texts) > rows.SLICE)
        return [t.upper() for t in texts]

    df = spark.range(1000).select(F.col("id").cast("string").alias("_key"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).coalesce(1)
    assert {r._key: r.reply for r in replies(df, counted, "").collect()} == {str(i): f"T{i}" for i in range(1000)} and most.value == 0


def test_equal_characters_are_those_of_the_diff():
    rng = random.Random(3)
    for _ in range(600):
        a, b = ("".join(rng.choice("ab é😀"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 30))) for _ in "ab")
        parts = diff.pieces(a, b)
        assert diff.equal_characters(a, b) == sum(n for equal, n, _ in parts if equal) and diff.likeness(a, b) == diff._share(parts, len(a) + len(b))
    long = "x" * 900 + "y" * 700
    assert diff.equal_characters(long, "x" * 500 + "z" + "y" * 800) == sum(n for equal, n, _ in diff.pieces(long, "x" * 500 + "z" + "y" * 800) if equal)


def test_letters_are_worked_out_once(spark):
    text = QUERIES["corrections_by_run"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("[^A-Za-z ]") == 1


def test_replies_are_applied_in_tasks_of_paragraphs(spark):
    assert "RepartitionByExpression [doc_id" in QUERIES["applied_replies"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_batches_of_large_packages_are_small(spark, tmp_path):
    noise = random.Random(5)
    path = tmp_path / "in"
    path.mkdir()
    for i in range(300):
        (path / f"{i}.docx").write_bytes(noise.randbytes(60_000))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], ["n"])

    def largest(files):
        return files.select("content").coalesce(1).mapInArrow(sizes, "n int").agg(F.sum("n"), F.max("n")).first()

    for files in (packages.files(spark, str(path)), office.packages(spark, str(path))):
        assert largest(files)[0] == 300 and largest(files)[1] < 150


def test_equal_characters_of_long_texts_are_all_counted():
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abcé") for _ in range(n)) for n in (1600, 1500))
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    assert diff.equal_characters(a, b) == row[-1]
    assert diff.equal_characters("x" + "a!" * 900 + "y", "xa" * 2 + "!" * 900 + "y") < 1800
    assert diff.equal_characters("ab  c!! " * 40000, "ab c! " * 40000) == 240000
