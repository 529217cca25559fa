"""A run that is stopped, that breaks off, and that goes on."""

import pytest
from pyspark.sql import functions as F

from palimpsest.plans import resumed


def paragraphs(spark, n=24):
    rows = [(d, part, pos, f"Text {d} of {part} number {pos}!!" if pos % 4 else "  ") for d in range(n) for part in ("main", "footnotes") for pos in range(6)]
    return spark.createDataFrame(rows, "doc_id long, part_kind string, pos int, text string")


def fixed(rows):
    return rows.withColumn("corrected", F.replace("text", F.lit("!!"), F.lit("!")))


def test_stopped_and_resumed(spark, tmp_path):
    paras, path = paragraphs(spark), f"file://{tmp_path}"
    run = resumed.Run(spark, path, "first")
    assert not run.start(paras, fixed, files=6, files_a_step=2, stop=lambda step: step >= 1)
    half = run.results().count()
    assert 0 < half < paras.where("text <> '  '").count()
    there = {(r.doc_id, r.part_kind): (r.prefix, r.total) for r in run.progress().collect()}
    assert {n for n, _ in there.values()} == {0, 1} and {n for _, n in there.values()} == {1}
    seen = []

    def breaks(rows):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("the service is gone")
        return fixed(rows)

    with pytest.raises(Exception, match="the service is gone"):
        run.start(paras, breaks, files_a_step=2)
    assert run.start(paras, fixed, files_a_step=2) and run.start(paras, breaks)  # nothing is left to ask
    rows = run.results().groupBy("doc_id", "part_kind", "pos").count().collect()
    assert len(rows) == paras.where("text <> '  '").count() and {r["count"] for r in rows} == {1}
    out = run.output(paras).collect()
    assert len(out) == paras.count() and all(r.corrected == r.text.replace("!!", "!") for r in out)
    assert all(r.prefix == r.total for r in run.progress().collect())
    other = resumed.Run(spark, path, "second")
    assert other.results().count() == 0 and other.start(paras.limit(20), fixed) and other.output(paras.limit(20)).count() == 20
