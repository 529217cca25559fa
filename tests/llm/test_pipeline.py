"""The pipeline against a plain version, and stage by stage on odd tables."""

import hashlib

import public_tokenizers

import corpus_pipeline
from palimpsest.llm import langid, pii

from ..conftest import DATA
from . import plain
from .conftest import DOCS


def test_pipeline(spark):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    path = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    judged = model.predict([t for _, t in rows])
    rows = [r for r, (lang, score) in zip(rows, judged, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    roots = plain.components([(i, plain.fingerprint(t)) for i, t in rows])
    rows = [(i, t) for i, t in rows if roots[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    rows = [r for r, w in zip(rows, plain.overlap([t for _, t in rows], items), strict=True) if not w[-1]]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in rows:
        ids = t.encode(pii.mask(text, pii.find(text)[1]), add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = corpus_pipeline.run(spark, path)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == want and got.count() == len(want)


def test_stages_on_odd_tables(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(plain.ODD_TEXTS)] + [(3, "word", "en", "s", 4), (None, "some text", None, None, None)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, DOCS)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, f"{DATA}/sf0.001")
            assert name == "encoding" or out.columns == docs.columns
            assert out.count() <= docs.count()


def test_clean_documents_stay(spark):
    path = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.language_id(spark, docs, path).count() == docs.count()
