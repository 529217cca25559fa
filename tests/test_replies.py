"""Replies give back what was asked, whatever the paragraphs hold."""

import duckdb

from palimpsest.plans.queries import QUERIES, SQL

from .compare import same

ODD = [
    (1, "one\n\n\ntwo\n"), (2, " led\ttrailed \n \nnext　"), (3, "dos\r\nends\r\n"), (4, "a\rb\n\rc\r\rd\r"), (5, ""), (6, " \n\t"), (7, "```text\ncode\n```\n```"), (8, "twice"), (8, "twice\nagain"), (8, "twice"),
    (9, None), (13, None), (13, "known"), (13, None), (None, "no id"), (10, "plain\ntext"), (11, " x\x85\n\x0by\x1f"), (12, "\n\n" * 50 + "end"),
]


def test_replies_give_back_odd_paragraphs(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(QUERIES["reply_blocks"](spark, str(tmp_path)), duck.sql(SQL["reply_blocks"]))


def test_other_replies_give_their_blocks(spark):
    from palimpsest.functions import replies

    rows = [(["a", " ", "b "], "A\n\nb"), (["a", "b"], "a"), (["a\rb"], "a\r\nb"), (["a\rb"], "a\n\nb"), ([""], "")]
    got = spark.createDataFrame(rows, "asked array<string>, reply string").select(replies.given_back("asked", "reply").alias("v"))
    assert [r.v for r in got.collect()] == [["A", "b"], ["a"], ["a\rb"], ["a", "b"], [""]]
