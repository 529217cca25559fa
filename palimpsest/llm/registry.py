"""The thin queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import ann, bpe, decon, divergence, fim, langid, lm, pieces, pii, quality, rollup, secrets, simhash
from .common import forget, read, shared_dir


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; those that are toxic go; the others are revised, their decorations taken out.  The middle batch is committed twice, which changes nothing."""
    docs = read(spark, sf_dir, "documents").withColumn("revised", F.regexp_replace("text", "[&$#%*!|]", ""))
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    ledger = rollup.Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex[:12]}")
    forget(spark, ledger.path)
    path = f"{ledger.path}/documents"
    rollup.counted(docs, ["doc_id", "source", "lang"], {"before": "text", "after": "revised"}).write.parquet(path)
    counts = spark.read.parquet(path)
    ledger.commit("load", rollup.inserted(counts))
    for _ in range(2):
        ledger.commit("takedown", rollup.deleted(counts.join(toxic, "doc_id", "left_semi")))
    ledger.commit("cleaning", rollup.revised(counts.join(toxic, "doc_id", "left_anti").where("before != after")))
    return ledger.totals()


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.qualities(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return bpe.bpe_digest(read(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op11_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return pieces.piece_digest(read(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle_digest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm, op2_token_counts, op3_quality, op4_pii, op5_neighbours, op6_decontamination, op7_secrets, op8_language, op9_bpe, op10_simhash, op11_sentencepiece, op12_divergence, op13_fim)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "len(regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+'))"
_PIECES = "len(regexp_extract_all({}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+|[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}\\x20\\x09-\\x0D]'))"
_REVISED = "regexp_replace(coalesce(text, ''), '[&$#%*!|]', '', 'g')"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

ORACLE_SQL: dict[str, str] = {
    "op2_token_counts": f"""
WITH gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
d AS (SELECT source, lang, {_REVISED} AS t FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL)),
c AS (SELECT source, lang, 'words/1' AS tokenizer, {_WORDS.format("t")} AS n FROM d UNION ALL SELECT source, lang, 'pieces/1', {_PIECES.format("t")} FROM d)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL""",
    "op5_neighbours": f"""
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS d FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
w AS (SELECT vec_id, list_transform(d, lambda x: x / pow(2, floor(log2(list_max(list_transform(d, lambda y: abs(y))))))) AS e FROM v),
q AS (SELECT vec_id AS query_id, min(e) AS qe FROM w WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT query_id, vec_id, list_inner_product(qe, e) / (sqrt(list_inner_product(qe, qe)) * sqrt(list_inner_product(e, e))) AS score
      FROM q JOIN w ON vec_id <> query_id AND len(qe) = len(e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op6_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
       FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, item, dw.n AS n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r),
same AS (SELECT x.r, y.k, x.i, x.i - y.i AS diag FROM (SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d) x
         JOIN (SELECT k, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM (SELECT row_number() OVER () AS k, w FROM (SELECT DISTINCT w FROM b))) y USING (v)),
l AS (SELECT r, max(c) AS longest FROM (SELECT r, count(*) AS c FROM (SELECT r, k, diag, i - row_number() OVER (PARTITION BY r, k, diag ORDER BY i) AS run FROM same) GROUP BY r, k, diag, run) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN l USING (r)""",
    "op12_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total, v FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p FROM a),
l AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM a GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n::HUGEINT + 5)) // (total + 5 * v)::HUGEINT AS q FROM l JOIN v USING (lang)),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50""",
    "op13_fim": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, len(w) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS x FROM d),
f AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, array_to_string(list_slice(w, 1, a), '') AS p, array_to_string(list_slice(w, a + 1, b), '') AS m, array_to_string(list_slice(w, b + 1, n), '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o""",
}
