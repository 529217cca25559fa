"""Queries over corrections and replies: what becomes of runs, what replies make of paragraphs, the whole run over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diff, labels, replies
from ..functions import growth as script
from ..operators import growth, revisions
from ..operators.correct import applied, rules, with_retries
from ..operators.correct import replies as replied
from ..sources.tables import table
from . import document_run
from .paragraph_queries import _ENTRIES, CORRECTIONS, LABELLED, _choice, _entries, _label_token, corrections, labelled, paras
from .registry import PARAS, query


@query(f"WITH {_ENTRIES} SELECT doc_id, pos, seq, kind, row_number() OVER (PARTITION BY doc_id ORDER BY pos, seq) AS rev_id FROM entries WHERE kind <> 'equal'")
def revision_numbers(spark, sf_dir):
    """Every insertion and deletion with its number in its document."""
    rows = revisions.numbered(_entries(spark, sf_dir), ["doc_id"], ["pos", "seq"])
    return rows.where("rev_id is not null").select("doc_id", "pos", "seq", "kind", "rev_id")


@query(f"""WITH {_ENTRIES}, t AS (SELECT *, regexp_extract(token, '^[\\s\\x{{00A0}}]*') AS lead, regexp_extract(token, '[\\s\\x{{00A0}}]*$') AS trail FROM entries),
m AS (SELECT *, substr(token, length(lead) + 1, greatest(0, length(token) - length(lead) - length(trail))) AS body, CASE kind WHEN 'insert' THEN 'ins' ELSE 'del' END AS tag FROM t),
e AS (SELECT doc_id, pos, seq, CASE WHEN kind = 'equal' THEN token WHEN body = '' THEN lead ELSE lead || chr(1) || tag || chr(2) || body || chr(1) || '/' || tag || chr(2) || trail END AS x FROM m),
s AS (SELECT doc_id, pos, string_agg(x, '' ORDER BY seq) AS x FROM e GROUP BY doc_id, pos)
SELECT doc_id, pos, sha256(replace(replace(replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), chr(1), '<'), chr(2), '>')) AS html_sha256 FROM s""")
def html_entries(spark, sf_dir):
    """Entries as HTML, with their marks; the white space at their ends outside."""
    rows = _entries(spark, sf_dir).groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "token"))).alias("ops"))
    return rows.select("doc_id", "pos", F.sha2(revisions.html(F.col("ops")), 256).alias("html_sha256"))


@query(f"""WITH {CORRECTIONS} SELECT doc_id, pos, sha256(left(original, length(original) // 2)) AS a_sha256, sha256(substr(original, length(original) // 2 + 1)) AS b_sha256, sha256(corrected) AS corrected_sha256, 1 AS marks, CAST(length(original) // 2 AS INTEGER) AS mark_at FROM corrections""")
def revision_runs(spark, sf_dir):
    """Entries as runs: the halves of the original have formats of their own, a mark stands between them, insertions have the new format."""
    c = revisions.compared(corrections(spark, sf_dir).repartition("doc_id", "pos"))
    n = F.length("original")
    half = F.floor(n / 2).cast("int")
    span = lambda size, name: F.struct(size.alias("size"), F.lit(name).alias("props"))
    runs = revisions.revision_runs("ops", F.array(span(half, "a"), span((n - half).cast("int"), "b")), F.array(span(F.length("corrected"), "c")), F.array(half))
    rows = c.select("doc_id", "pos", runs.alias("runs"))
    text = lambda keep: F.sha2(F.array_join(F.transform(F.filter("runs", keep), lambda r: r["text"]), ""), 256)
    mark = F.filter("runs", lambda r: r["kind"] == "mark")
    kept = text(lambda r: ((r["kind"] == "equal") & r["props"].isin("a", "b")) | ((r["kind"] == "insert") & (r["props"] == "c")))
    return rows.select("doc_id", "pos", text(lambda r: r["props"] == "a").alias("a_sha256"), text(lambda r: r["props"] == "b").alias("b_sha256"), kept.alias("corrected_sha256"), F.size(mark).alias("marks"), F.get(mark, F.lit(0))["offset"].alias("mark_at"))


@query(f"WITH {CORRECTIONS} SELECT doc_id, pos, 3 AS runs, sha256(corrected) AS corrected_sha256 FROM corrections")
def runs_write_back(spark, sf_dir):
    """A correction dealt to the three runs of a paragraph: together they are the whole of it."""
    c = corrections(spark, sf_dir).repartition("doc_id", "pos")
    n = F.length("original")
    a, b = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    runs = F.array(F.left("original", a), F.substr("original", a + 1, b - a), F.substr("original", b + 1))
    dealt = c.select("doc_id", "pos", diff.dealt_to_runs(runs, F.col("corrected")).alias("dealt"))
    return dealt.select("doc_id", "pos", F.size("dealt").alias("runs"), F.sha2(F.array_join("dealt", ""), 256).alias("corrected_sha256"))


@query(f"WITH {CORRECTIONS} SELECT doc_id, pos, 'Alpha ' AS a, sha256(f) AS b_sha256, ' omega' AS c FROM fixed")
def runs_kept(spark, sf_dir):
    """A correction inside the middle run leaves its neighbours as they are."""
    t = F.col("text")
    p = paras(spark, sf_dir).repartition("doc_id", "pos")
    dealt = diff.dealt_to_runs(F.array(F.lit("Alpha "), t, F.lit(" omega")), F.concat(F.lit("Alpha "), rules(t), F.lit(" omega")))
    return p.select("doc_id", "pos", dealt.alias("d")).select("doc_id", "pos", F.col("d")[0].alias("a"), F.sha2(F.col("d")[1], 256).alias("b_sha256"), F.col("d")[2].alias("c"))


#: Of the lists a and b whose table would be too large, how many entries are equal at the start, and at the end of the rest.
_ENDS = """SELECT doc_id, pos, a, b, coalesce((SELECT min(k) - 1 FROM (SELECT unnest(generate_series(1, least(len(a), len(b)))) AS k) WHERE a[k] <> b[k]), least(len(a), len(b))) AS head FROM t WHERE (len(a) + 1) * (len(b) + 1) > 2000000"""
_TAILS = """SELECT doc_id, pos, a, b, head, least(least(len(a), len(b)) - head, coalesce((SELECT min(k) FROM (SELECT unnest(generate_series(0, least(len(a), len(b)) - 1)) AS k) WHERE a[len(a) - k] <> b[len(b) - k]), least(len(a), len(b)))) AS tail FROM ends"""


@query(f"""WITH {CORRECTIONS}
SELECT doc_id, pos, round(2.0 * length(f) / CAST(length(original) + length(f) AS DOUBLE), 6) AS similarity FROM fixed WHERE original <> ''""")
def character_similarity(spark, sf_dir):
    """Similarity by the longest common subsequence of characters, of texts of any length.  The rules only take characters out, so all of the corrected text is common."""
    p = paras(spark, sf_dir).where("text <> ''").repartition("doc_id", "pos")
    return p.select("doc_id", "pos", F.round(diff.character_similarity("text", rules(F.col("text"))), 6).alias("similarity"))


_TOKENS = "regexp_extract_all({}, '[\\p{{L}}\\p{{Nd}}]+|(?s:.)')"


@query(f"""WITH {CORRECTIONS}, l AS (SELECT doc_id, pos, original, f, list_filter(string_split_regex(trim(original), '\\s+'), lambda x: x <> '') AS tokens FROM fixed WHERE trim(original) <> ''),
n AS (SELECT doc_id, pos, original, CASE WHEN length(f) / CAST(length(original) AS DOUBLE) BETWEEN 0.2 AND 4.0 THEN f ELSE original END AS f FROM l
  WHERE NOT (NOT regexp_matches(original, '\\p{{L}}') OR (length(trim(original)) <= 32 AND len(tokens) <= 6 AND len(list_filter(tokens, lambda x: NOT {_label_token("x", "len(tokens) > 1")})) = 0))),
t AS (SELECT doc_id, pos, {_TOKENS.format("original")} AS a, {_TOKENS.format("f")} AS b FROM n WHERE original <> f), ends AS ({_ENDS}), tails AS ({_TAILS}),
q AS (SELECT doc_id, pos, length(array_to_string(a[1:head], '') || array_to_string(a[len(a) - tail + 1:], '')) AS same FROM tails),
r AS (SELECT doc_id, original, f, coalesce(same, length(f)) AS eq FROM n LEFT JOIN q USING (doc_id, pos)),
s AS (SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE original <> f) AS changed, CAST(sum(length(f) - eq) AS BIGINT) AS inserted, CAST(sum(length(original) - eq) AS BIGINT) AS deleted, CAST(sum(eq) AS BIGINT) AS "equal" FROM r GROUP BY doc_id)
SELECT *, CASE WHEN 2 * "equal" + inserted + deleted = 0 THEN 1.0 ELSE round(2 * "equal" / CAST(2 * "equal" + inserted + deleted AS DOUBLE), 6) END AS similarity FROM s""")
def document_summary(spark, sf_dir):
    return document_run.summary(spark, sf_dir)


_LETTERS = "trim(regexp_replace('word ' || regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'))"


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of plain words, none empty."""
    return _letters_of(paras(spark, sf_dir))


def _letters_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.trim(F.regexp_replace(F.concat(F.lit("word "), F.regexp_replace("text", "[^A-Za-z ]+", "")), " {2,}", " ")))


def _around(lead: str, text: Column, trail: str) -> Column:
    return F.concat(F.lit(lead), text, F.lit(trail))


@query(f"WITH {PARAS}, w AS (SELECT doc_id, pos, {_LETTERS} AS t FROM paras) SELECT doc_id, pos, sha256(t) AS text_sha256 FROM w")
def reply_sanitizer(spark, sf_dir):
    """Marks, fences, quotes, numbers, notes and odd characters around a reply go."""
    t = F.col("text")
    marks = (("**", "**"), ("`", "`"), ('"', '"'), ("# ", ""), ("(Note: as asked) ", ""), ("1. ", ""), ("```text\n", "\n```"), ("[", "](http://x)"), (" \x01_", "_\n"))
    said = _choice(F.col("pos") % len(marks), *[_around(a, t, b) for a, b in marks])
    return _letters(spark, sf_dir).select("doc_id", "pos", F.sha2(replies.sanitized(said, t), 256).alias("text_sha256"))


@query(f"""WITH {PARAS}, w AS (SELECT doc_id, pos, {_LETTERS} AS t FROM paras),
x AS (SELECT *, CASE pos % 5 WHEN 4 THEN '1. ' || t || '  ' ELSE t END AS o, CASE pos % 5 WHEN 1 THEN t || '.' WHEN 2 THEN rtrim(repeat(t || ' ', 5)) WHEN 4 THEN '1. ' || t || ' end  ' ELSE t END AS n FROM w),
y AS (SELECT *, length(n) / CAST(length(o) AS DOUBLE) BETWEEN 0.2 AND 4.0 AS near FROM x)
SELECT doc_id, pos, sha256(CASE WHEN near THEN n ELSE o END) AS correct_sha256, sha256(CASE WHEN CASE WHEN length(o) < 40 THEN length(n) <= greatest(length(o) * 6, 60) ELSE near END THEN n ELSE o END) AS translate_sha256 FROM y""")
def applied_replies(spark, sf_dir):
    """What replies make of paragraphs: nothing where they are empty or too long, with the label and the spaces at the ends that the paragraph had."""
    t, at = F.col("text"), F.col("pos") % 5
    said = _choice(at, F.lit("  "), _around("", t, "."), F.rtrim(F.repeat(_around("", t, " "), F.lit(5))), _around("\n ", t, " "), _around("", t, " end"))
    rows = _letters(spark, sf_dir).repartition("doc_id", "pos").withColumns({"reply": said, "text": F.when(at == 4, _around("1. ", t, "  ")).otherwise(t)})
    done = applied(applied(rows, "correct").withColumnRenamed("corrected", "c"), "translate")
    return done.select("doc_id", "pos", F.sha2("c", 256).alias("correct_sha256"), F.sha2("corrected", 256).alias("translate_sha256"))


@query(f"""WITH {LABELLED}, t AS (SELECT l.doc_id, l.pos, p.text AS plain, regexp_extract(l.text, '^(\\S+)\\s', 1) AS a, regexp_extract(l.text, '^\\S+\\s+(\\S*)', 1) AS b, regexp_extract(l.text, '^\\S+\\s+') AS w, l.text FROM labelled l JOIN paras p USING (doc_id, pos))
SELECT doc_id, pos, sha256(CASE WHEN a <> '' AND {_label_token("a", "true")} AND NOT regexp_full_match(b, '\\p{{Nd}}+') AND regexp_matches(substr(text, length(w) + 1), '\\p{{L}}') THEN w ELSE '' END || 'word ' || plain) AS text_sha256 FROM t""")
def label_restore(spark, sf_dir):
    """A label that a correction has dropped leads it again."""
    p = labelled(spark, sf_dir).withColumnRenamed("text", "labelled").join(paras(spark, sf_dir), ["doc_id", "pos"])
    return p.select("doc_id", "pos", F.sha2(labels.label_restored("labelled", _around("word ", F.col("text"), "")), 256).alias("text_sha256"))


@query("""WITH c AS (SELECT doc_id, regexp_extract_all(text, '(?s).{1,500}\\z|.{1,499}[.!?\\r\\n]|.{1,499}\\s|.{500}') AS cs FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(cs, lambda x: CASE WHEN length(x) % 3 = 0 THEN x ELSE x || '+' END), '')) AS reply_sha256 FROM c""")
def chunked_correction(spark, sf_dir):
    """Long texts go in chunks; a chunk without a reply stays as it is."""
    some = lambda prompts, texts: [None if len(t) % 3 == 0 else t + "+" for t in texts]
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_key"), "text")
    return replied(rows, some, "", 500).select(F.col("_key").cast("long").alias("doc_id"), F.sha2("reply", 256).alias("reply_sha256"))


@query(f"""WITH {PARAS}, c AS (SELECT doc_id, pos, regexp_extract_all(text, '(?s).{{1,7500}}\\z|.{{1,1000}}') AS one, text FROM paras)
SELECT doc_id, pos, sha256(CASE WHEN length(text) % 5 = 0 THEN text ELSE text || '+' END) AS reply_sha256 FROM c""")
def retried_replies(spark, sf_dir):
    """A corrector that takes no batches and fails on some texts: those keep their text, all others are asked one by one."""

    def fails(prompts, texts):
        if len(texts) > 1 or len(texts[0]) % 5 == 0:
            raise ValueError
        return [texts[0] + "+"]

    rows = paras(spark, sf_dir).select(F.concat_ws(",", "doc_id", "pos").alias("_key"), "text")
    done = replied(rows, with_retries(fails, wait=lambda s: None), "", 1 << 24)
    key = F.split("_key", ",")
    return done.select(key[0].cast("long").alias("doc_id"), key[1].cast("int").alias("pos"), F.sha2("reply", 256).alias("reply_sha256"))


@query(f"""WITH {PARAS}, w AS (SELECT doc_id, pos, {_LETTERS} AS t FROM paras), x AS (SELECT doc_id, pos, CASE WHEN pos % 2 = 1 THEN chr(9) || t ELSE t END AS o, CASE WHEN pos % 2 = 1 THEN ' ' || t || '.' ELSE t || '.' END AS n FROM w)
SELECT doc_id, pos, sha256(CASE WHEN pos % 5 <> 0 AND length(n) / CAST(length(o) AS DOUBLE) BETWEEN 0.2 AND 4.0 THEN n ELSE o END) AS corrected_sha256 FROM x""")
def guarded_replies(spark, sf_dir):
    """Replies to paragraphs some of which follow a mark, with a tab between, and some of which must not be changed."""
    t, marked = F.col("text"), F.col("pos") % 2 == 1
    rows = _letters(spark, sf_dir).withColumns({"reply": _around("", t, "."), "text": F.when(marked, F.concat(F.lit("\t"), t)).otherwise(t)})
    return applied(rows, after_mark=marked, unsafe=F.col("pos") % 5 == 0).select("doc_id", "pos", F.sha2("corrected", 256).alias("corrected_sha256"))


_ESCAPED = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'\'', '&#39;')"""


@query(f"""WITH {CORRECTIONS}, s AS (SELECT *, unnest([1, 2, 3]) AS k FROM corrections), c AS (SELECT *, left(corrected, length(corrected) * k // 3) AS now, regexp_extract(original, '(?s)^.*[.!?](?:[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]|$)') AS cut FROM s)
SELECT doc_id, pos, CAST(k AS BIGINT) AS step, sha256(CASE WHEN k < 3 AND cut <> '' THEN cut ELSE original END) AS original_sha256, sha256(now) AS corrected_sha256,
  CASE WHEN k = 3 AND pos % 4 = 3 THEN sha256({_ESCAPED.format("original")}) WHEN k = 3 AND pos % 4 = 1 AND corrected = original || ' indeed' AND regexp_matches(original, '[A-Za-z.]$') THEN sha256({_ESCAPED.format("original")} || ' <span class="diff-inserted">indeed</span>') END AS html_sha256 FROM c""")
def growing_diff(spark, sf_dir):
    """What an editor shows of each paragraph while its correction comes in by thirds; HTML of the last where it is one that expressions can tell."""
    n, text = F.length("corrected"), F.col("corrected")
    cut = lambda k: F.floor(n * k / 3).cast("int")
    piece = lambda k: F.struct(F.lit(k).cast("long").alias("seq"), F.when(F.lit(k == 1), F.col("original")).alias("original"), F.substr(text, cut(k - 1) + 1, cut(k) - cut(k - 1)).alias("piece"), F.lit(k == 3).alias("done"))
    rows = corrections(spark, sf_dir).select("doc_id", "pos", F.explode(F.array(*map(piece, (1, 2, 3)))).alias("x")).select("doc_id", "pos", "x.*")
    ops, kind = F.col("ops"), F.col("pos") % 4
    plain = growth.shown(rows, ["doc_id", "pos"]).withColumns({"a": diff.kept_original(ops), "b": diff.accepted(ops)})
    told = F.col("done") & ((kind == 3) | (kind == 1) & (F.col("b") == F.concat("a", F.lit(" indeed"))) & F.col("a").rlike(r"[A-Za-z.]\z"))
    html = F.when(told, F.sha2(script.editor_html(F.when(told, ops)), 256))
    return plain.select("doc_id", "pos", F.col("seq").alias("step"), F.sha2("a", 256).alias("original_sha256"), F.sha2("b", 256).alias("corrected_sha256"), html.alias("html_sha256"))


@query(f"""WITH {PARAS}, w AS (SELECT doc_id, pos, {_LETTERS} AS t FROM paras), x AS (SELECT *, regexp_extract(t, '^[^ ]+') AS first, regexp_extract(t, '[^ ]+$') AS last FROM w)
SELECT doc_id, pos, sha256(CASE pos % 3 WHEN 0 THEN first || 'q' WHEN 1 THEN 'Anew ' || first ELSE first END) AS a_sha256, sha256(CASE WHEN t = first THEN '' ELSE substr(t, length(first) + 1, length(t) - length(first) - length(last)) END) AS b_sha256, sha256(CASE WHEN t = first THEN '' ELSE last || CASE pos % 3 WHEN 2 THEN '!?' ELSE '' END END) AS c_sha256 FROM x WHERE t <> first""")
def corrections_by_run(spark, sf_dir):
    """Which run has which part of a correction, of the first word, the last one and what is between: letters put in at the end of a word, a word before all others, marks after the last."""
    t, turn = F.col("text"), F.col("pos") % 3
    rows = _letters_of(paras(spark, sf_dir).where(t.rlike("[A-Za-z]")))  # those that are more than one word
    first, last = F.substring_index(t, " ", 1), F.substring_index(t, " ", -1)
    a = F.length(first)
    middle = F.substr(t, a + 1, F.length(t) - a - F.length(last))
    said = F.when(turn == 0, F.concat(first, F.lit("q"), F.substr(t, a + 1))).when(turn == 1, F.concat(F.lit("Anew "), t)).otherwise(F.concat(t, F.lit("!?")))
    dealt = rows.repartition("doc_id", "pos").select("doc_id", "pos", diff.dealt_to_runs(F.array(first, middle, last), said).alias("d"))
    return dealt.select("doc_id", "pos", *[F.sha2(F.col("d")[i], 256).alias(f"{n}_sha256") for i, n in enumerate("abc")])


@query(f"""WITH {PARAS}, w AS (SELECT doc_id, pos, {_LETTERS} AS t FROM paras), x AS (SELECT doc_id, pos, t, length(regexp_extract(t, '^[^ ]+ ')) AS lead FROM w)
SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE pos % 3 = 1 OR (pos % 3 = 2 AND lead > 0)) AS changed, CAST(sum(CASE WHEN pos % 3 = 1 THEN 8 ELSE 0 END) AS BIGINT) AS inserted, CAST(sum(CASE WHEN pos % 3 = 2 THEN lead ELSE 0 END) AS BIGINT) AS deleted,
  CAST(sum(length(t) - CASE WHEN pos % 3 = 2 THEN lead ELSE 0 END) AS BIGINT) AS equal FROM x GROUP BY doc_id""")
def diff_amounts(spark, sf_dir):
    """Characters that are put in, taken out and kept: a number after the text, or its first word away."""
    t, turn = F.col("text"), F.col("pos") % 3
    new = F.when(turn == 1, F.concat(t, F.lit(" 1234567"))).when(turn == 2, F.regexp_replace(t, "^[^ ]+ ", "")).otherwise(t)
    rows = _letters(spark, sf_dir).repartition("doc_id", "pos").select("doc_id", "pos", t.alias("original"), new.alias("corrected"))
    return revisions.statistics(revisions.compared(rows), ["doc_id"]).select("doc_id", "paragraphs", "changed", "inserted", "deleted", "equal")
