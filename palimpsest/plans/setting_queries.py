"""Queries over settings and sinks: names of languages, presets, modes, bounds, profiles of the pacer, tables and logs that are written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations
from ..functions import text as tx
from ..operators import lookup, pacing, validation
from ..sources import shared, sinks
from ..sources.tables import table
from . import deadline, settings
from .record_queries import pacing_events
from .registry import query

# What each language calls English, German, French and Spanish.
_NAMES = """bg английски немски френски испански
cs angličtina němčina francouzština španělština
da engelsk tysk fransk spansk
de Englisch Deutsch Französisch Spanisch
el Αγγλικά Γερμανικά Γαλλικά Ισπανικά
en English German French Spanish
es inglés alemán francés español
et inglise saksa prantsuse hispaania
fi englanti saksa ranska espanja
fr anglais allemand français espagnol
ga Béarla Gearmáinis Fraincis Spáinnis
hr engleski njemački francuski španjolski
hu angol német francia spanyol
it inglese tedesco francese spagnolo
lt anglų vokiečių prancūzų ispanų
lv angļu vācu franču spāņu
mt Ingliż Ġermaniż Franċiż Spanjol
nl Engels Duits Frans Spaans
pl angielski niemiecki francuski hiszpański
pt inglês alemão francês espanhol
ro engleză germană franceză spaniolă
sk angličtina nemčina francúzština španielčina
sl angleščina nemščina francoščina španščina
sv engelska tyska franska spanska"""
_READERS = [*lookup.LANGUAGES, "xx"]


@query(f"""WITH l AS (SELECT string_split(unnest(string_split('{_NAMES}', chr(10))), ' ') AS w), t AS (SELECT w[1] AS ui, unnest(['en', 'de', 'fr', 'es']) AS target, unnest(w[2:]) AS name FROM l),
d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' Klingon ' WHEN doc_id % 7 = 1 THEN ' ' || upper(lang) || ' ' ELSE lang END AS target, ['{"', '".join(_READERS)}'][doc_id % {len(_READERS)} + 1] AS reader FROM documents)
SELECT doc_id, coalesce(t.name, trim(d.target)) AS display_name FROM d LEFT JOIN t ON t.ui = CASE WHEN reader = 'xx' THEN 'en' ELSE reader END AND t.target = lower(trim(d.target))""")
def language_names(spark, sf_dir):
    """Languages of documents as readers in 24 languages call them, and in one that isn't known."""
    d, turn = table(spark, sf_dir, "documents"), F.col("doc_id") % 7
    target = F.when(turn == 0, F.lit(" Klingon ")).when(turn == 1, F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))).otherwise(F.col("lang"))
    reader = F.element_at(F.array(*map(F.lit, _READERS)), (F.col("doc_id") % len(_READERS) + 1).cast("int"))
    return lookup.language_display_names(d.select("doc_id", target.alias("target"), reader.alias("reader")), "target", "reader").select("doc_id", "display_name")


@query("""WITH p AS (SELECT o_custkey AS c, o_orderkey AS n, ['en', 'de', 'fr'][o_orderkey % 3 + 1] AS locale, CASE WHEN o_orderkey % 5 = 0 THEN 'Default-' || ['en', 'de', 'fr'][o_orderkey % 3 + 1] ELSE 'P' || o_orderkey % 7 END AS id, 'v' || o_orderkey AS value FROM orders),
a AS (SELECT c_custkey AS c, ['en', 'de', 'fr', 'es'][c_custkey % 4 + 1] AS language, 'p' || c_custkey % 7 AS active FROM customer),
r AS (SELECT a.c, a.language, p.id, p.value, row_number() OVER (PARTITION BY a.c ORDER BY CASE WHEN lower(p.id) = a.active THEN 0 WHEN lower(p.id) = 'default-' || a.language THEN 1 ELSE 2 END, p.n) AS k FROM a LEFT JOIN p ON p.c = a.c AND p.locale = a.language)
SELECT c AS c_custkey, language, coalesce(id, 'default-' || language) AS preset_id, coalesce(value, 'prompt in ' || language) AS value, id IS NULL AS added FROM r WHERE k = 1""")
def active_presets(spark, sf_dir):
    """Of customers' presets, one for each order, the one that holds; a default for those without any in their language."""
    of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))
    n, c = F.col("o_orderkey"), F.col("c_custkey")
    locale = of(("en", "de", "fr"), n)
    name = F.when(n % 5 == 0, F.concat(F.lit("Default-"), locale)).otherwise(F.concat(F.lit("P"), (n % 7).cast("string")))
    presets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), n.alias("n"), name.alias("id"), locale.alias("locale"), F.concat(F.lit("v"), n.cast("string")).alias("value"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", of(("en", "de", "fr", "es"), c).alias("language"), F.concat(F.lit(" P"), (c % 7).cast("string")).alias("active_id"))
    return lookup.active_presets(asked, presets, ["c_custkey"], F.concat(F.lit("prompt in "), F.col("language")))


_MODES = (" Off", "AUTO", "with-space", "WithSpace", "without_space", "withoutspace ", "other", None)


@query("""WITH m AS (SELECT doc_id, [' Off', 'AUTO', 'with-space', 'WithSpace', 'without_space', 'withoutspace ', 'other', NULL][doc_id % 8 + 1] AS raw, coalesce(text, '') || repeat(' S. 3 ff.', doc_id % 3) || repeat(' S. 4f.', doc_id % 5) AS text FROM documents),
c AS (SELECT doc_id, CASE lower(trim(raw)) WHEN 'off' THEN 'off' WHEN 'with-space' THEN 'with_space' WHEN 'withspace' THEN 'with_space' WHEN 'without_space' THEN 'without_space' WHEN 'withoutspace' THEN 'without_space' ELSE 'auto' END AS mode,
 len(regexp_extract_all(text, '(?i)s\\.[\\s\\x{00A0}]*[0-9]+[ \\x{00A0}](ff|f)\\.')) AS spaced, len(regexp_extract_all(text, '(?i)s\\.[\\s\\x{00A0}]*[0-9]+(ff|f)\\.')) AS closed FROM m)
SELECT doc_id, mode, CASE WHEN mode = 'off' THEN NULL WHEN mode <> 'auto' THEN mode WHEN spaced >= closed THEN 'with_space' ELSE 'without_space' END AS style FROM c""")
def citation_modes(spark, sf_dir):
    """The setting's names in several spellings, and the style that follows for a text."""
    raw = F.element_at(F.array(*map(F.lit, _MODES)), (F.col("doc_id") % len(_MODES) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit(" S. 3 ff."), (F.col("doc_id") % 3).cast("int")), F.repeat(F.lit(" S. 4f."), (F.col("doc_id") % 5).cast("int")))
    rows = table(spark, sf_dir, "documents").select("doc_id", citations.style_mode(raw).alias("mode"), tx.let(text, lambda t: F.array(*citations.style_counts(t))).alias("n"))
    return rows.select("doc_id", "mode", citations.resolved_style(F.col("mode"), F.get("n", F.lit(0)), F.get("n", F.lit(1))).alias("style"))


_BOUNDS = {"chunk_chars": settings.CHUNK, "batch_paragraphs": settings.BATCH_PARAGRAPHS, "parallel": settings.PARALLEL, "temperature": (0.0, 0.0, 2.0)}
_SHARES = {"chunk_chars": 1, "batch_paragraphs": 500, "parallel": 4000, "temperature": 30000}


@query("WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN CAST('NaN' AS DOUBLE) WHEN 3 THEN CAST('inf' AS DOUBLE) WHEN 4 THEN -l_extendedprice ELSE l_extendedprice END AS v FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"max(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN {d} ELSE least(greatest(v / {_SHARES[name]}, {low}), {high}) END) AS {name}" for name, (d, low, high) in _BOUNDS.items()) + " FROM v GROUP BY ALL")
def numeric_settings(spark, sf_dir):
    """The largest of each line's numbers, brought within their bounds; those that aren't numbers get their default."""
    line, price = F.col("l_linenumber"), F.col("l_extendedprice")
    v = F.when(line == 1, F.lit(None)).when(line == 2, F.lit(float("nan"))).when(line == 3, F.lit(float("inf"))).when(line == 4, -price).otherwise(price)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(validation.clamped(F.col("v") / _SHARES[name], bounds)).alias(name) for name, bounds in _BOUNDS.items()])


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'secret of error' WHEN 1 THEN CASE WHEN event_type = 'error' THEN 'secret of error' ELSE '' END WHEN 2 THEN event_type WHEN 3 THEN '' ELSE '' END AS key FROM events""")
def resolved_keys(spark, sf_dir):
    """Keys as they are, and those of variables that they name."""
    turn, kind = F.col("event_id") % 5, F.col("event_type")
    raw = F.when(turn == 0, F.lit("env: error ")).when(turn == 1, F.concat(F.lit("ENV:"), kind)).when(turn == 2, F.concat(F.lit(" "), kind, F.lit(" "))).when(turn == 3, F.lit("  "))
    return table(spark, sf_dir, "events").select("event_id", validation.resolved_key(raw, {"error": "secret of error"}).alias("key"))


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(CAST(ts AS TIMESTAMP)) / CAST(1000 AS DOUBLE) AS t, event_type = 'error' AS hit, CASE WHEN event_id % 5 = 0 THEN 2000.0 ELSE 0.0 END AS pause FROM events WHERE user_id IS NOT NULL),
s AS (SELECT key, CAST(0 AS BIGINT) AS seq, CAST(1500 AS DOUBLE) AS iv, CAST(0 AS DOUBLE) AS free, CAST(-1e300 AS DOUBLE) AS burst, 0 AS run, CAST(0 AS DOUBLE) AS slot FROM (SELECT DISTINCT key FROM e)
UNION ALL
SELECT key, seq, iv, greatest(t, free) + iv * (1 + (2 * (seq % 5 / CAST(4 AS DOUBLE)) - 1) * CAST(0.25 AS DOUBLE)), burst, run, greatest(t, free) FROM (
 SELECT key, seq, t, burst, CASE WHEN hit THEN greatest(free, t + greatest(iv, pause)) ELSE free END AS free, CASE WHEN falls THEN greatest(iv - 150, 1500) ELSE iv END AS iv, CASE WHEN falls THEN 0 ELSE run END AS run FROM (
  SELECT *, NOT hit AND run >= 20 AS falls FROM (
   SELECT key, seq, t, hit, pause, free, CASE WHEN grows THEN least(iv * 2, 15000) ELSE iv END AS iv, CASE WHEN grows THEN t + least(iv * 2, 15000) ELSE burst END AS burst, CASE WHEN grows OR (NOT hit AND iv <= 1500) THEN 0 WHEN hit THEN run ELSE run + 1 END AS run FROM (
    SELECT s.key, e.seq, e.t, e.hit, e.pause, s.iv, s.free, s.burst, s.run, e.hit AND e.t >= s.burst AS grows FROM s JOIN e ON e.key = s.key AND e.seq = s.seq + 1)))))
SELECT 'manual' AS profile, key, seq, iv AS interval_ms, slot AS slot_ms FROM s WHERE seq > 0 UNION ALL SELECT 'local', key, seq, CAST(0 AS DOUBLE), t FROM e""")
def pacing_profiles(spark, sf_dir):
    """The pacer with 40 requests a minute set by hand, its waits spread, and without any waits."""
    events = pacing_events(spark, sf_dir).withColumn("jitter", F.col("seq") % 5 / 4.0)
    rows = [pacing.paced(events, limits).select(F.lit(name).alias("profile"), "key", "seq", "interval_ms", "slot_ms") for name, limits in (("manual", pacing.manual(40)), ("local", pacing.LIMITS["local"]))]
    return rows[0].unionByName(rows[1])


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY o_orderstatus")
def promoted_table(spark, sf_dir):
    """A table put in its place twice, the second time over what was there, within the time that a run may take; read back and summed up."""
    path, o = f"{shared.folder(spark, 'promoted')}/orders", table(spark, sf_dir, "orders")
    for rows in (o.where("o_orderkey % 2 = 0"), o):
        deadline.within(spark, deadline.RUN_SECONDS, lambda rows=rows: sinks.promoted(rows.select("o_orderkey", "o_orderstatus"), path))
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ts_ms, event_type AS event, props AS details FROM events""")
def written_log(spark, sf_dir):
    """Events written to a log in two goes and read back, from the current log and those that were turned over."""
    path = shared.folder(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_type").alias("event"), F.col("props").alias("details"))
    for k in (0, 1):
        sinks.log_events(e.where(F.col("event_id") % 2 == k), path)
    return sinks.logged(spark, path).select("event_id", "ts_ms", "event", "details")
