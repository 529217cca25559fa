"""Queries over records: events and pacing, names and keys, payloads, lookups, audits."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, replies, text
from ..operators import audit, correct, fields, graph, lookup, packing, pacing, revisions, segments, validation
from ..sources import office, sinks, tables
from ..sources.tables import table
from ..streaming import pacing as pacing_stream
from ..streaming import tokens as token_stream
from .registry import query


@query("""SELECT user_id, round(list_reduce(list_prepend(NULL, list(value ORDER BY ts, event_id)), lambda a, v: CASE WHEN a IS NULL THEN v ELSE v * CAST(0.3 AS DOUBLE) + a * CAST(0.7 AS DOUBLE) END), 6) AS ema FROM events WHERE value > 0 GROUP BY user_id""")
def latency_ema(spark, sf_dir):
    return audit.latency_averages(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("ema", 6).alias("ema"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE event_type = 'error'),
s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 12 SECONDS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 SECONDS AS ended, count(*) AS refusals FROM s GROUP BY user_id, k""")
def throttle_sessions(spark, sf_dir):
    return pacing_stream.notices(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id")


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(CAST(ts AS TIMESTAMP)) / CAST(1000 AS DOUBLE) AS t, event_type = 'error' AS hit,
  CASE WHEN event_id % 5 = 0 THEN 2000.0 ELSE 0.0 END AS pause, event_id % 97 = 0 AS told FROM events WHERE user_id IS NOT NULL),
s AS (SELECT key, CAST(0 AS BIGINT) AS seq, CAST(500 AS DOUBLE) AS iv, CAST(0 AS DOUBLE) AS learned, CAST(0 AS DOUBLE) AS stated, CAST(0 AS DOUBLE) AS free, CAST(-1e300 AS DOUBLE) AS burst, 0 AS run, CAST(0 AS DOUBLE) AS slot FROM (SELECT DISTINCT key FROM e)
UNION ALL
SELECT key, seq, iv, learned, stated, greatest(t, free) + iv, burst, run, greatest(t, free) FROM (
 SELECT key, seq, t, stated, burst, CAST(CASE WHEN hit THEN greatest(free, t + greatest(iv, pause)) ELSE free END AS DOUBLE) AS free, CASE WHEN falls THEN 0 ELSE run END AS run,
  CASE WHEN falls AND stated = 0 THEN CASE WHEN learned > 0 THEN least(learned, iv) ELSE iv END ELSE learned END AS learned,
  CAST(CASE WHEN falls AND stated > 0 THEN stated WHEN falls THEN greatest(iv - 150, 0.9 * CASE WHEN learned > 0 THEN least(learned, iv) ELSE iv END) ELSE iv END AS DOUBLE) AS iv FROM (
  SELECT *, NOT hit AND run >= CASE WHEN stated > 0 THEN 5 ELSE 20 END AS falls FROM (
   SELECT key, seq, t, hit, pause, stated, free, CAST(CASE WHEN grows THEN grown ELSE iv END AS DOUBLE) AS iv, CAST(CASE WHEN grows AND stated = 0 THEN greatest(learned, grown) ELSE learned END AS DOUBLE) AS learned,
    CAST(CASE WHEN grows THEN t + grown ELSE burst END AS DOUBLE) AS burst, CASE WHEN grows THEN 0 WHEN hit THEN run ELSE run + 1 END AS run FROM (
    SELECT *, hit AND t >= burst AS grows, CAST(least(iv * CASE WHEN stated > 0 THEN 1.5 ELSE 2.0 END, 15000) AS DOUBLE) AS grown FROM (
     SELECT s.key, e.seq, e.t, e.hit, e.pause, s.free, s.burst, s.learned, CASE WHEN told THEN CAST(2100 AS DOUBLE) ELSE stated END AS stated, CASE WHEN told THEN greatest(iv, 2100) ELSE iv END AS iv, CASE WHEN told AND iv < 2100 THEN 0 ELSE run END AS run
     FROM s JOIN e ON e.key = s.key AND e.seq = s.seq + 1))))))
SELECT key, seq, iv AS interval_ms, learned AS learned_floor_ms, stated AS stated_floor_ms, slot AS slot_ms FROM s WHERE seq > 0""")
def adaptive_pacing(spark, sf_dir):
    """The pacer's state after each event of a user: errors as refusals, some with a time to wait or a stated limit."""
    return pacing.paced(pacing_events(spark, sf_dir))


def pacing_events(spark, sf_dir):
    """Events of users as those of the pacer."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.where("user_id is not null").select(
        F.col("user_id").cast("string").alias("key"), seq.alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ts_ms"),
        F.when(F.col("event_type") == "error", "throttled").otherwise("success").alias("outcome"), F.when(F.col("event_id") % 5 == 0, F.lit(2)).cast("int").alias("retry_after_s"),
        F.when(F.col("event_id") % 97 == 0, F.lit(30.0)).alias("header_rpm"), F.lit(0.5).alias("jitter"),
    )


@query("SELECT event_id, CAST(CASE WHEN value % 7 <= 0 THEN 8 WHEN value <= 0 THEN 1 ELSE least(8, greatest(1, ceil(value / (value % 7)))) END AS BIGINT) AS parallel FROM events WHERE value IS NOT NULL")
def parallelism(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", packing.parallelism(F.col("value"), F.expr("value % 7"), F.lit(8)).alias("parallel"))


@query("SELECT event_id, CASE WHEN event_id % 120 >= 3 AND event_id % 120 < 100 THEN CAST(greatest(1, floor(CAST(event_id AS DOUBLE) * (100 - event_id % 120) / (event_id % 120) / 60 + 0.5)) AS BIGINT) END AS minutes FROM events")
def eta(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", packing.minutes_left(F.col("event_id").cast("double"), F.col("event_id") % 120).alias("minutes"))


@query("""WITH b AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN (event_id % 90) || 's' WHEN 2 THEN (event_id % 9000) || 'ms' WHEN 3 THEN (event_id % 70) || '.5s' END AS d, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 40 AS VARCHAR) END AS h FROM events),
s AS (SELECT event_id, CASE WHEN h IS NOT NULL THEN greatest(1, CAST(h AS BIGINT)) WHEN ends_with(d, 'ms') THEN greatest(1, CAST(ceil(CAST(replace(d, 'ms', '') AS DOUBLE) / 1000) AS BIGINT)) WHEN ends_with(d, 's') THEN greatest(1, CAST(ceil(CAST(replace(d, 's', '') AS DOUBLE)) AS BIGINT)) END AS seconds FROM b)
SELECT event_id, seconds, CAST(greatest(500 * (event_id % 4), coalesce(seconds * 1000, 0)) AS BIGINT) AS delay_ms FROM s""")
def retry_delay(spark, sf_dir):
    i = F.col("event_id")
    d = F.when(i % 5 == 0, F.lit("x")).when(i % 5 == 1, F.concat((i % 90).cast("string"), F.lit("s"))).when(i % 5 == 2, F.concat((i % 9000).cast("string"), F.lit("ms"))).when(i % 5 == 3, F.concat((i % 70).cast("string"), F.lit(".5s")))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(d.alias("retryDelay"))).alias("details")).alias("error")))
    seconds = replies.retry_seconds(F.when(i % 7 == 0, (i % 40).cast("string")), body)
    return table(spark, sf_dir, "events").select("event_id", seconds.alias("seconds"), replies.retry_delay_ms(i % 4, seconds).alias("delay_ms"))


@query("SELECT event_id, 400 + CAST(event_id % 140 AS INTEGER) AS status, (400 + event_id % 140) IN (429, 503, 529) AS throttled FROM events")
def throttle_predicate(spark, sf_dir):
    status = (F.lit(400) + (F.col("event_id") % 140)).cast("int")
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), replies.is_throttled(status).alias("throttled"))


_ERRORS = ("temperature is not supported here", "Unsupported parameter unsupported_parameter", "reasoning effort unknown", "thinking budget too large", "quota exceeded")


@query("WITH e AS (SELECT event_id, [" + ", ".join(f"'{e}'" for e in _ERRORS) + "][event_id % 5 + 1] AS m FROM events) SELECT event_id, contains(lower(m), 'unsupported_parameter') OR (contains(lower(m), 'temperature') AND contains(lower(m), 'not supported')) AS temperature, regexp_matches(lower(m), 'reasoning|thinking') AS reasoning FROM e")
def error_classes(spark, sf_dir):
    message = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 5 + 1).cast("int"))
    body = F.to_json(F.struct(F.struct(message.alias("message")).alias("error")))
    return table(spark, sf_dir, "events").select("event_id", replies.temperature_unsupported(body).alias("temperature"), replies.reasoning_error(body).alias("reasoning"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN text || text ELSE text END AS content FROM conversations")
def completion_text(spark, sf_dir):
    """The text of completions in four formats."""
    c, t = table(spark, sf_dir, "conversations"), F.col("text")
    message = F.struct(t.alias("content"))
    parts = F.struct(F.array(F.struct(t.alias("text")), F.struct(t.alias("text"))).alias("content"))
    payload = F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))).when(F.col("turn") % 4 == 1, F.to_json(F.struct(t.alias("output_text"))))
    payload = payload.when(F.col("turn") % 4 == 2, F.to_json(F.struct(message.alias("message")))).otherwise(F.to_json(F.struct(F.array(parts).alias("output"))))
    return c.select("conv_id", "turn", replies.completion_text(payload).alias("content"))


@query("SELECT conv_id, turn, 1 + turn % 30 AS depth, text || '<' || turn || '>' AS content FROM conversations")
def deep_contents(spark, sf_dir):
    """Contents 1 to 30 objects and lists deep, the text in two parts."""
    depth = (F.col("turn") % 30 + 1).cast("int")
    inner = F.to_json(F.array("text", F.concat(F.lit("<"), F.col("turn").cast("string"), F.lit(">"))))
    payload = F.concat(F.lit('{"message":{"content":'), F.repeat(F.lit('[{"text":{"value":'), depth), inner, F.repeat(F.lit("}}]"), depth), F.lit("}}"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 30 + 1).alias("depth"), replies.completion_text(payload).alias("content"))


@query("""SELECT conv_id, count(*) AS messages, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS chat_sha256 FROM conversations GROUP BY conv_id""")
def chat_messages(spark, sf_dir):
    """Turns gathered as the messages of a request, through its JSON and back; a null field is left out."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    request = F.to_json(F.struct(F.lit("m").alias("model"), F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), F.lit(None).cast("double").alias("temperature")))
    back = F.from_json(F.get_json_object("request", "$.messages"), "array<struct<role:string,content:string>>")
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(request.alias("request")).withColumn("back", back)
    return out.select("conv_id", F.size("back").cast("long").alias("messages"), F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n"), 256).alias("chat_sha256"))


@query("""SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, true AS done FROM conversations GROUP BY conv_id""")
def event_stream_join(spark, sf_dir):
    """Turns as events of a stream, an end and something after it; joined again."""
    c = table(spark, sf_dir, "conversations")
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    lines = c.select("conv_id", (F.col("turn") * 2).alias("seq"), event.alias("line"))
    noise = c.select("conv_id", (F.col("turn") * 2 + 1).alias("seq"), F.lit(": ping").alias("line"))
    ends = c.groupBy("conv_id").agg((F.max("turn") * 2 + 2).alias("seq")).withColumn("line", F.lit("data: [DONE]"))
    late = ends.select("conv_id", (F.col("seq") + 1).alias("seq"), F.lit('data: {"choices":[{"delta":{"content":"late"}}]}').alias("line"))
    return token_stream.joined(lines.union(noise).union(ends).union(late), "conv_id")


@query("SELECT event_type, count(*) AS lines, CAST(sum(event_id % 100) AS BIGINT) AS percent FROM events WHERE event_id % 4 <> 0 GROUP BY event_type")
def event_lines(spark, sf_dir):
    """JSON lines of a worker, some broken."""
    line = F.when(F.col("event_id") % 4 == 0, F.lit("not json {")).otherwise(F.to_json(F.struct(F.col("event_type").alias("type"), (F.col("event_id") % 100).cast("int").alias("percent"))))
    got = tables.event_lines(table(spark, sf_dir, "events").select(line.alias("value")))
    return got.groupBy(F.col("type").alias("event_type")).agg(F.count(F.lit(1)).alias("lines"), F.sum("percent").cast("long").alias("percent"))


@query("SELECT p_partkey, 'model-' || p_partkey AS model FROM part WHERE p_partkey % 3 <> 0")
def model_list(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, F.lit("Vision-")).otherwise(F.lit("model-"))
    payload = F.to_json(F.struct(F.array(F.struct(F.concat(kind, F.col("p_partkey").cast("string")).alias("id"))).alias("data")))
    got = tables.model_names(table(spark, sf_dir, "part").select(payload.alias("value")))
    return got.select(F.regexp_extract("model", r"(\d+)$", 1).cast("long").alias("p_partkey"), "model")


@query("SELECT doc_id || '.docx' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE doc_id % 3 = 0 AND text <> ''")
def upload_decode(spark, sf_dir):
    ext = F.when(F.col("doc_id") % 3 == 0, F.lit(".docx")).when(F.col("doc_id") % 3 == 1, F.lit(".exe")).otherwise(F.lit(""))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("C:\\tmp/"), F.col("doc_id").cast("string"), ext).alias("name"), F.base64(F.encode("text", "utf-8")).alias("data"))
    return tables.uploads(rows).select("name", "size")


@query("SELECT page_id, url, length(html) * 1000 AS length FROM (SELECT * FROM pages) WHERE page_id % 2 = 0 AND length(html) * 1000 <= 31457280")
def input_gate(spark, sf_dir):
    path = F.concat("url", F.when(F.col("page_id") % 2 == 0, F.lit(".DOCX")).otherwise(F.lit(".txt")))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", path.alias("path"), (F.length("html").cast("long") * 1000).alias("length"))
    return tables.accepted_files(rows).select("page_id", "url", "length")


@query("""SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN 'Fix it. Be brief.' || chr(10) || chr(10) ELSE 'Fix it.' || chr(10) || chr(10) END || CASE WHEN turn % 3 = 0 THEN 'Keep names.' || chr(10) || chr(10) ELSE '' END || 'Text:' || chr(10) || text) AS prompt_sha256 FROM conversations""")
def prompt_compose(spark, sf_dir):
    system = F.when(F.col("turn") % 2 == 0, F.lit(" Be brief. ")).otherwise(F.lit("  "))
    extra = F.when(F.col("turn") % 3 == 0, F.lit("Keep names."))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(replies.prompt(F.lit("Fix it. "), system, extra, F.col("text")), 256).alias("prompt_sha256"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 3 = 1 AND conv_id % 2 = 0 THEN 'note' ELSE 'main' END AS prompt FROM conversations""")
def prompt_route(spark, sf_dir):
    mode = F.when(F.col("role") == "user", F.lit("translate")).otherwise(F.lit("correct"))
    part = F.when(F.col("turn") % 3 == 1, F.lit("footnotes")).otherwise(F.lit("main"))
    note = F.when(F.col("conv_id") % 2 == 0, F.lit("note")).otherwise(F.lit(" "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", replies.routed_prompt(mode, part, F.lit("main"), note).alias("prompt"))


@query("SELECT conv_id, turn, sha256(role || chr(10) || CASE WHEN turn % 2 = 0 THEN '' ELSE CAST(turn AS VARCHAR) END || chr(10) || text) AS fingerprint FROM conversations")
def run_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", names.run_fingerprint(F.col("role"), F.when(F.col("turn") % 2 == 1, F.col("turn").cast("string")), F.col("text")).alias("fingerprint"))


_SLUG = "coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace({x}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 24), '-+$', ''), ''), 'target')"


@query(f"WITH n AS (SELECT c_custkey, lower('Élève ' || c_name || ' ñ') AS x FROM customer) SELECT c_custkey, {_SLUG.format(x='strip_accents(x)')} AS folded, {_SLUG.format(x='x')} AS plain FROM n")
def slug(spark, sf_dir):
    x = F.concat(F.lit("Élève "), F.col("c_name"), F.lit(" ñ"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.slug(x).alias("folded"), names.slug(x, False).alias("plain"))


@query("""SELECT event_id, 'doc' || event_id || CASE event_id % 3 WHEN 0 THEN '_revised' WHEN 1 THEN '_corrected' ELSE '_translated_german' END || '_' || strftime(CAST(ts AS TIMESTAMP), '%Y%m%d%H%M') || '.docx' AS name FROM events""")
def output_name(spark, sf_dir):
    mode = F.when(F.col("event_id") % 3 == 1, F.lit("correct")).when(F.col("event_id") % 3 == 2, F.lit("translate"))
    name = names.output_name(F.concat(F.lit("doc"), F.col("event_id").cast("string")), F.coalesce(mode, F.lit("none")), F.lit("German"), F.col("ts"), F.lit(".docx"))
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"))


@query("SELECT event_id, event_type || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.txt' AS name FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)")
def collision_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lit(".txt").alias("ext"))
    return lookup.free_names(rows, "user_id", "event_type", "ext", "event_id").select("event_id", "name")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def log_tail(spark, sf_dir):
    return audit.newest(table(spark, sf_dir, "events"), 500, [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id", "event_type")


_V = ("v1.2.3", "1.2", "1.10.0-beta", "2.0.x", "v1.2.0", "0.9")


@query("WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(_V)) + """) AS v(i, raw)), n AS (SELECT i, raw, list_transform(string_split(string_split(ltrim(raw, 'v'), '-')[1], '.'), lambda x: coalesce(TRY_CAST(x AS BIGINT), 0)) AS p FROM v),
w AS (SELECT i, raw, list_concat(p, list_resize([]::BIGINT[], 4 - len(p), 0::BIGINT)) AS p FROM n)
SELECT e.event_id, a.raw AS l, b.raw AS r, CAST(CASE WHEN a.p < b.p THEN -1 WHEN a.p > b.p THEN 1 ELSE 0 END AS INTEGER) AS c FROM events e JOIN w a ON a.i = e.event_id % 6 JOIN w b ON b.i = e.event_id // 6 % 6""")
def version_compare(spark, sf_dir):
    all_v = F.array(*map(F.lit, _V))
    left, right = F.element_at(all_v, (F.col("event_id") % 6 + 1).cast("int")), F.element_at(all_v, (F.floor(F.col("event_id") / 6) % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", left.alias("l"), right.alias("r"), names.version_compare(left, right).alias("c"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'en' ELSE lang END AS locale FROM documents""")
def locale_normalize(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.upper("lang"), F.lit("-XX"))).when(F.col("doc_id") % 4 == 1, F.concat("lang", F.lit("_yy"))).when(F.col("doc_id") % 4 == 3, F.lit("tlh")).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", names.locale(raw).alias("locale"))


@query("SELECT page_id, left(sha256(url), 12) AS key, left(regexp_replace(url, '[\\x00-\\x1f<>:\"/\\\\|?*]', '_', 'g'), 100) AS file_name FROM pages")
def input_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.input_key("url").alias("key"), names.file_name_sanitized("url").alias("file_name"))


@query("SELECT page_id, '/home/my files/' || page_id AS path FROM pages")
def path_normalize(spark, sf_dir):
    i = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('"/home/my files/'), i, F.lit('"'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("file:///home/my%20files/"), i)).otherwise(F.concat(F.lit("/home/my\\ files/"), i))
    return table(spark, sf_dir, "pages").select("page_id", names.path_normalized(raw).alias("path"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://h:1/v1/chat/completions' WHEN 1 THEN 'http://h/v2/chat/completions' ELSE 'http://h/v1/chat/completions' END AS endpoint FROM pages")
def endpoint(spark, sf_dir):
    raw = F.when(F.col("page_id") % 3 == 0, F.lit("http://h:1/v1/chat/completions")).when(F.col("page_id") % 3 == 1, F.lit("http://h/v2/")).otherwise(F.lit("http://h"))
    return table(spark, sf_dir, "pages").select("page_id", names.endpoint(raw).alias("endpoint"))


@query("SELECT event_id, strftime(make_timestamp(event_id * 86399 * 1000000), '%Y-%m-%d %H:%M') AS at FROM events")
def epoch_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", names.epoch_text(F.col("event_id") * 86399).alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 20 >= 16 THEN 'large' WHEN event_id % 20 >= 8 THEN 'medium' ELSE 'small' END AS tier FROM events")
def memory_tier(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", names.memory_tier(F.col("event_id") % 20).alias("tier"))


@query("SELECT event_id, event_id % 3 = 0 AS matches, CAST(event_id % 900 + 1 AS BIGINT) AS interval_ms, CAST(greatest(1, floor(60000.0 / (event_id % 900 + 1) + 0.5)) AS BIGINT) AS per_minute FROM events WHERE event_id % 3 = 0")
def log_line_values(spark, sf_dir):
    """key=value pairs of log lines that start so; others have none."""
    i = (F.col("event_id") % 900 + 1).cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("pacing: key=a|b ; interval_ms="), i)).otherwise(F.concat(F.lit("other: interval_ms="), i))
    pairs = replies.pairs_of_log_line(line, "pacing: ")
    rows = table(spark, sf_dir, "events").select("event_id", F.coalesce(pairs["key"] == "a|b", F.lit(False)).alias("matches"), pairs["interval_ms"].try_cast("long").alias("interval_ms"))
    return rows.where("interval_ms is not null").withColumn("per_minute", replies.requests_per_minute(F.col("interval_ms")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN CAST(event_id + 1 AS DOUBLE) WHEN event_id % 3 = 1 THEN 7.5 END AS per_minute FROM events")
def header_limits(spark, sf_dir):
    values = F.array(F.when(F.col("event_id") % 3 == 0, F.lit("-1")).otherwise(F.lit("none")), F.when(F.col("event_id") % 3 == 2, (F.col("event_id") + 1).cast("string")), F.when(F.col("event_id") % 3 > 0, F.lit("7.5")))
    return table(spark, sf_dir, "events").select("event_id", replies.first_positive(values).alias("per_minute"))


_FIELDS = ("hyperlink x", "TOC \\o", "pageref a", "SEQ t", "Page", "DATE", "QUOTE q")


@query("""WITH f AS (SELECT l_orderkey AS o, upper(string_split([""" + ", ".join(f"'{f}'" for f in _FIELDS) + """][(l_partkey + l_linenumber) % 7 + 1], ' ')[1]) AS k FROM lineitem),
c AS (SELECT o, k, k IN ('HYPERLINK','SYMBOL','QUOTE','PAGE','NUMPAGES','SECTION','SECTIONPAGES','PAGEREF') AS is_safe, count(*) AS n FROM f GROUP BY o, k)
SELECT o AS l_orderkey, is_safe, string_agg(k || ':' || n, ', ' ORDER BY n DESC, k) AS histogram FROM c GROUP BY o, is_safe""")
def field_histogram(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _FIELDS)), ((F.col("l_partkey") + F.col("l_linenumber")) % 7 + 1).cast("int"))
    return audit.field_histogram(table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("field_type")), "l_orderkey")


@query("""WITH f AS (SELECT l_orderkey AS o, upper(string_split([""" + ", ".join(f"'{f}'" for f in _FIELDS) + """][(l_partkey + l_linenumber) % 7 + 1], ' ')[1]) AS k, l_suppkey % 50 = 0 AS foreign_part FROM lineitem)
SELECT o AS l_orderkey, bool_or(foreign_part) OR bool_or(k NOT IN ('HYPERLINK','SYMBOL','QUOTE','PAGE','NUMPAGES','SECTION','SECTIONPAGES','PAGEREF')) AS unsafe FROM f GROUP BY o""")
def unsafe_structures(spark, sf_dir):
    kind = F.split(F.element_at(F.array(*map(F.lit, _FIELDS)), ((F.col("l_partkey") + F.col("l_linenumber")) % 7 + 1).cast("int")), " ")[0]
    element = F.when(F.col("l_suppkey") % 50 == 0, F.lit("altChunk")).otherwise(F.lit("r"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(audit.is_unsafe(F.collect_set(kind), F.collect_set(element)).alias("unsafe"))


@query("""WITH n AS (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'de' ELSE 'en' END AS ui FROM documents), t AS (SELECT * FROM (VALUES ('de','de','Deutsch'),('de','en','Englisch'),('de','fr','Französisch'),('en','de','German'),('en','en','English')) AS t(ui, target, name))
SELECT doc_id, coalesce(t.name, trim(lang)) AS display_name FROM n LEFT JOIN t ON t.ui = n.ui AND t.target = lower(trim(lang))""")
def language_lookup(spark, sf_dir):
    known = spark.createDataFrame([("de", "de", "Deutsch"), ("de", "en", "Englisch"), ("de", "fr", "Französisch"), ("en", "de", "German"), ("en", "en", "English")], "ui string, target string, name string")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en").alias("ui"))
    return lookup.display_names(rows, known, "lang", "ui").select("doc_id", "display_name")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' THEN 2 END, o_orderkey) AS n
FROM orders WHERE o_orderkey % 5 = 0 OR o_orderstatus IN ('O', 'F')) WHERE n = 1""")
def preset_resolution(spark, sf_dir):
    priority = F.when(F.col("o_orderkey") % 5 == 0, 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2)
    return lookup.first_by_priority(table(spark, sf_dir, "orders"), ["o_custkey"], priority, ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type")
def hint_memory(spark, sf_dir):
    """The newest value of each key."""
    return lookup.last_values(table(spark, sf_dir, "events").where("value is not null"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS labels, count(DISTINCT o_orderstatus) FILTER (WHERE n > 1) AS batches FROM (SELECT o_custkey, o_orderstatus, max(o_orderkey % 4) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def checkpoint_write(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", (F.col("o_orderkey") % 4).alias("n"))
    out = lookup.checkpoint_rows(rows, ["o_custkey"], "o_orderstatus", "n")
    return out.select("o_custkey", F.array_join("completed_labels", ",").alias("labels"), F.size(F.map_filter("completed_batches", lambda k, v: v > 1)).cast("long").alias("batches"))


@query("""SELECT o_custkey, o_orderstatus, o_orderkey FROM orders WHERE NOT (o_custkey % 3 = 0 AND o_orderstatus = 'F')""")
def checkpoint_resume(spark, sf_dir):
    """Parts that are still to be done: the checkpoint of every third customer's run names status F, and counts where run and fingerprint are the same."""
    o = table(spark, sf_dir, "orders").withColumns({"fingerprint": F.sha2(F.col("o_custkey").cast("string"), 256), "label": F.col("o_orderstatus")})
    point = o.select("o_custkey").distinct().select("o_custkey", F.sha2(F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise("other"), 256).alias("fingerprint"), F.array(F.lit("F")).alias("completed_labels"), F.lit(True).alias("is_active"))
    return lookup.to_resume(o, point, ["o_custkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""WITH e AS (SELECT o_custkey, o_orderkey AS entry, o_orderstatus AS a, CASE WHEN o_orderkey % 5 = 0 THEN 'x' WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderstatus END AS b FROM orders)
SELECT o_custkey, entry, CASE WHEN entry % 3 = 0 AND a IS DISTINCT FROM b THEN 'changed' ELSE 'missing' END AS breach FROM e WHERE (entry % 3 = 0 AND a IS DISTINCT FROM b) OR (entry % 3 = 1 AND b IS NULL)""")
def integrity(spark, sf_dir):
    """A package for each customer, its orders as entries; of the second version some are changed, some missing."""
    before = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("entry"), F.col("o_orderstatus").cast("binary").alias("content"))
    after = before.where("entry % 5 <> 1").withColumn("content", F.when(F.col("entry") % 5 == 0, F.lit("x").cast("binary")).otherwise(F.col("content")))
    return audit.integrity(before, after, ["o_custkey"], F.col("entry") % 3 == 0, F.col("entry") % 3 == 1)


@query("SELECT user_id, CAST(coalesce(max(event_id) FILTER (WHERE event_id % 3 <> 0 AND event_id > 0), 0) + 1 AS BIGINT) AS next_id FROM events GROUP BY user_id")
def next_revision_id(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("x1")).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(revisions.next_revision_id(raw).alias("next_id"))


@query("""WITH l AS (SELECT user_id, event_id, event_id % 3 AS layer, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS done, 50 + event_id % 3 * 10 AS total FROM events),
s AS (SELECT *, CASE WHEN done = 1 THEN total ELSE 0 END AS t FROM l), p AS (SELECT user_id, event_id, floor(100.0 * count(*) OVER w / sum(t) OVER w) AS p FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CAST(max(p) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS percent FROM p""")
def pull_progress(spark, sf_dir):
    done = F.row_number().over(Window.partitionBy("user_id", F.col("event_id") % 3).orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("layer"), done.alias("done"), (50 + F.col("event_id") % 3 * 10).alias("total"))
    return audit.running_progress(rows, "user_id", "event_id", "layer", "done", "total").select("user_id", "event_id", "percent")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY event_id) AS n FROM events) WHERE n = 1")
def distinct_ignoring_case(spark, sf_dir):
    spelled = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_type")))
    return lookup.distinct_ignoring_case(table(spark, sf_dir, "events").withColumn("spelled", spelled), ["user_id"], "spelled", "event_id").select("user_id", "event_id")


_MARKERS = """WITH s AS (SELECT l_orderkey, l_linenumber * 10 AS a, l_linenumber * 10 + 5 AS b, 's' || l_linenumber AS p FROM lineitem), o AS (SELECT o_orderkey, o_custkey % 80 AS x FROM orders)
SELECT o_orderkey, CAST(x AS BIGINT) AS off, coalesce((SELECT min_by(p, a) FROM s WHERE l_orderkey = o_orderkey AND a <= x AND x < b), (SELECT max_by(p, a) FROM s WHERE l_orderkey = o_orderkey AND b <= x), (SELECT min_by(p, a) FROM s WHERE l_orderkey = o_orderkey AND a >= x)) AS props FROM o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""


@query(_MARKERS)
def marker_lookup(spark, sf_dir):
    """The format at an offset: of the span that holds it, else the last before, else the first after."""
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 5).alias("end"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("props")))).alias("spans"))
    rows = table(spark, sf_dir, "orders").join(spans, F.col("o_orderkey") == F.col("l_orderkey"))
    off = F.col("o_custkey") % 80
    return rows.select("o_orderkey", off.cast("long").alias("off"), revisions.span_at(F.col("spans"), off)["props"].alias("props"))


@query(_MARKERS)
def markers_as_of(spark, sf_dir):
    """The same as a join of two tables, in stretches of 16 places."""
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 10).alias("start"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("props"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 80).cast("long").alias("off"))
    return revisions.spans_at(rows, spans, ["o_orderkey"], "off", "start", ["props"], 16).where("props is not null")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, max(p_partkey) OVER () AS n FROM part), e AS (SELECT k AS a, k * 2 % (n + 7) AS b FROM p UNION SELECT k, k * 3 % (n + 7) FROM p UNION SELECT k, 1 FROM p WHERE k % 11 = 0), x AS (SELECT a, b FROM e WHERE b IN (SELECT k FROM p)),
r AS (SELECT CAST(1 AS BIGINT) AS part, 0 AS depth UNION SELECT x.b, r.depth + 1 FROM r JOIN x ON x.a = r.part WHERE r.depth < 8)
SELECT part, min(depth) AS depth FROM r GROUP BY part""")
def parts_reached(spark, sf_dir):
    """Parts that relations reach from the first in 8 steps, breadth first, each once, with their distance; relations go in circles, and some lead nowhere."""
    k = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("one"))
    n = k.agg(F.max("p_partkey")).first()[0] or 0
    e = lambda b, own=k: own.select(F.col("p_partkey").alias("source"), b.alias("target"))
    relations = e(F.col("p_partkey") * 2 % (n + 7)).union(e(F.col("p_partkey") * 3 % (n + 7))).union(e(F.lit(1), k.where("p_partkey % 11 = 0")))
    return graph.reached(k.where("p_partkey = 1").select(F.col("p_partkey").alias("part")), relations, k.select(F.col("p_partkey").alias("part")), 8)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 'TOC 1' WHEN 1 THEN 'Index 9' WHEN 2 THEN 'Table of Figures' ELSE 'Body' END AS style FROM lineitem) SELECT l_orderkey, l_linenumber FROM s WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM s WHERE style <> 'Body')""")
def directory_styles(spark, sf_dir):
    """Paragraphs outside directories, told by their style, by id or by name."""
    i = F.col("l_partkey") % 4
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(i == 0, "TOC1").when(i == 1, "Index 9").when(i == 2, "table of figures").otherwise("Body").alias("style"))
    inside = rows.where(names.is_directory_style("style")).select("l_orderkey", "l_linenumber")
    return audit.without_directories(rows, inside, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS para FROM lineitem WHERE l_linenumber IN (2, 3) AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linenumber = 2) = 1 AND count(*) FILTER (WHERE l_linenumber = 3) = 1)""")
def directory_fields(spark, sf_dir):
    """Paragraphs in directory fields: in every order the second line opens one, its type in two pieces, and the third one closes it, if it is there; where a line stands several times, the pieces of their types mix to none, or the fields don't balance."""
    line = F.col("l_linenumber")
    e = lambda n, kind, text=None: F.struct((line * 10 + n).alias("seq"), line.alias("para"), F.lit(kind).alias("kind"), F.lit(text).cast("string").alias("text"))
    made = F.when(line == 2, F.array(e(0, "paragraph"), e(1, "begin"), e(2, "code", " TO"), e(3, "code", "C \\o"))).when(line == 3, F.array(e(0, "paragraph"), e(1, "end"))).otherwise(F.array(e(0, "paragraph")))
    events = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(made).alias("e")).select("l_orderkey", "e.*")
    return fields.directory_paragraphs(events, ["l_orderkey"])


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'de-' || event_type END, CASE WHEN event_id % 3 = 0 THEN 'en-' || event_type END, event_type) AS shown FROM events""")
def message_lookup(spark, sf_dir):
    """A message in the language asked for, else in English, else its key."""
    e = table(spark, sf_dir, "events")
    own = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("de-"), F.col("event_type")))
    english = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("en-"), F.col("event_type")))
    return e.select("event_id", F.coalesce(own, english, F.col("event_type")).alias("shown"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 AND length(event_type) % 2 = 0 THEN 'de-' || event_type END, CASE WHEN ascii(event_type) % 2 = 0 THEN 'en-' || event_type END, event_type) AS message FROM events""")
def message_texts(spark, sf_dir):
    """Messages by a table of texts, in which some keys have no German text, some no English one, and some none."""
    e = table(spark, sf_dir, "events")
    kinds = e.select(F.col("event_type").alias("key")).distinct()
    text = lambda language, known: kinds.where(known).select("key", F.lit(language).alias("language"), F.concat(F.lit(f"{language}-"), F.col("key")).alias("text"))
    texts = text("de", F.length("key") % 2 == 0).union(text("en", F.ascii("key") % 2 == 0))
    rows = e.select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, "de").otherwise("fr").alias("language"))
    return lookup.messages(rows, texts, "event_type", "language").select("event_id", "message")


@query("""SELECT event_type, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_by_hour(spark, sf_dir):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return table(spark, sf_dir, "events").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


def _runs(spark, sf_dir):
    """Runs of orders as paragraphs: every fourth one an anchor."""
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4 == 0).alias("anchor"), F.repeat(F.lit("w"), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("text"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 = 0 AS anchor, o_orderkey % 7 + 1 AS n, count(*) FILTER (WHERE o_orderkey % 4 = 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM orders),
s AS (SELECT o_custkey, island, count(*) AS runs, CAST(sum(n) AS BIGINT) AS chars, arg_max(o_orderkey, (n, -o_orderkey)) AS dominant FROM r WHERE NOT anchor GROUP BY ALL)
SELECT o_custkey, runs, chars, dominant, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY island) - 1 AS INTEGER) AS segment FROM s""")
def run_segments(spark, sf_dir):
    return segments.segments(_runs(spark, sf_dir), ["o_custkey"], "o_orderkey", "anchor")


_NEAREST = """CASE WHEN p > 0 AND p < length(text) AND regexp_matches(substr(text, p, 2), '^[\\p{L}\\p{Nd}''-]{2}$') THEN CASE WHEN length(regexp_extract(left(text, p), '[\\p{L}\\p{Nd}''-]*$')) <= length(regexp_extract(substr(text, p + 1), '^[\\p{L}\\p{Nd}''-]*'))
  THEN p - length(regexp_extract(left(text, p), '[\\p{L}\\p{Nd}''-]*$')) ELSE p + length(regexp_extract(substr(text, p + 1), '^[\\p{L}\\p{Nd}''-]*')) END ELSE p END"""


@query(f"""WITH s AS (SELECT conv_id, turn, text, turn % 5 + 1 AS a, 7 AS b, conv_id % 11 AS c FROM conversations),
x AS (SELECT *, CAST(round_even(length(text) * a / CAST(a + b + c AS DOUBLE), 0) AS BIGINT) AS p FROM s), y AS (SELECT * EXCLUDE p, {_NEAREST} AS one FROM x),
z AS (SELECT *, CAST(round_even(length(text) * (a + b) / CAST(a + b + c AS DOUBLE), 0) AS BIGINT) AS p FROM y), w AS (SELECT *, greatest(one, {_NEAREST}) AS two FROM z)
SELECT conv_id, turn, left(text, one) AS a, substr(text, one + 1, two - one) AS b, substr(text, two + 1) AS c FROM w""")
def segment_distribution(spark, sf_dir):
    """Turns dealt to three segments by their shares, cut at words."""
    c = table(spark, sf_dir, "conversations")
    lengths = F.array((F.col("turn") % 5 + 1).cast("int"), F.lit(7), (F.col("conv_id") % 11).cast("int"))
    dealt = c.select("conv_id", "turn", segments.dealt_to_segments(lengths, F.col("text")).alias("d"))
    return dealt.select("conv_id", "turn", *[F.col("d")[i].alias(name) for i, name in enumerate("abc")])


@query("SELECT conv_id, turn, substr(text, 1, 5) AS a, substr(text, 6, turn) AS b, substr(text, 6 + turn) AS c FROM conversations")
def text_nodes(spark, sf_dir):
    nodes = segments.filled(F.array(F.lit(5), F.col("turn").cast("int"), F.lit(3)), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", nodes[0].alias("a"), nodes[1].alias("b"), nodes[2].alias("c"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE CASE turn % 3 WHEN 0 THEN 'Word' ELSE 'No. x' END || text END AS text FROM conversations")
def tab_labels(spark, sf_dir):
    """A label before a tab isn't part of the text; other words before it are."""
    lead = F.when(F.col("turn") % 2 == 0, F.lit("1.")).when(F.col("turn") % 3 == 0, F.lit("Word")).otherwise(F.lit("No. x"))
    runs = F.array(F.struct(lead.alias("text"), F.lit(False).alias("has_tab")), F.struct(F.lit("").alias("text"), F.lit(True).alias("has_tab")), F.struct(F.col("text"), F.lit(False).alias("has_tab")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(segments.without_tab_label(runs), lambda r: r["text"]), "").alias("text"))


@query("""WITH c AS (SELECT conv_id, turn, text, min(turn) FILTER (WHERE (conv_id + turn) % 3 = 0) OVER (PARTITION BY conv_id) AS stop FROM conversations)
SELECT conv_id, CASE WHEN count(*) FILTER (WHERE stop IS NULL OR turn < stop) > 0 THEN string_agg(text || '!', '' ORDER BY turn) FILTER (WHERE stop IS NULL OR turn < stop) ELSE string_agg(text, '' ORDER BY turn) END AS text FROM c GROUP BY conv_id""")
def cancelled_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumns({"new": F.concat("text", F.lit("!")), "done": (F.col("conv_id") + F.col("turn")) % 3 != 0})
    return segments.finished_prefix(c, ["conv_id"], "turn", "text", "new", "done")


@query("""WITH m AS (SELECT conv_id, min(turn) FILTER (WHERE turn % 3 = 1) AS first FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE first IS NULL OR turn > first), '') AS text FROM conversations JOIN m USING (conv_id) GROUP BY conv_id""")
def note_texts(spark, sf_dir):
    """Of each note what follows its first reference mark."""
    c = table(spark, sf_dir, "conversations").withColumn("mark", F.col("turn") % 3 == 1)
    return segments.note_texts(c, ["conv_id"], "turn", "mark")


@query("SELECT l_orderkey, count(*) FILTER (WHERE (l_partkey + l_linenumber) % 7 = 1) AS dirty FROM lineitem GROUP BY l_orderkey")
def dirty_directories(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _FIELDS)), ((F.col("l_partkey") + F.col("l_linenumber")) % 7 + 1).cast("int"))
    found = segments.dirty_fields(table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("instruction")))
    return found.groupBy("l_orderkey").agg(F.count_if("dirty").alias("dirty"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND NOT starts_with(text, ' ') THEN ' ' || text ELSE text END AS text FROM conversations WHERE text <> ''""")
def space_after_mark(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text <> ''")
    return c.select("conv_id", "turn", replies.space_after_mark(F.concat(F.lit(" "), F.col("text")), F.col("text"), F.col("turn") % 2 == 0).alias("text"))


#: What is changed in settings that are right, and the rule that then fails.
_FLAWS = (
    ("provider", "None", None), ("model", " ", "model"), ("presets", [("a", "n", "v", "en"), ("A", "n", "v", "en")], "preset ids differ"), ("presets", [("a", " ", "v", "en"), ("", "n", "v", "en")], "preset name"), ("scope", ["attic"], "scope parts"),
    ("target_language", " ", "target_language"), ("font_size", "huge", "font_size"), ("provider_keys", ["openai"], "provider_keys complete"), ("provider_keys", ["openai", "who"], "provider_keys known"), ("editor_chunk_size", 7, "editor_chunk_size"),
    ("batching_parts", [], "batching_parts"), ("batching_parts", ["Main", "attic"], "batching_parts known"), ("reasoning_effort", "endless", "reasoning_effort"), ("translation_prompt", "", "translation_prompt"), ("translation_presets", [("t", "n", " ")], "translation preset main_prompt"),
    ("api_url", "", "api_url"), ("ui_language", "tlh", "ui_language"), ("active_preset", "z", "active_preset exists"), ("compare_mode", "eyes", "compare_mode"), ("temperature", 2.5, "temperature"), ("batch_paragraphs", 0, "batch_paragraphs"), ("parallel", 17, "parallel"),
    ("rpm", -1, "rpm"), ("mode", "dream", "mode"), ("speed", "MANUAL", None), ("reasoning_effort", None, None),
)
_RIGHT = {
    "provider": " OpenAI ", "api_url": "http://h", "model": "m", "custom_prompt": "c", "system_prompt": "s", "ui_language": "de", "correction_language": "en", "active_preset": "A", "presets": [("a", "n", "v", "en"), ("b", "n", "v", "de")],
    "provider_keys": list(validation.PROVIDERS[:-1]), "compare_mode": "openxml", "font_size": "default", "citation_style": "auto", "temperature": 0.5, "batch_chars": 7500, "chunk_size": 7500, "editor_chunk_size": 7500, "batch_paragraphs": 10, "batching_parts": ["main"],
    "reasoning_effort": "low", "scope": ["main"], "parallel": 4, "speed": "auto", "rpm": 0, "mode": "translation", "target_language": "de", "translation_prompt": "t", "translation_presets": [("t", "n", "m")],
}


def _settings(flaw: tuple) -> str:
    s = _RIGHT | {flaw[0]: flaw[1]}
    s["presets"] = [dict(zip(("id", "name", "value", "locale"), p, strict=True)) for p in s["presets"]]
    s["translation_presets"] = [dict(zip(("id", "name", "main_prompt"), p, strict=True)) for p in s["translation_presets"]]
    return json.dumps(s | {"provider_keys": dict.fromkeys(s["provider_keys"], "k")})


@query("SELECT c_custkey, CASE c_custkey % " + str(len(_FLAWS)) + " " + " ".join(f"WHEN {i} THEN '{f[2]}'" for i, f in enumerate(_FLAWS) if f[2]) + " END AS problem FROM customer")
def settings_check(spark, sf_dir):
    """Settings as JSON, read and checked; the first rule that fails is named."""
    line = F.element_at(F.array(*[F.lit(_settings(f)) for f in _FLAWS]), (F.col("c_custkey") % len(_FLAWS) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.from_json(line, validation.SETTINGS).alias("s")).select("c_custkey", "s.*")
    return validation.checked(rows).select("c_custkey", "problem")


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN 'c' || event_id WHEN event_id % 2 = 0 THEN 'f' || event_id END AS result, CASE WHEN event_type <> 'error' THEN 'compared' WHEN event_id % 2 = 0 THEN 'corrected_only' ELSE 'failed' END AS status FROM events""")
def salvage(spark, sf_dir):
    """A step that failed keeps its row: with the corrected text where that may stand for the comparison."""
    i = F.col("event_id").cast("string")
    e = table(spark, sf_dir, "events")
    return sinks.salvaged(e, F.concat(F.lit("c"), i), F.concat(F.lit("f"), i), F.when(F.col("event_type") == "error", F.lit("boom")), F.col("event_id") % 2 == 0).select("event_id", "result", "status")


@query("""SELECT event_id, CAST(event_id AS VARCHAR) || ';' AS id, event_type FROM events WHERE event_id % 5 <> 0""")
def event_log(spark, sf_dir):
    """Lines as an event log has them, read; odd ones are passed over."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_type").alias("event"), F.struct(F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("id")).alias("details"))))
    got = e.select("event_id", F.from_json(line, "ts_ms long, event string, details map<string,string>").alias("x")).where("x.event is not null")
    return got.select("event_id", F.col("x.details")["id"].alias("id"), F.col("x.event").alias("event_type"))


_ELEMENTS = ("comment", "altChunk", "TOC", "chart", "diagram", "oleObject", "vml", "p", "r")


@query("WITH e AS (SELECT l_orderkey, [" + ", ".join(f"'{e}'" for e in _ELEMENTS) + """][l_partkey % 9 + 1] AS k FROM lineitem) SELECT l_orderkey, count(*) FILTER (WHERE k = 'comment') AS comments, count(*) FILTER (WHERE k = 'altChunk') AS "foreign", count(*) FILTER (WHERE k = 'TOC') AS directories,
count(*) FILTER (WHERE k = 'chart') AS charts, count(*) FILTER (WHERE k = 'diagram') AS diagrams, count(*) FILTER (WHERE k = 'oleObject') AS objects, count(*) FILTER (WHERE k = 'vml') AS drawings FROM e GROUP BY l_orderkey""")
def content_counters(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _ELEMENTS)), (F.col("l_partkey") % 9 + 1).cast("int"))
    return audit.content_counters(table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("kind")), ["l_orderkey"])


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://h/v3/api/chat' ELSE 'http://h/v3/chat/completions' END AS endpoint FROM pages")
def editor_endpoint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.editor_endpoint(F.lit(" http://h/v3// "), F.col("page_id") % 2 == 0).alias("endpoint"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bad ' || event_id WHEN 1 THEN 'plain' WHEN 2 THEN 'short' ELSE 'first line' END AS message FROM events")
def error_messages(spark, sf_dir):
    """The message of an error payload in its formats, else its first line."""
    i = F.col("event_id")
    nested = F.to_json(F.struct(F.struct(F.concat(F.lit("bad "), i.cast("string")).alias("message")).alias("error")))
    body = F.when(i % 4 == 0, nested).when(i % 4 == 1, F.lit('{"message":"plain"}')).when(i % 4 == 2, F.lit('{"error":"short"}')).otherwise(F.lit("first line\nsecond"))
    return table(spark, sf_dir, "events").select("event_id", replies.error_text(body).alias("message"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(1, event_id % 600) WHEN event_id % 3 = 1 THEN 4 END AS seconds FROM events")
def retry_dates(spark, sf_dir):
    """Retry-After as a date, and as seconds."""
    i = F.col("event_id")
    until = F.concat(F.lit("Sun, "), F.date_format(F.timestamp_seconds(F.lit(784111740) + i % 600), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    header = F.when(i % 3 == 0, until).when(i % 3 == 1, F.lit("3.2")).otherwise(F.lit("later"))
    return table(spark, sf_dir, "events").select("event_id", replies.retry_seconds(header, F.lit("{}"), F.timestamp_seconds(F.lit(784111740))).alias("seconds"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, true AS done FROM conversations GROUP BY conv_id")
def json_line_stream(spark, sf_dir):
    """Turns as JSON lines, the last of each with done; joined again."""
    c = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"), (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))).alias("done")))
    return token_stream.joined(c.select("conv_id", F.col("turn").alias("seq"), line.alias("line")), "conv_id")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 = 0 AS anchor, count(*) FILTER (WHERE o_orderkey % 4 = 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM orders),
c AS (SELECT o_custkey, count(*) FILTER (WHERE anchor) AS anchors, count(DISTINCT island) FILTER (WHERE NOT anchor) AS segments FROM r GROUP BY o_custkey)
SELECT o_custkey, anchors, true AS few, sha256('Das ist ein Satz von ' || o_custkey || ', und er geht-weiter.') AS text_sha256 FROM c WHERE segments > 0""")
def translated_runs(spark, sf_dir):
    """Translations dealt to the segments between anchors: together they are whole, and no more runs than segments have text."""
    runs = _runs(spark, sf_dir)
    said = runs.select("o_custkey").distinct().withColumn("translation", F.concat(F.lit("Das ist ein Satz von "), F.col("o_custkey").cast("string"), F.lit(", und er geht-weiter.")))
    out = segments.translated(runs, said, ["o_custkey"], "o_orderkey", "anchor")
    island = F.sum(F.col("anchor").cast("int")).over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("anchor"), F.struct("o_orderkey", "text")))), lambda x: x["text"]), "")
    sums = out.withColumn("island", island).groupBy("o_custkey").agg(F.count_if("anchor").alias("anchors"), F.countDistinct(F.when(~F.col("anchor"), F.col("island"))).alias("segments"), F.count_if(~F.col("anchor") & (F.col("text") != "")).alias("filled"), text.alias("t"))
    return sums.where("segments > 0").select("o_custkey", "anchors", (F.col("filled") <= F.col("segments")).alias("few"), F.sha2("t", 256).alias("text_sha256"))


@query(f"""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 = 0 AS anchor, o_orderkey % 7 + 1 AS n, count(*) FILTER (WHERE o_orderkey % 4 = 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM orders),
s AS (SELECT o_custkey, island, CAST(sum(n) AS BIGINT) AS chars, arg_max(o_orderkey, (n, -o_orderkey)) AS dominant FROM r WHERE NOT anchor GROUP BY ALL),
t AS (SELECT *, 'Das ist ein Satz von ' || o_custkey || ', und er geht-weiter.' AS text, sum(chars) OVER (PARTITION BY o_custkey ORDER BY island) AS seen, sum(chars) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY island DESC) = 1 AS last FROM s),
x AS (SELECT *, CAST(round_even(length(text) * seen / CAST(total AS DOUBLE), 0) AS BIGINT) AS p FROM t),
c AS (SELECT *, max(CASE WHEN last THEN length(text) ELSE {_NEAREST} END) OVER (PARTITION BY o_custkey ORDER BY island) AS cut FROM x),
d AS (SELECT o_custkey, dominant, substr(text, coalesce(lag(cut) OVER w, 0) + 1, cut - coalesce(lag(cut) OVER w, 0)) AS share FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY island))
SELECT r.o_custkey, r.o_orderkey, CASE WHEN anchor THEN repeat('w', n) ELSE coalesce(share, '') END AS text FROM r LEFT JOIN d ON d.o_custkey = r.o_custkey AND d.dominant = r.o_orderkey""")
def translation_by_run(spark, sf_dir):
    """Which run has which share of a translation: the longest of each segment its share, cut at words, the others nothing, anchors their own text."""
    runs = _runs(spark, sf_dir)
    said = runs.select("o_custkey").distinct().withColumn("translation", F.concat(F.lit("Das ist ein Satz von "), F.col("o_custkey").cast("string"), F.lit(", und er geht-weiter.")))
    return segments.translated(runs, said, ["o_custkey"], "o_orderkey", "anchor").select("o_custkey", "o_orderkey", "text")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 5 = 0 AND l_suppkey % 2 = 0), s AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey % 2 = 0) SELECT * FROM f UNION SELECT * FROM s""")
def directory_union(spark, sf_dir):
    """Paragraphs of the main body that lie in a directory, by a field or by their style."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_suppkey") % 2 == 0, "main").otherwise("headers").alias("part_kind"))
    return audit.directories(rows.where("l_partkey % 5 = 0"), rows.where("l_partkey % 3 = 0"), ["l_orderkey", "l_linenumber"], "part_kind")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7, event_id) - 1 AS INTEGER) AS turn FROM events")
def markers_in_order(spark, sf_dir):
    """Marks of a paragraph by their offset, those at one place as they came."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("offset"))
    return audit.in_order_of_place(rows, ["user_id"], "offset", "event_id").select("user_id", "event_id", "turn")


@query("""WITH n AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'chart' ELSE 'diagram' END AS kind, unnest([0, 2]) AS node, url FROM pages) SELECT page_id, kind, CAST(node AS INTEGER) AS node, CASE node WHEN 0 THEN url || ' & <' || page_id || '>' ELSE 'Total' END AS text,
CASE WHEN node = 2 THEN 'Total' ELSE url || ' & <' || page_id || '>+' END AS corrected FROM n""")
def embedded_texts(spark, sf_dir):
    """Texts of charts and diagrams, corrected each once, put in their places and read again; a blank answer changes nothing."""
    node = lambda x: F.concat(F.lit("<a:t>"), text.html_escaped(x), F.lit("</a:t>"))
    said = F.concat("url", F.lit(" & <"), F.col("page_id").cast("string"), F.lit(">"))
    drawing = F.concat(F.lit('<x xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">'), node(said), F.lit("<a:t> </a:t>"), node(F.lit("Total")), F.lit("</x>"))
    parts = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "chart").otherwise("diagram").alias("kind"), F.encode(drawing, "utf-8").alias("content"))
    texts = office.embedded_texts(parts)
    asked = correct.corrected_as_a_whole(texts, lambda prompts, said: ["" if t == "Total" else t + "+" for t in said])
    again = office.embedded_texts(office.embedded_replaced(parts, asked, ["page_id"])).withColumnRenamed("text", "corrected")
    return texts.join(again, ["page_id", "kind", "node"]).select("page_id", "kind", "node", "text", "corrected")
