"""Queries over the measures of reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import measure, parse
from .base import LINES, docs, nt, pct, query, sessions, spans, table, walked

MIN = 64
SESSION = "doc_id // 3 AS sid, doc_id % 3 AS snap"

#: spans with text keys, sessions and owners; `again` marks all but the first with the text.
OWNED = f"""
texts AS (
    SELECT k AS doc_id, k // 3 AS sid, k % 3 AS snap, s, e, spans.n, string_agg(line || chr(10), '' ORDER BY pos) AS t
    FROM spans JOIN lines ON doc_id = k AND pos >= s AND pos < e GROUP BY ALL
)"""


def owners(src: str, order: str, cols: str = "") -> str:
    return f"owned AS (SELECT *, row_number() OVER w > 1 AS again, first(sid) OVER w AS first_sid {cols} FROM {src} WINDOW w AS (PARTITION BY t ORDER BY {order}))"


def total(cond: str, of: str = "n") -> str:
    return f"coalesce(sum({of}) FILTER ({cond}), 0)::BIGINT"


REUSE = f"""WITH RECURSIVE {LINES}, src AS (SELECT doc_id AS k, pos, n FROM counted), {walked('src', MIN)}, {spans()}, {OWNED},
named AS (SELECT texts.*, coalesce(source, 'none') AS task FROM texts JOIN documents USING (doc_id) WHERE {{where}}),
{owners('named', 'sid, snap, s', ', first(task) OVER w AS first_task')},
part AS (SELECT {total('again')} AS reused, {total('again AND sid = first_sid')} AS same_session,
    {total('again AND sid <> first_sid AND task = first_task')} AS cross_run_same_task, {total('again AND sid <> first_sid AND task <> first_task')} AS cross_task, coalesce(sum(n), 0)::BIGINT AS span_tokens FROM owned),
whole AS (SELECT coalesce(sum(n), 0)::BIGINT AS stream_tokens, count(DISTINCT doc_id // 3) AS sessions FROM counted WHERE {{where}})
SELECT *, {pct('reused', 'stream_tokens')} AS pic_pct FROM whole, part"""


def _snaps(spark, d, task="coalesce(source, 'none')"):
    return measure.with_lines(sessions(spark, d, task))


@query("reuse_measure", REUSE.replace("{where}", "true"))
def reuse_measure(spark, d):
    return measure.reuse(_snaps(spark, d), MIN)


@query("dedup_tasks", "WITH t AS (SELECT doc_id, coalesce(lang, 'none') || '-' || (doc_id % 7) AS task FROM documents) SELECT doc_id, task FROM t QUALIFY row_number() OVER (PARTITION BY task ORDER BY doc_id) = 1")
def dedup_tasks(spark, d):
    rows = docs(spark, d).selectExpr("doc_id AS sid", "0 AS snap", "concat(coalesce(lang, 'none'), '-', doc_id % 7) AS task")
    return measure.one_per_task(rows).selectExpr("sid AS doc_id", "task")


@query(
    "reuse_report",
    "SELECT 'all' AS runs, * FROM (" + REUSE.replace("{where}", "true") + ") UNION ALL SELECT 'one per task', * FROM (" + REUSE.replace("{where}", "doc_id // 3 IN (SELECT sid FROM (SELECT min(doc_id // 3) AS sid FROM documents GROUP BY source))") + ")",
)
def reuse_report(spark, d):
    rows = sessions(spark, d, "coalesce(source, 'none')")
    firsts = rows.groupBy("task").agg(F.min("sid").alias("sid")).select("sid").distinct()
    every, first = measure.with_lines(rows), measure.with_lines(rows.join(firsts, "sid", "left_semi"))
    one = lambda name, x: measure.reuse(x, MIN).select(F.lit(name).alias("runs"), "*")
    return one("all", every).unionByName(one("one per task", first))


DISJOINT = f"""WITH RECURSIVE {LINES}, based AS (
    SELECT *, coalesce(sum(cnt) OVER (PARTITION BY doc_id // 3 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
    FROM (SELECT doc_id, count(*) AS cnt FROM lines GROUP BY doc_id)
), flat AS (SELECT doc_id // 3 AS sid, base + pos AS p, line, n FROM counted JOIN based USING (doc_id)),
fp AS (SELECT sid, p, n, md5(string_agg(line || chr(10), '') OVER (PARTITION BY sid ORDER BY p)) AS f FROM flat),
hit AS (SELECT sid, p, n, p < 2000 AND min(CASE WHEN p < 2000 THEN sid END) OVER (PARTITION BY f, p) < sid AS h FROM fp),
cuts AS (SELECT sid, coalesce(sum(h::INT), 0) AS cut, sum(n)::BIGINT AS n, {total('h')} AS served FROM hit GROUP BY sid),
src AS (SELECT doc_id AS k, pos, n FROM counted), {walked('src', MIN)}, {spans()}, {OWNED},
beyond AS (SELECT texts.* FROM texts JOIN based USING (doc_id) JOIN cuts USING (sid) WHERE base + e > cut),
{owners('beyond', 'sid, snap, s')},
part AS (SELECT {total('again')} AS pic_tokens, {total('again AND sid = first_sid')} AS in_session, {total('again AND sid <> first_sid')} AS cross_session FROM owned),
whole AS (SELECT count(*) AS sessions, sum(n)::BIGINT AS stream_tokens, sum(served)::BIGINT AS prefix_tokens FROM cuts)
SELECT *, {pct('prefix_tokens', 'stream_tokens')} AS prefix_pct, {pct('pic_tokens', 'stream_tokens')} AS pic_pct FROM whole, part"""


@query("disjoint_measure", DISJOINT)
def disjoint_measure(spark, d):
    return measure.disjoint(_snaps(spark, d), MIN)


def _trajectory(messages: str, least: int) -> str:
    return f"""WITH RECURSIVE m AS ({messages}), lines AS (
    SELECT msg AS doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT msg, string_split(text, chr(10)) AS l FROM m WHERE role = 'input')
), counted AS (SELECT *, {nt('line || chr(10)')} AS n FROM lines), src AS (SELECT doc_id AS k, pos, n FROM counted), {walked('src', least)}, {spans(True)},
texts AS (SELECT k AS msg, s, spans.n, string_agg(line, chr(10) ORDER BY pos) AS t FROM spans JOIN lines ON doc_id = k AND pos >= s AND pos < e GROUP BY ALL),
named AS (SELECT texts.*, traj, grp FROM texts JOIN m USING (msg)),
owned AS (SELECT *, min(msg) OVER w < msg AS again, first(traj) OVER w AS first_traj, first(grp) OVER w AS first_grp FROM named WHERE n >= {least} WINDOW w AS (PARTITION BY t ORDER BY msg)),
part AS (SELECT {total('again')} AS reused_tokens, {total('again AND traj = first_traj')} AS in_session, {total('again AND traj <> first_traj AND grp = first_grp')} AS cross_same_group,
    {total('again AND traj <> first_traj AND grp <> first_grp')} AS cross_other_group, count(DISTINCT t) AS unique_spans FROM owned),
whole AS (SELECT coalesce(sum(n), 0)::BIGINT AS span_tokens, count(*) AS spans, {total(f'n < {least}')} AS uncacheable_tokens FROM named),
side AS (SELECT coalesce(sum({nt('text || chr(10)')}), 0)::BIGINT AS system_tokens FROM m WHERE role = 'system'),
every AS (SELECT *, span_tokens + system_tokens AS total_tokens FROM whole, side, part)
SELECT *, {pct('reused_tokens', 'total_tokens')} AS reuse_pct FROM every"""


MESSAGES = "SELECT conv_id AS traj, conv_id % 5 AS grp, conv_id * 1000 + turn AS msg, CASE role WHEN 'system' THEN 'system' WHEN 'assistant' THEN 'decode' ELSE 'input' END AS role, text FROM conversations WHERE text <> ''"


@query("trajectory_measure", _trajectory(MESSAGES, 16))
def trajectory_measure(spark, d):
    rows = parse.roles(table(spark, d, "conversations"))
    return measure.trajectories(rows.selectExpr("conv_id AS traj", "conv_id % 5 AS grp", "conv_id * 1000 + turn AS msg", "role", "text"), 16)


DOC_MESSAGES = "SELECT doc_id // 4 AS traj, doc_id % 5 AS grp, doc_id AS msg, CASE doc_id % 10 WHEN 0 THEN 'system' WHEN 5 THEN 'decode' ELSE 'input' END AS role, text FROM documents WHERE text <> ''"


@query("trajectory_measure_docs", _trajectory(DOC_MESSAGES, MIN))
def trajectory_measure_docs(spark, d):
    rows = docs(spark, d).where("text <> ''").selectExpr("doc_id div 4 AS traj", "doc_id % 5 AS grp", "doc_id AS msg", "CASE doc_id % 10 WHEN 0 THEN 'system' WHEN 5 THEN 'decode' ELSE 'input' END AS role", "text")
    return measure.trajectories(rows, MIN)


BLOCKS = f"""t AS (SELECT doc_id, regexp_extract_all(text, '{T.TOKEN}') AS t FROM documents),
b AS (SELECT doc_id, q, array_to_string(t[q * 16 + 1 : q * 16 + 16], chr(31)) AS block FROM (SELECT doc_id, t, unnest(range(len(t) // 16)) AS q FROM t))"""


@query(
    "block_reuse",
    f"""WITH {BLOCKS}, o AS (SELECT doc_id, row_number() OVER (PARTITION BY block ORDER BY doc_id, q) > 1 AS again FROM b),
e AS (SELECT doc_id, count(*) AS t, sum(again::INT) AS r FROM o GROUP BY doc_id)
SELECT count(*) AS outputs, {total('r > 0', '1')} AS hit_outputs, (16 * sum(r))::BIGINT AS reused_tokens, (16 * sum(t))::BIGINT AS block_tokens, round(100.0 * avg(r / t), 2) AS mean_reuse_pct FROM e""",
)
def block_reuse(spark, d):
    return measure.block_reuse(sessions(spark, d))


@query(
    "line_dedup",
    f"""WITH {LINES}, s AS (SELECT trim(line) AS line FROM lines WHERE trim(line) <> ''), g AS (SELECT line, count(*) AS k FROM s GROUP BY line),
e AS (SELECT sum(length(line) * k)::BIGINT AS total_chars, sum(length(line) * (k - 1))::BIGINT AS dup_chars FROM g)
SELECT *, {pct('dup_chars', 'total_chars')} AS dup_pct FROM e""",
)
def line_dedup(spark, d):
    return measure.line_dedup(sessions(spark, d))


#: Prompts: a document's lines are the schema, a benchmark passage the question.
PROMPTS = "SELECT doc_id AS pid, source AS task, documents.text AS schema, item.text AS head FROM documents JOIN benchmark item ON item_id = doc_id % (SELECT max(item_id) + 1 FROM benchmark)"


def _prompts(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("head"))
    many = items.agg((F.max("item") + 1).alias("many"))  # one row
    rows = docs(spark, d).crossJoin(F.broadcast(many)).withColumn("item", F.col("doc_id") % F.col("many")).drop("many")
    return rows.join(items, "item").select(F.col("doc_id").alias("pid"), F.col("source").alias("task"), "head", "text")


def _chain(text: str) -> str:
    return f"""WITH p AS ({PROMPTS}), t AS (SELECT pid, regexp_extract_all({text}, '{T.TOKEN}') AS t FROM p),
b AS (SELECT pid, q, md5(array_to_string(t[1 : q * 16 + 16], chr(31))) AS upto FROM (SELECT pid, t, unnest(range(len(t) // 16)) AS q FROM t)),
o AS (SELECT min(pid) OVER (PARTITION BY upto, q) < pid AS hit FROM b),
e AS (SELECT 16 * count(*) AS block_tokens, {total('hit', '16')} AS served_tokens FROM o) SELECT *, {pct('served_tokens', 'block_tokens')} AS prefix_pct FROM e"""


@query("prefix_schema_first", _chain("schema || chr(10) || head"))
def prefix_schema_first(spark, d):
    return measure.prefix_share(_prompts(spark, d).select("pid", F.concat_ws("\n", "text", "head").alias("text")))


@query("prefix_schema_after", _chain("head || chr(10) || schema"))
def prefix_schema_after(spark, d):
    return measure.prefix_share(_prompts(spark, d).select("pid", F.concat_ws("\n", "head", "text").alias("text")))


def _schema(key: str, owner: str) -> str:
    return f"""WITH RECURSIVE {LINES}, units AS (SELECT doc_id, pos, line, {nt('line')} AS n FROM lines), src AS (SELECT doc_id AS k, pos, n FROM units), {walked('src', MIN)}, {spans()},
texts AS (SELECT k AS pid, s, spans.n, string_agg(line, {key} ORDER BY pos) AS t FROM spans JOIN lines ON doc_id = k AND pos >= s AND pos < e GROUP BY ALL),
p AS ({PROMPTS}), named AS (SELECT texts.*, {owner} AS own FROM texts JOIN p USING (pid)),
owned AS (SELECT *, row_number() OVER w > 1 AS again, first(own) OVER w AS first_own FROM named WINDOW w AS (PARTITION BY t ORDER BY pid, s)),
part AS (SELECT {total('again')} AS reused, {total('again AND own = first_own')} AS same_session, {total('again AND own <> first_own')} AS cross_task FROM owned),
whole AS (SELECT (sum({nt('head')}) + (SELECT sum(n) FROM units))::BIGINT AS full_tokens FROM p)
SELECT *, {pct('reused', 'full_tokens')} AS pic_pct FROM whole, part"""


def _units(spark, d):
    return _prompts(spark, d).withColumn("units", F.split("text", "\n", -1))


@query("schema_pic", _schema("''", "pid"))
def schema_pic(spark, d):
    return measure.schema_reuse(_units(spark, d), MIN)


@query("schema_pic_by_task", _schema("chr(10)", "task"))
def schema_pic_by_task(spark, d):
    return measure.schema_reuse(_units(spark, d), MIN, "\n", "task")


#: Heads count once; lines of an observation that the prefix cache serves are skipped first fit, one by one.
HEADONCE = f"""WITH RECURSIVE p AS (SELECT pid, pid % 3 = 0 AS first, head || chr(10) || 'OBSERVATION:' || chr(10) AS head, coalesce(schema, '') AS obs FROM ({PROMPTS})),
t AS (SELECT pid, regexp_extract_all(head || obs, '{T.TOKEN}') AS t FROM p),
b AS (SELECT pid, q, md5(array_to_string(t[1 : q * 16 + 16], chr(31))) AS upto FROM (SELECT pid, t, unnest(range(len(t) // 16)) AS q FROM t)),
o AS (SELECT pid, min(pid) OVER (PARTITION BY upto, q) < pid AS hit FROM b),
cuts AS (SELECT pid, {total('hit', '16')} AS served FROM o GROUP BY pid),
r AS MATERIALIZED (SELECT p.*, {nt('head')} AS head_n, {nt('head || obs')} - {nt('head')} AS obs_n, coalesce(served, 0) AS served, greatest(0, coalesce(served, 0) - {nt('head')}) AS skip FROM p LEFT JOIN cuts USING (pid)),
l AS MATERIALIZED (
    SELECT pid, skip, line, {nt('line')} AS n, row_number() OVER (PARTITION BY pid ORDER BY i) - 1 AS i
    FROM (SELECT pid, skip, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT pid, skip, string_split(obs, chr(10)) AS x FROM r)) WHERE trim(line) <> ''
), fit AS (
    SELECT pid, i, line, n, CASE WHEN n <= skip THEN n ELSE 0 END AS acc, skip > 0 AND n <= skip AS fits FROM l WHERE i = 0
    UNION ALL
    SELECT l.pid, l.i, l.line, l.n, CASE WHEN f.acc + l.n <= skip THEN f.acc + l.n ELSE f.acc END, skip > 0 AND f.acc + l.n <= skip FROM fit f JOIN l ON l.pid = f.pid AND l.i = f.i + 1
), src AS MATERIALIZED (SELECT pid AS k, row_number() OVER (PARTITION BY pid ORDER BY i) - 1 AS pos, n, line FROM fit WHERE NOT fits),
{walked('src', MIN)}, {spans()},
texts AS (SELECT spans.k // 3 AS sid, spans.k % 3 AS snap, s, spans.n, string_agg(line, '' ORDER BY pos) AS t FROM spans JOIN src ON src.k = spans.k AND pos >= s AND pos < e GROUP BY ALL),
{owners('texts', 'sid, snap, s')},
part AS (SELECT {total('again AND sid = first_sid')} AS in_session, {total('again AND sid <> first_sid')} AS cross_session FROM owned),
whole AS (SELECT sum(obs_n + CASE WHEN first THEN head_n ELSE 0 END)::BIGINT AS stream_tokens, {total('first', 'head_n')} AS head_tokens, sum(CASE WHEN first THEN served ELSE skip END)::BIGINT AS prefix_tokens FROM r)
SELECT * FROM whole, part"""


@query("headonce_measure", HEADONCE)
def headonce_measure(spark, d):
    """Three documents are a session's steps; a benchmark passage is the head of each."""
    rows = _prompts(spark, d).selectExpr("pid div 3 AS sid", "cast(pid % 3 AS int) AS step", "concat(head, '\\nOBSERVATION:\\n') AS head", "text AS obs")
    return measure.head_once(rows, MIN)
