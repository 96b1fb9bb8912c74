"""Queries over treatments, mining, parsing, joins and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining, parse, treat
from .base import LINES, ORACLES, docs, nt, pct, query, spans, table, walked

PAGE = "SELECT page_id, {x} AS text FROM pages"


def pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("html").alias("text"))


@query("mask_attr", PAGE.format(x="""regexp_replace(html, '\\s*href="[^"]*"', '', 'g')"""))
def mask_attr(spark, d):
    return pages(spark, d).select("page_id", treat.mask(F.col("text"), "attr:href").alias("text"))


@query("mask_json", """SELECT event_id, regexp_replace(props, '"k"\\s*:\\s*(?:"[^"]{0,120}"|-?[0-9][0-9.eE+-]*)', '"k":"<V>"', 'g') AS text FROM events""")
def mask_json(spark, d):
    return table(spark, d, "events").select("event_id", treat.mask(F.col("props"), "json:k").alias("text"))


#: Events as log text: a bracketed handle, key=value pairs, and a YAML field.
EVENT = "'[' || event_id || '] ' || event_type || ' [' || (event_id % 7) || ']' || chr(10) || 'user_id=' || user_id || ' kind=' || event_type || chr(10) || '- score: ' || (event_id % 100) || ' points'"


def events(spark, d):
    text = EVENT.replace("chr(10)", r"'\n'")
    return table(spark, d, "events").selectExpr("event_id", "user_id", f"{text} AS text")


@query("mask_bracket", f"SELECT event_id, regexp_replace({EVENT}, '\\[[0-9]+\\]', '[N]', 'g') AS text FROM events")
def mask_bracket(spark, d):
    return events(spark, d).select("event_id", treat.mask(F.col("text"), "bracket_id").alias("text"))


@query("mask_kv", f"SELECT event_id, regexp_replace({EVENT}, '\\buser_id=[^\\s,;\"'']{{1,80}}', 'user_id=<V>', 'g') AS text FROM events")
def mask_kv(spark, d):
    return events(spark, d).select("event_id", treat.mask(F.col("text"), "kv:user_id").alias("text"))


@query("mask_yaml", f"SELECT event_id, regexp_replace({EVENT}, '(?m)^(\\s*(?:- )?)score:\\s+\\S.*$', '\\1score: <V>', 'g') AS text FROM events")
def mask_yaml(spark, d):
    return events(spark, d).select("event_id", treat.mask(F.col("text"), "yaml:score").alias("text"))


#: Line items as log lines of eleven words.
ITEM = "concat_ws(' ', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, l_returnflag, l_linestatus, 'ship', 'by', 'truck', 'ok')"


def items(spark, d):
    text = ITEM.replace("l_quantity::INT", "cast(l_quantity AS int)")
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{text} AS text")


@query("mask_pos", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, array_to_string(list_concat(w[1:2], ['<V>'], w[4:]), ' ') AS text FROM (SELECT *, string_split({ITEM}, ' ') AS w FROM lineitem)")
def mask_pos(spark, d):
    return items(spark, d).select("l_orderkey", "l_linenumber", treat.mask(F.col("text"), "pos:2").alias("text"))


@query("relocate_pos", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, array_to_string(list_concat(w[1:1], w[3:4], w[6:]), ' ') AS body, w[2] || ' ' || w[5] AS side FROM (SELECT *, string_split({ITEM}, ' ') AS w FROM lineitem)")
def relocate_pos(spark, d):
    body, side = treat.relocate_positions(F.col("text"))
    return items(spark, d).select("l_orderkey", "l_linenumber", body.alias("body"), side.alias("side"))


@query(
    "relocate_json",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '{"output":"' || event_type || '"}' ELSE 'plain ' || event_type END AS body,
CASE event_id % 3 WHEN 0 THEN '{"user":' || user_id || '}' ELSE '' END AS side FROM events""",
)
def relocate_json(spark, d):
    """Events in envelopes with metadata, envelopes without, and plain text."""
    text = """CASE event_id % 3 WHEN 0 THEN concat('{"output":"', event_type, '","metadata":{"user":', user_id, '}}') WHEN 1 THEN concat('{"output":"', event_type, '"}') ELSE concat('plain ', event_type) END"""
    rows = table(spark, d, "events").selectExpr("event_id", f"{text} AS text")
    body, side = treat.relocate_envelope(F.col("text"))
    return rows.select("event_id", body.alias("body"), side.alias("side"))


@query(
    "replace_handles",
    f"""WITH s AS (SELECT user_id, string_agg({EVENT}, chr(10) ORDER BY event_id) AS text FROM events GROUP BY user_id),
l AS (SELECT user_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT user_id, string_split(text, chr(10)) AS x FROM s)),
c AS (SELECT *, regexp_replace(line, '\\[[0-9]+\\]', '[.]', 'g') AS cleaned, string_split_regex(line, '\\[[0-9]+\\]') AS p FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, cleaned ORDER BY pos) - 1 AS nth FROM c),
n AS (SELECT user_id, pos, array_to_string([CASE WHEN j < len(p) THEN p[j] || '[a' || substr(md5(cleaned || '|' || nth || '|' || (j - 1)), 1, 16) || ']' ELSE p[j] END FOR j IN range(1, len(p) + 1)], '') AS new FROM o)
SELECT user_id, md5(string_agg(new, chr(10) ORDER BY pos)) AS key FROM n GROUP BY user_id""",
)
def replace_handles(spark, d):
    rows = events(spark, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return treat.replace_by_line(rows, ["user_id"]).select("user_id", F.md5(F.col("text").cast("binary")).alias("key"))


TAG = '<[^>]*href="[^"]*"[^>]*>'


@query(
    "replace_ids",
    f"""WITH s AS (SELECT page_id, string_split_regex(html, '{TAG}') AS p, regexp_extract_all(html, '{TAG}') AS t FROM pages),
l AS (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM s),
c AS (SELECT *, regexp_replace(tag, '\\s*href="[^"]*"', '', 'g') AS cleaned FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id, cleaned ORDER BY pos) - 1 AS nth FROM c),
n AS (SELECT page_id, pos, regexp_replace(tag, 'href="[^"]*"', 'href="a' || substr(md5(cleaned || '|' || nth), 1, 16) || '"', 'g') AS new FROM o),
g AS (SELECT page_id, list(new ORDER BY pos) AS new FROM n GROUP BY page_id)
SELECT s.page_id, md5(array_to_string([p[j] || CASE WHEN j < len(p) THEN new[j] ELSE '' END FOR j IN range(1, len(p) + 1)], '')) AS key FROM s LEFT JOIN g USING (page_id)""",
)
def replace_ids(spark, d):
    return treat.replace_attribute(pages(spark, d), ["page_id"], "href").select("page_id", F.md5(F.col("text").cast("binary")).alias("key"))


@query(
    "bucket_align",
    f"""WITH RECURSIVE c AS (SELECT source AS grp, doc_id, {nt('text')} AS n FROM documents),
src AS (SELECT grp AS k, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, n, doc_id FROM c), {walked('src', 900)}, {spans(True)}
SELECT spans.k AS grp, doc_id, dense_rank() OVER (PARTITION BY spans.k ORDER BY s) - 1 AS bucket FROM spans JOIN src ON src.k = spans.k AND pos >= s AND pos < e""",
)
def bucket_align(spark, d):
    return treat.buckets(docs(spark, d).select(F.col("source").alias("grp"), "doc_id", "text"), 900)


def _found(text: str, pattern: str, prefix: str, value: str = "v") -> str:
    p = pattern.replace("'", "''")
    return f"SELECT id, '{prefix}' || unnest(regexp_extract_all({text}, '{p}', 1)) AS field, unnest(regexp_extract_all({text}, '{p}', 2)) AS v FROM src"


@query(
    "field_values",
    f"""WITH src AS (SELECT page_id AS id, html AS t FROM pages), f AS ({_found('t', T.ATTR, 'attr:')} UNION ALL SELECT id, field, regexp_replace(v, '^"|"$', '', 'g') FROM ({_found('t', T.JSON_PAIR, 'json:')})
UNION ALL {_found('t', T.LOG_KV, 'kv:')} UNION ALL SELECT id, field, regexp_replace(v, '^"+|"+$', '', 'g') FROM ({_found('t', T.YAML_KV, 'yaml:')}) UNION ALL SELECT id, 'bracket_id', unnest(regexp_extract_all(t, '\\[([0-9]+)\\]', 1)) FROM src)
SELECT id AS page_id, field, count(DISTINCT v) AS n, md5(string_agg(DISTINCT v, '|' ORDER BY v)) AS key FROM f GROUP BY ALL""",
)
def field_values(spark, d):
    rows = pages(spark, d).select(F.col("page_id").alias("sid"), F.lit(0).alias("snap"), "text")
    out = mining.field_values(rows)
    return out.select(F.col("sid").alias("page_id"), "field", F.size("vals").alias("n"), F.md5(F.array_join("vals", "|").cast("binary")).alias("key"))


VALUES = "CASE event_id % 5 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_type WHEN 2 THEN substr(md5(event_id::VARCHAR), 1, 12) WHEN 3 THEN '10,' || event_id || '.5' ELSE '2024-01-' || (10 + event_id % 15) END"


@query("machine_value", f"SELECT event_id, v, regexp_matches(trim(v), '{T.MACHINE}') AS machine FROM (SELECT event_id, {VALUES} AS v FROM events)")
def machine_value(spark, d):
    sql = VALUES.replace("event_id::VARCHAR", "cast(event_id AS string)")
    rows = table(spark, d, "events").selectExpr("event_id", f"{sql} AS v")
    return rows.select("event_id", "v", T.machine_value(F.col("v")).alias("machine"))


def event_sessions(spark, d):
    """A user's events in order are the snapshots of a session."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("snap", F.row_number().over(order) - 1)
    return rows.selectExpr("user_id AS sid", "snap", "concat('user_id=', user_id, ' id=', event_id, ' ', props) AS text")


CHURN = """WITH s AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS snap, user_id, event_id, props FROM events),
f AS (SELECT sid, snap, 'kv:user_id' AS field, user_id::VARCHAR AS v FROM s UNION ALL SELECT sid, snap, 'kv:id', event_id::VARCHAR FROM s
    UNION ALL SELECT sid, snap, 'json:' || unnest(regexp_extract_all(props, '"([A-Za-z_]+)"\\s*:\\s*("[^"]{0,120}"|-?[0-9][0-9.eE+-]*)', 1)), regexp_replace(unnest(regexp_extract_all(props, '"([A-Za-z_]+)"\\s*:\\s*("[^"]{0,120}"|-?[0-9][0-9.eE+-]*)', 2)), '^"|"$', '', 'g') FROM s),
j AS (SELECT a.field, avg((a.v = b.v)::INT::DOUBLE) AS j FROM f a JOIN f b ON a.sid = b.sid AND a.field = b.field AND b.snap = a.snap + 1 GROUP BY a.field),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY sid, snap) AS rn FROM f),
m AS (SELECT field, avg(regexp_matches(trim(v), '{machine}')::INT::DOUBLE) AS mf, count(DISTINCT v) / count(*) AS dr FROM r WHERE rn <= 2000 GROUP BY field)
SELECT field, count(*) AS occurrences, round(any_value(j), 3) AS mean_jaccard, round(any_value(mf), 2) AS machine_frac, round(any_value(dr), 2) AS distinct_ratio
FROM f JOIN j USING (field) JOIN m USING (field) GROUP BY field HAVING count(*) >= 200""".replace("{machine}", T.MACHINE)


@query("field_churn", CHURN)
def field_churn(spark, d):
    return mining.churn(mining.field_values(event_sessions(spark, d)))


def _mined() -> str:
    """The greedy loop as a recursion over candidates: its rows are the snapshots, masked by the fields chosen so far."""
    kv = """regexp_replace(text, '\\b' || name || '=[^\\s,;"'']{1,80}', name || '=<V>', 'g')"""
    js = """regexp_replace(text, '"' || name || '"\\s*:\\s*(?:"[^"]{0,120}"|-?[0-9][0-9.eE+-]*)', '"' || name || '":"<V>"', 'g')"""
    share = pct("(sum(length({0})) OVER () - sum(CASE WHEN rn = 1 THEN length({0}) END) OVER ())", "(sum(length({0})) OVER ())")
    nth = "row_number() OVER (PARTITION BY {0} ORDER BY event_id) AS rn"
    return f"""WITH RECURSIVE cand AS (
    SELECT row_number() OVER (ORDER BY mean_jaccard, field) AS k, field, split_part(field, ':', 1) AS kind, split_part(field, ':', 2) AS name
    FROM ({CHURN}) WHERE mean_jaccard < 0.9 AND machine_frac >= 0.9 AND distinct_ratio >= 0.05
), t AS (SELECT event_id, 'user_id=' || user_id || ' id=' || event_id || ' ' || props AS text FROM events),
walk AS (
    SELECT 0::BIGINT AS k, event_id, text, {share.format('text')} AS base, []::VARCHAR[] AS chosen FROM (SELECT *, {nth.format('text')} FROM t)
    UNION ALL
    SELECT k + 1, event_id, CASE WHEN more >= 0.5 THEN new ELSE text END, CASE WHEN more >= 0.5 THEN base + more ELSE base END, CASE WHEN more >= 0.5 THEN list_append(chosen, field) ELSE chosen END
    FROM (SELECT *, {share.format('new')} - base AS more FROM (SELECT *, {nth.format('new')} FROM (
        SELECT w.*, cand.field, CASE kind WHEN 'kv' THEN {kv} ELSE {js} END AS new FROM walk w JOIN cand ON cand.k = w.k + 1)))
)
SELECT row_number() OVER (ORDER BY field) - 1 AS nth, field FROM (SELECT unnest(any_value(chosen)) AS field FROM walk WHERE k = (SELECT max(k) FROM cand))"""


@query("mined_spec", _mined())
def mined_spec(spark, d):
    fields = mining.mine(event_sessions(spark, d))
    return spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "nth long, field string")


HEAD = "CASE WHEN conv_id % 3 = 0 THEN text ELSE role || chr(10) || 'OBSERVATION: ' || chr(10) || text END"


@query("head_split", f"WITH p AS (SELECT conv_id, turn, {HEAD} AS p FROM conversations), h AS (SELECT *, regexp_extract(p, '(?s)^.*?OBSERVATION:\\s*\\n') AS h FROM p) SELECT conv_id, turn, length(CASE WHEN h = '' THEN p ELSE h END) AS head_chars, length(p) - length(CASE WHEN h = '' THEN p ELSE h END) AS obs_chars FROM h")
def head_split(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", HEAD.replace("chr(10)", r"'\n'") + " AS p")
    head = T.head_of(F.col("p"))
    return rows.select("conv_id", "turn", F.length(head).alias("head_chars"), (F.length("p") - F.length(head)).alias("obs_chars"))


OPEN = ["'[File: a.py (3 lines total)] '", "'OBSERVATION: Here is the result of running `cat -n` on a.py: '", "'The file a.py has been edited. result of running `cat -n` '", "'File created successfully '", "'Found '", "'ISSUE: '", "''"]
OPENED = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(OPEN)) + " END || text"
KINDS = ["file_read", "file_read", "edit", "edit", "search_list", "prompt_task"]


@query("classify_text", "SELECT doc_id, CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(KINDS)) + " ELSE CASE WHEN text LIKE 'Found %' OR text LIKE 'grep:%' THEN 'search_list' WHEN text LIKE 'The file %' THEN 'edit' ELSE 'bash_other' END END AS tool FROM documents")
def classify_text(spark, d):
    return docs(spark, d).selectExpr("doc_id", f"{OPENED} AS text").select("doc_id", T.classify(F.col("text")).alias("tool"))


ROOTS = "CASE page_id % 5 WHEN 0 THEN '/testbed/' WHEN 1 THEN '/workspace/x/' WHEN 2 THEN '/app/' WHEN 3 THEN '/app/projects/' ELSE '/srv/' END || 'a/b' || page_id || '.py'"


@query("norm_path", "SELECT page_id, CASE WHEN page_id % 5 = 4 THEN '/srv/' ELSE '' END || 'a/b' || page_id || '.py' AS path FROM pages")
def norm_path(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{ROOTS} AS path").select("page_id", T.norm_path(F.col("path")).alias("path"))


@query("repo_key", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'org/' || p_size WHEN 1 THEN 'a/b-c' ELSE 'solo-' || p_partkey END AS repo FROM part")
def repo_key(spark, d):
    name = "CASE p_partkey % 3 WHEN 0 THEN concat('org__', p_size, '-', p_partkey) WHEN 1 THEN concat('a__b-c.', p_partkey, '.mut') ELSE concat('solo-', p_partkey) END"
    return table(spark, d, "part").selectExpr("p_partkey", f"{name} AS x").select("p_partkey", T.repo_key(F.col("x")).alias("repo"))


@query("parse_numbered", f"WITH {LINES} SELECT doc_id, (doc_id % 50) || '.py' AS path, count(*) AS n, max(pos + 1)::BIGINT AS last_no, md5(string_agg(line, chr(10) ORDER BY pos)) AS key FROM lines GROUP BY doc_id HAVING count(*) >= 2")
def parse_numbered(spark, d):
    """Documents shown by a viewer that numbers their lines."""
    shown = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 6, " "), F.lit("\t"), x)), "\n")
    head = F.concat(F.lit("Here's the result of running `cat -n` on /testbed/"), (F.col("doc_id") % 50).cast("string"), F.lit(".py:\n"))
    rows = docs(spark, d).select("doc_id", F.concat(head, shown, F.lit("\nReview the changes.")).alias("text"))
    out = parse.reads(rows, "cat_n")
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    return out.select("doc_id", "path", F.size("lines").alias("n"), F.element_at("lines", -1)["no"].alias("last_no"), F.md5(text.cast("binary")).alias("key"))


@query("leading_run", f"WITH {LINES}, c AS (SELECT *, min(pos) FILTER (pos % 9 NOT IN (0, 7)) OVER w AS a FROM lines WINDOW w AS (PARTITION BY doc_id)), e AS (SELECT *, min(pos) FILTER (pos > a AND pos % 9 IN (0, 7)) OVER (PARTITION BY doc_id) AS b FROM c) SELECT doc_id, (count(*) FILTER (pos >= a AND pos < coalesce(b, 1000000)))::BIGINT AS n FROM e GROUP BY doc_id")
def leading_run(spark, d):
    """Lines 0 and 7 modulo 9 have no number."""
    shown = F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i % 9).isin(0, 7), F.lit("...")).otherwise(F.concat((i + 1).cast("string"), F.lit("→"), x)))
    return docs(spark, d).select("doc_id", F.size(parse.leading_run(shown, parse.VIEWERS["arrow"][1])).alias("n"))


@query(
    "tool_call_join",
    """WITH u AS (SELECT o_custkey AS traj, o_orderkey AS seq, o_orderkey // 8 AS use_id, 'f' || o_orderkey AS path, o_orderkey % 2 = 0 AS call FROM orders)
SELECT r.traj, r.seq, coalesce(max(c.path), '?') AS path FROM u r LEFT JOIN LATERAL (SELECT path FROM u c WHERE c.call AND c.traj = r.traj AND c.use_id = r.use_id AND c.seq < r.seq ORDER BY seq DESC LIMIT 1) c ON true WHERE NOT r.call GROUP BY r.traj, r.seq""".replace("o_custkey AS traj", "o_orderkey // 40 AS traj"),
)
def tool_call_join(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey div 40 AS traj", "o_orderkey AS seq", "o_orderkey div 8 AS use_id", "if(o_orderkey % 2 = 0, 'tool_use', 'tool_result') AS kind", "concat('f', o_orderkey) AS path", "'' AS text")
    return parse.match_calls(rows).select("traj", "seq", "path")


@query("role_map", "SELECT conv_id, turn, CASE role WHEN 'system' THEN 'system' WHEN 'assistant' THEN 'decode' ELSE 'input' END AS role FROM conversations WHERE text <> ''")
def role_map(spark, d):
    return parse.roles(table(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("system_prompt_rows", "SELECT conv_id, turn, 0 AS part, 'system' AS role, length(text) AS n FROM conversations WHERE turn = 0 AND text <> '' UNION ALL SELECT conv_id, turn, 1, CASE role WHEN 'system' THEN 'system' WHEN 'assistant' THEN 'decode' ELSE 'input' END, length(text) FROM conversations WHERE text <> ''".replace("0 AS part", "0::BIGINT AS part").replace("turn, 1,", "turn, 1::BIGINT,"))
def system_prompt_rows(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.when(F.col("turn") == 0, F.col("text")).alias("system_prompt"))
    return parse.with_system_prompts(rows).select("conv_id", "turn", "part", "role", F.length("text").alias("n"))


@query("first_user_turn", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS rn FROM conversations) SELECT conv_id, text FROM r WHERE rn = 1 AND text <> ''")
def first_user_turn(spark, d):
    rows = table(spark, d, "conversations")
    best = rows.groupBy("conv_id").agg(F.min(F.struct((F.col("role") != "user").alias("other"), "turn", "text")).alias("x"))
    return best.select("conv_id", "x.text").where("text <> ''")


@query("turn_unpivot", "SELECT conv_id, 't' || (1 + (turn > 1)::INT) AS task, text FROM conversations WHERE turn IN (1, 2) AND text <> ''")
def turn_unpivot(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("query"), F.max(F.when(F.col("turn") == 2, F.col("text"))).alias("follow_up"))
    turns = F.array(F.struct(F.lit("t1").alias("task"), F.col("query").alias("text")), F.struct(F.lit("t2").alias("task"), F.col("follow_up").alias("text")))
    return rows.select("conv_id", F.explode(F.filter(turns, lambda x: F.coalesce(x["text"], F.lit("")) != "")).alias("x")).select("conv_id", "x.*")


@query("session_min_snaps", "WITH f AS (SELECT conv_id, count(*) AS n, min(turn) AS first FROM conversations GROUP BY conv_id HAVING count(*) >= 2) SELECT conv_id, n FROM f ORDER BY conv_id LIMIT 40")
def session_min_snaps(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 2")
    return rows.orderBy("conv_id").limit(40)  # the first 40 sessions: the operator's own limit


@query("argmax_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def argmax_per_group(spark, d):
    rows = table(spark, d, "orders")
    best = rows.groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("x"))
    return best.select("o_custkey", (-F.col("x.k")).alias("o_orderkey"), "x.o_totalprice")


@query("shard_dedup", "WITH s AS (SELECT p_partkey, 't' || (p_size % 9) || '_<DATE>' AS shard FROM part) SELECT shard, min(p_partkey) AS first_part, count(*) AS n FROM s GROUP BY shard")
def shard_dedup(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "concat('t', p_size % 9, '_2024', lpad(cast(p_partkey % 10000 AS string), 4, '0')) AS name")
    return rows.select("p_partkey", F.regexp_replace("name", "[0-9]{8}$", "<DATE>").alias("shard")).groupBy("shard").agg(F.min("p_partkey").alias("first_part"), F.count("*").alias("n"))


@query("slice_lines", "WITH n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS rn, count(*) OVER () // 20 AS per FROM lineitem) SELECT rn // per AS sid, (rn % per) // 500 AS snap, count(*) AS lines, min(l_orderkey) AS first_order FROM n WHERE rn < 20 * per GROUP BY ALL")
def slice_lines(spark, d):
    """Twenty equal slices of the lines in order, in snapshots of 500 lines."""
    from ..operators.order import numbered

    rows = numbered(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    per = table(spark, d, "lineitem").agg(F.floor(F.count("*") / 20).alias("per"))
    rows = rows.crossJoin(F.broadcast(per)).where("rn < 20 * per")  # one row
    return rows.selectExpr("rn div per AS sid", "(rn % per) div 500 AS snap", "l_orderkey").groupBy("sid", "snap").agg(F.count("*").alias("lines"), F.min("l_orderkey").alias("first_order"))


@query("doc_token_stats", f"WITH n AS (SELECT {nt('text')} AS n FROM documents), l AS (SELECT list(n ORDER BY n) AS l FROM n) SELECT len(l) AS docs, l[1] AS min_tokens, l[len(l) // 2 + 1] AS median_tokens, l[len(l)] AS max_tokens FROM l")
def doc_token_stats(spark, d):
    from ..operators.order import numbered

    n = docs(spark, d).select("doc_id", T.n_tokens(F.col("text")).alias("n"))
    whole = n.agg(F.count("*").alias("docs"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"))
    middle = numbered(n, ["n", "doc_id"]).crossJoin(F.broadcast(whole)).where("rn = docs div 2")  # one row
    return middle.select("docs", "min_tokens", F.col("n").alias("median_tokens"), "max_tokens")


@query("full_kb", f"SELECT item_id, (SELECT count(*) FROM documents) AS docs, {nt('text')} + (SELECT sum({nt('text')})::BIGINT FROM documents) AS tokens FROM benchmark")
def full_kb(spark, d):
    kb = docs(spark, d).agg(F.count("*").alias("docs"), F.sum(T.n_tokens(F.col("text"))).alias("kb"))
    return table(spark, d, "benchmark").crossJoin(F.broadcast(kb)).select("item_id", "docs", (T.n_tokens(F.col("text")) + F.col("kb")).alias("tokens"))  # one row


@query("doc_ref_join", "SELECT quality::BIGINT AS quality, source, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def doc_ref_join(spark, d):
    refs = table(spark, d, "labels").select("doc_id", "quality")
    return refs.join(docs(spark, d), "doc_id").groupBy("quality", "source").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("semi_docs", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_docs(spark, d):
    return docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("group_by_domain", "WITH g AS (SELECT source, lang, count(*) AS docs FROM documents GROUP BY ALL) SELECT * FROM g WHERE source = (SELECT max(source) FROM documents WHERE source LIKE '%1%')")
def group_by_domain(spark, d):
    last = docs(spark, d).where("source LIKE '%1%'").agg(F.max("source").alias("source"))
    return docs(spark, d).join(F.broadcast(last), "source").groupBy("source", "lang").agg(F.count("*").alias("docs"))  # one row


@query("context_units", "WITH c AS (SELECT p_brand, 0 AS part, p_partkey AS k, 'CREATE TABLE ' || p_name AS unit FROM part UNION ALL SELECT p_brand, 1, p_partkey, p_name || ': ' || p_type FROM part UNION ALL SELECT p_brand, 2, p_partkey, 'size ' || p_size FROM part WHERE p_size > 25) SELECT p_brand, count(*) AS units, md5(string_agg(unit, chr(10) ORDER BY part, k)) AS key FROM c GROUP BY p_brand")
def context_units(spark, d):
    rows = table(spark, d, "part")
    part = lambda i, text, src=rows: src.selectExpr("p_brand", f"{i} AS part", "p_partkey AS k", f"{text} AS unit")
    every = part(0, "concat('CREATE TABLE ', p_name)").unionByName(part(1, "concat(p_name, ': ', p_type)")).unionByName(part(2, "concat('size ', p_size)", rows.where("p_size > 25")))
    return every.groupBy("p_brand").agg(F.count("*").alias("units"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "unit"))), lambda x: x["unit"]), "\n").cast("binary")).alias("key"))


@query("family_best", "WITH r AS (SELECT lang AS family, source AS corpus, round(100.0 * count(DISTINCT text) / count(*), 2) AS pct FROM documents GROUP BY ALL) SELECT *, max(pct) OVER (PARTITION BY family) = pct AS best FROM r")
def family_best(spark, d):
    from ..operators.report import family_best as best

    rows = docs(spark, d).groupBy(F.col("lang").alias("family"), F.col("source").alias("corpus")).agg(F.round(F.lit(100.0) * F.countDistinct("text") / F.count("*"), 2).alias("pct"))
    return best(rows, "family", "pct")




@query("report_rows", "WITH r AS (" + "{D}" + ") SELECT 'documents' AS corpus, unnest(['prefix', 'pic']) AS metric, unnest([prefix_pct, pic_pct]) AS computed FROM r")
def report_rows(spark, d):
    from ..operators.report import rows
    from .base import QUERIES

    return rows(QUERIES["disjoint_measure"](spark, d), "documents", {"prefix": "prefix_pct", "pic": "pic_pct"})


@query("delta_vs_published", "WITH r AS ({D}), c AS (SELECT 'documents' AS corpus, unnest(['prefix', 'pic']) AS metric, unnest([prefix_pct, pic_pct]) AS computed, unnest([26.62, 3.28]) AS published FROM r) SELECT corpus, metric, computed, published::DOUBLE AS published, round(computed - published, 2)::DOUBLE AS delta FROM c")
def delta_vs_published(spark, d):
    from ..operators.report import PUBLISHED, delta
    from .base import QUERIES

    published = spark.createDataFrame([("documents", m, v) for m, v in zip(("prefix", "pic"), PUBLISHED["WildChat"])], "corpus string, metric string, published double")
    return delta(QUERIES["report_rows"](spark, d), published)


def _finish() -> None:
    from .measure_queries import DISJOINT

    for name in ("report_rows", "delta_vs_published"):
        ORACLES[name] = ORACLES[name].replace("{D}", DISJOINT)


_finish()
