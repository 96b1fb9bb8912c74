"""Queries over tokens, lines and span boundaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger, measure, segment, structure
from .base import LINES, docs, nt, query, spans, table, walked

MIN = 64


@query("token_count", f"SELECT doc_id, {nt('text')}::BIGINT AS n_tokens FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.n_tokens(F.col("text")).alias("n_tokens"))


@query("lines_of", f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, line || chr(10) AS line FROM lines")
def lines_of(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("pos", "line"))


def _snaps(spark, d):
    return measure.with_lines(docs(spark, d).select("doc_id", "text"))


@query("cum_tokens", f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, (sum(n) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS cum FROM counted")
def cum_tokens(spark, d):
    lines = _snaps(spark, d).select("doc_id", F.posexplode("n").alias("pos", "x"))
    return lines.select("doc_id", "pos", F.sum("x").over(Window.partitionBy("doc_id").orderBy("pos")).alias("cum"))


def _flat(rows, spans_col):
    return rows.select("doc_id", F.explode(spans_col).alias("x")).select("doc_id", "x.s", "x.e", "x.n")


SRC = "src AS (SELECT doc_id AS k, pos, n FROM counted)"


@query("pack_spans", f"WITH RECURSIVE {LINES}, {SRC}, {walked('src', MIN)}, {spans()} SELECT k AS doc_id, s, e, n FROM spans")
def pack_spans(spark, d):
    return _flat(_snaps(spark, d), segment.pack(F.col("n"), MIN))


@query(
    "pack_spans_nl",
    f"WITH RECURSIVE {LINES}, src AS (SELECT doc_id AS k, pos, {nt('line')} AS n FROM lines), {walked('src', MIN)}, {spans()} "
    "SELECT k AS doc_id, s, e, n, md5(string_agg(line, chr(10) ORDER BY pos)) AS key FROM spans JOIN lines ON doc_id = k AND pos >= s AND pos < e GROUP BY ALL",
)
def pack_spans_nl(spark, d):
    rows = docs(spark, d).select("doc_id", F.split("text", "\n", -1).alias("lines"))
    rows = rows.withColumn("n", F.transform("lines", T.n_tokens))
    out = rows.select("doc_id", "lines", F.explode(segment.pack(F.col("n"), MIN)).alias("x"))
    text = F.array_join(F.slice("lines", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")), "\n")
    return out.select("doc_id", "x.s", "x.e", "x.n", F.md5(text.cast("binary")).alias("key"))


@query("pack_tokens", f"WITH RECURSIVE {LINES}, {SRC}, {walked('src', MIN)}, {spans(True)} SELECT k AS doc_id, s, e, n FROM spans")
def pack_tokens(spark, d):
    return _flat(_snaps(spark, d), segment.pack(F.col("n"), MIN, MIN, True))


def _flags(flag: str, extra: str = "") -> str:
    """SQL of spans that start at line 0 and where flag holds, over lines with the lines before them."""
    return f"""
WITH {LINES}, seen AS (
    SELECT *, lag(line) OVER w AS before, min(CASE WHEN trim(line) <> '' THEN length(line) - length(ltrim(line)) END) OVER (PARTITION BY doc_id) AS low
    FROM (SELECT doc_id, pos, n, {extra or 'line'} AS line FROM counted) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), cut AS (
    SELECT doc_id, pos, n, sum(CASE WHEN pos = 0 OR ({flag}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM seen
) SELECT doc_id, min(pos)::BIGINT AS s, (max(pos) + 1)::BIGINT AS e, sum(n)::BIGINT AS n FROM cut GROUP BY doc_id, g"""


@query("seg_fixed_line", _flags("pos % 4 = 0"))
def seg_fixed_line(spark, d):
    return _flat(_snaps(spark, d), segment.fixed_line(F.col("n"), 4))


def _bare(rows):
    """Lines without their ends."""
    return rows.withColumn("lines", F.transform("lines", lambda x: F.substring(x, F.lit(1), F.length(x) - 1)))


@query(
    "seg_fixed_char",
    f"""
WITH RECURSIVE {LINES}, src AS (SELECT doc_id AS k, pos, length(line) + 1 AS n FROM lines), {walked('src', 400)}
SELECT g.k AS doc_id, g.s::BIGINT AS s, g.e::BIGINT AS e, sum(c.n)::BIGINT AS n
FROM grp g JOIN counted c ON c.doc_id = g.k AND c.pos >= g.s AND c.pos < g.e GROUP BY ALL""",
)
def seg_fixed_char(spark, d):
    return _flat(_bare(_snaps(spark, d)), segment.fixed_char(F.col("lines"), F.col("n"), 400))


@query("seg_anchor", _flags("(7 + pos) // 5 <> (6 + pos) // 5"))
def seg_anchor(spark, d):
    return _flat(_snaps(spark, d), segment.anchor_line(F.transform("n", lambda _, i: i + 7), F.col("n"), 5))


@query("seg_pack_file", f"WITH RECURSIVE {LINES}, {SRC}, {walked('src', MIN)} SELECT k AS doc_id, 100::BIGINT AS line FROM grp UNION SELECT k, (100 + e)::BIGINT FROM grp WHERE closed")
def seg_pack_file(spark, d):
    return _snaps(spark, d).select("doc_id", F.explode(segment.pack_file(F.lit(100), F.col("n"), MIN)).alias("line"))


@query(
    "seg_cdc",
    f"""
WITH RECURSIVE {LINES}, src AS (SELECT doc_id AS k, pos, n, (('0x' || substr(md5(line || chr(10)), 1, 7))::BIGINT & 3) = 0 AS low FROM counted), walk AS (
    SELECT k, pos, n, 1 AS run, 0 AS g, low AS closed FROM src WHERE pos = 0
    UNION ALL
    SELECT u.k, u.pos, u.n, CASE WHEN w.closed THEN 1 ELSE w.run + 1 END, CASE WHEN w.closed THEN w.g + 1 ELSE w.g END,
        u.low OR (CASE WHEN w.closed THEN 1 ELSE w.run + 1 END) >= 16
    FROM walk w JOIN src u ON u.k = w.k AND u.pos = w.pos + 1
) SELECT k AS doc_id, min(pos)::BIGINT AS s, (max(pos) + 1)::BIGINT AS e, sum(n)::BIGINT AS n FROM walk GROUP BY k, g""",
)
def seg_cdc(spark, d):
    rows = _snaps(spark, d)
    return _flat(rows, segment.cdc_line(segment.line_bits(F.col("lines")), F.col("n"), 4))


@query("seg_blank", _flags("trim(line) <> '' AND trim(before) = ''"))
def seg_blank(spark, d):
    return _flat(_bare(_snaps(spark, d)), segment.blank(F.col("lines"), F.col("n")))


#: Documents rendered as code: indentation and openings by line number.
CODE = "repeat(' ', ((pos % 3) * 2)::INT) || CASE pos % 5 WHEN 0 THEN 'def ' WHEN 1 THEN '@' WHEN 3 THEN ') ' ELSE '' END || line"


def _code(spark, d):
    opens = lambda i: F.when(i % 5 == 0, "def ").when(i % 5 == 1, "@").when(i % 5 == 3, ") ").otherwise("")
    return _bare(_snaps(spark, d)).withColumn("lines", F.transform("lines", lambda x, i: F.concat(F.repeat(F.lit(" "), (i % 3) * 2), opens(i), x)))


@query("seg_defline", _flags(r"regexp_matches(line, '^\s*(async\s+def\s|def\s|class\s|@)') AND NOT starts_with(ltrim(before), '@')", CODE))
def seg_defline(spark, d):
    return _flat(_code(spark, d), segment.def_line(F.col("lines"), F.col("n")))


@query("seg_indent0", _flags("trim(line[1:1]) <> '' AND line[1:1] NOT IN (')', ']', '}')", CODE))
def seg_indent0(spark, d):
    return _flat(_code(spark, d), segment.indent0(F.col("lines"), F.col("n")))


@query("seg_indent_min", _flags("trim(line) <> '' AND length(line) - length(ltrim(line)) = low AND NOT regexp_matches(ltrim(line), '^(\\)|\\]|\\}|elif|else|except|finally)')", CODE))
def seg_indent_min(spark, d):
    return _flat(_code(spark, d), segment.indent_min(F.col("lines"), F.col("n")))


@query("bounds_to_spans", _flags("length(line) % 3 = 0"))
def bounds_to_spans(spark, d):
    rows = _bare(_snaps(spark, d))
    at = F.filter(F.transform("lines", lambda x, i: F.when(F.length(x) % 3 == 0, i)), lambda i: i.isNotNull())
    outside = F.array(F.lit(-3), F.lit(0), F.size("n"), F.size("n") + 5)
    return _flat(rows, segment.from_bounds(F.concat(outside, at), F.col("n")))


@query(
    "merge_spans",
    f"""
WITH RECURSIVE {LINES}, two AS (SELECT doc_id AS k, pos // 2 AS pos, sum(n)::BIGINT AS n, min(pos) AS s, max(pos) + 1 AS e FROM counted GROUP BY doc_id, pos // 2),
src AS (SELECT k, pos, n FROM two), {walked('src', MIN)}, {spans(True)}
SELECT a.k AS doc_id, min(two.s)::BIGINT AS s, max(two.e)::BIGINT AS e, a.n FROM spans a JOIN two ON two.k = a.k AND two.pos >= a.s AND two.pos < a.e GROUP BY a.k, a.s, a.n""",
)
def merge_spans(spark, d):
    rows = _snaps(spark, d).withColumn("fine", segment.fixed_line(F.col("n"), 2))
    return _flat(rows, segment.merge(F.col("fine"), MIN))


@query("seg_snap_pack")
def seg_snap_pack(spark, d):
    return structure.snap_pack(_bare(_snaps(spark, d)), MIN, MIN // 2)


def _python(spark, d):
    """Documents rendered as a program, line by line."""
    kinds = lambda x, i: F.when(i % 4 == 0, "@wrap").when(i % 4 == 1, "def f(a):").when(i % 4 == 2, "    return a").otherwise(F.concat(F.lit("x = "), F.length(x).cast("string")))
    return _bare(_snaps(spark, d)).withColumn("lines", F.transform("lines", kinds))


@query("seg_ast")
def seg_ast(spark, d):
    return structure.ast_spans(_python(spark, d))


@query("seg_ast_accumulated")
def seg_ast_accumulated(spark, d):
    rows = _python(spark, d).withColumn("numbers", F.transform("n", lambda _, i: i + 5)).withColumn("known", F.array_join("lines", "\n")).withColumn("known_first", F.lit(5))
    return structure.ast_accumulated(rows)


@query("seg_cdc_tokens")
def seg_cdc_tokens(spark, d):
    return structure.cdc_pack(_bare(_snaps(spark, d)), 0.2, 0.5, MIN, 2 * MIN, 3 * MIN, boost=1.5)


@query(
    "boundary_values",
    f"""
WITH {LINES}, ends AS (SELECT doc_id, pos, (sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS e FROM lines),
body AS (SELECT doc_id, hex(encode(replace(text, chr(13) || chr(10), chr(10)))) AS h FROM documents)
SELECT doc_id, pos::BIGINT AS pos, ('0x' || substr(md5(unhex(substr(h, (2 * greatest(e - 64, 0) + 1)::BIGINT, (2 * (least(e, length(h) // 2) - greatest(e - 64, 0)))::BIGINT))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
FROM ends JOIN body USING (doc_id)""",
)
def boundary_values(spark, d):
    return structure.boundary_values(table(spark, d, "documents").select("doc_id", "text"))


@query("token_blocks", f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{T.TOKEN}') AS t FROM documents) SELECT doc_id, q::BIGINT AS q, md5(array_to_string(t[q * 16 + 1 : q * 16 + 16], chr(31))) AS block FROM (SELECT doc_id, t, unnest(range(len(t) // 16)) AS q FROM t)")
def token_blocks(spark, d):
    return measure.blocks(table(spark, d, "documents"), ["doc_id"]).select("doc_id", "q", F.md5(F.col("block").cast("binary")).alias("block"))


CHAIN = f"""
WITH t AS (SELECT doc_id AS pid, regexp_extract_all(text, '{T.TOKEN}') AS t FROM documents),
b AS (SELECT pid, q, array_to_string(t[1 : q * 16 + 16], chr(31)) AS upto FROM (SELECT pid, t, unnest(range(len(t) // 16)) AS q FROM t)),
o AS (SELECT pid, q, min(pid) OVER (PARTITION BY md5(upto), q) < pid AS hit FROM b)"""


@query("block_chain", CHAIN + " SELECT pid, count(*) AS blocks, sum(hit::INT)::BIGINT AS cut FROM o GROUP BY pid")
def block_chain(spark, d):
    return measure.chained_prefix(docs(spark, d).withColumnRenamed("doc_id", "pid"))


@query(
    "prefix_fingerprint",
    f"WITH {LINES}, f AS (SELECT doc_id, pos, md5(string_agg(line || chr(10), '') OVER (PARTITION BY doc_id ORDER BY pos)) AS fp FROM lines) SELECT doc_id, pos::BIGINT AS pos, min(doc_id) OVER (PARTITION BY fp, pos) AS first_doc FROM f",
)
def prefix_fingerprint(spark, d):
    rows = _snaps(spark, d).select("doc_id", F.posexplode("lines").alias("pos", "line"))
    rows = ledger.prefix_fingerprint(rows, ["doc_id"], "pos", F.col("line"))
    first = rows.groupBy("pos", "fp").agg(F.min("doc_id").alias("first_doc"))
    return rows.join(first, ["pos", "fp"]).select("doc_id", "pos", "first_doc")
