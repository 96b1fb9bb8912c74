"""Registry of queries, the views they share, and the SQL pieces of their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cluster import ship
from ..functions.text import TOKEN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; whole numbers come out as longs, as in the SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = f(spark, sf_dir)
            return df.select(*[F.col(c.name).cast("long") if isinstance(c.dataType, (T.IntegerType, T.ShortType)) else F.col(c.name) for c in df.schema])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def sessions(spark: SparkSession, sf_dir: str, task: str = "source") -> DataFrame:
    """Three documents in a row are the snapshots of a session."""
    return docs(spark, sf_dir).selectExpr("doc_id div 3 AS sid", "cast(doc_id % 3 AS int) AS snap", f"{task} AS task", "text")


def nt(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN}'))"


#: doc_id, pos, line (without its end), n (tokens with it), for every line of every document.
LINES = f"""
lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), counted AS (SELECT *, {nt('line || chr(10)')} AS n FROM lines)"""


def walked(src: str, target: int, more: str = "") -> str:
    """CTEs walk and grp: rows (k, pos, n) of src packed to target."""
    acc = "CASE WHEN w.closed THEN u.n ELSE w.acc + u.n END"
    return f"""
walk AS (
    SELECT k, pos, n, n AS acc, 0 AS g, n >= {target} AS closed FROM {src} WHERE pos = 0
    UNION ALL
    SELECT u.k, u.pos, u.n, {acc}, CASE WHEN w.closed THEN w.g + 1 ELSE w.g END, ({acc}) >= {target}
    FROM walk w JOIN {src} u ON u.k = w.k AND u.pos = w.pos + 1
), grp AS (
    SELECT k, g, bool_or(closed) AS closed, min(pos) AS s, max(pos) + 1 AS e, sum(n)::BIGINT AS n FROM walk GROUP BY k, g
)"""


def spans(alone: bool = False) -> str:
    """CTE spans(k, s, e, n): an open last group joins the one before it; without one it is a span or none."""
    h = "CASE WHEN closed OR g = 0 THEN g ELSE g - 1 END" if alone else "CASE WHEN closed THEN g ELSE g - 1 END"
    return f"""
spans AS (
    SELECT k, min(s)::BIGINT AS s, max(e)::BIGINT AS e, sum(n)::BIGINT AS n
    FROM (SELECT *, {h} AS h FROM grp) WHERE h >= 0 GROUP BY k, h
)"""


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE round(100.0 * {a} / {b}::DOUBLE, 2) END"
