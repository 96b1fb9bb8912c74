"""Mining of volatile fields: values by field, churn between snapshots, a verified mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import measure, treat
from .order import kept

_PAIR = "array<struct<field:string,value:string>>"


def _pairs(text: Column, pattern: str, prefix: str, value=lambda v: v) -> Column:
    names, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(names, values, lambda n, v: F.struct(F.concat(F.lit(prefix), n).alias("field"), value(v).alias("value")))


def field_pairs(text: Column, positions: bool = False) -> Column:
    """Distinct (field, value) of a snapshot: attributes, bracketed numbers, JSON, key=value and YAML fields."""
    unquote = lambda v: F.regexp_replace(v, '^"|"$', "")
    parts = [
        _pairs(text, T.ATTR, "attr:"),
        F.transform(F.regexp_extract_all(text, F.lit(T.BRACKET), F.lit(1)), lambda v: F.struct(F.lit("bracket_id").alias("field"), v.alias("value"))),
        _pairs(text, T.JSON_PAIR, "json:", unquote),
        _pairs(text, T.LOG_KV, "kv:"),
        _pairs(text, T.YAML_KV, "yaml:", lambda v: F.regexp_replace(v, '^"+|"+$', "")),
    ]
    if positions:
        words = F.transform(F.split(text, "\n", -1), lambda x: F.filter(F.split(x, r"\s+", -1), lambda w: w != ""))
        words = F.filter(words, lambda w: F.size(w) >= 8)
        parts.append(F.flatten(F.transform(words, lambda w: F.transform(F.slice(w, 1, 6), lambda t, i: F.struct(F.concat(F.lit("pos:"), i.cast("string")).alias("field"), t.alias("value"))))))
    return F.array_distinct(F.concat(*[p.cast(_PAIR) for p in parts]))


def field_values(snaps: DataFrame, positions: bool = False) -> DataFrame:
    """(sid, snap, field, vals): sorted distinct values of each field in each snapshot."""
    rows = snaps.select("sid", "snap", F.explode(field_pairs(F.col("text"), positions)).alias("x"))
    return rows.groupBy("sid", "snap", "x.field").agg(F.array_sort(F.collect_set("x.value")).alias("vals"))


def churn(values: DataFrame, support: int = 200, sample: int = 2000) -> DataFrame:
    """Mean Jaccard of consecutive snapshots, occurrences, shares of machine-made and of distinct values, by field.

    Samples take a snapshot's first 50 values in order, snapshots in arrival order.
    """
    values = kept(values)
    after = values.select("sid", (F.col("snap") - 1).alias("snap"), "field", F.col("vals").alias("next"))
    pair = values.join(after, ["sid", "snap", "field"])
    j = F.size(F.array_intersect("vals", "next")) / F.greatest(F.lit(1), F.size(F.array_union("vals", "next")))
    stats = pair.groupBy("field").agg(F.avg(j).alias("mean_jaccard"))
    found = values.groupBy("field").agg(F.sum(F.size("vals")).alias("occurrences")).where(F.col("occurrences") >= support)
    rows = values.select("field", "sid", "snap", F.posexplode(F.slice("vals", 1, 50)).alias("i", "v")).where(F.trim("v") != "")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("field").orderBy("sid", "snap", "i"))).where(F.col("rn") <= sample)
    shape = first.groupBy("field").agg(F.avg(T.machine_value(F.col("v")).cast("double")).alias("machine_frac"), (F.countDistinct("v") / F.count("*")).alias("distinct_ratio"))
    out = found.join(stats, "field").join(shape, "field", "left")
    return out.select("field", "occurrences", F.round("mean_jaccard", 3).alias("mean_jaccard"), F.round("machine_frac", 2).alias("machine_frac"), F.round("distinct_ratio", 2).alias("distinct_ratio"))


def compared(snaps: DataFrame, hand: list[str], support: int = 200) -> DataFrame:
    """Reuse of token blocks as it is, under the mined mask and under a mask made by hand: a row each, with its fields."""
    out = None
    for spec, fields in (("raw", []), ("mined", mine(snaps, support)), ("hand", hand)):
        row = measure.block_reuse(snaps.withColumn("text", treat.mask_all(F.col("text"), fields))).select(F.lit(spec).alias("spec"), F.lit(",".join(fields)).alias("fields"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def mine(snaps: DataFrame, support: int = 200, ceiling: float = 0.9, gain: float = 0.5, positions: bool = False) -> list[str]:
    """Fields whose masking raises the share of duplicate lines by `gain` points, tried in order of churn.

    One job for each candidate field: their number is a property of the format, not of the data's size.
    """
    table = churn(field_values(snaps, positions), support).where((F.col("mean_jaccard") < ceiling) & (F.col("machine_frac") >= 0.9) & (F.col("distinct_ratio") >= 0.05))
    chosen: list[str] = []

    def share(fields: list[str]) -> float:
        return measure.line_dedup(snaps.withColumn("text", treat.mask_all(F.col("text"), fields))).first()["dup_pct"]

    base = share([])
    for row in table.orderBy("mean_jaccard", "field").toLocalIterator():
        more = share([*chosen, row["field"]]) - base
        if more >= gain:
            chosen.append(row["field"])
            base += more
    return sorted(chosen)
