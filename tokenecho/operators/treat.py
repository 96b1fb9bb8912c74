"""Rewrites of volatile text before measuring: mask, replace, relocate, align. Column in, Column out."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import n_tokens


def mask(text: Column, field: str) -> Column:
    """One field's values removed (attr:) or replaced by a placeholder (all others)."""
    kind, _, name = field.partition(":")
    key = re.escape(name)
    if field == "bracket_id":
        return F.regexp_replace(text, r"\[[0-9]+\]", "[N]")
    if kind == "attr":
        return F.regexp_replace(text, rf'\s*{key}="[^"]*"', "")
    if kind == "json":
        return F.regexp_replace(text, rf'"{key}"\s*:\s*(?:"[^"]{{0,120}}"|-?[0-9][0-9.eE+-]*)', f'"{name}":"<V>"')
    if kind == "kv":
        return F.regexp_replace(text, rf"\b{key}=[^\s,;\"']{{1,80}}", f"{name}=<V>")
    if kind == "yaml":
        return F.regexp_replace(text, rf"(?m)^(\s*(?:- )?){key}:\s+\S.*$", f"$1{name}: <V>")
    if kind == "pos":
        return mask_position(text, int(name))
    raise ValueError(f"unknown field {field!r}")


def mask_all(text: Column, fields: list[str]) -> Column:
    return reduce(mask, fields, text)


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+", -1), lambda w: w != "")


def mask_position(text: Column, i: int, least: int = 8) -> Column:
    """Word i of every line with enough words becomes a placeholder; such lines are joined by single blanks."""

    def line(x: Column) -> Column:
        w = _words(x)
        return F.when((F.size(w) >= least) & (F.size(w) > i), F.array_join(F.transform(w, lambda t, j: F.when(j == i, F.lit("<V>")).otherwise(t)), " ")).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def relocate_positions(line: Column, at: tuple[int, ...] = (1, 4), least: int = 8) -> tuple[Column, Column]:
    """(body, side): the words at these positions moved to the side text; short lines stay whole."""
    w = _words(line)
    moved = F.filter(w, lambda t, j: j.isin(*at))
    stay = F.filter(w, lambda t, j: ~j.isin(*at))
    long = F.size(w) >= least
    return F.when(long, F.array_join(stay, " ")).otherwise(line), F.when(long, F.array_join(moved, " ")).otherwise(F.lit(""))


def canonical_json(text: Column) -> Column:
    """JSON written anew; other text stays."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def relocate_envelope(text: Column) -> tuple[Column, Column]:
    """(body, side) of a JSON envelope {"output": string, "metadata": ...}; other text is its own body."""
    parsed = F.from_json(text, "struct<output:variant,metadata:variant>", {"mode": "PERMISSIVE"})
    is_text = F.schema_of_variant(parsed["output"]) == "STRING"
    both = is_text & parsed["metadata"].isNotNull() & ~F.is_variant_null(parsed["metadata"])
    return F.when(both, F.variant_get(parsed["output"], "$", "string")).otherwise(text), F.when(both, F.to_json(parsed["metadata"])).otherwise(F.lit(""))


def replace_by_line(snaps: DataFrame, of: list[str], text: str = "text", pattern: str = r"\[[0-9]+\]") -> DataFrame:
    """Handles in brackets become hashes of their line without handles, its ordinal and their own, so equal pages agree."""
    lines = snaps.select(*of, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("cleaned", F.regexp_replace("line", pattern, "[.]"))
    lines = lines.withColumn("nth", F.row_number().over(Window.partitionBy(*of, "cleaned").orderBy("pos")) - 1)
    pieces, cleaned, nth = F.split("line", pattern, -1), F.col("cleaned"), F.col("nth")
    handle = lambda j: F.concat(F.lit("[a"), F.substring(F.md5(F.concat_ws("|", cleaned, nth.cast("string"), j.cast("string")).cast("binary")), 1, 16), F.lit("]"))
    last = F.size(pieces) - 1
    new = F.array_join(F.transform(pieces, lambda p, j: F.when(j < last, F.concat(p, handle(j))).otherwise(p)), "")
    lines = lines.withColumn("new", new)
    return lines.groupBy(*of).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]), "\n").alias(text))


def replace_attribute(snaps: DataFrame, of: list[str], attribute: str, text: str = "text") -> DataFrame:
    """An attribute's value in each tag becomes a hash of the tag without it and of the tag's ordinal in the snapshot."""
    tag = rf'<[^>]*{re.escape(attribute)}="[^"]*"[^>]*>'
    rows = snaps.select(*of, F.split(text, tag, -1).alias("pieces"), F.regexp_extract_all(F.col(text), F.lit(tag), F.lit(0)).alias("tags"))
    tags = rows.select(*of, F.posexplode("tags").alias("pos", "tag"))
    tags = tags.withColumn("cleaned", F.regexp_replace("tag", rf'\s*{re.escape(attribute)}="[^"]*"', ""))
    tags = tags.withColumn("nth", F.row_number().over(Window.partitionBy(*of, "cleaned").orderBy("pos")) - 1)
    handle = F.substring(F.md5(F.concat_ws("|", "cleaned", F.col("nth").cast("string")).cast("binary")), 1, 16)
    new = F.expr("regexp_replace(tag, '" + re.escape(attribute) + "=\"[^\"]*\"', concat('" + attribute + "=\"a', h, '\"'))")
    tags = tags.withColumn("h", handle).withColumn("new", new)
    tags = tags.groupBy(*of).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("new"))
    out = rows.join(tags, of, "left").withColumn("new", F.coalesce("new", F.array().cast("array<string>")))
    return out.select(*of, F.array_join(F.zip_with("pieces", "new", lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "").alias(text))


def _fold(batches, least: int):
    """(group, doc_id, bucket) of rows (group, doc_id, n) in order: memory holds one batch and the open bucket."""
    opened, group, ids, acc, bucket = False, None, [], 0, 0
    for batch in batches:
        kinds = [batch.schema.field(c).type for c in range(2)]

        def closed(g, ids, bucket):
            return pa.RecordBatch.from_arrays([pa.array([g] * len(ids), kinds[0]), pa.array(ids, kinds[1]), pa.array([bucket] * len(ids), pa.int32())], [*batch.schema.names[:2], "bucket"])

        for g, i, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if not opened or g != group:
                if ids:
                    yield closed(group, ids, max(bucket - 1, 0))
                opened, group, ids, acc, bucket = True, g, [], 0, 0
            ids.append(i)
            acc += n
            if acc >= least:
                yield closed(g, ids, bucket)
                ids, acc, bucket = [], 0, bucket + 1
    if ids:
        yield closed(group, ids, max(bucket - 1, 0))


def buckets(docs: DataFrame, least: int = 500, group: str = "grp") -> DataFrame:
    """(group, doc_id, bucket): a group's documents by id, packed to `least` tokens; a short tail joins the last bucket.

    Ids and counts of a group pass through one task in order, as a bucket's start depends on
    all documents before; they are sorted on disk and never held as a whole. A null text counts nothing.
    """
    rows = docs.select(group, "doc_id", F.coalesce(n_tokens(F.col("text")), F.lit(0)).alias("n"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("bucket", T.IntegerType())])
    return rows.repartition(group).sortWithinPartitions(group, "doc_id", "n").mapInArrow(lambda batches: _fold(batches, least), schema)
