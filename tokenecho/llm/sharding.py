"""Contiguous shards of equal bytes: global prefix sums from per-partition totals.

Documents stand in one global order; it is dealt into ranges, each range sums its
bytes, the few totals are summed up in order, and each row's prefix is its range's
offset plus a running sum inside the range. Shard borders are where the prefix passes
equal targets. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Size is the text's UTF-8 bytes plus one. Equal texts stand side by side, at the
    place of their smallest id (nulls last), so a group of copies is cut only where a
    border falls into it; a group may be larger than a shard and still be balanced. A
    row goes to the shard in which the middle of its bytes lies, so a shard's bytes
    differ from the target by half a document at each border at most. A null text counts
    as empty and stands with the empty ones, rows with null or repeated ids each get a place, an empty table gives no
    rows, other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("copy"),
    )
    rows = scratch.save(rows, "rows")
    first = rows.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.save(first.drop("n"), "copies")  # read back, so that the join can split a group of copies
    placed = rows.join(first, "copy", "left").withColumn("first", F.coalesce("first", "doc_id", F.lit(2**63 - 1)))
    order = ["first", "copy", F.coalesce("doc_id", F.lit(2**63 - 1))]
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    dealt = scratch.save(dealt, "dealt")  # the ranges stay as they are from here on

    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("offset"), F.sum("part_size").over(Window.partitionBy(F.lit(1))).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    sums = dealt.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(inside))
    sums = sums.join(F.broadcast(offsets), "part")  # one row for each range
    middle = "((offset + upto) * 2 - size)"  # twice the middle of a row's bytes
    sums = sums.withColumn("shard", F.expr(f"cast(least({middle} * {shards} div (total * 2), {shards - 1}) AS int)"))
    sums = scratch.save(sums.select("doc_id", "size", "text_crc32", "part", "nth", "shard"), "sharded")

    # a shard's rows in a range are consecutive: its first slot there is the count in earlier ranges
    pieces = sums.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("nth").alias("first_nth"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("part", "shard", "first_nth", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    slots = sums.join(F.broadcast(pieces), ["part", "shard"])  # ranges plus shards rows at most
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - F.col("first_nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
