"""The difference-cover algorithm over tables: suffix ranks of strings that no single task holds together.

Every string keeps its own name (k, r) and positions, so nothing is concatenated. A level
sorts the triples that start at positions 1 and 2 modulo 3 over range partitions; where
their names are not unique the names of each residue form two shorter strings, which the
next level ranks. The other suffixes are merged in by two more sorts: against residue 1
by (symbol, rank behind), against residue 2 by (two symbols, rank behind). A rank is the
number of suffixes that are smaller, so equal suffixes share one. Sorts run over distinct
keys that were counted before the exchange; only one row for each range meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that is sorted and merged, whatever the files' sizes say: they are those of compressed arrays, whose exploded rows would be broadcast through the driver."""
    return left.join(right.hint("merge"), on, how)


def _below(scratch: Scratch, rows: DataFrame, key: list[str], counted: dict[str, Column], name: str) -> DataFrame:
    """Each distinct key with its `n_<name>` rows of every kind and with how many of these have a smaller key (`<name>`)."""
    d = rows.groupBy(*key).agg(*[F.count_if(c).alias(f"n_{n}") for n, c in counted.items()])
    d = scratch.save(d.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), name)
    parts = d.groupBy("part").agg(*[F.sum(f"n_{n}").alias(f"t_{n}") for n in counted])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = parts.select("part", *[F.coalesce(F.sum(f"t_{n}").over(earlier), F.lit(0)).alias(f"b_{n}") for n in counted])
    inner = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.coalesce(F.sum(f"n_{n}").over(inner), F.lit(0)) + F.col(f"b_{n}")).alias(n) for n in counted]
    return d.join(F.broadcast(parts), "part").select(*key, *[f"n_{n}" for n in counted], *sums)


def _at(array: str, i: Column, beyond: int) -> Column:
    """array[i], or `beyond` behind its end."""
    return F.coalesce(F.get(F.col(array), i.cast("int")), F.lit(beyond).cast("long"))


def _positions(strings: DataFrame, *fields) -> DataFrame:
    """A row for each position j of every string; fields are pairs of a name and a function of j."""
    at = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda j: F.struct(j.alias("j"), *[f(j).alias(n) for n, f in fields]))
    return strings.select("k", "r", F.inline(at))


def _gathered(rows: DataFrame, value: str, *by) -> DataFrame:
    """An array of value in the order of j, for each group."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("j", value))).alias("x")).withColumn("x", F.col(f"x.{value}"))


def ranks(scratch: Scratch, strings: DataFrame, name: str = "cover") -> DataFrame:
    """(k, r, x): for strings (k, r, s), s a non-empty array of longs from 1 up, the rank of the suffix at each position."""
    longest = strings.agg(F.max(F.size("s"))).first()[0] or 0
    symbols = [(f"c{i}", lambda j, i=i: _at("s", j + i, 0)) for i in range(3)]
    key = ["c0", "c1", "c2"]
    triples = _positions(strings, *symbols)
    if longest <= 3:  # a triple is the whole suffix
        named = merged(triples, _below(scratch, triples, key, {"rank": F.lit(True)}, f"{name}-whole"), key)
        return _gathered(named, "rank", "k", "r")

    sampled = triples.where("j % 3 <> 0")
    names = _below(scratch, sampled, key, {"rank": F.lit(True)}, f"{name}-triples")
    named = scratch.save(merged(sampled, names.select(*key, (F.col("rank") + 1).alias("name")), key).select("k", "r", "j", "name"), f"{name}-names")
    by = ["k", (F.col("r") * 2 + F.col("j") % 3 - 1).alias("r")]
    if names.agg(F.max("n_rank")).first()[0] == 1:
        sub = _gathered(named.withColumn("name", F.col("name") - 1), "name", *by)
    else:
        shorter = scratch.save(_gathered(named, "name", *by).withColumnRenamed("x", "s"), f"{name}-shorter")
        sub = ranks(scratch, shorter, f"{name}-")
    residues = sub.groupBy("k", F.shiftright("r", 1).alias("r")).agg(*[F.first(F.when(F.col("r") % 2 == i, F.col("x")), ignorenulls=True).alias(n) for i, n in enumerate(("one", "two"))])

    def behind(j: Column) -> Column:
        third = F.floor(j / 3)
        return F.when(j % 3 == 1, _at("one", third, -1)).when(j % 3 == 2, _at("two", third, -1))

    whole = merged(strings, residues, ["k", "r"], "left")
    fields = [*symbols[:2], ("own", behind), ("r1", lambda j: behind(j + 1)), ("r2", lambda j: behind(j + 2))]
    rows = scratch.save(_positions(whole, *fields), f"{name}-rows")
    zero, one, two = (rows.where(F.col("j") % 3 == i) for i in range(3))
    is_zero = F.col("j") % 3 == 0
    first = _below(scratch, rows.where("j % 3 <> 2"), ["c0", "r1"], {"z": is_zero, "o": ~is_zero}, f"{name}-first").select("c0", "r1", "z", "o")
    second = _below(scratch, rows.where("j % 3 <> 1"), ["c0", "c1", "r2"], {"z": is_zero, "w": ~is_zero}, f"{name}-second").select("c0", "c1", "r2", F.col("z").alias("z2"), "w")
    zero = merged(merged(zero, first, ["c0", "r1"]), second, ["c0", "c1", "r2"]).select("k", "r", "j", (F.col("z") + F.col("o") + F.col("w")).alias("rank"))
    one = merged(one, first, ["c0", "r1"]).select("k", "r", "j", (F.col("own") + F.col("z")).alias("rank"))
    two = merged(two, second, ["c0", "c1", "r2"]).select("k", "r", "j", (F.col("own") + F.col("z2")).alias("rank"))
    return _gathered(zero.union(one).union(two), "rank", "k", "r")


def first_owners(scratch: Scratch, texts: DataFrame, length: int) -> DataFrame:
    """(k, low): for distinct texts (k, text binary, owner), the smallest owner of each full window of `length` bytes.

    Suffixes are put in order by rank, and the first `length` bytes of adjacent ones are compared.
    """
    symbols = F.expr("transform(sequence(1, octet_length(text)), i -> cast(conv(hex(substring(text, i, 1)), 16, 10) as long) + 1)")
    order = scratch.save(ranks(scratch, texts.select("k", F.lit(1).cast("long").alias("r"), symbols.alias("s"))), "order")
    windows = merged(order, texts, "k").select("k", "text", "owner", F.posexplode("x").alias("j", "rank")).where(F.col("j") + length <= F.octet_length("text"))
    each = windows.groupBy("rank").agg(F.min("owner").alias("owner"), F.first(F.expr(f"substring(text, j + 1, {length})")).alias("prefix"))
    each = scratch.save(each.repartitionByRange("rank").withColumn("part", F.spark_partition_id()), "each")
    inner = Window.partitionBy("part").orderBy("rank")
    before = F.lag("prefix").over(inner)
    each = each.withColumn("starts", F.when(before.isNull() | (before != F.col("prefix")), F.col("rank")))
    each = each.withColumn("run", F.last("starts", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    # a run that began in an earlier range: one row for each range is compared with the one before
    edge = each.groupBy("part").agg(F.min("rank").alias("least"), F.min_by("prefix", "rank").alias("head"), F.max_by("prefix", "rank").alias("tail"), F.max("run").alias("last"))
    ranges = Window.orderBy("part")
    edge = edge.withColumn("joined", F.coalesce(F.lag("tail").over(ranges) == F.col("head"), F.lit(False)))
    edge = edge.withColumn("open", F.last(F.when(~F.col("joined") | (F.col("last") != F.col("least")), F.col("last")), ignorenulls=True).over(ranges))
    edge = edge.withColumn("since", F.when(F.col("joined"), F.lag("open").over(ranges))).select("part", "least", "since")
    run = F.when(F.col("run") == F.col("least"), F.coalesce("since", "run")).otherwise(F.col("run"))
    each = each.join(F.broadcast(edge), "part").select("rank", "owner", run.alias("run"))
    low = each.groupBy("run").agg(F.min("owner").alias("low"))
    found = merged(windows.select("k", "j", "rank"), merged(each.select("rank", "run"), low, "run"), "rank")
    return _gathered(found, "low", "k").withColumnRenamed("x", "low")
