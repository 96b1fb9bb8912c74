"""Who had it first: span owners, prefix fingerprints, block chains.

Owners are partial-aggregated minima joined back by key, not windows, so a span that
every session holds is combined where it is read, and AQE can split its join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_owners(rows: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """rows with first: the arrival of the first row that has the key."""
    first = rows.groupBy(key).agg(F.min(F.struct(*arrival)).alias("first"))
    return rows.join(first, key)


def prefix_fingerprint(rows: DataFrame, of: list[str], pos: str, item: Column) -> DataFrame:
    """rows with fp: a hash of all items of the sequence up to this one.

    Items are hashed with their position and combined by exclusive or, which is linear,
    cannot overflow and needs one sort.
    """
    w = Window.partitionBy(*of).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("fp", F.bit_xor(F.xxhash64(F.col(pos), item)).over(w))


def shared_prefix(rows: DataFrame, of: str, pos: str, registered: int | None = None) -> DataFrame:
    """(of, cut): the length of each sequence's longest leading run that an earlier sequence also opens with."""
    known = rows if registered is None else rows.where(F.col(pos) < registered)
    first = known.groupBy(pos, "fp").agg(F.min(of).alias("first"))
    hit = rows.join(first, [pos, "fp"], "left")
    return hit.groupBy(of).agg(F.sum((F.col("first") < F.col(of)).cast("int")).alias("cut")).select(of, F.coalesce("cut", F.lit(0)).cast("long").alias("cut"))
