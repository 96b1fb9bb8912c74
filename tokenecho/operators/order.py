"""Row numbers in a global order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kept(rows: DataFrame) -> DataFrame:
    """rows, made once for all their uses: in the checkpoint folder where there is one, else in the cache."""
    shared = rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    return rows.checkpoint() if shared else rows.persist()


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rn from 0: rows are dealt into ranges, only the ranges' counts meet in one place.

    The dealt rows are kept, so that both uses see the same ranges even if an executor is lost.
    """
    dealt = kept(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("nth", inner).join(F.broadcast(before), "part").withColumn("rn", F.col("before") + F.col("nth") - 1).drop("part", "nth", "before")
