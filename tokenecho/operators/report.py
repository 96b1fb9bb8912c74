"""Reports: metric rows, the best of a family, differences from published values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Published percentages (prefix, reuse) by corpus.
PUBLISHED = {
    "WildChat": (26.62, 3.28), "PAWS": (27.67, 0.00), "SWE-smith": (4.21, 17.06), "OpenHands": (6.42, 2.69), "CC-Bench": (0.00, 16.43), "SWE-agent": (7.96, 19.27),
    "NNetNav-WA": (37.32, 4.50), "NNetNav-Live": (20.31, 11.82), "Mind2Web": (0.71, 0.00), "ITBench SRE": (0.18, 0.00), "ITBench K8s": (0.71, 26.73), "ITBench alerts": (0.08, 16.93),
    "BGL": (0.00, 0.00), "AppWorld": (16.93, 0.21), "tau2 airline": (12.81, 1.31), "tau2 retail": (23.28, 23.08), "tau2 telecom": (60.70, 3.73), "MT-RAG": (0.44, 13.76),
    "MultiDoc2Dial": (56.01, 39.97), "tau-Knowledge": (34.77, 4.32), "Spider 2.0": (86.5, 86.95), "BIRD": (93.7, 78.54), "LiveSQLBench": (95.9, 95.86), "BIRD-INTERACT": (97.9, 97.87),
}


def rows(result: DataFrame, corpus: str, metrics: dict[str, str]) -> DataFrame:
    """(corpus, metric, computed) from a one-row result."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("computed")) for m, c in metrics.items()])
    return result.select(F.lit(corpus).alias("corpus"), F.explode(each).alias("x")).select("corpus", "x.*")


def delta(computed: DataFrame, published: DataFrame) -> DataFrame:
    return computed.join(published, ["corpus", "metric"]).withColumn("delta", F.round(F.col("computed") - F.col("published"), 2))


def family_best(values: DataFrame, family: str, value: str) -> DataFrame:
    best = values.groupBy(family).agg(F.max(value).alias("top"))
    return values.join(best, values[family].eqNullSafe(best[family])).drop(best[family]).withColumn("best", F.col(value) == F.col("top")).drop("top")
