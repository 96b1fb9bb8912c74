"""What the training-data operators share: scratch tables, word hashes, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import ship

U64 = np.uint64
NO_DOC = np.iinfo(np.int64).max  # stands for a null id: it sorts after every id


def row_key(id_col: str, text_col: str):
    """128 bits that stand for an id and a text; a null text counts as empty."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of our own in local mode, else an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tokenecho-")
        spark.sparkContext.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
    return d


class Scratch:
    """Tables in the shared folder that cut lineage; lost executors only cost a re-read."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def blocks(self, df: DataFrame, buckets: int, key: str) -> DataFrame:
        """A table bucketed by key: every later grouping by key reads it without a shuffle."""
        self.spark.sql("CREATE DATABASE IF NOT EXISTS tokenecho_scratch")
        name = f"tokenecho_scratch.blocks_{uuid.uuid4().hex}"
        df.repartition(buckets, key).write.option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            for t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            self.drop("")
        except Exception:  # noqa: BLE001  the session may have ended, with its folder
            pass


# ---------------------------------------------------------------- hashing

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("n", np.empty(0)).size < n:
        m = max(n, 1 << 18)
        up, down = np.full(m, BASE, dtype=np.uint64), np.full(m, BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers["n"], _powers["i"] = np.cumprod(up), np.cumprod(down)
    return _powers["n"], _powers["i"]


def words_of(buf: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of bytes other than white space.

    A word's hash is the slice of a prefix sum of byte codes times powers of BASE,
    divided by the power at its start, so that all words are hashed at once. Long
    buffers go in slices that end at white space, which bounds memory.
    """
    starts, ends, hashes, at = [], [], [], 0
    while at < buf.size:
        to = min(buf.size, at + step)
        while to < buf.size:  # a word that is longer than a slice widens it
            gap = np.flatnonzero(SPACE[buf[at:to]])
            if gap.size:
                to = at + int(gap[-1]) + 1
                break
            to = min(buf.size, to + step)
        part = buf[at:to]
        solid = np.concatenate(([False], ~SPACE[part], [False]))
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        s, e = edge[::2], edge[1::2]
        if s.size:
            up, down = powers(part.size)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[part] * up[: part.size])))
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def run_hash(h: np.ndarray, n: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of each n consecutive hashes; n-1 shorter than h."""
    m = h.size - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= U64(factor)
        out += h[j : j + m]
    return mix(out)


# ---------------------------------------------------------------- components


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component) for every id in edges(u, v): the smallest id reachable.

    Alternating large-star and small-star rounds; each is a partial-aggregated
    minimum and an equi-join that AQE can split, so no node's neighbours meet in
    one task. Rounds end when the edge set stays as it is.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, before = scratch.save(e, f"{name}-0"), None
    for k in count(1):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = scratch.save(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
