"""Exact top-k inner products by aggregation of sorted lists without random access.

Candidates are dealt into stretches, and each stretch is stored once as one list per
dimension, sorted by component. For a query the lists are read in their order, from the
end where a component adds most, all to the same depth. What has been read of a candidate,
with the least and the most that its unread lists can add, bounds its score from both
sides. Candidates whose upper bound is below the k-th best lower bound, here or in an
earlier stretch, are out; reading stops when the rest are few, and only their components
are looked up, which resolves their scores.

Queries come to the stored lists in blocks of bounded size, by broadcast; no list is
exchanged. At a depth, a list is read once for many queries, whose bounds are products of
matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a stretch; bytes of a block of queries, each of which is one pass over the lists.
STRETCH, BLOCK = 4096, 16_000_000
#: Bounds are drawn at these depths of the lists; with this many times k candidates left the rest is resolved.
DEPTHS, FEW = (1 / 16, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8), 4
#: Bounds (of a query and a candidate) that are held at once.
AT_ONCE = 1 << 21


class Lists:
    """One sorted list per dimension: values[d] rise, places[d] are their candidates; rows are for resolving."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, places: np.ndarray, rows: np.ndarray):
        self.ids, self.values, self.places, self.rows = ids, values, places, rows

    def best(self, q: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of all that can be among the k best with a score of at least floor."""
        return next(self.bests(q[None], np.array([own]), k, np.array([floor], float)))

    def bests(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for each row of q, in stretches of queries that bound the memory."""
        step = max(1, AT_ONCE // self.ids.size)
        for lo in range(0, len(q), step):
            part, alive = q[lo : lo + step], self._alive(q[lo : lo + step], own[lo : lo + step], k, floor[lo : lo + step])
            for x, left in zip(part, alive):
                at = np.flatnonzero(left)
                yield self.rows[at] @ x, self.ids[at]

    def _read(self, part: slice, rest: np.ndarray) -> np.ndarray:
        """A component of every candidate in each dimension: what this part of the lists says, and rest for those unread."""
        out = np.repeat(rest[:, None], self.ids.size, axis=1)
        np.put_along_axis(out, self.places[:, part], self.values[:, part], axis=1)
        return out

    def _alive(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
        """For each query the candidates whose upper bound reaches its floor or its k-th best lower bound.

        At one depth a list says the same to all queries of one sign, so it is read once for
        them, and their bounds are products of matrices. Whole numbers below 2**52 stay exact.
        """
        m, floor = self.ids.size, floor.copy()
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        alive, busy, before = self.ids != own[:, None], np.arange(len(q)), 0
        for depth in DEPTHS:
            hi = int(m * depth)
            if hi == before:
                continue
            before, high, low = hi, slice(m - hi, m), slice(0, hi)
            left = alive[busy]
            if m >= k:
                sure = up[busy] @ self._read(high, self.values[:, 0]) + down[busy] @ self._read(low, self.values[:, -1])
                sure[~left] = -math.inf
                floor[busy] = np.maximum(floor[busy], np.partition(sure, m - k, axis=1)[:, m - k])
            most = up[busy] @ self._read(high, self.values[:, m - hi]) + down[busy] @ self._read(low, self.values[:, hi - 1])
            left &= most >= floor[busy, None]
            alive[busy] = left
            busy = busy[left.sum(axis=1) > FEW * k]
            if not busy.size:
                break
        return alive


def _vectors(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)


def _scaled(batches):
    for batch in batches:
        vecs, size = [], []
        for x in batch.column("embedding"):
            v = None
            if x.is_valid and x.values is not None and x.values.null_count == 0 and len(x.values):
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                v = np.floor(v * 1024).astype("<f8").tobytes() if np.isfinite(v).all() else None
            vecs.append(v)
            size.append(len(v) // 8 if v else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vecs, pa.binary()), pa.array(size, pa.int32())], ["vec_id", "vec", "dim"])


_LISTS = "dim int, ids binary, vecs binary, vals binary, places binary"


def _sorted_lists(t: pa.Table) -> pa.Table:
    """A stretch: its ids in order, its rows, and its lists."""
    ids = t["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x = _vectors(t["vec"].to_pylist())[order]
    places = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
    out = [ids[order], x, np.take_along_axis(x.T, places, 1), places]
    return pa.table([pa.array([x.shape[1]], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in out]], names=[c.split()[0] for c in _LISTS.split(", ")])


def _whole(q: np.ndarray, at: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids where products are beyond doubles: whole numbers of Python, cut to 64 bits."""
    w = [int(v) for v in q]
    return np.array([max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(w, r)))) for r in rows[at]], object), ids[at]


def _search(k: int, sent):
    def search(batches):
        blocks = {dim: (own, x, [(np.empty(0), np.empty(0, np.int64))] * len(own)) for dim, (own, x) in sent.value.items()}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in blocks:
                    continue
                own, q, best = blocks[dim]
                ids = np.frombuffer(row["ids"], np.int64)
                values, rows = np.frombuffer(row["vals"], "<f8").reshape(dim, -1), np.frombuffer(row["vecs"], "<f8").reshape(-1, dim)
                lists = Lists(ids, values, np.frombuffer(row["places"], np.int32).reshape(dim, -1), rows)
                exact = np.abs(q).max() * np.abs(values).max() * dim < 2**52
                if exact:
                    found = lists.bests(q, own, k, np.array([have[k - 1] if have.size >= k else -math.inf for have, _ in best], float))
                else:
                    found = (_whole(q[i], ids != own[i], ids, rows) for i in range(len(q)))
                for i, (score, cand) in enumerate(found):
                    have, who = best[i]
                    score, cand = np.concatenate((have, score)), np.concatenate((who, cand))
                    top = np.array(sorted(range(len(cand)), key=lambda j: (-score[j], cand[j])), int) if score.dtype == object else np.lexsort((cand, -score))
                    best[i] = (score[top[:k]], cand[top[:k]])
        for dim, (own, _, best) in blocks.items():
            n = [len(who) for _, who in best]
            columns = (np.repeat(own, n).tolist(), np.repeat(np.arange(len(own)), n).tolist(), [dim] * sum(n), [x for _, who in best for x in who.tolist()], [int(x) for score, _ in best for x in score])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "nth", "dim", "vec_id", "score"])

    return search


def _blocks(asked: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Queries in blocks of bounded size: ids and vectors by dimension."""
    held: dict[int, tuple[list, list]] = {}
    size = 0
    for r in asked.toLocalIterator(prefetchPartitions=True):
        ids, vecs = held.setdefault(r["dim"], ([], []))
        ids.append(r["vec_id"])
        vecs.append(bytes(r["vec"]))
        size += len(vecs[-1])
        if size >= BLOCK:
            yield {dim: (np.array(i, np.int64), _vectors(v)) for dim, (i, v) in held.items()}
            held, size = {}, 0
    if held:
        yield {dim: (np.array(i, np.int64), _vectors(v)) for dim, (i, v) in held.items()}


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(1024 x) for each query.

    queries has the columns of vectors and defaults to the rows whose id divides by 100.
    A query's own id is no candidate; ties go to smaller ids; fewer than k candidates give
    fewer rows. Vectors that are null, empty or hold null or non-finite components, and rows
    with a null id, take no part; vectors of other lengths are no candidates; repeated rows
    count one by one as candidates. A repeated query is asked once; different vectors under
    one id are different queries, each with ranks of its own. An empty table gives no rows;
    other columns are ignored. Scores beyond 64 bits are cut to them.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")

    def scaled(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
        return df.mapInArrow(_scaled, "vec_id long, vec binary, dim int").where("vec_id IS NOT NULL AND vec IS NOT NULL")

    rows = scratch.save(scaled(vectors), "vectors")
    asked = rows.where("vec_id % 100 = 0") if queries is None else scaled(queries)
    asked = scratch.save(asked.dropDuplicates(["vec_id", "vec"]), "queries")
    groups = max(1, math.ceil(rows.count() / STRETCH))
    lists = rows.withColumn("g", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(groups)).cast("int")).groupBy("g", "dim").applyInArrow(_sorted_lists, _LISTS)
    lists = scratch.save(lists, "lists")
    found = []
    for n, block in enumerate(_blocks(asked)):
        sent = spark.sparkContext.broadcast(block)  # BLOCK bytes and a vector
        found.append(scratch.save(lists.mapInArrow(_search(k, sent), "query_id long, nth long, dim long, vec_id long, score long").withColumn("block", F.lit(n)), f"found-{n}"))
        sent.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("query_id", "block", "dim", "nth").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
