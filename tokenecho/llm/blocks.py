"""Exchanges of packed keys between blocks of documents and slices of the key space.

Documents are dealt into blocks of a few MB, kept as a table bucketed by block, which
later passes read without shuffling a text again. A block sends each of its distinct
keys once to the slice that owns the key, so a key that a third of all documents hold
reaches its slice once for each block at most; the slice answers the blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_DOC, U64, Scratch

#: UTF-8 bytes of a block, and of the text whose keys meet in a slice.
BLOCK, SLICE = 2_000_000, 8_000_000
#: Files of the table of blocks, at most (Spark's own limit of buckets); more blocks share files.
MOST_FILES = 100_000


def deal(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The table (b, doc_id, text) bucketed by block b, and the number of slices."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4, math.ceil(total / BLOCK))
    docs = docs.withColumn("b", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.crc32(F.col("text").cast("binary"))), F.lit(n)).cast("int"))
    return scratch.blocks(docs, min(n, MOST_FILES), "b"), max(4, math.ceil(total / SLICE))


class Block:
    """The documents of a block in one byte array; null ids stand after all others."""

    def __init__(self, table: pa.Table, separator: bytes):
        table = table.select(["b", "doc_id", "text"])
        self.b = table["b"][0].as_py() if table.num_rows else 0
        ids = table["doc_id"].fill_null(NO_DOC).to_numpy()
        texts = table["text"].cast(pa.binary()).to_pylist()
        size = np.array([len(t or b"") for t in texts], np.int64)
        data = b"".join(x for t in texts for x in (t or b"", separator))
        order = np.lexsort((size, ids))
        if not np.array_equal(order, np.arange(ids.size)):  # a fixed order, whichever way the rows came
            texts = sorted(zip(ids.tolist(), size.tolist(), [t or b"" for t in texts]))
            ids, size = np.array([x[0] for x in texts], np.int64), np.array([x[1] for x in texts], np.int64)
            data = b"".join(y for x in texts for y in (x[2], separator))
        self.ids, self.data, self.buf = ids, data, np.frombuffer(data, np.uint8)
        self.start = np.concatenate(([0], np.cumsum(size + len(separator))))[:-1].astype(np.int64)
        self.end = self.start + size

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.ids == NO_DOC)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Slices own equal ranges of the 64-bit keys."""
    return ((keys >> U64(32)) * U64(slices) >> U64(32)).astype(np.int64)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if sorted_keys.size else np.empty(0, np.int64)


SENT = "p int, b int, keys binary, many binary"
SHARED = "p int, b int, keys binary, hot binary"
_LOW = U64(0xFFFFFFFF)


def short(keys: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each key above its 32 low bits: a slice has too few keys for many to collide, and those only err to one side."""
    return slice_of(keys, slices).astype(np.uint64) << U64(32) | keys & _LOW


def sliced(b: int, p: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """A block's rows for each slice; p is sorted."""
    cut = np.concatenate((runs(p), [p.size]))
    rows = [(int(p[lo]), b, *[c[lo:hi].tobytes() for c in columns.values()]) for lo, hi in zip(cut[:-1], cut[1:])]
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * len(columns)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=["p", "b", *columns])


def send_keys(b: int, keys: np.ndarray, doc: np.ndarray, slices: int, weight: np.ndarray | None = None) -> pa.Table:
    """A block's distinct keys, each with a byte: whether several of its documents have it, and above that bit the logarithm of its weight. doc rises."""
    keys = short(keys, slices)
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], doc[order]
    at = runs(k)
    last = np.concatenate((at[1:], [k.size])) - 1 if k.size else at
    many = (d[at] != d[last]).astype(np.uint8)
    if weight is not None and k.size:
        many |= np.ceil(np.log2(np.add.reduceat(weight[order], at))).astype(np.uint8) << 1
    return sliced(b, (k[at] >> U64(32)).astype(np.int64), {"keys": (k[at] & _LOW).astype(np.uint32), "many": many})


def shared_keys(sent: DataFrame, most: int | None = None) -> DataFrame:
    """(p, b, keys, hot): for each block those of its keys that another document also has.

    hot has a byte for each key, 1 if the key weighs more than `most` over all blocks; it is null if none of the row's keys does.
    """

    def meet(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["keys"]]
        many = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["many"]])
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        at = runs(k)
        count = np.diff(np.concatenate((at, [k.size])))
        shared = (count > 1) | np.maximum.reduceat(many[order] & 1, at).astype(bool)
        mask, hot = np.empty(keys.size, bool), np.zeros(keys.size, np.uint8)
        mask[order] = np.repeat(shared, count)
        if most is not None:
            hot[order] = np.repeat(np.add.reduceat(2.0 ** (many[order] >> 1), at) > most, count)
        out, lo = [], 0
        for p, b, x in zip(table["p"].to_pylist(), table["b"].to_pylist(), parts):
            at = lo + np.flatnonzero(mask[lo : lo + x.size])
            lo += x.size
            if at.size:
                out.append((p, b, keys[at].tobytes(), hot[at].tobytes() if hot[at].any() else None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["p", "b", "keys", "hot"])

    return sent.groupBy("p").applyInArrow(meet, SHARED)


def answered(table: pa.Table, name: str = "keys", kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]]) if table.num_rows else np.empty(0, kind)


def answered_short(table: pa.Table, hot: bool = False) -> np.ndarray:
    """What shared_keys gave a block, or the hot ones of these, sorted."""
    if hot:
        table = table.filter(table["hot"].is_valid())
    parts = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) | U64(p << 32) for p, x in zip(table["p"].to_pylist(), table["keys"])]
    if hot:
        parts = [x[np.frombuffer(f.as_buffer(), np.bool_)] for x, f in zip(parts, table["hot"])]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in `of`, a sorted array."""
    if not of.size:
        return np.zeros(keys.size, bool)
    return of[np.minimum(np.searchsorted(of, keys), of.size - 1)] == keys


def covered(marks: np.ndarray, width: int) -> np.ndarray:
    """Positions within `width` of a marked start."""
    total = np.concatenate(([0], np.cumsum(marks)))
    i = np.arange(1, marks.size + 1)
    return total[i] - total[np.maximum(i - width, 0)] > 0
