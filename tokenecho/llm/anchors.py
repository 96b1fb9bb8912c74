"""Removal of repeated passages of words, found by difference-cover anchors.

Positions modulo 7 that are in the cover {0, 1, 3} are anchors: for any two positions
there is an offset below 7 that brings both to cover positions, so two equal windows of
13 words hold a pair of equal 7-word anchors at one offset. Only anchors are hashed and
exchanged. Where an anchor is also in another document, the match is extended to the
13-word windows that hold it, and each window's first document is looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .common import Scratch, run_hash, words_of

PERIOD, COVER = 7, (0, 1, 3)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


class Words:
    def __init__(self, block: B.Block, window: int):
        self.start, self.end, self.hash = words_of(block.buf)
        self.first = np.searchsorted(self.start, block.start)
        self.count = np.searchsorted(self.start, block.end) - self.first
        self.doc = np.repeat(np.arange(block.ids.size), self.count)
        self.pos = np.arange(self.hash.size) - self.first[self.doc]
        self.window, self.length = window, window - PERIOD + 1

    def whole(self, n: int) -> np.ndarray:
        """Starts of n words of one document."""
        m = self.hash.size - n + 1
        return self.doc[:m] == self.doc[n - 1 :] if m > 0 else np.empty(0, bool)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of anchors and their hashes."""
        at = np.flatnonzero(self.whole(self.length) & _IN_COVER[self.pos[: max(0, self.hash.size - self.length + 1)] % PERIOD])
        return at, run_hash(self.hash, self.length)[at]

    def candidates(self, shared: np.ndarray, slices: int) -> np.ndarray:
        """Starts of windows that hold a shared anchor."""
        at, keys = self.anchors()
        held = np.zeros(self.hash.size + 1, np.int32)
        held[at] = B.member(B.short(keys, slices), shared)
        total = np.concatenate(([0], np.cumsum(held)))
        i = np.flatnonzero(self.whole(self.window))
        return i[total[i + PERIOD] > total[i]]

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows at these starts."""
        return run_hash(self.hash, self.window)[at], run_hash(self.hash, self.window, 0xC2B2AE3D27D4EB4F)[at]


def _send_windows(b: int, ids: np.ndarray, k1: np.ndarray, k2: np.ndarray, slices: int) -> pa.Table:
    order = np.lexsort((ids, k2, k1))
    k1, k2, ids = k1[order], k2[order], ids[order]
    new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if k1.size else np.empty(0, bool)
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [k1.size])) - 1 if k1.size else at
    return B.sliced(b, B.slice_of(k1[at], slices), {"keys": k1[at], "doc": ids[at], "last": ids[last], "key2": k2[at]})


def _owners(table: pa.Table) -> pa.Table:
    """For each block, its windows that start in a smaller document than its last one with them."""
    parts = [len(x.as_buffer()) // 8 for x in table["keys"]]
    k1, k2 = B.answered(table), B.answered(table, "key2")
    doc, last = B.answered(table, "doc", np.int64), B.answered(table, "last", np.int64)
    order = np.lexsort((doc, k2, k1))
    a, c = k1[order], k2[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))))
    low = np.empty(k1.size, np.int64)
    low[order] = np.repeat(doc[order][at], np.diff(np.concatenate((at, [a.size]))))
    out, lo = [], 0
    for b, n in zip(table["b"].to_pylist(), parts):
        s = np.arange(lo, lo + n)[low[lo : lo + n] < last[lo : lo + n]]
        lo += n
        if s.size:
            out.append((b, k1[s].tobytes(), k2[s].tobytes(), low[s].tobytes()))
    kinds = [pa.int32()] + [pa.binary()] * 3
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["b", "keys", "key2", "doc"])


def remove_repeated_passages(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by blanks).

    A word goes if a window of words over it also starts in a document with a smaller id;
    all windows are judged on the input. A null text has no words. Rows with a null id
    stand after all others, rows with the same id are no smaller than one another, an empty
    table gives no rows, other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "anchors")
    table, slices = B.deal(scratch, docs, id_col, text_col)

    def anchors(t: pa.Table) -> pa.Table:
        block = B.Block(t, b" ")
        words = Words(block, window)
        at, keys = words.anchors()
        return B.send_keys(block.b, keys, block.ids[words.doc[at]], slices)

    shared = scratch.save(B.shared_keys(table.groupBy("b").applyInArrow(anchors, B.SENT)), "shared")

    def windows(t: pa.Table, answer: pa.Table) -> pa.Table:
        block = B.Block(t, b" ")
        words = Words(block, window)
        at = words.candidates(B.answered_short(answer), slices) if t.num_rows else np.empty(0, np.int64)
        return _send_windows(block.b, block.ids[words.doc[at]], *words.keys(at), slices)

    sent = table.groupBy("b").cogroup(shared.groupBy("b")).applyInArrow(windows, "p int, b int, keys binary, doc binary, last binary, key2 binary")
    owners = scratch.save(sent.groupBy("p").applyInArrow(_owners, "b int, keys binary, key2 binary, doc binary"), "owners")

    def cut(t: pa.Table, answer: pa.Table) -> pa.Table:
        block = B.Block(t, b" ")
        words = Words(block, window)
        gone = np.zeros(words.hash.size, bool)
        key, key2, doc = B.answered(answer), B.answered(answer, "key2"), B.answered(answer, "doc", np.int64)
        if key.size and words.hash.size >= window:
            order = np.argsort(key)
            key, key2, doc = key[order], key2[order], doc[order]
            at = np.flatnonzero(words.whole(window))
            k1, k2 = words.keys(at)
            i = np.minimum(np.searchsorted(key, k1), key.size - 1)
            marks = np.zeros(words.hash.size, np.int32)
            marks[at[(key[i] == k1) & (key2[i] == k2) & (doc[i] < block.ids[words.doc[at]])]] = 1
            gone = B.covered(marks, window)
        removed = np.add.reduceat(np.concatenate((gone, [False])).astype(np.int64), words.first) if block.ids.size else np.empty(0, np.int64)
        removed = np.where(words.count > 0, removed, 0)
        kept = []
        for i in range(block.ids.size):
            own = block.data[block.start[i] : block.end[i]].split()
            if removed[i]:
                lo = words.first[i]
                own = [own[j] for j in np.flatnonzero(~gone[lo : lo + len(own)])]
            kept.append(b" ".join(own))
        return pa.table([block.id_column(), pa.array(words.count.astype(np.int64)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return table.groupBy("b").cogroup(owners.groupBy("b")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
