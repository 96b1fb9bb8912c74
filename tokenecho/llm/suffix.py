"""Removal of repeated byte strings with difference-cover suffix arrays.

Equal 50-byte strings have the same minimizer (the smallest hash of their 24-byte
substrings), so consecutive windows of a text with one minimizer, cut out as a piece,
are dealt by it: all occurrences of a string meet in one slice. Pieces whose minimizer
no other document has cannot repeat and are not sent; equal pieces are sent once for
each block. A slice builds the suffix array of its distinct pieces by the
difference-cover algorithm (sort the triples that start at positions 1 and 2 modulo 3,
recurse on their names where these are not unique, sort the other suffixes by their
first byte and the rank behind it, merge) and compares the prefixes of adjacent
suffixes. Suffixes that agree for 50 bytes form a group, whose first document goes back
to the blocks. Only where all pieces of a minimizer are one text is there nothing to sort.
Minimizers whose pieces are too many for one task are taken out, and the same algorithm
runs for them over tables (see cover), where no task holds a minimizer's pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import BYTE, U64, Scratch, mix, powers
from .cover import first_owners as owners_by_tables
from .cover import merged

GRAM = 24
#: Bytes of pieces in one suffix array, as long as one minimizer's pieces have no more.
PART = 400_000
#: Bytes of pieces of one minimizer that meet in one task, at most.
HOT = 8_000_000


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (integers from 1 up) in order; difference cover {1, 2} mod 3."""
    n = s.size
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate((s.astype(np.int64), [0, 0, 0]))
    # an odd one out at the end keeps the last triples of both residues apart
    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    base = int(t.max()) + 1
    if base < 2_000_000:
        key = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
        order = np.argsort(key, kind="stable")
        new = key[order][1:] != key[order][:-1]
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        o = sample[order]
        new = (t[o[1:]] != t[o[:-1]]) | (t[o[1:] + 1] != t[o[:-1] + 1]) | (t[o[1:] + 2] != t[o[:-1] + 2])
    name = np.empty(sample.size, np.int64)
    name[order] = np.concatenate(([1], 1 + np.cumsum(new)))
    if not new.all():
        order = suffix_array(name)
        name[order] = np.arange(1, sample.size + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    a = sample[order]  # sampled suffixes in order
    a = a[a < n]
    # the others: first element, then the rank of the sampled suffix behind it
    b = np.arange(0, n, 3)
    b = b[np.lexsort((rank[b + 1], t[b]))]
    # merge: an element of b comes after those of a that are smaller, by residue
    wide = np.int64(rank.max() + 2)
    one, two = a[a % 3 == 1], a[a % 3 == 2]
    below = np.searchsorted(t[one] * wide + rank[one + 1], t[b] * wide + rank[b + 1])
    if base * base < 2**62 // int(wide):
        below += np.searchsorted((t[two] * base + t[two + 1]) * wide + rank[two + 2], (t[b] * base + t[b + 1]) * wide + rank[b + 2])
    else:
        head = np.unique(np.concatenate((t[two] * base + t[two + 1], t[b] * base + t[b + 1])), return_inverse=True)[1]
        below += np.searchsorted(head[: two.size] * wide + rank[two + 2], head[two.size :] * wide + rank[b + 2])
    out = np.empty(n, np.int64)
    at = below + np.arange(b.size)
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = b, a
    return out


def first_owners(pieces: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, owner): runs of full windows with one smallest owner, in the order of the pieces."""
    s = np.concatenate([x for p in pieces for x in (np.frombuffer(p, np.uint8).astype(np.int64) + 2, np.ones(1, np.int64))])
    size = np.array([len(p) for p in pieces], np.int64)
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    of = np.repeat(np.arange(size.size), size + 1)
    left = np.repeat(start + size, size + 1) - np.arange(s.size)
    sa = suffix_array(s)
    sa = sa[left[sa] >= length]  # other suffixes are no full window
    same = np.ones(max(0, sa.size - 1), bool)
    i = np.arange(same.size)
    for j in range(length):  # adjacent prefixes
        i = i[s[sa[i + 1] + j] == s[sa[i] + j]]
    same[:] = False
    same[i] = True
    low = np.zeros(s.size, np.int64)
    if sa.size:
        at = np.flatnonzero(np.concatenate(([True], ~same)))
        low[sa] = np.repeat(np.minimum.reduceat(owner[of[sa]], at), np.diff(np.concatenate((at, [sa.size]))))
    i = np.flatnonzero(left >= length)
    piece, low = of[i], low[i]
    new = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (low[1:] != low[:-1])))) if i.size else i
    return piece[new], i[new] - start[piece[new]], low[new]


def stretch_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of buf[start:end]; starts rise. Prefix sums of byte codes go in slices, which bounds memory."""
    out, k = np.empty(start.size, np.uint64), 0
    while k < start.size:
        m = max(k + 1, int(np.searchsorted(start, start[k] + step)))
        lo, hi = start[k], end[k:m].max()
        up, down = powers(int(hi - lo))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[buf[lo:hi]] * up[: hi - lo])))
        s, e = start[k:m] - lo, end[k:m] - lo
        out[k:m] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        k = m
    return out


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, one after the other."""
    to = np.cumsum(size)
    return buf[np.repeat(start - to + size, size) + np.arange(to[-1] if to.size else 0)]


class Pieces:
    """The pieces of a block: windows [start, last] with one minimizer, in one document."""

    def __init__(self, block: B.Block, length: int):
        self.block, self.length = block, length
        buf, n = block.buf, block.buf.size
        value, start = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        last, doc = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = 1 << 19  # windows of a stretch; a run across its border only becomes two pieces
        for lo in range(0, max(0, n - length + 1), step):
            part = buf[lo : min(n, lo + step + length - 1)]
            h = BYTE[part]
            for k, f in ((1, 0xD6E8FEB86659FD93), (2, 0xC2B2AE3D27D4EB4F), (4, 0xA24BAED4963EE407)):
                h = h[:-k] * U64(f) + h[k:]
            h = mix((h[:-16] * U64(0x9FB21C651E98DF25) + h[8:-8]) * U64(0x9FB21C651E98DF25) + h[16:])  # 8, 16, 24 bytes
            w = length - GRAM + 1
            k = 1
            while 2 * k <= w:
                h = np.minimum(h[:-k], h[k:])
                k *= 2
            h = np.minimum(h[: h.size - (w - k)], h[w - k :])  # one for each window
            i = np.arange(lo, lo + h.size)
            d = np.searchsorted(block.start, i, "right") - 1
            full = i + length <= block.end[d]
            change = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | ~full[:-1]))
            at = np.flatnonzero(change & full)
            ends = np.flatnonzero(np.concatenate((change[1:] | ~full[1:], [True])) & full)
            value.append(mix(h[at]))  # minimizers are small numbers; slices want them spread
            start.append(i[at])
            last.append(i[ends])
            doc.append(d[at])
        self.value, self.start, self.last, self.doc = map(np.concatenate, (value, start, last, doc))

    def pick(self, shared: np.ndarray, slices: int) -> None:
        """Keep those whose minimizer is shared; `same` numbers them by minimizer and text, `one` is the first of each number."""
        keep = np.flatnonzero(B.member(B.short(self.value, slices), shared))
        self.value, self.start, self.last, self.doc = (x[keep] for x in (self.value, self.start, self.last, self.doc))
        text = stretch_hashes(self.block.buf, self.start, self.last + self.length)
        order = np.lexsort((self.start, text, self.value))
        v, t = self.value[order], text[order]
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (t[1:] != t[:-1]))) if v.size else np.empty(0, bool)
        at = np.flatnonzero(new)
        self.same = np.empty(v.size, np.int64)
        self.same[order] = np.cumsum(new) - 1
        self.one, self.end = order[at], order[np.append(at[1:], v.size) - 1] if v.size else at


def _heavy_owners(scratch: Scratch, pieces: DataFrame, length: int) -> DataFrame:
    """(b, piece, count, offset, low) for pieces (b, piece, text, doc, last) with a smaller owner than their last document."""
    texts = scratch.save(pieces.groupBy("text").agg(F.min("doc").alias("owner")).withColumn("k", F.monotonically_increasing_id()), "texts")
    low = merged(texts.select("k", "text"), owners_by_tables(scratch, texts, length), "k").select("text", "low")
    low = merged(pieces, low, "text").where(F.array_min("low") < F.col("last")).select("b", "piece", "low")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("piece")
        size = np.diff(t["low"].combine_chunks().offsets.to_numpy())
        low = t["low"].combine_chunks().flatten().to_numpy()
        first = np.cumsum(size) - size
        new = np.concatenate(([True], low[1:] != low[:-1]))
        new[first] = True
        at = np.flatnonzero(new)
        of = np.searchsorted(first, at, "right") - 1
        row = [t["piece"].to_numpy(), np.bincount(of), at - first[of], low[at]]
        return pa.table([t["b"][:1].cast(pa.int32()), *[pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in row]], names=["b", "piece", "count", "offset", "low"])

    return scratch.save(low.groupBy("b").applyInArrow(pack, "b int, piece binary, count binary, offset binary, low binary"), "heavy-owners")


_SENT = "p int, b int, first long, value binary, size binary, text binary, doc binary, more binary"


def remove_repeated_strings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) for every row.

    A byte goes if a string of `length` bytes over it also starts in a document with a
    smaller id, within that document; overlaps count and all is judged on the input. A
    null text is empty, texts shorter than `length` stay. Rows with a null id stand after
    all others, rows with the same id are no smaller than one another, an empty table gives
    no rows, other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    table, slices = B.deal(scratch, docs, id_col, text_col)

    def minimizers(t: pa.Table) -> pa.Table:
        p = Pieces(B.Block(t, b""), length)
        return B.send_keys(p.block.b, p.value, p.block.ids[p.doc], slices, p.last + length - p.start)

    shared = scratch.save(B.shared_keys(table.groupBy("b").applyInArrow(minimizers, B.SENT), HOT), "shared")

    def send(t: pa.Table, answer: pa.Table) -> pa.Table:
        p = Pieces(B.Block(t, b""), length)
        p.pick(B.answered_short(answer), slices)
        number = np.flatnonzero(~B.member(B.short(p.value[p.one], slices), B.answered_short(answer, hot=True)))
        one, end = p.one[number], p.end[number]
        value, start, size = p.value[one], p.start[one], p.last[one] + length - p.start[one]
        doc, more = p.block.ids[p.doc[one]], p.block.ids[p.doc[end]]  # ids rise within the block
        slot = B.slice_of(value, slices)
        cut, rows = np.append(B.runs(slot * (p.one.size + 1) + number - np.arange(number.size)), number.size), []  # numbers in a row
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            text = gather(p.block.buf, start[a:z], size[a:z])
            rows.append((int(slot[a]), p.block.b, int(number[a]), value[a:z].tobytes(), size[a:z].astype(np.uint32).tobytes(), text.tobytes(), doc[a:z].tobytes(), (more[a:z] - doc[a:z]).tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=["p", "b", "first", "value", "size", "text", "doc", "more"])

    def send_heavy(t: pa.Table, answer: pa.Table) -> pa.Table:
        p = Pieces(B.Block(t, b""), length)
        p.pick(B.answered_short(answer), slices)
        number = np.flatnonzero(B.member(B.short(p.value[p.one], slices), B.answered_short(answer, hot=True)))
        one, end = p.one[number], p.end[number]
        text = [p.block.data[a:z] for a, z in zip(p.start[one].tolist(), (p.last[one] + length).tolist())]
        ids = p.block.ids[p.doc[one]], p.block.ids[p.doc[end]]
        return pa.table([pa.array(np.full(one.size, p.block.b), pa.int32()), pa.array(number), pa.array(text, pa.binary()), pa.array(ids[0]), pa.array(ids[1])], names=["b", "piece", "text", "doc", "last"])

    def arrays(t: pa.Table) -> pa.Table:
        value, size = B.answered(t, "value"), B.answered(t, "size", np.uint32).astype(np.int64)
        doc = B.answered(t, "doc", np.int64)
        last = doc + B.answered(t, "more", np.int64)
        buf = B.answered(t, "text", np.uint8)
        end = np.cumsum(size)
        text = stretch_hashes(buf, end - size, end)
        many = np.array([len(x.as_buffer()) // 8 for x in t["value"]], np.int64)
        b = np.repeat(t["b"].to_numpy(), many)
        piece = np.arange(value.size) - np.repeat(np.cumsum(many) - many - t["first"].to_numpy(), many)  # its number in its block

        order = np.lexsort((text, value))
        v, h = value[order], text[order]
        new_value = np.concatenate(([True], v[1:] != v[:-1]))
        new_text = new_value | np.concatenate(([True], h[1:] != h[:-1]))
        at = np.flatnonzero(new_text)
        of = np.cumsum(new_text) - 1  # the distinct text of each piece in order
        owner, group = np.minimum.reduceat(doc[order], at), np.cumsum(new_value)[at] - 1
        sole = np.bincount(group)[group] == 1
        # where all pieces of a minimizer are one text, its suffixes need no sorting: one owner holds throughout
        runs = [(np.flatnonzero(sole), np.zeros(int(sole.sum()), np.int64), owner[sole])]
        several = np.flatnonzero(~sole)
        bytes_of = size[order[at]]
        to = np.cumsum(bytes_of[several])
        whole = np.searchsorted(group[several], group[several], "right") - 1  # the last text with the same minimizer
        lo = 0
        while lo < several.size:  # whole minimizers, as many as fit
            hi = int(whole[min(several.size - 1, np.searchsorted(to, (to[lo - 1] if lo else 0) + PART))]) + 1
            some = several[lo:hi]
            first = end[order[at[some]]] - bytes_of[some]
            k, offset, low = first_owners([buf[x : x + n].tobytes() for x, n in zip(first.tolist(), bytes_of[some].tolist())], owner[some], length)
            runs.append((some[k], offset, low))
            lo = hi
        k, offset, low = map(np.concatenate, zip(*runs))
        by_text = np.argsort(k, kind="stable")
        k, offset, low = k[by_text], offset[by_text], low[by_text]
        begin = np.searchsorted(k, np.arange(at.size + 1))
        # answers for the pieces that have a smaller owner than their last document, by block
        hit = np.flatnonzero(np.minimum.reduceat(low, begin[:-1])[of] < last[order])
        hit = hit[np.lexsort((piece[order[hit]], b[order[hit]]))]
        count = (begin[1:] - begin[:-1])[of[hit]]
        which = np.repeat(begin[:-1][of[hit]] - np.cumsum(count) + count, count) + np.arange(count.sum())
        own, cut = b[order[hit]], B.runs(b[order[hit]])
        z = np.append(np.cumsum(count), 0)
        out = []
        for a, e in zip(cut.tolist(), [*cut[1:].tolist(), hit.size]):
            i = which[z[a - 1] : z[e - 1]]
            out.append((int(own[a]), piece[order[hit[a:e]]].tobytes(), count[a:e].tobytes(), offset[i].tobytes(), low[i].tobytes()))
        return pa.table([pa.array(x, c) for x, c in zip(zip(*out) if out else [[]] * 5, [pa.int32()] + [pa.binary()] * 4)], names=["b", "piece", "count", "offset", "low"])

    found = ["piece", "count", "offset", "low"]
    sent = table.groupBy("b").cogroup(shared.groupBy("b")).applyInArrow(send, _SENT)
    owners = scratch.save(sent.groupBy("p").applyInArrow(arrays, "b int, " + ", ".join(f"{x} binary" for x in found)), "owners")
    heavy = shared.where("hot IS NOT NULL").select("b").distinct()
    if not heavy.isEmpty():
        pieces = table.join(heavy, "b", "left_semi").groupBy("b").cogroup(shared.join(heavy, "b", "left_semi").groupBy("b")).applyInArrow(send_heavy, "b int, piece long, text binary, doc long, last long")
        owners = owners.unionByName(_heavy_owners(scratch, scratch.save(pieces, "heavy"), length))
    both = shared.drop("hot").join(owners.select("b").distinct(), "b", "left_semi")
    none = {x: F.lit(None).cast("binary") for x in found}
    answers = owners.withColumns({"p": F.lit(None).cast("int"), "keys": F.lit(None).cast("binary")}).unionByName(both.withColumns(none))

    def remove(t: pa.Table, answer: pa.Table) -> pa.Table:
        block = B.Block(t, b"")
        size = block.end - block.start
        change = np.zeros(block.buf.size + 1, np.int32)
        if answer.num_rows:
            p = Pieces(block, length)
            p.pick(B.answered_short(answer.filter(answer["keys"].is_valid())), slices)
            answer = answer.filter(answer["piece"].is_valid())
            piece, count, offset, low = (B.answered(answer, x, np.int64) for x in found)
            first = np.full(p.one.size, -1, np.int64)
            first[piece] = np.arange(piece.size)
            at = np.cumsum(count) - count
            rows = np.flatnonzero(first[p.same] >= 0)  # pieces of the block with an answer
            k = first[p.same[rows]]
            which = np.repeat(at[k] - np.cumsum(count[k]) + count[k], count[k]) + np.arange(count[k].sum())
            rows = np.repeat(rows, count[k])
            # a run of windows ends where the next begins, the last one with its piece
            follow = np.append(offset[1:], 0)
            follow[at + count - 1] = -1
            ends = np.where(follow[which] >= 0, p.start[rows] + follow[which] - 1, p.last[rows])
            hit = low[which] < block.ids[p.doc[rows]]
            np.add.at(change, (p.start[rows] + offset[which])[hit], 1)
            np.add.at(change, (ends + length)[hit], -1)
        gone = np.cumsum(change[:-1]) > 0
        removed, spans, kept = [], [], []
        for a, z in zip(block.start.tolist(), block.end.tolist()):
            g = gone[a:z]
            n = int(g.sum())
            removed.append(n)
            spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0)
            kept.append(block.buf[a:z][~g].tobytes() if n else block.data[a:z])
        return pa.table([block.id_column(), pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return table.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
