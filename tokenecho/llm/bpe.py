"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts every text into chunks. Chunks that several documents of the
corpus hold are encoded once, at their first document, and their ids are handed to
every other occurrence. The ids on both sides of a cut come from texts that ended
there, so each join is repaired: a window between two safe breaks around the cut is
encoded again and widened until it agrees with the chunks on both of its ends.

A safe break is an ASCII letter or digit followed by a blank or line end: the
tokenizer's splitting pattern ends a piece there whatever stands around it, and no
special token holds one. What is encoded between two safe breaks is what encoding
the whole text gives.

Documents without any repeated chunk, as a bit table of bounded size tells (it errs to
one side only), are encoded where they are read; only the others are shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key

#: Bytes of a chunk: the least, the mean beyond it, the most.
LEAST, MEAN, MOST = 256, 1024, 16384
#: Bits of the table of repeated chunks: 16 or more for each, between 4 MB and 128 MB in all.
FILTER_BITS, MOST_BITS = 1 << 25, 1 << 30

_rng = np.random.default_rng(8191)
_GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x0A]] = True


def cuts(text: bytes) -> list[int]:
    """Chunk borders, 0 and the length included; they depend on the 32 bytes before them only."""
    n = len(text)
    if n <= LEAST:
        return [0, n]
    b = np.frombuffer(text, np.uint8)
    h = _GEAR[b]
    for k in (1, 2, 4, 8, 16):  # windows of 2, 4, ... 32 bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    head = (b & 0xC0) != 0x80  # never inside a character
    at = np.flatnonzero((h[:-1] >> np.uint32(22) == 0) & head[1:]) + 1
    out = [0]
    for c in at.tolist():
        while c - out[-1] > MOST:
            x = out[-1] + MOST
            while not head[x]:
                x -= 1
            out.append(x)
        if c - out[-1] >= LEAST:
            out.append(c)
    while n - out[-1] > MOST:
        x = out[-1] + MOST
        while not head[x]:
            x -= 1
        out.append(x)
    out.append(n)
    return out


def chunk_key(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


class Codec:
    """A byte-level BPE of the tokenizers library's file format.

    Merging is done by tiktoken over the same vocabulary (ids are ranks), which gives
    the ids of the tokenizers library several times as fast; texts that its pattern
    engine refuses go to the tokenizers library itself. A file of another kind is an error.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._slow = path, None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        codes = {chr(c): c for c in printable}
        codes |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printable)}
        ranks = {bytes(codes[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if i not in set(special.values())}
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for t, i in ranks.items():
            self.bytes_of[i] = t
        for t, i in special.items():
            self.bytes_of[i] = t.encode()
        self.width = np.array([len(t) for t in self.bytes_of], dtype=np.int64)
        plain = {k: v for k, v in (spec.get("pre_tokenizer") or {}).items() if k in ("type", "add_prefix_space", "use_regex")}
        known = plain in ({"type": "ByteLevel", "add_prefix_space": False}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
        if not known or spec.get("normalizer") or spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
            raise ValueError(f"{path}: not a byte-level BPE with the usual splitting pattern and no normalizer")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: bytes) -> np.ndarray:
        s = text.decode("utf-8", "replace")
        try:
            return np.array(self._fast.encode(s, allowed_special="all"), dtype=np.uint32)
        except BaseException as e:  # noqa: BLE001  the pattern engine's own limits come as panics
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self.path)
                self._slow.no_truncation()
                self._slow.no_padding()
            return np.array(self._slow.encode(s, add_special_tokens=False).ids, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()

    def join(self, text: bytes, at: list[int], parts: list[np.ndarray]) -> np.ndarray:
        """Ids of the whole text from those of its chunks."""
        if len(parts) == 1:
            return parts[0]
        b = np.frombuffer(text, np.uint8)
        safe = np.flatnonzero(_ALNUM[b[:-1]] & _BLANK[b[1:]]) + 1
        done: list[np.ndarray] = []
        lo, ids = 0, parts[0]  # ids stand for text[lo:cut] as if it ended there
        for k in range(1, len(parts)):
            cut, hi, right = at[k], at[k + 1], parts[k]
            i0, i1 = np.searchsorted(safe, lo, "right"), np.searchsorted(safe, cut, "left")
            j0, j1 = np.searchsorted(safe, cut, "right"), np.searchsorted(safe, hi, "left")
            left_ends = lo + np.cumsum(self.width[ids])
            right_ends = cut + np.cumsum(self.width[right])
            reach = 2
            while True:
                if i1 - reach < i0 or j0 + reach > j1:  # nothing safe to hold on to: the two become one chunk
                    ids = self.encode(text[lo:hi])
                    break
                a, a2 = int(safe[i1 - reach]), int(safe[i1 - reach + 1])
                z2, z = int(safe[j0 + reach - 2]), int(safe[j0 + reach - 1])
                window = self.encode(text[a:z])
                ends = a + np.cumsum(self.width[window])
                la, la2 = np.searchsorted(left_ends, [a, a2], "right")
                rz2, rz = np.searchsorted(right_ends, [z2, z], "right")
                wa2, wz2 = np.searchsorted(ends, [a2, z2], "right")
                if np.array_equal(window[:wa2], ids[la:la2]) and np.array_equal(window[wz2:], right[rz2:rz]) and left_ends[la - 1] == a and right_ends[rz - 1] == z:
                    done += [ids[:la], window]
                    lo, ids = z, right[rz:]
                    break
                reach *= 2
        return np.concatenate([*done, ids])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for x in batch.column(name):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks int, n_reused int"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], [x.split()[0] for x in _OUT.split(", ")])


def _result(c: Codec, doc_id, ids: np.ndarray, chunks: int, reused: int) -> tuple:
    back = c.decode(ids)
    return (doc_id, len(ids), _sha(ids.astype("<u4").tobytes()), _sha(back), chunks, reused)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, n_chunks, n_reused.

    path is the tokenizer's file; it has to be readable at the same place on every
    machine. A null text counts as empty (no ids); rows with a null or repeated id are
    encoded one by one like any other; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("key", row_key("doc_id", "text"))

    def occurrences(batches):
        for batch in batches:
            keys, rows = batch.column("key").to_pylist(), ([], [], [])
            for key, text in zip(keys, _texts(batch)):
                at = cuts(text)
                for i in range(len(at) - 1):
                    rows[0].append(chunk_key(text[at[i] : at[i + 1]]))
                    rows[1].append(key)
                    rows[2].append(i)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int32())], ["chunk", "key", "i"])

    found = docs.select("key", "text").where("text <> ''").mapInArrow(occurrences, "chunk binary, key binary, i int")
    found = scratch.save(found, "occurrences")
    shared = scratch.save(found.groupBy("chunk").agg(F.min(F.struct("key", "i")).alias("first"), F.max("key").alias("last")).where("first.key <> last").drop("last"), "shared")

    bits = min(MOST_BITS, max(FILTER_BITS, 1 << (16 * shared.count()).bit_length()))
    bit = F.pmod(F.conv(F.hex(F.substring("chunk", 1, 7)), 16, 10).cast("long"), F.lit(bits))
    set_bits = shared.select(bit.alias("b")).selectExpr("b div 64 AS w", "shiftleft(1L, cast(b % 64 AS int)) AS m")
    table = set_bits.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[table["w"].to_numpy()] = table["m"].to_numpy().astype(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(words)

    def may_repeat(piece_key: bytes) -> bool:
        b = int.from_bytes(piece_key[:7], "big") % bits
        return bool(int(sent.value[b >> 6]) >> (b & 63) & 1)

    def alone(batches):
        c = codec(path)
        for batch in batches:
            rows, before = [], None
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch)):
                if text == before and rows:  # a repeated row behind its like
                    rows.append((doc_id, *rows[-1][1:]))
                    continue
                at, before = cuts(text), None
                pieces = [text[x:y] for x, y in zip(at, at[1:])]
                if not any(may_repeat(chunk_key(p)) for p in pieces) or not text:
                    ids = c.join(text, at, [c.encode(p) for p in pieces])
                    rows.append(_result(c, doc_id, ids, len(pieces), 0))
                    before = text
            yield _out(rows)

    def others(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = [
                (key, doc_id, z.compress(text))
                for key, doc_id, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), _texts(batch))
                if text and any(may_repeat(chunk_key(text[x:y])) for at in [cuts(text)] for x, y in zip(at, at[1:]))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 3, (pa.binary(), pa.int64(), pa.binary()))], ["key", "doc_id", "packed"])

    marks = found.join(shared, "chunk").select("key", "i", "chunk", (F.struct("key", "i") == F.col("first")).alias("owner"))
    marks = marks.groupBy("key").agg(F.collect_set(F.struct("i", "chunk", "owner")).alias("marks"))
    rest = docs.mapInArrow(others, "key binary, doc_id long, packed binary").join(marks, "key", "left")
    rest = scratch.save(rest, "rest")

    def own(batches):
        import zstandard

        z, c = zstandard.ZstdDecompressor(), codec(path)
        for batch in batches:
            rows = ([], [])
            for packed, owned in zip(batch.column("packed").to_pylist(), batch.column("owned").to_pylist()):
                text = z.decompress(packed)
                at = cuts(text)
                for m in owned:
                    rows[0].append(m["chunk"])
                    rows[1].append(c.encode(text[at[m["i"]] : at[m["i"] + 1]]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in rows], ["chunk", "ids"])

    owners = rest.dropDuplicates(["key"]).select("packed", F.filter("marks", lambda m: m["owner"]).alias("owned")).where("size(owned) > 0")
    encoded = scratch.save(owners.mapInArrow(own, "chunk binary, ids binary"), "encoded")
    fills = rest.select("key", F.explode("marks").alias("m")).select("key", "m.*").distinct().join(encoded, "chunk").groupBy("key").agg(F.collect_list(F.struct("i", "ids", "owner")).alias("fills"))

    def assemble(batches):
        import zstandard

        z, c = zstandard.ZstdDecompressor(), codec(path)
        for batch in batches:
            rows = []
            for doc_id, packed, fill in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), batch.column("fills").to_pylist()):
                text = z.decompress(packed)
                at = cuts(text)
                have = {f["i"]: np.frombuffer(f["ids"], "<u4") for f in fill or []}
                parts = [have[k] if k in have else c.encode(text[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
                rows.append(_result(c, doc_id, c.join(text, at, parts), len(parts), sum(not f["owner"] for f in fill or [])))
            yield _out(rows)

    there = rest.select("key", "doc_id", "packed").join(fills, "key", "left").select("doc_id", "packed", "fills")
    return docs.select("doc_id", "key", "text").mapInArrow(alone, _OUT).unionByName(there.mapInArrow(assemble, _OUT))
