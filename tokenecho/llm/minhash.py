"""Near-duplicate documents: banded MinHash with sequential Bayesian verification.

Documents with equal shingle sets are one class; signatures of classes are cut into
bands, and classes that share a band are candidates. Their signatures are compared batch
by batch, and a pair is pruned once the posterior probability that its similarity reaches
the threshold (uniform prior) falls below the chosen miss probability: first two bits of
every value, inside the buckets, then whole values. Survivors are verified on full sets.

No pair leaves the task that compares it. A bucket gives a spanning forest of the pairs
that pass the first batches; the trees that these forests form hold every link. Signatures
and texts of a tree are dealt to tasks in square stretches of bounded size, which compare
all its pairs, the most similar first, and verify those that earlier links do not join
already; they give a spanning forest of links, from which the components follow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Scratch, components, mix, run_hash, words_of
from .groups import by_group, reached, stretches, whole_groups

#: 36 bands of 6 values: a pair at similarity 0.8 shares none with probability 2e-5.
BANDS, ROWS = 36, 6
HASHES = BANDS * ROWS
#: Values of a batch: whole values, and two-bit values in the words that hold them.
BATCH, WORDS = 24, -(-HASHES // 64)
#: Members of a bucket, and members and bytes of sets of a tree, that are compared at once.
BUCKET, TREE, TREE_BYTES = 4096, 1024, 32_000_000
#: Groups of up to so many members are compared together.
SMALL = 32
_rng = np.random.default_rng(4099)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[bytes], n: int = 2, part: int = 1 << 20):
    """A sorted array of distinct 64-bit shingle hashes for each text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < part):
            size += len(texts[to]) + 1
            to += 1
        own = texts[at:to]
        buf = LOWER[np.frombuffer(b" ".join(own), np.uint8)]
        starts, _, words = words_of(buf)
        border = np.cumsum([0] + [len(t) + 1 for t in own])
        first = np.searchsorted(starts, border)
        for i in range(len(own)):
            w = words[first[i] : first[i + 1]]
            if w.size >= n:
                yield np.unique(run_hash(w, n))
            elif w.size:
                yield run_hash(w, w.size, 0xA24BAED4963EE407)  # the whole sequence, apart from longer shingles
            else:
                yield w
        at = to


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, s.size, 512):
        low = np.minimum(low, (s[i : i + 512, None] * _A + _B).min(axis=0))
    return (mix(low) >> U64(48)).astype(np.uint16)


def least_matches(threshold: float, miss: float, sizes: list[int], chance: float = 0.0) -> dict[int, int]:
    """For n compared values the fewest matches with P(similarity >= threshold) >= miss.

    The prior is uniform; different values match with probability `chance`.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) * chance
    out = {}
    for n in sizes:
        for m in range(n + 1):
            w = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(w - w.max())
            if w[s >= threshold].sum() >= miss * w.sum():
                break
        out[n] = m
    return out


def _planes(batches):
    """The two lowest bits of signature values, packed into WORDS words for each of the bits."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        plane = np.zeros((len(sig), 2, WORDS * 64), np.uint8)
        plane[:, 0, :HASHES], plane[:, 1, :HASHES] = sig & 1, sig >> 1 & 1
        packed = np.packbits(plane.reshape(len(sig), 2 * WORDS * 64), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array([x.tobytes() for x in packed], pa.binary())], ["id", "n", "planes"])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")]


def _sketcher(shingle: int):
    def sketch(batches):
        for batch in batches:
            n, keys, sigs = [], [], []
            for s in shingle_sets(_texts(batch), shingle):
                n.append(s.size)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None)
                sigs.append(signature(s).tobytes() if s.size else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "same", "sig"])

    return sketch


def _bands(batches):
    for batch in batches:
        ids = batch.column("id").to_numpy()
        if not ids.size:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(ids.size, BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * U64(0x9E3779B97F4A7C15) + sig[:, :, 0]
        for r in range(1, ROWS):
            key = mix(key) + sig[:, :, r]
        yield pa.RecordBatch.from_arrays([pa.array(mix(key).view(np.int64).ravel()), pa.array(np.repeat(ids, BANDS))], ["bucket", "id"])


def _compatible(percent: int):
    """Pairs of rows of (n, planes) that pass the batches of two-bit values."""
    sizes = [min(HASHES, 64 * (w + 1)) for w in range(WORDS)]
    most = [n - m for n, m in least_matches(percent / 100, 1e-4, sizes, 0.25).items()]

    def compatible(n: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
        a, b = a[some], b[some]
        differ = np.zeros(a.size, np.int64)
        for w in range(WORDS):
            differ += np.bitwise_count((x[a, w] ^ x[b, w]) | (x[a, WORDS + w] ^ x[b, WORDS + w]))
            some = differ <= most[w]
            a, b, differ = a[some], b[some], differ[some]
        return a, b

    return compatible


def _candidates(percent: int):
    """A spanning forest (u, v) of the pairs in each bucket that pass."""
    compatible = _compatible(percent)

    def candidates(batches):
        for t, starts in whole_groups(batches, ["bucket", "i", "j"]):
            ids, n = t["id"].to_numpy(), t["n"].to_numpy()
            x = np.frombuffer(b"".join(t["planes"].to_pylist()), np.uint64).reshape(len(ids), -1)
            size = np.diff(np.append(starts, len(ids)))
            group = np.repeat(np.arange(size.size), size)
            label = np.arange(len(ids))
            rows = np.flatnonzero(size[group] <= SMALL)
            for lag in range(1, SMALL):
                rows = rows[rows + lag < len(ids)]
                rows = rows[group[rows + lag] == group[rows]]
                if not rows.size:
                    break
                label = reached(label, *compatible(n, x, rows, rows + lag))
            for a, m in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
                for r in range(a, a + m - 1):
                    rest = np.arange(r + 1, a + m)
                    rest = rest[label[rest] != label[r]]
                    if rest.size:
                        _join(label[a : a + m], label[r], label[compatible(n, x, np.full(rest.size, r), rest)[1]])
            u, v = ids, ids[label]
            some = u != v
            yield pa.RecordBatch.from_arrays([pa.array(u[some]), pa.array(v[some])], ["u", "v"])

    return candidates


def _join(label: np.ndarray, one: int, others: np.ndarray) -> None:
    """Makes rows with these labels have the smallest of them."""
    if others.size:
        every = np.unique(np.append(others, one))
        label[np.isin(label, every)] = every[0]


def _verified(percent: int, miss: float, shingle: int):
    """A spanning forest (u, v) of the links in each pair of stretches of a tree."""
    need = least_matches(percent / 100, miss, list(range(BATCH, HASHES + 1, BATCH)))

    def survivors(sig: np.ndarray, n: np.ndarray, across: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows, which stand by size, that pass all batches, the most similar first."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        end = np.searchsorted(n, n * 100 // percent, "right")
        for r in range(len(n)):
            rest = np.arange(r + 1, end[r])
            if across is not None:
                rest = rest[across[rest] != across[r]]
            match = np.zeros(rest.size, np.int64)
            for k in range(0, HASHES, BATCH):
                if not rest.size:
                    break
                match = match + (sig[rest, k : k + BATCH] == sig[r, k : k + BATCH]).sum(axis=1)
                some = match >= need[k + BATCH]
                rest, match = rest[some], match[some]
            if rest.size:
                out.append((np.full(rest.size, r), rest, match))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b, match = map(np.concatenate, zip(*out))
        order = np.argsort(-match, kind="stable")
        return a[order], b[order]

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        i = np.searchsorted(y, x)  # x is no larger
        both = int((y[np.minimum(i, y.size - 1)] == x).sum())
        return 100 * both >= percent * (x.size + y.size - both)

    def verify(batches):
        for t in by_group(batches, ["tree", "i", "j"]):
            texts = t.filter(t["text"].is_valid())
            t = t.filter(t["sig"].is_valid())
            order = np.lexsort((t["id"].to_numpy(), t["n"].to_numpy()))
            t = t.take(pa.array(order))
            ids, n, sub = t["id"].to_numpy(), t["n"].to_numpy(), t["sub"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(ids), HASHES)
            a, b = survivors(sig, n, None if not t.num_rows or t["i"][0].as_py() == t["j"][0].as_py() else sub)
            if not a.size:
                continue
            keys = t["same"].to_pylist()
            wanted = {keys[k] for k in np.unique(np.concatenate((a, b))).tolist()}
            sets = {key: s for s in shingle_sets(_texts(texts), shingle) for key in [hashlib.blake2b(s.tobytes(), digest_size=16).digest()] if key in wanted}
            root = list(range(len(ids)))

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            us, vs = [], []
            for k, m in zip(a.tolist(), b.tolist()):
                p, q = find(k), find(m)
                if p != q and linked(sets[keys[k]], sets[keys[m]]):
                    root[max(p, q)] = min(p, q)
                    us.append(ids[k])
                    vs.append(ids[m])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return verify


def near_duplicates(docs: DataFrame, percent: int = 80, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Words are runs of characters other than white space, A-Z lower-cased; a document's
    set holds its distinct shingles of `shingle` words, or its whole sequence if it has fewer words.
    Null, empty and blank texts have an empty set and link with nothing. Rows with a null
    id link with nothing (component null, kept true); rows that repeat an id share its
    component, whatever their texts; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.save(docs.mapInArrow(_sketcher(shingle), "doc_id long, n_shingles long, same binary, sig binary"), "sketches")
    own = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # all documents with one set are the one with the smallest id from here on; that id may stand for several sets
    sigs = own.groupBy("same").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "sig")).alias("x"))
    sigs = scratch.save(sigs.select("same", F.col("x.doc_id").alias("id"), "x.n", "x.sig"), "signatures")

    buckets = sigs.select("id", "sig").mapInArrow(_bands, "bucket long, id long")
    many = buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    many = scratch.save(many.select("bucket", F.ceil(F.col("m") / F.lit(BUCKET)).alias("m")), "shared")  # only buckets with several classes
    met = buckets.join(many, "bucket").join(sigs.select("id", "sig", "n").mapInArrow(_planes, "id long, n long, planes binary"), "id")
    met = stretches(met, F.col("m")).select("bucket", "i", "j", "id", "n", "planes")
    met = met.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    trees = scratch.save(components(scratch, met.mapInArrow(_candidates(percent), "u long, v long"), "trees"), "trees").toDF("id", "tree")
    scratch.drop("shared")

    size = sigs.join(trees, "id").groupBy("tree").agg(F.count("*").alias("members"), F.sum("n").alias("values"))
    split = F.ceil(F.greatest(F.col("members") / F.lit(TREE), F.col("values") * F.lit(8) / F.lit(TREE_BYTES)))
    trees = scratch.save(trees.join(size.select("tree", split.alias("split")), "tree"), "sized")
    # rows that repeat an id, and classes that share one: these are linked
    repeated = own.groupBy("doc_id").agg(F.min("same").alias("lo"), F.max("same").alias("hi"), F.count("*").alias("m")).where("m > 1")
    repeated = scratch.save(repeated.select("doc_id", F.expr("lo <> hi").alias("several")), "repeated")
    texts = docs.join(trees.withColumnRenamed("id", "doc_id"), "doc_id").withColumnRenamed("doc_id", "id")
    if repeated.take(1):
        texts = texts.dropDuplicates(["id", "text"])
    texts = texts.select("tree", "split", "id", "text").withColumns({"n": F.lit(None).cast("long"), "same": F.lit(None).cast("binary"), "sig": F.lit(None).cast("binary")})
    signed = sigs.join(trees, "id").withColumn("text", F.lit(None).cast("string"))
    dealt = stretches(signed.unionByName(texts), F.col("split")).select("tree", "i", "j", "sub", "id", "n", "same", "sig", "text")
    dealt = dealt.repartition(parts, "tree", "i", "j").sortWithinPartitions("tree", "i", "j")
    links = dealt.mapInArrow(_verified(percent, miss, shingle), "u long, v long")

    shared = own.join(repeated.where("several"), "doc_id").select("doc_id", "same").distinct().join(sigs.select("same", "id"), "same")
    shared = scratch.save(shared.select("doc_id", "id"), "owned")
    shared = shared.join(shared.groupBy("doc_id").agg(F.min("id").alias("v")), "doc_id").select(F.col("id").alias("u"), "v")
    comp = components(scratch, links.union(shared), "links")

    named = scratch.save(sigs.select("same", "id").join(comp, "id", "left").select("same", F.coalesce("component", "id").alias("component")), "named")
    out = rows.select("doc_id", "n_shingles", "same").join(named, "same", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
