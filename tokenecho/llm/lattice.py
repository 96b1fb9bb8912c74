"""Near-duplicate vectors by E8 lattice hashing.

Unit vectors are projected at random to pairs of 8-space blocks and each block is decoded
to its nearest point of the E8 lattice; the two points are a cell. Every vector lives in
one cell of each table and also looks into neighbouring cells: those behind the minimal
vectors that lie closest to its offset from the lattice point. Vectors that meet are
compared by cosine in double precision.

Equal vectors are one class throughout. A cell gives a spanning forest of its links, not
its pairs, from which the components follow. All links lie inside components, so links are
counted there, again without any pair leaving its task. Cells and components with many
members are compared in square stretches of fixed size, dealt over many tasks.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, components, mix
from .groups import by_group, stretches

#: At cosine 0.95 a pair meets with probability over 0.99, at 0.98 nearly always.
TABLES, PROBES, SCALE = 12, 6, 0.7
#: Members of a cell or component that are compared at once.
STRETCH = 1024

MINIMAL = np.array(
    [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    + [x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates and an even sum."""
    r = np.rint(x)
    e = x - r
    k = np.abs(e).argmax(axis=1)
    i = np.flatnonzero(r.sum(axis=1) % 2)
    r[i, k[i]] += np.where(e[i, k[i]] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the even-sum whole points, and those shifted by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _hash(points: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(points), seed, np.uint64)
    for c in (points * 2).astype(np.int64).T:
        h = mix(h * U64(0x9E3779B97F4A7C15) + c.view(np.uint64))
    return h


def projections(dim: int, tables: int = TABLES, scale: float = SCALE) -> np.ndarray:
    return np.random.default_rng(dim * 1000 + 8).standard_normal((tables, 2, dim, 8)) * scale


def cells(unit: np.ndarray, planes: np.ndarray, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """The home cell in each table, (n, tables), and the cells looked into, (n, tables, probes)."""
    home, look = [], []
    for t, pair in enumerate(planes):
        points, keys, near = [], [], []
        for side in (0, 1):
            x = unit @ pair[side]
            p = decode(x)
            gain = (x - p) @ MINIMAL.T
            best = np.argpartition(-gain, probes, axis=1)[:, :probes]
            points.append(p)
            keys.append(_hash(p, 2 * t + side))
            near.append((np.take_along_axis(gain, best, 1), best))
        # the probes with the largest gain on either side
        gain = np.concatenate([near[0][0], near[1][0]], axis=1)
        pick = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        move = np.take_along_axis(np.concatenate([near[0][1], near[1][1]], axis=1), pick, 1)
        seen = []
        for j in range(probes):
            step = MINIMAL[move[:, j]]
            first = pick[:, j] < probes
            a = np.where(first, _hash(points[0] + step, 2 * t), keys[0])
            b = np.where(first, keys[1], _hash(points[1] + step, 2 * t + 1))
            seen.append(mix(a * U64(3) + b))
        home.append(mix(keys[0] * U64(3) + keys[1]))
        look.append(np.stack(seen, axis=1))
    return np.stack(home, axis=1), np.stack(look, axis=1)


def _unit(vecs: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1, in double precision; scaled by their largest component first, so that squares stay finite."""
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _linked(t: pa.Table, cosine: float, kind: str) -> np.ndarray:
    x = _unit(t["vec"].to_pylist(), kind)
    link = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    return link


def _forest(cosine: float, kind: str):
    def forest(batches):
        for t in by_group(batches, ["cell", "i", "j"]):
            link = _linked(t, cosine, kind)
            home = t["home"].to_numpy()
            link &= home[:, None] | home
            if not link.any():
                continue
            ids = t["id"].to_numpy()
            label = ids.copy()
            while True:  # the smallest id in reach
                low = np.minimum(label, np.where(link, label, np.iinfo(np.int64).max).min(axis=1))
                if (low == label).all():
                    break
                label = low
            k = label != ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(label[k])], ["u", "v"])

    return forest


def _counts(cosine: float, kind: str):
    def counts(batches):
        for t in by_group(batches, ["component", "i", "j"]):
            link, sub = _linked(t, cosine, kind), t["sub"].to_numpy()
            if t["i"][0].as_py() != t["j"][0].as_py():
                link &= sub[:, None] != sub
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), pa.array((link * t["w"].to_numpy()).sum(axis=1))], ["id", "links"])

    return counts


def _usable(kind: str):
    def usable(batches):
        for batch in batches:
            keys, vecs = [], []
            for x in batch.column("embedding"):
                v = None
                if x.is_valid and x.values is not None and x.values.null_count == 0 and len(x.values):
                    v = x.values.to_numpy(zero_copy_only=False).astype(kind)
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                keys.append(None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest())
                vecs.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "same", "vec"])

    return usable


def _memberships(kind: str):
    def memberships(batches):
        for batch in batches:
            size = np.array([len(v) for v in batch.column("vec").to_pylist()], np.int64)
            for n in np.unique(size):  # vectors of other lengths never meet
                own = batch.filter(pa.array(size == n))
                x = _unit(own.column("vec").to_pylist(), kind)
                planes, ids = projections(x.shape[1]), own.column("id").to_numpy()
                for lo in range(0, len(x), 512):
                    home, look = cells(x[lo : lo + 512], planes)
                    every = np.concatenate([home[:, :, None], look], axis=2)
                    flag = np.zeros(every.shape, bool)
                    flag[:, :, 0] = True
                    cell = mix(every.ravel() + U64(n)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.repeat(ids[lo : lo + 512], every[0].size)), pa.array(flag.ravel())], ["cell", "id", "home"])

    return memberships


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null id, link with nothing (component: their id; kept). Equal vectors link with
    one another and count one by one; rows may repeat; vectors of other lengths never link;
    an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lattice")
    # floats travel as they are, other numbers as doubles
    name, kind = ("float", "<f4") if vectors.select(vec_col).schema[0].dataType.simpleString() == "array<float>" else ("double", "<f8")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{name}>").alias("embedding"))
    rows = scratch.save(rows.mapInArrow(_usable(kind), "vec_id long, same binary, vec binary"), "rows")
    good = rows.where("same IS NOT NULL AND vec_id IS NOT NULL")
    classes = scratch.save(good.groupBy("same").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("vec").alias("vec")), "classes")

    members = scratch.save(classes.select("id", "vec").mapInArrow(_memberships(kind), "cell long, id long, home boolean"), "members")
    members = members.groupBy("cell", "id").agg(F.max("home").alias("home"))
    live = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 AND any_home").select("cell", "n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts_of = lambda: F.ceil(F.col("n") / F.lit(STRETCH))
    met = stretches(members.join(live, "cell"), parts_of()).join(classes.select("id", "vec"), "id").select("cell", "i", "j", "id", "home", "vec")
    met = met.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    edges = met.mapInArrow(_forest(cosine, kind), "u long, v long")
    comp = scratch.save(components(scratch, edges), "components")

    sized = comp.join(comp.groupBy("component").agg(F.count("*").alias("n")), "component")
    inside = stretches(sized, parts_of()).join(classes.select("id", "vec", "w"), "id").select("component", "i", "j", "sub", "id", "w", "vec")
    inside = inside.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = inside.mapInArrow(_counts(cosine, kind), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))

    named = classes.select("same", "id", "w").join(comp, "id", "left").join(links, "id", "left")
    named = named.select("same", F.coalesce("component", "id").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("same")).alias("same")).join(named, "same", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
