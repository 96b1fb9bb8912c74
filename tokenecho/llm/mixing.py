"""Mixing overlapping sources to target weights by min-cost flow.

A text that several sources hold is what makes sources overlap: taken for each of them it
repeats the same words. Documents are aggregated by the set of sources that hold their text
(the membership pattern) and, inside it, by the source that they count for (the pool).
Words flow from patterns, at a cost that grows with each repetition of the pattern's
distinct words, through the pools to the sources' quotas; the flow is the cheapest of the
largest ones. So a source draws on what it alone holds before words are repeated that
others need. What a pool has to give is then met by its documents in a seeded order: whole
passes first, and in the last pass those that come first in the order, the one at the
border with the words that are still missing.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Sources, and patterns of several sources, that the flow is solved for on the driver. More sources are an
#: error; in the patterns with the fewest words beyond that, documents count as held by their own source only.
MOST_PATTERNS = 20_000


def quotas(sizes: dict, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Target words by source: sources in code point order, null last, weigh 5, 2, 1 in turn.

    Targets share `share` of all words by weight, none above `most` times its source's
    words; what is cut off is shared again among the rest until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        all_w = sum(weigh[s] for s in open_)
        above = [s for s in open_ if left * weigh[s] / all_w > most * sizes[s]]
        if not above:
            return {s: target.get(s, left * weigh[s] / all_w) for s in names}
        for s in above:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in above)
        open_ = [s for s in open_ if s not in target]
    return target


def _fill(graph: list[list[int]], to: list[int], room: list[int]) -> None:
    """Adds flow from node 0 to node 1 until there is no more way (blocking flows by distance)."""
    while True:
        far = [-1] * len(graph)
        far[0], queue = 0, deque([0])
        while queue:
            u = queue.popleft()
            for k in graph[u]:
                if room[k] and far[to[k]] < 0:
                    far[to[k]] = far[u] + 1
                    queue.append(to[k])
        if far[1] < 0:
            return
        at, path, u = [0] * len(graph), [], 0
        while True:
            if u == 1:
                push = min(room[k] for k in path)
                for k in path:
                    room[k] -= push
                    room[k ^ 1] += push
                full = next(i for i, k in enumerate(path) if not room[k])
                u = to[path[full] ^ 1]
                del path[full:]
            elif at[u] < len(graph[u]):
                k = graph[u][at[u]]
                if room[k] and far[to[k]] == far[u] + 1:
                    path.append(k)
                    u = to[k]
                else:
                    at[u] += 1
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def cheapest_routes(levels: dict[tuple, list[int]], pools: dict[tuple, tuple[int, list]], demand: dict) -> dict[tuple, int]:
    """Words that each pool gives, in the cheapest of the largest flows.

    levels: for each pattern the words that it can give at rising costs, the same for all
    patterns. pools: (pattern, pool) with the words that it can give and the sources it
    serves. demand: words that each source wants. Costs are on the way out of the origin
    only, so a path has the cost of its level, and the cheapest paths come first if the
    levels are opened one by one and each is filled before the next.
    """
    patterns, names, sources = sorted(levels), sorted(pools), sorted(demand)
    place = {("p", x): 2 + i for i, x in enumerate(patterns)}
    place |= {("o", x): len(place) + 2 + i for i, x in enumerate(names)}
    place |= {("s", x): len(place) + 2 + i for i, x in enumerate(sources)}
    graph: list[list[int]] = [[] for _ in range(2 + len(place))]
    to, room = [], []

    def arc(u: int, v: int, most: int) -> int:
        for a, b, r in ((u, v, most), (v, u, 0)):
            graph[a].append(len(to))
            to.append(b)
            room.append(r)
        return len(to) - 2

    origin = {x: arc(0, place["p", x], 0) for x in patterns}
    out = {}
    for x in names:
        most, serves = pools[x]
        out[x] = arc(place["p", x[0]], place["o", x], most)
        for s in sorted(serves):
            arc(place["o", x], place["s", s], most)
    for s in sources:
        arc(place["s", s], 1, demand[s])
    for step in range(max(map(len, levels.values()), default=0)):
        for x in patterns:
            room[origin[x]] += levels[x][step] if step < len(levels[x]) else 0
        _fill(graph, to, room)
    return {x: room[k ^ 1] for x, k in out.items()}


def cheapest_flow(supply: dict[tuple, int], demand: dict, repeats: int = 2) -> dict[tuple, int]:
    """Words that each pattern (a tuple of sources, any of which it may serve) gives if its words can be taken `repeats` times."""
    pools = {(p, ""): (repeats * n, list(p)) for p, n in supply.items()}
    return {p: n for (p, _), n in cheapest_routes({p: [n] * repeats for p, n in supply.items()}, pools, demand).items()}


def n_words(text):
    """Number of maximal runs of characters other than blank, tab, LF, VT, FF and CR."""
    blanked = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blanked, " "), lambda w: w != "")).cast("long")


def _code(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def mix(docs: DataFrame, members: Column | None = None, seed: int = 17, weights=(5, 2, 1), share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry=()) -> DataFrame:
    """docs' id, source, size, source_size, target, the words taken of each document and n_sources of its pattern.

    carry: names of columns of docs to return in the struct `carried`. members: a column
    with the array of sources that a document may serve, whichever is its own; unless given,
    a document serves its own source, and its pattern is the set of sources that hold its
    text. No document is taken more than twice. Rows with a null source form one source,
    null texts and blank ones have no words and are not taken, repeated rows each count, ids
    may be null, very long texts count whole; an empty table gives no rows; names of other
    columns do not matter. The order of documents is a hash of seed, id and text, so reruns
    and other partitionings agree; equal rows tie and are alike.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    source = F.col(source_col).cast("string")
    given = members is not None
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        source.alias("source"),
        _code(source).alias("pool"),
        n_words(F.col(text_col)).alias("size"),
        (F.transform(members, lambda x: _code(x.cast("string"))) if given else F.lit(None).cast("array<string>")).alias("pattern"),
        F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("same"),
        F.xxhash64(F.lit(seed), id_col, text_col).alias("draw"),
        (F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(0)).alias("carried"),
    )
    rows = scratch.save(rows, "rows")
    if given:
        rows = rows.withColumn("pool", F.lit("")).drop("same")
        distinct = rows.groupBy("pattern").agg(F.sum("size").alias("words"))
    else:
        texts = rows.where("same IS NOT NULL").groupBy("same").agg(F.min("size").alias("size"), F.sort_array(F.collect_set("pool")).alias("pattern"))
        texts = scratch.save(texts, "texts")
        distinct = texts.groupBy("pattern").agg(F.sum("size").alias("words"))
        common = distinct.where("size(pattern) > 1").orderBy(F.desc("words"), "pattern").limit(MOST_PATTERNS).select("pattern")
        shared = scratch.save(texts.where("size(pattern) > 1").join(common, "pattern").select("same", "pattern"), "shared")
        rows = rows.drop("pattern").join(shared, "same", "left").drop("same").withColumn("pattern", F.coalesce("pattern", F.array("pool")))
    sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()}
    grouped = rows.groupBy("pattern", "pool").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    grouped = grouped.limit(MOST_PATTERNS * 50 + 1).collect()
    if len(sizes) > MOST_PATTERNS or len(grouped) > MOST_PATTERNS * 50:
        raise ValueError(f"more than {MOST_PATTERNS} sources, or patterns of {MOST_PATTERNS * 50} pools")
    patterns = {tuple(r["pattern"]): 0 for r in grouped}
    for r in grouped:
        patterns[tuple(r["pattern"])] += r["size"]
    once = {tuple(r["pattern"]): r["words"] for r in distinct.join(F.broadcast(grouped_patterns(spark, patterns)), "pattern", "left_semi").collect()}
    target = quotas(sizes, weights, share)
    # the distinct words once, once more, and what copies can give beyond that
    levels = {p: [u, u, 2 * n - 2 * u] for p, n in patterns.items() for u in [min(n, once.get(p, n))]}
    pools = {(tuple(r["pattern"]), r["pool"]): (2 * r["size"], list(r["pattern"]) if given else [r["pool"]]) for r in grouped}
    demand = {"n" if s is None else f"s{s}": round(t) for s, t in target.items()}
    for p in [x for x, (_, serves) in pools.items() if not set(serves) <= set(demand)]:
        pools[p] = (pools[p][0], [s for s in pools[p][1] if s in demand])  # a given member that is no document's own source wants nothing
    flow = cheapest_routes(levels, pools, demand)

    # the passes that all documents of a pool make, and the words of the last one
    passes = [(list(p), o, k, int(flow[p, o] // n) if n else 0, int(flow[p, o] % n) if n else 0) for k, (p, o, n) in enumerate(sorted((tuple(r["pattern"]), r["pool"], r["size"]) for r in grouped))]
    schema = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("pool", T.StringType()), *[T.StructField(x, T.LongType()) for x in ("k", "passes", "rest")]])
    passes = F.broadcast(spark.createDataFrame(passes, schema))  # one row for each pool
    goals = F.broadcast(spark.createDataFrame([(s, sizes[s], float(target[s])) for s in sizes], "of_source string, source_size long, target double"))

    # prefix sums in the drawn order: bins of the hash first, then only inside the bin at the border
    total = sum(r["n"] for r in grouped)
    bits = max(8, (total // 20_000).bit_length())
    rows = rows.join(passes, ["pattern", "pool"]).withColumn("n_sources", F.size("pattern")).drop("pattern", "pool").withColumn("bin", F.shiftrightunsigned("draw", 64 - bits))
    sums = rows.groupBy("k", "bin", "rest").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    border = sums.where("below < rest AND below + bin_size >= rest").select("k", F.col("bin").alias("border"), (F.col("rest") - F.col("below")).alias("missing"))
    rows = rows.join(F.broadcast(border), "k", "left")  # one row for each pool at most
    at = rows.where("bin = border")
    inner = Window.partitionBy("k").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("upto", F.sum("size").over(inner)).withColumn("last", F.greatest(F.lit(0), F.least("size", F.col("missing") - F.col("upto") + F.col("size"))))
    off = rows.where("border IS NULL OR bin <> border").withColumn("last", F.when(F.coalesce(F.expr("bin < border"), F.lit(False)), F.col("size")).otherwise(F.lit(0)))
    cols = ["doc_id", "source", "size", "passes", "last", "n_sources", "carried"]
    both = off.select(*cols).unionByName(at.select(*cols)).join(goals, F.col("source").eqNullSafe(F.col("of_source")))
    taken = (F.col("passes") * F.col("size") + F.col("last")).cast("long").alias("taken")
    return both.select("doc_id", "source", "size", "source_size", "target", taken, "n_sources", *(["carried"] if carry else []))


def grouped_patterns(spark, patterns) -> DataFrame:
    """One row for each pattern that the flow knows."""
    return spark.createDataFrame([(list(p),) for p in patterns], "pattern array<string>")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """docs as often as the mix takes them: whole documents, the one at a border if half of it or more is taken.

    All columns of docs come back, whatever their names; rows are defined as in mix().
    """
    out = mix(docs, carry=docs.columns, **options)
    times = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    out = out.withColumn("times", times).where("times > 0").select("carried", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*[F.col("carried")[c].alias(c) for c in docs.columns])
