"""The training-data operators against brute force, on awkward rows."""

import hashlib
import re
import time
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenecho.llm import anchors, bpe, common, cover, crf, lattice, mixing, minhash, pii, sharding, suffix, topk
from tokenecho.llm.queries import OP7_SQL, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, b int, id long"


def words(seed, n, k=300):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(k)], r.integers(0, k, n)


def prose(seed, n):
    vocabulary, at = words(7, 1)
    r = np.random.default_rng(seed)
    return " ".join(vocabulary[i] for i in r.integers(0, len(vocabulary), n))


PASSAGE = prose(1, 40)
TEXTS = {
    0: prose(2, 120), 1: prose(2, 120), 2: prose(2, 118) + " tail word", 3: "", 4: None, 5: "  \n\t ", 6: "one", 7: "One", 8: prose(3, 30) + " " + PASSAGE + " " + prose(4, 30),
    9: PASSAGE + "\n" + prose(5, 50), 10: "mail a.b@c.org, or 1.2.3.4 and 4111 1111 1111 1111; +1 (555) 010-9999 999.1.1.1", 11: "é漢字 " * 300, 12: "be " * 500, 13: "x" * 20000,
    14: "don't <|endoftext|>  stop'll\n\n " * 60, 15: prose(6, 3000),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s0", None][i % 3], len(t or ""), "k", 1, 2, 3) for i, t in TEXTS.items()]
    return spark.createDataFrame([*rows, rows[0], (None, prose(2, 120), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, column):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r[column]) for r in df.collect())


def test_bpe_equals_the_tokenizers_library(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs, tokenizer_path()).collect()}
    for i, text in [*TEXTS.items(), (None, TEXTS[0]), (None, None)]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()) in out
    assert bpe.encode_documents(docs, tokenizer_path()).count() == docs.count()
    assert bpe.encode_documents(empty, tokenizer_path()).count() == 0


def test_bpe_joins_chunks_exactly():
    from tokenizers import Tokenizer

    t, c, r = Tokenizer.from_file(tokenizer_path()), bpe.codec(tokenizer_path()), np.random.default_rng(3)
    for _ in range(30):
        text = "".join(r.choice(["a", "b ", " ", "'ll", "\n", "  ", "<|endoftext|>", "7", "漢", "é", "... ", "word "], 800))
        b = text.encode()
        at = sorted({0, len(b), *(x for x in r.integers(0, len(b), 9).tolist() if b[x] & 0xC0 != 0x80)})
        assert c.join(b, at, [c.encode(b[x:y]) for x, y in zip(at, at[1:])]).tolist() == t.encode(text, add_special_tokens=False).ids


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    spans = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                spans.append((m.start(), k, m.end()))
    return ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(spans))


def test_pii_base_spans(spark, empty):
    r = np.random.default_rng(5)
    pieces = ["a@b.c", "x_y@q-1.co.uk_", "1.2.3.4", "300.1.2.3", ".5.6.7.8", "4111-1111-1111-1111", "+49 (30) 1234567", "+1", " ", "word", "é漢", "@", "..", "99", "-", "a%b@c", "\n", "4111 1111 1111 1112"]
    texts = ["".join(r.choice(pieces, 12)) for _ in range(200)] + ["", None, "z" * 5000 + "@", "1" * 5000, "a@" + "b." * 3000 + "c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x["doc_id"]: x for x in pii.find_private(rows).collect()}
    for i, t in enumerate(texts):
        assert out[i]["base_sha256"] == hashlib.sha256(base(t).encode()).hexdigest(), t
        assert set(filter(None, base(t).split(","))) <= set(out[i]["spans"].split(","))
    assert pii.find_private(empty).count() == 0


def test_pii_removes_what_discloses_and_leaves_the_rest(spark):
    noise = [(100 + i, prose(50 + i, 20) + " common words") for i in range(60)]
    rows = [(i, f"{prose(i, 5)} zanzibar common words near secret.name@corp.org and {prose(i + 9, 30)}") for i in range(6)]
    df = spark.createDataFrame([*rows, *noise], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all(out[i] == t for i, t in noise)
    assert all("secret.name" not in out[i] and "zanzibar" not in out[i] and "common words" in out[i] and "<EMAIL>" in out[i] for i, _ in rows)


def test_pii_counts_and_removes_in_whole_documents(spark):
    far = prose(300, 80)
    noise = [(100 + i, prose(50 + i, 60) + " Zoltan") for i in range(60)] + [(200, prose(49, 40) + " Li Quy")]
    rows = [(i, f"{prose(i, 40)} Li called. {far} q.x@corp.org {far} zanzibar, {prose(i + 9, 700)} Zanzibar! Li Zoltan") for i in range(6)]
    two = [(20 + i, f"{prose(70 + i, 40)} jo.x@corp.org {far} Only{i // 2}") for i in range(2)]
    df = spark.createDataFrame([*rows, rows[0], *two, *noise], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all(out[i] == t for i, t in noise)
    assert all(out[i] == t.replace("jo.x@corp.org", "<EMAIL>") for i, t in two)  # two documents are too few
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.find_private(df).collect()}
    for i, t in rows:
        assert not re.search("zanzibar|called|corp", out[i], re.I) and out[i].endswith(" <TERM> Zoltan")
        expected = [(m.start(), "generalise" if m[0] == "Li" else "remove", m.end()) for m in re.finditer(r"\b(?:Li|called|zanzibar)\b", t, re.I)]
        assert [f"{k}:{s}:{e}" for s, k, e in expected] == [x for x in spans[i] if not x.startswith("email")]


def test_sanitise_keeps_columns_of_any_name(spark):
    names = ["key", "all", "row", "base", "added"]
    df = spark.createDataFrame([(i, t, *([f"k{i}"] * 5)) for i, t in enumerate(["a@b.org x", None, "", "plain"])] + [(None, "a@b.org x", *("n",) * 5)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = pii.sanitise(df)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(str(r).replace("a@b.org", "<EMAIL>") for r in df.collect())


def test_redaction_of_many_spans(spark):
    mails = " ".join(f"né u{i}@x{i % 7}.org, 10.0.{i % 250}.7;" for i in range(1500))
    df = spark.createDataFrame([(1, mails), (2, "4111 1111 1111 1111"), (3, "nothing")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert out == {1: " ".join(["né <EMAIL>, <IP>;"] * 1500), 2: "<CARD>", 3: "nothing"}


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    size = [len(WORD.findall(t or "")) for t in TEXTS.values()]
    assert sum(r["size"] for r in rows) == sum(size) + 2 * 120 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    target = {r["source"]: r["target"] for r in rows}
    taken = {s: sum(r["taken"] for r in rows if r["source"] == s) for s in target}
    assert all(abs(target[s] - taken[s]) <= 1 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, "a" if i < 20 else "b", "one two three four five") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    members = F.when(F.col("doc_id").between(10, 19), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))
    out = {r["doc_id"]: r["taken"] for r in mixing.mix(df, members).collect()}
    targets = {s: round(t) for s, t in mixing.quotas({"a": 100, "b": 50}).items()}
    flow = mixing.cheapest_flow({("a",): 50, ("a", "b"): 50, ("b",): 50}, targets)
    taken = {p: sum(out[i] for i in range(k, k + 10)) for p, k in ((("a",), 0), (("a", "b"), 10), (("b",), 20))}
    assert taken == flow and sum(flow.values()) == sum(targets.values()) and all(0 <= x <= 10 for x in out.values())


def test_flow_costs_no_more_than_any_other():
    from itertools import product

    r = np.random.default_rng(11)
    for _ in range(40):
        patterns = [("a",), ("b",), ("a", "b")]
        pools = {(p, s): (2 * int(r.integers(0, 4)), [s]) for p in patterns for s in p}
        rows = {p: sum(pools[p, s][0] for s in p) for p in patterns}
        levels = {p: [u, u, rows[p] - 2 * u] for p in patterns for u in [int(r.integers(0, rows[p] // 2 + 1))]}
        demand = {s: int(r.integers(0, 9)) for s in "ab"}
        cost = lambda give: sum(c * min(max(0, sum(give[p, s] for s in p) - lo), n) for p in patterns for c, lo, n in zip((1, 4, 9), np.cumsum([0, *levels[p]]).tolist(), levels[p]))
        got = mixing.cheapest_routes(levels, pools, demand)
        every = [dict(zip(pools, x)) for x in product(*(range(m + 1) for m, _ in pools.values()))]
        every = [g for g in every if all(sum(n for (_, s), n in g.items() if s == k) <= demand[k] for k in "ab")]
        assert got in every and min((-sum(g.values()), cost(g)) for g in every) == (-sum(got.values()), cost(got))


def test_mixing_by_brute_force(spark, docs):
    shared = [(1000 + i, f"{prose(700 + i % 7, 20)}", "en", ["s0", "s1", "s2"][i % 3 if i % 7 < 4 else 0], 1, "k", 1, 2, 3) for i in range(60)]
    df = docs.union(spark.createDataFrame(shared, SCHEMA)).repartition(5)
    rows = [(r["doc_id"], r["source"], r["text"], len(WORD.findall(r["text"] or "")), r["draw"]) for r in df.withColumn("draw", F.xxhash64(F.lit(17), "doc_id", "text")).collect()]
    held = {}
    for _, s, t, _, _ in rows:
        if t is not None:
            held.setdefault(t, set()).add("n" if s is None else f"s{s}")
    pools, once, sizes = {}, {}, {}
    for row in rows:
        own = "n" if row[1] is None else f"s{row[1]}"
        pools.setdefault((tuple(sorted(held.get(row[2], {own}))), own), []).append(row)
        sizes[row[1]] = sizes.get(row[1], 0) + row[3]
    for t, s in held.items():
        once[tuple(sorted(s))] = once.get(tuple(sorted(s)), 0) + len(WORD.findall(t))
    words_of = {k: sum(r[3] for r in v) for k, v in pools.items()}
    total = {p: sum(n for (q, _), n in words_of.items() if q == p) for p, _ in pools}
    levels = {p: [once[p], once[p], 2 * n - 2 * once[p]] for p, n in total.items()}
    target = mixing.quotas(sizes)
    flow = mixing.cheapest_routes(levels, {k: (2 * n, [k[1]]) for k, n in words_of.items()}, {"n" if s is None else f"s{s}": round(t) for s, t in target.items()})
    expected = []
    for k, own in pools.items():
        left = flow[k] % words_of[k] if words_of[k] else 0
        for i, s, _, n, _ in sorted(own, key=lambda r: (r[4] % 2**64, r[0] is not None, r[0] or 0, r[3])):
            last = min(n, left)
            left -= last
            expected.append((i, s, n, sizes[s], target[s], (flow[k] // words_of[k] if words_of[k] else 0) * n + last, len(k[0])))
    assert any(len(p) > 1 and flow[p, s] for p, s in pools)
    assert sorted(map(str, map(tuple, mixing.mix(df).collect()))) == sorted(map(str, expected))


def test_mixture_keeps_columns_of_any_name(spark):
    names = ["row", "times", "k", "pool", "pattern", "bin", "carried", "taken", "all"]
    df = spark.createDataFrame([(i, "s", f"w{i} b", *([i] * 9)) for i in range(20)] + [(99, None, None, *([1] * 9))], "doc_id long, source string, text string, " + ", ".join(f"`{c}` long" for c in names))
    out = mixing.mixture(df)
    assert out.columns == df.columns and out.count() == 30 and all(r["row"] == r["times"] == r["all"] == r["doc_id"] for r in out.collect())


def test_min_cost_flow_spreads_before_it_repeats():
    flow = mixing.cheapest_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15})
    assert flow == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    assert mixing.quotas({"b": 10, "a": 10, None: 20}) == {"a": 20.0, "b": 80 / 6, None: 80 / 3} or sum(mixing.quotas({"b": 10, "a": 10, None: 20}).values()) == pytest.approx(60)
    assert sum(mixing.cheapest_flow({("a",): 5}, {"a": 100}).values()) == 10


def components_of(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def shingles(text):
    w = [x.lower() if x.isascii() else x for x in WORD.findall(text or "")]
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def test_minhash_components(spark, docs, empty):
    r = np.random.default_rng(8)
    seeds = [prose(100 + i, 60).split() for i in range(5)]
    texts = []
    for i in range(120):
        w = list(seeds[i % 5])
        for k in r.integers(0, len(w), r.integers(0, 9)):
            w[k] = f"new{r.integers(0, 50)}"
        texts.append(" ".join(w))
    texts += ["", None, "one", "One", " \n"]
    out = {x["doc_id"]: x for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    assert [out[i]["component_id"] for i in range(len(texts))] == components_of(sets)
    assert [out[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    odd = minhash.near_duplicates(docs).collect()
    assert len(odd) == docs.count() and all(x["kept"] == (x["doc_id"] is None or x["component_id"] == x["doc_id"]) for x in odd)
    assert minhash.near_duplicates(empty).count() == 0


def fives(text):
    w = [x.lower() if x.isascii() else x for x in WORD.findall(text or "")]
    return set(zip(*(w[k:] for k in range(5)))) if len(w) > 4 else {tuple(w)} if w else set()


def test_minhash_shingles_of_five_words(spark):
    r, w = np.random.default_rng(9), [f"w{k}" for k in range(200)]
    changed = lambda n: " ".join(f"new{i}" if k in at else x for at in [set(r.choice(200, n, False).tolist())] for k, x in enumerate(w) for i in [r.integers(0, 99)])
    texts = [" ".join(w), *(changed(n) for n in (1, 2, 3, 4, 8, 9, 10, 11)), "a b c d", "A b c d", "a b c", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x["doc_id"]: x for x in minhash.near_duplicates(df, shingle=5).collect()}
    sets = [fives(t) for t in texts]
    assert [out[i]["component_id"] for i in range(len(texts))] == components_of(sets) != components_of([shingles(t) for t in texts])
    assert [out[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_minhash_links_all_texts_of_a_repeated_id(spark):
    rows = []
    for k in range(8):  # ids 10k, each with two texts, and a near copy of either
        a, b = prose(400 + k, 60), prose(500 + k, 60)
        rows += [(10 * k, a), (10 * k, b), (10 * k + 1, a + " tail"), (10 * k + 2, b + " tail"), (10 * k + 3, prose(600 + k, 60))]
    for parts in (1, 5):
        out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert len(out) == len(rows)
        assert all(x["component_id"] == (x["doc_id"] if x["doc_id"] % 10 == 3 else x["doc_id"] // 10 * 10) for x in out)


def test_anchors_remove_repeated_windows(docs, empty):
    first = {}
    tokens = {i: WORD.findall(t or "") for i, t in TEXTS.items()}
    for i in sorted(tokens):
        for j in range(len(tokens[i]) - 12):
            first.setdefault(tuple(tokens[i][j : j + 13]), i)
    out = anchors.remove_repeated_passages(docs).collect()
    assert len(out) == docs.count() and anchors.remove_repeated_passages(empty).count() == 0
    for row in out:
        i, w = (99, WORD.findall(TEXTS[0])) if row["doc_id"] is None and row["n_words"] else (row["doc_id"], tokens.get(row["doc_id"], []))
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        assert (row["n_words"], row["n_removed"], row["kept"]) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))


def test_suffix_ranks_over_tables(spark):
    r = np.random.default_rng(1)
    strings = [r.integers(1, 4, n).tolist() for n in [*range(1, 14), 40, 41, 42]] + [[2] * 30, [2] * 29]
    rows = spark.createDataFrame([(i, 1, s) for i, s in enumerate(strings)], "k long, r long, s array<long>")
    every = sorted(s[j:] for s in strings for j in range(len(s)))
    for row in cover.ranks(common.Scratch(spark, "test"), rows).collect():
        s = strings[row["k"]]
        assert row["x"] == [every.index(s[j:]) for j in range(len(s))]


def test_suffix_tables_are_not_broadcast(spark):
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsList().size()
    r = np.random.default_rng(2)
    rows = [(i, bytes(r.integers(97, 100, 60).astype(np.uint8)), i, 0, i) for i in range(200)]
    pieces = spark.createDataFrame(rows, "piece long, text binary, doc long, b int, last long")
    assert suffix._heavy_owners(common.Scratch(spark, "test"), pieces, 5).count() == 1
    bus.waitUntilEmpty(30_000)
    sent, done = [], store.executionsList()
    for run in (done.apply(i).executionId() for i in range(before, done.size())):
        made, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (x for x in (nodes.apply(i) for i in range(nodes.size())) if x.name() == "BroadcastExchange"):
            metrics = {m.name(): m.accumulatorId() for m in (node.metrics().apply(i) for i in range(node.metrics().size()))}
            value = made.get(metrics["number of output rows"])
            sent.append(int(value.get().replace(",", "")) if value.isDefined() else 0)
    assert sent and max(sent) <= 20  # a row for each range


@pytest.mark.parametrize("hot", [suffix.HOT, 150])
def test_suffix_arrays(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)  # minimizers with over 150 bytes of pieces go over tables
    r = np.random.default_rng(0)
    for n in [*range(30), 200]:
        s = r.integers(1, 4, n)
        assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    data, first = {i: (t or "").encode() for i, t in TEXTS.items()}, {}
    for i in sorted(data):
        for j in range(len(data[i]) - 49):
            first.setdefault(data[i][j : j + 50], i)
    for row in suffix.remove_repeated_strings(docs).collect():
        data[99] = b"" if row["n_bytes"] == 0 else data[0]  # rows without an id stand after all others
        row = row.asDict() | {"doc_id": 99 if row["doc_id"] is None else row["doc_id"]}
        b = data[row["doc_id"]]
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < row["doc_id"]:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], bytes(row["kept"])) == (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept)
    assert suffix.remove_repeated_strings(empty).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, id long, w long, cell long"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 16)).astype(np.float32)
    x[100:140] = x[0] + 0.1 * r.standard_normal((40, 16))
    x[200:210] = x[5]
    rows = [(i, v.tolist(), 0, 1, 2, 3) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1.0, 2.0]]
    return x, spark.createDataFrame([*rows, *((1000 + 100 * i, v, 0, 1, 2, 3) for i, v in enumerate(odd)), (None, x[0].tolist(), 0, 1, 2, 3)], VECTORS)


def test_topk(spark, vectors):
    import duckdb

    x, df = vectors
    out = sorted(map(tuple, topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()))
    con = duckdb.connect()
    embeddings = df.toPandas()  # noqa: F841  the SQL reads it
    con.register("embeddings", embeddings.astype({"vec_id": "Int64"}))
    assert out == sorted(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({OP7_SQL})").fetchall())
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_topk_reads_lists_in_order(monkeypatch):
    r = np.random.default_rng(20)
    x = np.floor(r.standard_normal((500, 8)) * 1024)
    places = np.argsort(x, axis=0, kind="stable").T
    lists = topk.Lists(np.arange(500), np.take_along_axis(x.T, places, 1), places, x)
    for i in range(0, 500, 50):
        score, ids = lists.best(x[i], i, 10, -np.inf)
        brute = sorted(((-(x[j] @ x[i]), j) for j in range(500) if j != i))[:10]
        assert ids.size < 250 and sorted(zip((-score).tolist(), ids.tolist()))[:10] == brute


def test_topk_reads_lists_once_for_many_queries(monkeypatch):
    r = np.random.default_rng(22)
    x = np.floor(r.standard_normal((3000, 32)) * 1024)
    x[1500:1600], x[7], x[:, 5] = x[3], 0, np.abs(x[:, 5])
    stretches = [topk._sorted_lists(pa.table({"vec_id": np.arange(i, 3000, 2), "vec": [v.tobytes() for v in x[i::2]]})) for i in (0, 1)]

    def search(n):
        began = time.perf_counter()
        out = pa.Table.from_batches(topk._search(10, SimpleNamespace(value={32: (np.arange(n), x[:n])}))(b for t in stretches for b in t.to_batches()))
        return list(zip(*[out[c].to_pylist() for c in ("query_id", "score", "vec_id")])), time.perf_counter() - began

    score = (x[:300] @ x.T).astype(int)
    brute = [(i, score[i, j], j) for i in range(300) for j in sorted(set(range(3000)) - {i}, key=lambda j: (-score[i, j], j))[:10]]
    found, many = search(300)
    assert found == brute
    assert many < 100 * min(search(1)[1] for _ in range(5))
    monkeypatch.setattr(topk, "AT_ONCE", 10_000)
    assert search(300)[0] == brute


def test_topk_of_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 200)
    r = np.random.default_rng(21)
    x = r.standard_normal((60, 4))
    df = spark.createDataFrame([(i % 50, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, x[7].tolist()), (7, x[7].tolist()), (7, x[57].tolist()), (900, x[3].tolist())], df.schema)
    z = np.floor(1024 * x)
    brute = lambda own, q: [(own, k + 1, j % 50, int(s)) for k, (s, _, j) in enumerate(sorted(((z[j] @ np.floor(1024 * q), -(j % 50), j) for j in range(60) if j % 50 != own), key=lambda y: (-y[0], -y[1]))[:3])]
    expected = brute(7, x[7]) + brute(7, x[57]) + brute(900, x[3])
    assert sorted(map(tuple, topk.top_k(df, asked, 3).collect())) == sorted(expected)


def test_lattice(spark, vectors):
    x, df = vectors
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    out = {r["vec_id"]: r for r in lattice.near_vectors(df).collect()}
    assert len(out) == 307
    found = sum(out[i]["n_links"] for i in range(300))
    assert 0.9 * link.sum() <= found <= link.sum()
    assert all(out[k]["n_links"] == 0 and out[k]["kept"] for k in (1000, 1100, 1200, 1300, 1400, None))
    assert out[205]["component_id"] == 5 and out[205]["n_links"] >= 10
    assert lattice.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_lattice_in_double_precision(spark):
    r = np.random.default_rng(14).standard_normal(16)
    rows = [(1, (r * 1e200).tolist()), (2, (r * 1e-200).tolist()), (3, r.tolist()), (4, (-r).tolist()), (5, (r + 1e-12).tolist()), (6, [float("inf")] * 16)]
    out = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1), 6: (0, 6)}


def test_e8_points_are_nearest():
    x = np.random.default_rng(1).standard_normal((500, 8)) * 2
    p = lattice.decode(x)
    d = ((x - p) ** 2).sum(1)
    assert len(lattice.MINIMAL) == 240 and d.max() <= 1 + 1e-9
    assert ((((x[:, None] - p[:, None] - lattice.MINIMAL) ** 2).sum(2)).min(1) >= d - 1e-9).all()


def test_crf_learns_languages_and_switches(spark, empty):
    r = np.random.default_rng(2)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "er"], "cc": ["ción", "os", "ñe"]}
    text = lambda lang, n: " ".join("".join(r.choice(sounds[lang], r.integers(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 30), lang) for i in range(150) for lang in [("aa", "bb", "cc")[i % 3]]]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !", "aa"), (902, "", None), (None, text("bb", 9), "bb")], "doc_id long, text string, lang string")
    out = {x["doc_id"]: x for x in crf.identify_documents(df).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, _ in held} == {i for i in range(150) if out[i]["held_out"]}
    assert np.mean([out[i]["lang_pred"] == lang for i, lang in held]) >= 0.95
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in (900, 901, 902)) and out[None]["lang_pred"] == "bb"
    tagger = crf.fit([(t, lang) for _, t, lang in rows])
    mixed = tagger.label_words(text("aa", 12) + " " + text("bb", 12))
    assert np.mean([m[2] == ("aa" if k < 12 else "bb") for k, m in enumerate(mixed)]) >= 0.85
    assert crf.identify_documents(empty).count() == 0


def test_crf_reads_long_runs_to_their_end(spark):
    r = np.random.default_rng(12)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "er"]}
    word = lambda lang, n: "".join(r.choice(sounds[lang], n))
    tagger = crf.fit([(" ".join(word(lang, r.integers(1, 4)) for _ in range(30)), lang) for _ in range(60) for lang in sounds])
    run = word("aa", 20)[:40] + word("bb", 8000)
    labels = tagger.label_words(f"1{run} {word('aa', 2)}")
    assert (labels[0][0], labels[0][1], labels[-2][1]) == (1, 41, 1 + len(run)) and all(a[1] == b[0] for a, b in zip(labels, labels[1:-1]))
    assert labels[0][2] == labels[-1][2] == "aa" and np.mean([x[2] == "bb" for x in labels[1:-1]]) > 0.95
    df = spark.createDataFrame([(0, run), (1, run[:40]), (2, run[:40] + word("aa", 900))], "doc_id long, text string")
    assert [x["language_found"]["lang_pred"] for x in crf.identify(df, tagger).orderBy("doc_id").collect()] == ["bb", "aa", "aa"]
    heads = [np.sort(crf.features([run[:40] + tail], {})[0]).tolist() for tail in ("", "er", "ka")]
    assert heads[0] != heads[1] != heads[2]


def test_forward_backward_equals_enumeration():
    from itertools import product

    r = np.random.default_rng(6)
    scores, trans, first = r.standard_normal((4, 2)), r.standard_normal((2, 2)), r.standard_normal(2)
    weight = {y: np.exp(first[y[0]] + sum(scores[t, y[t]] for t in range(4)) + sum(trans[y[t - 1], y[t]] for t in range(1, 4))) for y in product((0, 1), repeat=4)}
    expected = [[sum(w for y, w in weight.items() if y[t] == k) / sum(weight.values()) for k in (0, 1)] for t in range(4)]
    got = crf.forward_backward(scores, np.array([0]), np.array([4]), trans, first)
    assert np.allclose(got, expected)
    fwd, back, local = crf.messages(scores, np.array([0]), np.array([4]), trans, first)
    for t in (1, 2, 3):
        both = [[sum(w for y, w in weight.items() if (y[t - 1], y[t]) == (a, b)) / sum(weight.values()) for b in (0, 1)] for a in (0, 1)]
        assert np.allclose(crf.pairs(fwd, back, local, trans, np.array([t]))[0], both)


def test_crf_deals_its_sample_and_keeps_other_columns(spark):
    assert crf.shares({"a": 5, "b": 1000, "c": 900}, 100) == {"a": 5, "c": 47, "b": 48}
    r = np.random.default_rng(3)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "er"], "rare": ["quix", "zy"]}
    text = lambda lang, n: " ".join("".join(r.choice(sounds[lang], 3)) for _ in range(n))
    rows = [(i, text(lang, 8), lang, i, "s") for i in range(3000) for lang in ["rare" if i % 500 == 0 else ("aa", "bb")[i % 2]]]
    df = spark.createDataFrame([*rows, (-1, text("rare", 30000), None, -1, "s")], "doc_id long, text string, lang string, score long, lang_pred string")
    tagger = crf.fit_on(df, sample=60)
    assert tagger.langs == ["aa", "bb", "rare"]
    out = crf.identify(df, tagger)
    assert out.columns == [*df.columns, "language_found"] and out.where("score <> doc_id OR lang_pred <> 's'").count() == 0
    assert out.where("doc_id = -1").first()["language_found"]["lang_pred"] == "rare"
    with pytest.raises(ValueError):
        crf.identify(df.withColumn("Language_Found", F.lit(1)), tagger)
    again = crf.fit_on(df.repartition(7), sample=60)
    assert np.array_equal(again.weights, tagger.weights) and np.array_equal(again.trans, tagger.trans)


def test_shards(docs, empty):
    out = sharding.shard_by_bytes(docs, 4).collect()
    assert len(out) == docs.count() and sharding.shard_by_bytes(empty).count() == 0
    for r in out:
        if r["doc_id"] is not None:
            t = (TEXTS[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for k in range(4):
        own = [r for r in out if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= largest
    texts = [r["text"] or "" for r in docs.collect()]
    ordered = [r["text_crc32"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    for t in texts:  # equal texts stand side by side
        at = [k for k, c in enumerate(ordered) if c == zlib.crc32(t.encode())]
        assert at == list(range(at[0], at[0] + texts.count(t)))


def test_components(spark):
    scratch = common.Scratch(spark, "test")
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 50)] + [(7, 7)]
    out = {r["id"]: r["component"] for r in common.components(scratch, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}


def test_word_hashes_do_not_depend_on_slices():
    text = np.frombuffer((" ".join(TEXTS[15].split()) + "\n" + "y" * 700 + " end").encode(), np.uint8)
    a, b = common.words_of(text), common.words_of(text, 64)
    assert all(np.array_equal(x, y) for x, y in zip(a, b)) and len(a[0]) == len(WORD.findall(text.tobytes().decode()))


def encoded(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.documents(spark, "/root/testdata/sf0.001")
    odd = [(9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "12 !!", "en", None, 5), (None, "plain words and more of them", None, "s", 28), (9005, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("key", "all", "row", "score", "lang_pred", "times", "size", "b")})
    stages = dict(pipeline.STAGES)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    same = lambda out, keep: sorted(map(str, out.collect())) == sorted(map(str, keep))

    spoken = stages["language"](spark, docs, "")
    assert spoken.columns == docs.columns
    kept = {r["doc_id"]: r for r in spoken.collect()}
    assert set(kept) == {r["doc_id"] for r in rows if re.search(r"[^\W\d_]", r["text"] or "")}
    assert all(kept[r["doc_id"]].asDict() == r.asDict() | {"lang": r["lang"] or kept[r["doc_id"]]["lang"]} for r in rows if r["doc_id"] in kept)
    assert all(r["lang"] for r in kept.values())

    own = [r for r in rows if r["doc_id"] is not None]
    found = components_of([fives(r["text"]) for r in own])
    assert same(stages["near_duplicates"](spark, docs, ""), [r for k, r in enumerate(own) if found[k] == k] + [r for r in rows if r["doc_id"] is None])

    clean = {r["doc_id"]: r for r in stages["private_data"](spark, docs, "").collect()}
    spans = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in pii.find_private(docs).collect()}
    assert len(clean) == len(rows)
    for r in rows:
        text, at = "", 0
        for kind, a, z in spans[r["doc_id"]]:
            if int(a) >= at:
                text += r["text"][at : int(a)] + {"remove": "", "generalise": "<TERM>"}.get(kind, f"<{kind.upper()}>")
            at = max(at, int(z))
        text = None if r["text"] is None else text + r["text"][at:]
        assert clean[r["doc_id"]].asDict() == r.asDict() | {"text": text, "n_chars": None if text is None else len(text)}

    taken = mixing.mix(docs).collect()
    times = {r["doc_id"]: int(r["taken"] / max(1, r["size"]) + 0.5) for r in taken}
    assert same(stages["mix"](spark, docs, ""), [r for r in rows for _ in range(times[r["doc_id"]])])

    out = stages["encode"](spark, docs, "").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert same(out, [pytest.importorskip("pyspark.sql").Row(doc_id=r["doc_id"], n_tokens=n, ids_sha256=a, decoded_sha256=b) for r in rows for n, a, b in [encoded(r["text"])]])
    empty = docs.limit(0)
    assert all(stages[name](spark, empty, "").count() == 0 for name in stages)
