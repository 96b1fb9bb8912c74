"""Small streams on which each rule of the accounting shows, and folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tokenecho.operators import measure, mining, parse, segment, structure, treat


def line(i):
    """Three tokens and a line end: four."""
    return "abc"[i % 3] * (1 + i) + " x y"


def snaps(spark, *sessions):
    """Each session is a list of snapshots, each a list of lines; snapshots end in no line of their own."""
    rows = [(sid, k, str(sid), "\n".join(ls)) for sid, s in enumerate(sessions) for k, ls in enumerate(s)]
    return measure.with_lines(spark.createDataFrame(rows, "sid long, snap int, task string, text string"))


A, B, C, D = (line(i) for i in range(4))


def test_the_first_owner_counts(spark):
    out = measure.reuse(snaps(spark, [[A]], [[A], [A]]), 4).first()
    assert (out["reused"], out["same_session"], out["cross_task"]) == (8, 0, 8)


def test_spans_inside_the_opening_neither_score_nor_register(spark):
    out = measure.disjoint(snaps(spark, [[A, B, C, D]], [[A], [B, C], [D]], [["other z z"], [B, C]]), 8).first()
    assert (out["prefix_tokens"], out["pic_tokens"]) == (16, 0)


def test_a_span_across_the_end_of_the_opening_scores_in_full(spark):
    out = measure.disjoint(snaps(spark, [[A, B, C]], [[D, "q q q"], [A, B]], [[A], [B, "r r r"], [A, B]]), 8).first()
    assert out["prefix_tokens"] == 8 and out["pic_tokens"] == 8 and out["cross_session"] == 8


def test_tails(spark):
    rows = snaps(spark, [["a b", "c d", "e"]], [["a"]])
    spans = {r["sid"]: r["x"] for r in rows.select("sid", segment.pack(F.col("n"), 5).alias("x")).collect()}
    assert [tuple(x) for x in spans[0]] == [(0, 3, 8)] and spans[1] == []
    short = rows.select("sid", segment.pack(F.col("n"), 5, 5, True).alias("x")).where("sid = 1").first()["x"]
    assert [tuple(x) for x in short] == [(0, 1, 2)]


def test_messages(spark):
    span = "\n".join([A, A])
    rows = [(1, 1, 0, "system", span), (1, 1, 1, "decode", span), (1, 1, 2, "input", span), (2, 1, 3, "input", span), (3, 2, 4, "input", span)]
    out = measure.trajectories(spark.createDataFrame(rows, "traj long, grp long, msg long, role string, text string"), 4).first()
    assert (out["system_tokens"], out["reused_tokens"], out["in_session"], out["cross_same_group"], out["cross_other_group"]) == (8, 16, 0, 8, 8)
    assert out["total_tokens"] == 32 and out["unique_spans"] == 1


def test_first_fit_keeps_a_line_and_skips_a_later_one(spark):
    head = " ".join(["h"] * 16)
    obs = "\n".join([" ".join(["a"] * 5), " ".join(["b"] * 9), "c c"])
    rows = spark.createDataFrame([(0, 0, head, obs), (1, 0, head, obs)], "sid long, step int, head string, obs string")
    out = measure.head_once(rows, 1, 2).first()
    # 33 tokens each, as the last word of the head and the first of the observation are one; full blocks of two are served
    assert out["stream_tokens"] == 66 and out["prefix_tokens"] == 32


@pytest.mark.parametrize("seed", range(3))
def test_packing_against_a_loop(spark, seed):
    r = random.Random(seed)
    lists = [[r.randint(1, 9) for _ in range(r.randint(0, 12))] for _ in range(60)]

    def plain(n, least):
        out, lo, total = [], 0, 0
        for i, x in enumerate(n):
            total += x
            if total >= least:
                out.append([lo, i + 1, total])
                lo, total = i + 1, 0
        if lo < len(n) and out:
            out[-1][1:] = [len(n), out[-1][2] + total]
        return [tuple(x) for x in out]

    rows = spark.createDataFrame(list(enumerate(lists)), "id long, n array<int>").select("id", segment.pack(F.col("n"), 12).alias("x"))
    assert {x["id"]: [tuple(y) for y in x["x"]] for x in rows.collect()} == {i: plain(n, 12) for i, n in enumerate(lists)}


def test_boundaries_hold_every_line_once(spark):
    texts = ["a b\n\nc d e\n f\n", "", "one", "\n\n\n", "def f():\n  x\n@d\ndef g():\n  y"]
    rows = measure.with_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    n, lines = F.col("n"), F.col("lines")
    ways = [segment.fixed_line(n, 2), segment.fixed_char(lines, n, 5), segment.blank(lines, n), segment.def_line(lines, n), segment.indent0(lines, n), segment.indent_min(lines, n), segment.cdc_line(segment.line_bits(lines), n, 4), segment.pack(n, 3, 3, True)]
    for way in ways:
        for row in rows.select("n", way.alias("x")).collect():
            assert [i for x in row["x"] for i in range(x["s"], x["e"])] == list(range(len(row["n"])))
            assert sum(x["n"] for x in row["x"]) == sum(row["n"])
    for way in (structure.snap_pack(rows, 3, 2), structure.cdc_pack(rows, 0.3, 0.6, 3, 5, 8)):
        for row in rows.collect():
            own = sorted((x["s"], x["e"]) for x in way.where(F.col("doc_id") == row["doc_id"]).collect())
            assert [i for s, e in own for i in range(s, e)] == list(range(len(row["n"])))


def test_handles_are_stable_across_snapshots(spark):
    rows = spark.createDataFrame([(0, "[1] link\n[2] link\n[3] a [4]"), (1, "[9] link\n[8] link\n[7] a [6]")], "k long, text string")
    a, b = (r["text"] for r in treat.replace_by_line(rows, ["k"]).orderBy("k").collect())
    assert a == b and len(set(a.split("\n"))) == 3
    pages = spark.createDataFrame([(0, '<a id="1"><a id="2"><b>'), (1, '<a id="7"><a id="9"><b>')], "k long, text string")
    a, b = (r["text"] for r in treat.replace_attribute(pages, ["k"], "id").orderBy("k").collect())
    assert a == b and a.endswith("<b>") and a.count('id="a') == 2


def test_envelopes(spark):
    texts = ['{"output": "body", "metadata": {"t": 1}}', '{"output": "body"}', '{"output": 5, "metadata": 1}', "no json", '{"output": "b", "metadata": null}', None]
    body, side = treat.relocate_envelope(F.col("text"))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", body.alias("b"), side.alias("s")).orderBy("id").collect()
    assert [(r["b"], r["s"]) for r in rows] == [("body", '{"t":1}'), *[(t, "") for t in texts[1:]]]


def test_long_values_stay_unmasked(spark):
    rows = spark.createDataFrame([(f'"k": "{"v" * 120}"',), (f'"k": "{"v" * 121}"',), ('"k": -1.5e3',)], "text string")
    assert [r[0][:11] for r in rows.select(treat.mask(F.col("text"), "json:k")).collect()] == ['"k":"<V>"', '"k": "vvvvv', '"k":"<V>"']


def test_short_buckets_extend_the_one_before(spark):
    rows = spark.createDataFrame([("g", i, " ".join("x" * n)) for i, n in enumerate((6, 6, 1))], "grp string, doc_id long, text string")
    assert [r["bucket"] for r in treat.buckets(rows, 10).orderBy("doc_id").collect()] == [0, 0, 0]
    rows = spark.createDataFrame([("a", "4", "x"), ("a", "1", "x" + " y" * 9), ("a", "2", "x"), ("a", "3", " x" * 10), ("b", "1", "x"), (None, "1", None), (None, "2", " x" * 12)], "source string, doc_id string, text string")
    found = {(r["source"], r["doc_id"]): r["bucket"] for r in treat.buckets(rows, 10, "source").collect()}
    assert found == {("a", "1"): 0, ("a", "2"): 1, ("a", "3"): 1, ("a", "4"): 1, ("b", "1"): 0, (None, "1"): 0, (None, "2"): 0}
    assert treat.buckets(rows.limit(0), 10, "source").count() == 0


def test_mining_finds_the_volatile_field(spark):
    rows = [(s, k, f"id={1000 * s + k} kind=open\nstate same words here") for s in range(20) for k in range(20)]
    df = spark.createDataFrame(rows, "sid long, snap int, text string")
    assert mining.mine(df, 50) == ["kv:id"]


def test_later_calls_do_not_answer_earlier_results(spark):
    rows = [("t", 0, "tool_result", "1", None, "r0"), ("t", 1, "tool_use", "1", "a", None), ("t", 2, "tool_result", "1", None, "r2")]
    df = spark.createDataFrame(rows, "traj string, seq long, kind string, use_id string, path string, text string")
    assert sorted((r["text"], r["path"]) for r in parse.match_calls(df).collect()) == [("r0", "?"), ("r2", "a")]
