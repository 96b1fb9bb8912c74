"""Measures of reuse. Snapshots are rows (sid, snap, task, lines array<string>) whose sid
is the arrival order of sessions; nothing relies on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLOCK, lines_of, n_tokens, percent, tokens
from . import ledger, segment
from .order import kept

REGISTERED = 2000


def with_lines(snaps: DataFrame, text: str = "text") -> DataFrame:
    out = snaps.withColumn("lines", lines_of(F.col(text))).drop(text)
    return out.withColumn("n", F.transform("lines", n_tokens))


def spans_of(snaps: DataFrame, least: int, joiner: str = "") -> DataFrame:
    """One row for each packed span: the snapshot's other columns, s, e, n and its content key."""
    keep = [c for c in snaps.columns if c not in ("lines", "n")]
    out = snaps.select(*keep, "lines", F.explode(segment.pack(F.col("n"), least)).alias("x"))
    text = F.array_join(F.slice("lines", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")), joiner)
    return out.select(*keep, "x.s", "x.e", "x.n", F.sha2(text.cast("binary"), 256).alias("key"))


def _reuse(spans: DataFrame) -> DataFrame:
    owned = ledger.first_owners(spans, "key", ["sid", "snap", "s"] + (["task"] if "task" in spans.columns else []))
    again = F.struct("sid", "snap", "s") != F.struct("first.sid", "first.snap", "first.s")
    return owned.withColumn("again", again)


def _if(cond, value):
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))


def reuse(snaps: DataFrame, least: int = 500, sidecar: int = 0) -> DataFrame:
    """Reuse of spans from their second occurrence on, by the first owner: one row."""
    whole = snaps.select((F.coalesce(F.sum(F.aggregate("n", F.lit(0), lambda a, x: a + x)), F.lit(0)) + sidecar).alias("stream_tokens"), F.countDistinct("sid").alias("sessions"))
    again, n = F.col("again"), F.col("n")
    same, task = F.col("first.sid") == F.col("sid"), F.col("first.task") == F.col("task")
    part = _reuse(spans_of(snaps, least)).agg(
        _if(again, n).alias("reused"),
        _if(again & same, n).alias("same_session"),
        _if(again & ~same & task, n).alias("cross_run_same_task"),
        _if(again & ~same & ~task, n).alias("cross_task"),
        _if(F.lit(True), n).alias("span_tokens"),
    )
    return whole.crossJoin(part).withColumn("pic_pct", percent(F.col("reused"), F.col("stream_tokens")))  # one row each


def one_per_task(snaps: DataFrame) -> DataFrame:
    """Snapshots of each task's first session only."""
    first = snaps.groupBy("task").agg(F.min("sid").alias("sid"))
    return snaps.join(first, ["task", "sid"], "left_semi")


def disjoint(snaps: DataFrame, least: int = 500, sidecar: int = 0) -> DataFrame:
    """Tokens that the shared opening of sessions serves, then reuse of the spans beyond it: one row.

    Spans wholly inside a session's shared opening neither score nor register; a span
    across its end scores in full.
    """
    order = Window.partitionBy("sid").orderBy("snap").rowsBetween(Window.unboundedPreceding, -1)
    snaps = snaps.withColumn("base", F.coalesce(F.sum(F.size("lines")).over(order), F.lit(0)))
    units = snaps.select("sid", "base", F.posexplode(F.arrays_zip("lines", "n")).alias("i", "u")).select("sid", (F.col("base") + F.col("i")).alias("pos"), F.col("u.lines").alias("line"), F.col("u.n").alias("n"))
    cuts = ledger.shared_prefix(ledger.prefix_fingerprint(units, ["sid"], "pos", F.col("line")), "sid", "pos", REGISTERED)
    opening = units.join(cuts, "sid").agg(_if(F.lit(True), F.col("n")).alias("stream"), _if(F.col("pos") < F.col("cut"), F.col("n")).alias("prefix_tokens"), F.countDistinct("sid").alias("sessions"))
    spans = spans_of(snaps, least).join(cuts, "sid").where(F.col("base") + F.col("e") > F.col("cut"))
    again, same = F.col("again"), F.col("first.sid") == F.col("sid")
    part = _reuse(spans).agg(_if(again, F.col("n")).alias("pic_tokens"), _if(again & same, F.col("n")).alias("in_session"), _if(again & ~same, F.col("n")).alias("cross_session"))
    both = opening.crossJoin(part).withColumn("stream_tokens", F.col("stream") + sidecar)  # one row each
    return both.select(
        "sessions", "stream_tokens", "prefix_tokens", "pic_tokens", "in_session", "cross_session",
        percent(F.col("prefix_tokens"), F.col("stream_tokens")).alias("prefix_pct"), percent(F.col("pic_tokens"), F.col("stream_tokens")).alias("pic_pct"),
    )


def trajectories(messages: DataFrame, least: int = 500, system_as_prefix: bool = True) -> DataFrame:
    """Reuse over (traj, grp, msg, role, text): decoded text counts nowhere, system text only in the total: one row.

    A message's spans are known to others from its end on; msg orders all messages.
    """
    rows = messages.where("role <> 'decode'").withColumn("lines", F.split("text", "\n", -1))
    rows = rows.withColumn("n", F.transform("lines", lambda x: n_tokens(F.concat(x, F.lit("\n")))))
    system = rows.where("role = 'system'") if system_as_prefix else rows.limit(0)
    scored = rows.where("role <> 'system'") if system_as_prefix else rows
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    side = system.agg(_if(F.lit(True), total("n")).alias("system_tokens"))
    spans = scored.select("traj", "grp", "msg", "lines", F.explode(segment.pack(F.col("n"), least, least, True)).alias("x"))
    text = F.array_join(F.slice("lines", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")), "\n")
    spans = spans.select("traj", "grp", "msg", F.col("x.n").alias("n"), F.when(F.col("x.n") >= least, F.sha2(text.cast("binary"), 256)).alias("key"))
    spans = kept(spans)
    owned = ledger.first_owners(spans.where("key IS NOT NULL"), "key", ["msg", "traj", "grp"])
    again = F.col("first.msg") < F.col("msg")
    same, group = F.col("first.traj") == F.col("traj"), F.col("first.grp") == F.col("grp")
    n = F.col("n")
    reused = owned.agg(
        _if(again, n).alias("reused_tokens"), _if(again & same, n).alias("in_session"), _if(again & ~same & group, n).alias("cross_same_group"),
        _if(again & ~same & ~group, n).alias("cross_other_group"), F.countDistinct("key").alias("unique_spans"),
    )
    counts = spans.agg(_if(F.lit(True), n).alias("span_tokens"), F.count("*").alias("spans"), _if(F.col("key").isNull(), n).alias("uncacheable_tokens"))
    out = counts.crossJoin(side).crossJoin(reused)  # one row each
    out = out.withColumn("total_tokens", F.col("span_tokens") + F.col("system_tokens"))
    return out.withColumn("reuse_pct", percent(F.col("reused_tokens"), F.col("total_tokens")))


def blocks(rows: DataFrame, of: list[str], text: str = "text", size: int = BLOCK) -> DataFrame:
    """(of, q, block) for each full block of `size` tokens."""
    out = rows.select(*of, tokens(F.col(text)).alias("t")).where(F.size("t") >= size)
    q = F.sequence(F.lit(0), (F.floor(F.size("t") / size) - 1).cast("int"))
    return out.select(*of, "t", F.explode(q).alias("q")).select(*of, "q", F.array_join(F.slice("t", F.col("q") * size + 1, size), "\x1f").alias("block"))


def chained_prefix(prompts: DataFrame, of: str = "pid", size: int = BLOCK) -> DataFrame:
    """(of, blocks, cut): full blocks of each prompt and how many leading ones earlier prompts open with."""
    rows = blocks(prompts, [of], size=size)
    rows = ledger.prefix_fingerprint(rows, [of], "q", F.col("block"))
    cuts = ledger.shared_prefix(rows, of, "q")
    return rows.groupBy(of).agg(F.count("*").alias("blocks")).join(cuts, of)


def prefix_share(prompts: DataFrame, size: int = BLOCK) -> DataFrame:
    """Tokens in full blocks and those of them that a prefix cache serves: one row."""
    out = chained_prefix(prompts, size=size).agg((_if(F.lit(True), F.col("blocks")) * size).alias("block_tokens"), (_if(F.lit(True), F.col("cut")) * size).alias("served_tokens"))
    return out.withColumn("prefix_pct", percent(F.col("served_tokens"), F.col("block_tokens")))


def schema_reuse(prompts: DataFrame, least: int = 500, joiner: str = "", owner: str = "pid") -> DataFrame:
    """Reuse of packed schema units over (pid, head, units): one row."""
    rows = prompts.select(F.col("pid").alias("sid"), F.lit(0).alias("snap"), F.col(owner).cast("string").alias("task"), "head", F.col("units").alias("lines"), F.transform("units", n_tokens).alias("n"))
    whole = rows.agg(_if(F.lit(True), n_tokens(F.col("head")) + F.aggregate("n", F.lit(0), lambda a, x: a + x)).alias("full_tokens"))
    again, same, n = F.col("again"), F.col("first.task") == F.col("task"), F.col("n")
    part = _reuse(spans_of(rows.drop("head"), least, joiner)).agg(_if(again, n).alias("reused"), _if(again & same, n).alias("same_session"), _if(again & ~same, n).alias("cross_task"))
    return whole.crossJoin(part).withColumn("pic_pct", percent(F.col("reused"), F.col("full_tokens")))  # one row each


def block_reuse(snaps: DataFrame, size: int = BLOCK) -> DataFrame:
    """Reuse of blocks of tokens wherever they stand, over (sid, snap, text): one row."""
    # the key is exchanged, the tokens are not
    rows = blocks(snaps, ["sid", "snap"], size=size).withColumn("block", F.unhex(F.md5(F.col("block").cast("binary"))))
    owned = ledger.first_owners(kept(rows), "block", ["sid", "snap", "q"])
    again = (F.struct("sid", "snap", "q") != F.col("first")).cast("int")
    each = owned.groupBy("sid", "snap").agg(F.count("*").alias("t"), F.sum(again).alias("r"))
    return each.agg(
        F.count("*").alias("outputs"), _if(F.col("r") > 0, F.lit(1)).alias("hit_outputs"), (_if(F.lit(True), F.col("r")) * size).alias("reused_tokens"), (_if(F.lit(True), F.col("t")) * size).alias("block_tokens"),
        F.round(F.lit(100.0) * F.avg(F.col("r") / F.col("t")), 2).alias("mean_reuse_pct"),
    )


def line_dedup(snaps: DataFrame, text: str = "text") -> DataFrame:
    """Characters in lines, and in lines seen before; lines stripped, blank ones left out: one row."""
    lines = snaps.select(F.explode(F.split(text, "\n", -1)).alias("line")).select(F.trim("line").alias("line")).where("line <> ''")
    # a hash and a length are exchanged, lines are not
    each = lines.select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"), F.length("line").alias("n")).groupBy("key", "n").agg(F.count("*").alias("k"))
    n = F.col("n")
    return each.agg(_if(F.lit(True), n * F.col("k")).alias("total_chars"), _if(F.lit(True), n * (F.col("k") - 1)).alias("dup_chars")).withColumn("dup_pct", percent(F.col("dup_chars"), F.col("total_chars")))


def head_once(steps: DataFrame, least: int = 500, size: int = BLOCK) -> DataFrame:
    """Reuse over (sid, step, head, obs) where a session's head counts once: one row.

    The observation lines that the prefix cache already serves are skipped first fit: a
    line that does not fit is kept and later, shorter ones may still be skipped.
    """
    rows = steps.withColumn("pid", F.struct("sid", "step"))
    rows = rows.withColumn("head_n", n_tokens(F.col("head"))).withColumn("obs_n", n_tokens(F.concat("head", "obs")) - F.col("head_n"))
    served = chained_prefix(rows.select("pid", F.concat("head", "obs").alias("text")), size=size).select("pid", (F.col("cut") * size).alias("served"))
    rows = rows.join(served, "pid", "left").withColumn("served", F.coalesce("served", F.lit(0)))
    rows = rows.withColumn("skip", F.greatest(F.lit(0), F.col("served") - F.col("head_n")))
    first = F.col("step") == 0
    whole = rows.agg(
        _if(F.lit(True), F.col("obs_n") + F.when(first, F.col("head_n")).otherwise(0)).alias("stream_tokens"), _if(first, F.col("head_n")).alias("head_tokens"),
        _if(F.lit(True), F.when(first, F.col("served")).otherwise(F.col("skip"))).alias("prefix_tokens"),
    )
    lines = F.filter(F.split("obs", "\n", -1), lambda x: F.trim(x) != "")
    start = F.struct(F.lit(0).cast("bigint").alias("acc"), F.array().cast("array<string>").alias("kept"))

    def fit(a, x):
        fits = a["acc"] + n_tokens(x) <= F.col("skip")
        return F.struct(F.when(fits, a["acc"] + n_tokens(x)).otherwise(a["acc"]).alias("acc"), F.when(fits, a["kept"]).otherwise(F.concat(a["kept"], F.array(x))).alias("kept"))

    kept = rows.withColumn("lines", F.when(F.col("skip") > 0, F.aggregate(lines, start, fit, lambda a: a["kept"])).otherwise(lines))
    snaps = kept.select("sid", F.col("step").alias("snap"), "lines", F.transform("lines", n_tokens).alias("n"))
    again, same, n = F.col("again"), F.col("first.sid") == F.col("sid"), F.col("n")
    part = _reuse(spans_of(snaps, least)).agg(_if(again & same, n).alias("in_session"), _if(again & ~same, n).alias("cross_session"))
    return whole.crossJoin(part)  # one row each
