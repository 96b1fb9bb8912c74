"""Parsing of message logs and viewer output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_path

# The viewers' headers and line formats.
VIEWERS = {
    "cat_n": (r"result of running `cat -n` on (?:a snippet of )?([^\n:]+):", r"^\s*([0-9]+)\t(.*)$"),
    "swe_agent": (r"\[File: ([^\n\]]+?) \([0-9]+ lines total\)\]", r"^\s*([0-9]+):(.*)$"),
    "arrow": (None, r"^\s*([0-9]+)→(.*)$"),
}


def role_of(role: Column) -> Column:
    return F.when(role == "system", "system").when(role.isin("assistant", "ai"), "decode").otherwise("input")


def roles(messages: DataFrame) -> DataFrame:
    """Messages with text, by what they are to the cache: system, decode (generated) or input."""
    return messages.where("text IS NOT NULL AND text <> ''").withColumn("role", role_of(F.col("role")))


def with_system_prompts(messages: DataFrame) -> DataFrame:
    """Messages whose system_prompt field, where there is one, comes first as a message of its own."""
    rows = F.filter(F.array(F.struct(F.lit(0).alias("part"), F.lit("system").alias("role"), F.col("system_prompt").alias("text")), F.struct(F.lit(1).alias("part"), F.col("role"), F.col("text"))), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    keep = [c for c in messages.columns if c not in ("role", "text", "system_prompt")]
    return roles(messages.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.part", "x.role", "x.text"))


def block_text(blocks: Column) -> Column:
    """The texts of content blocks, end to end."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")


def leading_run(lines: Column, pattern: str) -> Column:
    """array<struct<no, text>>: the first run of numbered lines; what stands before it is passed over."""
    start = F.struct(F.lit(0).alias("st"), F.array().cast("array<struct<no:int,text:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        hit = x.rlike(pattern)
        item = F.struct(F.regexp_extract(x, pattern, 1).cast("int").alias("no"), F.regexp_extract(x, pattern, 2).alias("text"))
        state = F.when(a["st"] == 2, 2).when(hit, 1).when(a["st"] == 1, 2).otherwise(0)
        return F.struct(state.alias("st"), F.when(hit & (a["st"] < 2), F.concat(a["out"], F.array(item))).otherwise(a["out"]).alias("out"))

    return F.aggregate(lines, start, step, lambda a: a["out"])


def reads(messages: DataFrame, viewer: str, text: str = "text") -> DataFrame:
    """A row for each file shown in an observation: the other columns, nth, path and lines (two at least)."""
    head, line = VIEWERS[viewer]
    keep = [c for c in messages.columns if c != text]
    if head is None:
        rows = messages.withColumn("nth", F.lit(0)).withColumn("body", F.col(text)).withColumn("path", F.coalesce(F.col("path"), F.lit("?")) if "path" in keep else F.lit("?"))
    else:
        rows = messages.select(*keep, F.regexp_extract_all(F.col(text), F.lit(head), F.lit(1)).alias("paths"), F.split(text, head, -1).alias("bodies"))
        rows = rows.select(*keep, F.posexplode(F.arrays_zip("paths", F.slice("bodies", 2, F.size("paths")).alias("body"))).alias("nth", "x"))
        rows = rows.select(*keep, "nth", F.col("x.paths").alias("path"), F.col("x.body").alias("body"))
    rows = rows.select(*[c for c in keep if c != "path"], "nth", norm_path(F.col("path")).alias("path"), leading_run(F.split("body", "\n", -1), line).alias("lines"))
    return rows.where(F.size("lines") >= 2)


def code_messages(events: DataFrame) -> DataFrame:
    """Events of sources.readers.code_events as messages: (traj_id, instance_id, msg, role, text, tool, call).

    Calls are generated, results are input; a result has the tool and path of its call.
    """
    calls = match_calls(events.withColumn("task", F.col("traj")).withColumn("traj", F.col("run"))).select(F.col("traj").alias("run"), "seq", F.col("path").alias("call"), F.col("tool").alias("used"))
    role = F.when(F.col("kind") == "tool_use", "assistant").when(F.col("kind") == "tool_result", "user").otherwise(F.col("role"))
    rows = events.join(calls, ["run", "seq"], "left")
    return rows.select(F.col("run").alias("traj_id"), F.col("traj").alias("instance_id"), F.col("seq").alias("msg"), role.alias("role"), "text", F.coalesce("used", "tool").alias("tool"), F.coalesce("call", "path").alias("call"))


def read_trajectories(messages: DataFrame, viewer: str) -> DataFrame:
    """(traj_id, reads, n_msgs, msg_chars, read_chars) of the trajectories that show a file.

    messages: traj_id, msg, text, and path where the viewer's calls name it.
    """
    shown = reads(messages.select("traj_id", "msg", "text", *[c for c in messages.columns if c == "path"]), viewer)
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    shown = shown.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("msg", "nth", "path", "lines"))).alias("reads"), F.sum(chars).alias("read_chars"))
    sizes = messages.groupBy("traj_id").agg(F.countDistinct("msg").alias("n_msgs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("msg_chars"))
    return shown.join(sizes, "traj_id").select("traj_id", F.transform("reads", lambda r: F.struct(r["path"].alias("path"), r["lines"].alias("lines"))).alias("reads"), "n_msgs", "msg_chars", "read_chars")


def match_calls(events: DataFrame) -> DataFrame:
    """Tool results of (traj, seq, kind, use_id, path, text) with the path of the last earlier call of that id, or `?`, and its tool."""
    tool = F.col("tool") if "tool" in events.columns else F.lit(None).cast("string")
    calls = events.where("kind = 'tool_use'").select("traj", "use_id", F.col("seq").alias("call_seq"), F.col("path").alias("call_path"), tool.alias("call_tool"))
    results = events.where("kind = 'tool_result'").select("traj", "seq", "use_id", "text")
    met = results.join(calls, ["traj", "use_id"], "left").withColumn("early", F.col("call_seq") < F.col("seq"))
    best = met.groupBy("traj", "seq", "use_id", "text").agg(F.max(F.when(F.col("early"), F.struct("call_seq", "call_path", "call_tool"))).alias("call"))
    return best.select("traj", "seq", "use_id", "text", F.coalesce("call.call_path", F.lit("?")).alias("path"), *([F.col("call.call_tool").alias("tool")] if "tool" in events.columns else []))
