"""The rows of the study: each is a source, a treatment and a measure.

Every function takes DataFrames as the readers give them and returns one row with
prefix_pct, pic_pct (as it is), pic_proc_pct (treated), in_session and cross_session in
percent of the stream's tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import head_of, n_tokens, percent, repo_key
from ..operators import measure, order, parse, treat
from ..sources import readers

LEAST = 500


def _out(raw: DataFrame, treated: DataFrame | None = None, prefix_of_treated: bool = False) -> DataFrame:
    """One row of percentages from one-row results of measure.disjoint."""
    share = lambda c: percent(F.col(c), F.col("stream_tokens"))
    a = raw.select("pic_pct") if prefix_of_treated else raw.select("prefix_pct", "pic_pct")
    b = (treated if treated is not None else raw).select(*(["prefix_pct"] if prefix_of_treated else []), F.col("pic_pct").alias("pic_proc_pct"), share("in_session").alias("in_session"), share("cross_session").alias("cross_session"))
    return a.crossJoin(b)  # one row each


def plain(snaps: DataFrame, least: int = LEAST, dedup: bool = False) -> DataFrame:
    """Prompts, manifests, alerts, tool outputs as they are; dedup keeps each task's first session."""
    return _out(measure.disjoint(measure.with_lines(measure.one_per_task(snaps) if dedup else snaps), least))


def treated(snaps: DataFrame, after: DataFrame, least: int = LEAST, sidecar: int = 0, prefix_of_treated: bool = False) -> DataFrame:
    return _out(measure.disjoint(measure.with_lines(snaps), least), measure.disjoint(measure.with_lines(after), least, sidecar), prefix_of_treated)


def masked(snaps: DataFrame, fields: list[str], least: int = LEAST) -> DataFrame:
    """Traces: one session for each task, fields masked."""
    first = measure.one_per_task(snaps)
    return treated(first, first.withColumn("text", treat.mask_all(F.col("text"), fields)), least)


def replaced(snaps: DataFrame, attribute: str, least: int = LEAST) -> DataFrame:
    """Pages: an attribute's values replaced by stable handles."""
    return treated(snaps, treat.replace_attribute(snaps, ["sid", "snap", "task"], attribute), least)


def enveloped(snaps: DataFrame, least: int = LEAST) -> DataFrame:
    """JSON envelopes: bodies in place, metadata moved to the side; the side counts in the stream.

    Outputs count if their body has 80 characters; the metadata of shorter ones still counts.
    """
    first = measure.one_per_task(snaps).withColumn("text", treat.canonical_json(F.col("text")))
    body, side = treat.relocate_envelope(F.col("text"))
    rows = first.withColumn("body", body).withColumn("side", side)
    moved = rows.agg(F.coalesce(F.sum(n_tokens(F.col("side"))), F.lit(0)).alias("n")).first()["n"]
    rows = rows.where(F.length("body") >= 80).drop("side")
    return treated(rows.drop("body"), rows.drop("text").withColumnRenamed("body", "text"), least, moved)


def _joined(lines: DataFrame, text: Column) -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct("i", text.alias("t"))))
    return lines.groupBy("sid", "snap").agg(F.array_join(F.transform(each, lambda x: x["t"]), "\n").alias("text")).withColumn("task", F.col("sid").cast("string"))


def columned_log(lines: DataFrame, at: tuple[int, ...] = (1, 4), least: int = LEAST) -> DataFrame:
    """Log lines (sid, snap, i, line) with volatile columns moved to the side; the prefix is that of the relocated stream."""
    body, side = treat.relocate_positions(F.col("line"), at)
    moved = lines.agg(F.coalesce(F.sum(n_tokens(side)), F.lit(0)).alias("n")).first()["n"]
    return treated(_joined(lines, F.col("line")), _joined(lines, body), least, moved, prefix_of_treated=True)


def dialogues(passages: DataFrame, least: int = LEAST) -> DataFrame:
    """Passages (task, snap, pos, text) are the units of a turn; sessions by `arrived` or `sid`, where there is one, else by task.

    A task that arrives twice keeps its first session.
    """
    by = next((c for c in ("arrived", "sid") if c in passages.columns), "task")
    met = passages.groupBy("task").agg(F.min(by).alias("first__"))
    first = order.numbered(met, ["first__", "task"]).withColumnRenamed("rn", "sid")
    passages = passages.withColumn("by__", F.col(by)).join(met, "task").where("by__ = first__").drop("by__", "first__", "sid")
    first = first.select("task", "sid")
    rows = passages.join(first, "task").groupBy("sid", "snap", "task").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("lines"))
    return _out(measure.disjoint(rows.withColumn("n", F.transform("lines", n_tokens)), least))


def last_collection(passages: DataFrame, part: str) -> DataFrame:
    """Passages of the last domain, by name, that contains `part`."""
    last = passages.where(F.col("domain").contains(part)).agg(F.max("domain").alias("domain"))
    return passages.join(F.broadcast(last), "domain")  # one row


def aligned(tasks: DataFrame, documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Documents that tasks need: end to end, against whole buckets of documents."""
    first = order.numbered(tasks.select("task").distinct(), ["task"]).withColumnRenamed("rn", "sid")
    rows = tasks.join(first, "task")
    text = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "text"))), lambda x: x["text"]), "\n").alias("text")
    whole = rows.withColumn("snap", F.lit(0)).groupBy("sid", "snap", "task").agg(text("pos"))
    owner = treat.buckets(documents.withColumn("grp", F.lit(0)), least).select("doc_id", "bucket")
    filled = documents.join(owner, "doc_id").groupBy("bucket").agg(text("doc_id"))
    used = rows.join(owner, "doc_id").select("sid", "task", "bucket").distinct().join(filled, "bucket").withColumnRenamed("bucket", "snap")
    return treated(whole, used, least)


def coding(messages: DataFrame, least: int = LEAST, most: int = 1000) -> DataFrame:
    """Trajectories (traj_id, instance_id, msg, role, text), one for each instance, grouped by repository."""
    first = messages.groupBy("instance_id").agg(F.min("traj_id").alias("traj_id"))  # ids sort by arrival
    first = order.numbered(first, ["traj_id", "instance_id"]).where(F.col("rn") < most)  # the corpus is defined by its first trajectories
    rows = messages.join(first.select("traj_id", "rn"), "traj_id")
    if "system_prompt" in messages.columns:  # a system prompt comes before the message that carries it
        rows = parse.with_system_prompts(rows).withColumn("msg", F.struct("msg", "part"))
    else:
        rows = parse.roles(rows)
    rows = order.numbered(rows.select("rn", "instance_id", F.col("msg").alias("at"), "role", "text").withColumnRenamed("rn", "traj"), ["traj", "at"])
    out = measure.trajectories(rows.select("traj", repo_key(F.col("instance_id")).alias("grp"), F.col("rn").alias("msg"), "role", "text"), least)
    share = lambda c: percent(F.col(c), F.col("total_tokens"))
    cross = F.col("cross_same_group") + F.col("cross_other_group")
    return out.select(share("system_tokens").alias("prefix_pct"), F.col("reuse_pct").alias("pic_pct"), F.col("reuse_pct").alias("pic_proc_pct"), share("in_session").alias("in_session"), percent(cross, F.col("total_tokens")).alias("cross_session"))


def web_steps(prompts: DataFrame, least: int = LEAST) -> DataFrame:
    """Prompts of web agents: a head that counts once for each session, and observations with handles replaced."""
    head = head_of(F.col("text"))
    steps = prompts.select("sid", F.col("snap").alias("step"), head.alias("head"), F.substring(F.col("text"), F.length(head) + 1, F.length("text")).alias("obs"))
    seen = treat.replace_by_line(steps.withColumnRenamed("obs", "text"), ["sid", "step", "head"]).withColumnRenamed("text", "obs")
    share = lambda c: percent(F.col(c), F.col("stream_tokens"))
    raw = measure.head_once(steps, least).select(percent(F.col("in_session") + F.col("cross_session"), F.col("stream_tokens")).alias("pic_pct"))
    new = measure.head_once(seen, least)
    return new.select(share("prefix_tokens").alias("prefix_pct"), percent(F.col("in_session") + F.col("cross_session"), F.col("stream_tokens")).alias("pic_proc_pct"), share("in_session").alias("in_session"), share("cross_session").alias("cross_session")).crossJoin(raw)


def schemas(prompts: DataFrame, joiner: str = "", owner: str = "pid", least: int = LEAST) -> DataFrame:
    """Prompts (pid, task, head, units): the prefix cache's share with the schema first and after, and reuse of its units."""
    text = F.array_join("units", "\n")
    first = measure.prefix_share(prompts.select("pid", F.concat_ws("\n", text, "head").alias("text"))).select(F.col("prefix_pct").alias("prefix_schema_first"))
    after = measure.prefix_share(prompts.select("pid", F.concat_ws("\n", "head", text).alias("text"))).select(F.col("prefix_pct").alias("prefix_schema_after"))
    share = lambda c: percent(F.col(c), F.col("full_tokens"))
    pic = measure.schema_reuse(prompts, least, joiner, owner).select("pic_pct", F.col("pic_pct").alias("pic_proc_pct"), share("same_session").alias("in_session"), share("cross_task").alias("cross_session"))
    return first.crossJoin(after).crossJoin(pic)  # one row each


def measured(names: dict[str, tuple], spark, skip_failures: bool = True, **options) -> list[dict]:
    """Runs rows of the study on their files, as {name: paths}; a row that fails says so and the others go on."""
    out = []
    for name, paths in names.items():
        try:
            got = run_row(spark, name, *paths, **options).first()
            out.append({"row": name, **(got.asDict() if got else {})})
        except Exception as e:  # noqa: BLE001  a stage of its own
            if not skip_failures:
                raise
            out.append({"row": name, "failed": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"})
    return out


#: How each row of the study is put together, on what its reader gives.
STUDY = {
    "WildChat": plain, "PAWS": plain, "SWE-smith": coding, "OpenHands": coding, "SWE-agent": coding, "CC-Bench": lambda x, **k: coding(parse.code_messages(x) if "kind" in x.columns else x, **k), "NNetNav-WA": web_steps, "NNetNav-Live": web_steps,
    "Mind2Web": lambda x, **k: replaced(x, "backend_node_id", **k), "ITBench SRE": enveloped, "ITBench K8s": plain, "ITBench alerts": plain, "BGL": columned_log,
    "AppWorld": lambda x, **k: masked(x, ["json:release_date"], **k), "tau2 airline": lambda x, **k: plain(x, dedup=True, **k), "tau2 retail": lambda x, **k: plain(x, dedup=True, **k), "tau2 telecom": lambda x, **k: plain(x, dedup=True, **k),
    "MT-RAG": lambda x, **k: dialogues(last_collection(x, "ibmcloud"), **k), "MultiDoc2Dial": dialogues, "tau-Knowledge": aligned, "Spider 2.0": lambda x, **k: schemas(x, "\n", **k), "BIRD": schemas,
    "LiveSQLBench": lambda x, **k: schemas(x, "\n", "task", **k), "BIRD-INTERACT": lambda x, **k: schemas(x, "\n", "task", **k),
}


#: Readers of each row's files, as DataFrames for its plan: (spark, *paths) -> tuple.
SOURCES = {
    "WildChat": readers.wildchat, "PAWS": readers.paws, "SWE-smith": readers.chat_trajectories, "OpenHands": lambda s, p: readers.chat_trajectories(s, p, "trajectory"),
    "SWE-agent": readers.agent_trajectories, "CC-Bench": readers.code_events, "NNetNav-WA": readers.web_prompts, "NNetNav-Live": readers.web_prompts, "Mind2Web": readers.web_pages,
    "ITBench SRE": lambda s, p: readers.tool_outputs(s, p, least_chars=0), "ITBench K8s": readers.file_sessions, "ITBench alerts": readers.alerts, "BGL": readers.log_slices, "AppWorld": readers.app_traces,
    "tau2 airline": lambda s, p: readers.simulations(s, p, "airline"), "tau2 retail": lambda s, p: readers.simulations(s, p, "retail"), "tau2 telecom": lambda s, p: readers.simulations(s, p, "telecom"),
    "MT-RAG": readers.retrieval_dialogues, "MultiDoc2Dial": readers.grounded_dialogues, "Spider 2.0": lambda s, q, ddl: readers.schema_questions(s, q, readers.table_schemas(s, ddl)),
    "BIRD": lambda s, q, schemas: readers.schema_questions(s, q, readers.exported_schemas(s, schemas)),
}


def _knowledge(spark, documents, tasks) -> tuple[DataFrame, DataFrame]:
    docs = readers.knowledge_documents(spark, documents)
    return readers.knowledge_tasks(spark, tasks, docs), docs


SOURCES |= {"tau-Knowledge": _knowledge, "LiveSQLBench": readers.interactive_prompts, "BIRD-INTERACT": readers.interactive_prompts}


def run_row(spark, name: str, *paths, **options) -> DataFrame:
    """A row of the study from its files: reader, treatment and measure."""
    found = SOURCES[name](spark, *paths)
    return STUDY[name](*(found if isinstance(found, tuple) else (found,)), **options)
