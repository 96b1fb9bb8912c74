"""Readers of the corpora: each gives sessions as rows with explicit order columns.

Snapshots are (sid, snap, task, text); messages (traj_id, instance_id, msg, role, text);
prompts (pid, task, head, units). Order comes from files and lines, never from the order
in which rows happen to arrive. Schemas are declared; missing fields read as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import order

LEAST_CHARS = 80


def lines(spark: SparkSession, path) -> DataFrame:
    """(file, at, value): at orders the lines of a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return rows.select("file", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("at"), "value")


def _run(file: str, block: str, row: str) -> Column:
    """A name of a trajectory that sorts by file and line."""
    return F.concat_ws(":", F.col(file), F.lpad(F.col(block).cast("string"), 20, "0"), F.lpad(F.col(row).cast("string"), 20, "0"))


def _parquet_runs(spark: SparkSession, path) -> DataFrame:
    """Rows of Parquet files with traj_id, which sorts by file and row."""
    rows = spark.read.parquet(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file__"), F.col("_metadata.row_index").alias("row__")).withColumn("traj_id", _run("file__", "row__", "row__")).drop("file__", "row__")


def whole_files(spark: SparkSession, path, depth: int = 2) -> DataFrame:
    """(folder, file, text) of each file."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))


def json_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    return lines(spark, path).select("file", "at", F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("file", "at", "r.*")


def sessions(rows: DataFrame, of: list[str], arrival: list[str], least: int = 2, most: int | None = None) -> DataFrame:
    """rows with sid and snap: groups of `of` with enough rows, numbered by their first arrival.

    most keeps the sessions that arrive first, which is part of some corpora's definition.
    """
    first = rows.groupBy(*of).agg(F.min(F.struct(*arrival)).alias("arrived"), F.count("*").alias("k")).where(F.col("k") >= least)
    first = order.numbered(first.drop("k"), ["arrived", *of]).withColumnRenamed("rn", "sid")
    if most is not None:
        first = first.where(F.col("sid") < most)
    snap = F.row_number().over(Window.partitionBy("sid").orderBy(*arrival)) - 1
    return rows.join(first.drop("arrived"), of).withColumn("snap", snap)


def _first_user(turns: Column) -> Column:
    users = F.filter(turns, lambda t: t["role"] == "user")
    return F.when(F.size(users) > 0, F.get(users, F.lit(0))["content"]).otherwise(F.get(turns, F.lit(0))["content"])


def wildchat(spark: SparkSession, path, most: int = 40_000) -> DataFrame:
    """The first user turn of each conversation, each its own session."""
    rows = spark.read.schema("conversation_hash string, timestamp timestamp, conversation array<struct<role:string,content:string>>").parquet(path)
    rows = rows.select("conversation_hash", "timestamp", _first_user(F.col("conversation")).alias("text")).where("text <> ''")
    out = order.numbered(rows, ["timestamp", "conversation_hash", "text"]).where(F.col("rn") < most)
    return out.select(F.col("rn").alias("sid"), F.lit(0).alias("snap"), F.col("rn").cast("string").alias("task"), "text")


def paws(spark: SparkSession, path, most: int = 40_000) -> DataFrame:
    """Both sentences of each pair, each its own session."""
    rows = json_lines(spark, path, "sentence1 string, sentence2 string")
    rows = rows.select("file", "at", F.posexplode(F.array("sentence1", "sentence2")).alias("side", "text")).where("text <> ''")
    out = order.numbered(rows, ["file", "at", "side"]).where(F.col("rn") < most)
    return out.select(F.col("rn").alias("sid"), F.lit(0).alias("snap"), F.col("rn").cast("string").alias("task"), "text")


TURNS = "array<struct<role:string,content:string>>"


def chat_trajectories(spark: SparkSession, path, column: str = "messages") -> DataFrame:
    """Messages of trajectories held as a JSON string or as an array of turns; other columns of the message stay out.

    traj_id sorts by arrival; a trajectory without messages gives one row without text, so that it is still its task's first.
    """
    rows = _parquet_runs(spark, path)
    turns = F.from_json(column, TURNS) if dict(rows.dtypes)[column] == "string" else F.col(column)
    rows = rows.select("instance_id", "traj_id", F.posexplode_outer(turns).alias("msg", "m"))
    return rows.select("traj_id", "instance_id", "msg", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def agent_trajectories(spark: SparkSession, path) -> DataFrame:
    """Messages with a system_prompt field, for operators.parse.with_system_prompts."""
    rows = _parquet_runs(spark, path).select("instance_id", "traj_id", F.posexplode_outer("trajectory").alias("msg", "m"))
    return rows.select("traj_id", "instance_id", "msg", F.col("m.role").alias("role"), F.col("m.text").alias("text"), F.col("m.system_prompt").alias("system_prompt"))


EVENT = "struct<message:struct<role:string,content:string>>"
BLOCK = "array<struct<type:string,text:string,id:string,name:string,input:struct<file_path:string>,tool_use_id:string,content:string>>"


def code_events(spark: SparkSession, path) -> DataFrame:
    """Blocks of code-agent events: (traj, run, seq, kind, use_id, tool, path, text, role); a plain content is one text block.

    traj is the task, run one trajectory of it; runs sort by arrival, seq inside a run.
    """
    rows = json_lines(spark, path, f"task_id string, trajectory array<{EVENT}>")
    rows = rows.select(F.col("task_id").alias("traj"), _run("file", "at.block", "at.row").alias("run"), F.posexplode("trajectory").alias("ev", "e"))
    blocks = F.from_json("e.message.content", BLOCK)
    plain = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.col("e.message.content").alias("text"))), BLOCK[6:-1]))
    listed = F.col("e.message.content").startswith("[")
    rows = rows.select("traj", "run", "ev", F.col("e.message.role").alias("role"), F.posexplode(F.when(listed, blocks).otherwise(plain)).alias("i", "b"))
    inner = F.coalesce(F.array_join(F.transform(F.from_json("b.content", "array<struct<text:string>>"), lambda x: x["text"]), ""), F.col("b.content"))
    text = F.when(F.col("b.type") == "tool_result", inner).otherwise(F.col("b.text"))
    seq = F.shiftleft(F.col("ev").cast("long"), 32) + F.col("i")
    return rows.select("traj", "run", seq.alias("seq"), F.col("b.type").alias("kind"), F.coalesce("b.tool_use_id", "b.id").alias("use_id"), F.col("b.name").alias("tool"), F.col("b.input.file_path").alias("path"), F.coalesce(text, F.lit("")).alias("text"), "role")


def web_prompts(spark: SparkSession, path, tasks: int = 40, most_lines: int = 4000) -> DataFrame:
    """(sid, snap, task, prompt): tasks with two prompts at least, among the first lines."""
    rows = order.numbered(json_lines(spark, path, "id string, prompt string"), ["file", "at"]).where(F.col("rn") < most_lines).where("prompt <> ''")
    out = sessions(rows.withColumnRenamed("rn", "line"), ["id"], ["line"], 2, tasks)
    return out.select("sid", "snap", F.col("id").alias("task"), F.col("prompt").alias("text"))


#: Fixed value: what a mining snapshot is of a web agent's prompt.
OBSERVED = r"(?s)OBSERVATION:\s*\n(.*?)\nURL:"


def web_observations(spark: SparkSession, path, tasks: int = 40, most_lines: int = 4000) -> DataFrame:
    """(sid, snap, task, text): the observations between their headings, for mining; tasks with two at least."""
    rows = order.numbered(json_lines(spark, path, "id string, prompt string"), ["file", "at"]).where(F.col("rn") < most_lines)
    rows = rows.where(F.regexp_like("prompt", F.lit(OBSERVED))).select("id", F.col("rn").alias("line"), F.regexp_extract("prompt", OBSERVED, 1).alias("text"))
    return sessions(rows, ["id"], ["line"], 2, tasks).select("sid", "snap", F.col("id").alias("task"), "text")


def web_pages(spark: SparkSession, path, most: int = 25) -> DataFrame:
    """Cleaned pages of each task's actions."""
    rows = json_lines(spark, path, "annotation_id string, actions array<struct<cleaned_html:string>>")
    rows = rows.select("file", "at", "annotation_id", F.posexplode("actions").alias("i", "a")).select("file", "at", "annotation_id", "i", F.col("a.cleaned_html").alias("text")).where("text <> ''")
    return sessions(rows, ["file", "at"], ["file", "at", "i"], 2, most).select("sid", "snap", F.col("annotation_id").alias("task"), "text")


def tool_outputs(spark: SparkSession, path, most: int = 40, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Function outputs of incident trajectories, one file a session; task is the scenario in the path.

    plans.rows.enveloped takes all outputs (least_chars 0), as it judges their bodies.
    """
    rows = json_lines(spark, path, "payload struct<type:string,output:string>").where("payload.type = 'function_call_output'")
    rows = rows.select("file", "at", F.col("payload.output").alias("text")).where(F.length("text") >= least_chars)
    scenario = F.regexp_extract("file", "Scenario-[0-9]+", 0)
    return sessions(rows, ["file"], ["file", "at"], 2, most).select("sid", "snap", F.when(scenario == "", F.col("file")).otherwise(scenario).alias("task"), "text")


def file_sessions(spark: SparkSession, path, most: int = 200, name: str = "") -> DataFrame:
    """A folder is a session, its files in order are the snapshots; name is a pattern of the files' names."""
    rows = whole_files(spark, path).where(F.length("text") >= LEAST_CHARS).where(F.regexp_like(F.regexp_extract("file", "[^/]*$", 0), F.lit(name)))
    return sessions(rows, ["folder"], ["file"], 2, most).select("sid", "snap", F.col("folder").alias("task"), "text")


def alerts(spark: SparkSession, path, most: int = 40) -> DataFrame:
    """Alert files of each folder in order."""
    return file_sessions(spark, path, most, r"^alerts_at_.*\.json$")


def log_slices(spark: SparkSession, path, slices: int = 20, snapshot: int = 500) -> DataFrame:
    """Lines with content in equal slices, in snapshots of some lines; (sid, snap, i, line)."""
    rows = order.numbered(lines(spark, path).where(F.trim("value") != ""), ["file", "at"])
    per = rows.agg(F.floor(F.count("*") / slices).alias("per"))
    rows = rows.crossJoin(F.broadcast(per)).where(F.col("rn") < slices * F.col("per"))  # one row
    return rows.selectExpr("rn div per AS sid", f"(rn % per) div {snapshot} AS snap", f"(rn % per) % {snapshot} AS i", "value AS line")


#: Where an agent's task stands in its prompt, and a simulation's domain in its file's name.
INSTRUCTION, DOMAIN = r"(?s)# Real Task Instruction\n(.*?)(?:\n\n|$)", "_(airline|retail|telecom)_"


def app_traces(spark: SparkSession, path) -> DataFrame:
    """Tool messages of each trace's longest model call; task is the last instruction of a user message in it, else the trace."""
    rows = json_lines(spark, path, "trace_id string, attributes map<string,string>").where("attributes['openinference.span.kind'] = 'LLM'")
    number = lambda k: F.regexp_extract(k, r"^llm\.input_messages\.([0-9]+)\.message\.role$", 1)
    at = F.filter(F.transform(F.map_keys("attributes"), number), lambda x: x != "")
    rows = rows.withColumn("ks", F.transform(at, lambda x: x.cast("int")))
    first = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc(F.size("ks")), "file", "at"))
    each = rows.withColumn("nth", first).where("nth = 1").select("trace_id", "file", "at", "attributes", F.explode("ks").alias("k"))
    field = lambda name: F.element_at("attributes", F.concat(F.lit("llm.input_messages."), F.col("k").cast("string"), F.lit(f".message.{name}")))
    every = each.select("trace_id", "file", "at", "k", field("role").alias("role"), field("content").alias("text"))
    asked = every.where("role = 'user'").withColumn("task", F.regexp_extract("text", INSTRUCTION, 1)).where(F.regexp_like("text", F.lit(INSTRUCTION)))
    asked = asked.groupBy("trace_id").agg(F.max_by("task", "k").alias("task"))
    out = sessions(every.where("role = 'tool'").where(F.length("text") >= LEAST_CHARS), ["trace_id"], ["file", "at", "k"])
    return out.join(asked, "trace_id", "left").select("sid", "snap", F.coalesce("task", "trace_id").alias("task"), "text")


def simulations(spark: SparkSession, path, domain: str | None = None) -> DataFrame:
    """Tool messages without errors of each simulation, of files with the domain in their name; sessions in the order of their task."""
    schema = "simulations array<struct<task_id:string,messages:array<struct<role:string,error:boolean,content:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode("simulations").alias("run", "s"))
    if domain is not None:
        rows = rows.where(F.regexp_extract(F.regexp_extract("file", "[^/]*$", 0), DOMAIN, 1) == domain)
    rows = rows.select("file", "run", F.col("s.task_id").alias("task"), F.posexplode("s.messages").alias("i", "m"))
    rows = rows.where("m.role = 'tool' AND NOT coalesce(m.error, false)").where(F.length("m.content") >= LEAST_CHARS)
    rows = rows.select("file", "run", "task", "i", F.col("m.content").alias("text"))
    return sessions(rows, ["file", "run"], ["task", "file", "run", "i"]).select("sid", "snap", "task", "text")


def retrieval_dialogues(spark: SparkSession, path) -> DataFrame:
    """Passages retrieved for each message: (sid, snap, task, domain, pos, text)."""
    schema = "domain string, messages array<struct<contexts:array<struct<text:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), "domain", "messages")
    rows = order.numbered(rows, ["file", "row"]).withColumnRenamed("rn", "sid")
    rows = rows.select("sid", "domain", F.posexplode("messages").alias("snap", "m")).select("sid", "domain", "snap", F.posexplode("m.contexts").alias("pos", "c"))
    return rows.select("sid", "snap", F.concat_ws("/", "domain", F.col("sid").cast("string")).alias("task"), "domain", "pos", F.col("c.text").alias("text")).where(F.trim("text") != "")


def grounded_dialogues(spark: SparkSession, documents, dialogues) -> DataFrame:
    """Documents that each user turn of a dialogue refers to, each once in the order of reference."""
    docs = spark.read.schema("doc_data map<string,map<string,struct<doc_text:string>>>").json(documents, multiLine=True)
    docs = docs.select(F.explode("doc_data").alias("domain", "d")).select(F.explode("d").alias("doc_id", "x")).select("doc_id", F.col("x.doc_text").alias("text"))
    turn = "struct<role:string,references:array<struct<doc_id:string>>>"
    rows = spark.read.schema(f"dial_data map<string,array<struct<dial_id:string,turns:array<{turn}>>>>").json(dialogues, multiLine=True).select(F.col("_metadata.file_path").alias("file"), "dial_data")
    rows = rows.select("file", F.posexplode(F.map_entries("dial_data")).alias("d", "e")).select("file", "d", F.posexplode("e.value").alias("nth", "x"))
    rows = rows.select(F.struct("file", "d", "nth").alias("arrived"), "x.dial_id", F.posexplode("x.turns").alias("snap", "t")).where("t.role = 'user'")
    rows = rows.select("arrived", "dial_id", "snap", F.posexplode(F.array_distinct(F.transform("t.references", lambda r: r["doc_id"]))).alias("pos", "doc_id"))
    return rows.join(docs, "doc_id").select("arrived", F.col("dial_id").alias("task"), "snap", "pos", "doc_id", "text")


def knowledge_documents(spark: SparkSession, path) -> DataFrame:
    rows = spark.read.schema("id string, title string, content string").json(path, multiLine=True)
    return rows.select(F.col("id").alias("doc_id"), F.concat_ws("\n", "title", "content").alias("text"))


def knowledge_tasks(spark: SparkSession, path, documents: DataFrame) -> DataFrame:
    """(task, pos, doc_id, text) of the documents that each task needs and that exist, by id."""
    rows = spark.read.schema("id string, required_documents array<string>").json(path, multiLine=True)
    rows = rows.select(F.col("id").alias("task"), F.posexplode(F.array_sort("required_documents")).alias("pos", "doc_id"))
    return rows.join(documents, "doc_id").select("task", "pos", "doc_id", "text")


def table_schemas(spark: SparkSession, path) -> DataFrame:
    """(db, units): definitions by table name from <db>/DDL.csv; shards of a date count once."""
    rows = spark.read.schema("table_name string, DDL string").csv(path, header=True, multiLine=True, escape='"').withColumn("file", F.col("_metadata.file_path"))
    rows = rows.withColumn("db", F.regexp_extract("file", "([^/]+)/[^/]*$", 1)).withColumn("shard", F.regexp_replace("table_name", "[0-9]{8}$", "<DATE>"))
    first = rows.groupBy("db", "shard").agg(F.min(F.struct("table_name", "DDL")).alias("x"))
    return first.groupBy("db").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["DDL"]).alias("units"))


def schema_questions(spark: SparkSession, path, schemas: DataFrame, knowledge: DataFrame | None = None) -> DataFrame:
    """Questions on databases with a known schema, with their external knowledge where there is any."""
    rows = json_lines(spark, path, "db string, db_id string, instance_id string, question_id string, question string, evidence string, external_knowledge string")
    rows = rows.select("file", "at", F.coalesce("db", "db_id").alias("db"), F.coalesce("instance_id", "question_id").alias("task"), "question", "evidence", "external_knowledge").join(schemas, "db")
    if knowledge is not None:
        rows = rows.join(knowledge.select(F.col("name").alias("external_knowledge"), F.col("text").alias("more")), "external_knowledge", "left")
    else:
        rows = rows.withColumn("more", F.lit(None).cast("string"))
    rows = order.numbered(rows, ["file", "at"])
    return rows.select(F.col("rn").alias("pid"), "task", "db", F.concat_ws("\n", "question", F.when(F.col("evidence") != "", F.col("evidence")), "more").alias("head"), "units")


def catalog_schemas(spark: SparkSession, url: str, db: str, properties: dict[str, str] | None = None) -> DataFrame:
    """(db, units): CREATE texts of a SQLite catalogue by name, by JDBC, where a driver is on the class path."""
    rows = spark.read.jdbc(url, "(SELECT name, sql FROM sqlite_master WHERE sql IS NOT NULL) t", properties=properties or {})
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "sql"))), lambda x: x["sql"]).alias("units")).select(F.lit(db).alias("db"), "units")


def exported_schemas(spark: SparkSession, path) -> DataFrame:
    """(db, units) of catalogues exported as one JSON object: the CREATE texts of each database in order."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("db", "units"))
    return rows.where(F.size("units") > 0)


def context_units(schema: DataFrame, meanings: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(db, units): schema paragraphs, then `column: meaning` lines by column, then knowledge lines; any may be missing.

    schema(db, text), meanings(db, meaning map<string,string>), knowledge(db, nth, line).
    """
    a = schema.select("db", F.posexplode(F.split("text", r"\n\s*\n")).alias("k", "unit")).where(F.trim("unit") != "").selectExpr("db", "0 AS part", "lpad(cast(k AS string), 9, '0') AS k", "unit")
    b = meanings.select("db", F.explode("meaning").alias("k", "v")).selectExpr("db", "1 AS part", "k", "concat(k, ': ', v) AS unit")
    c = knowledge.selectExpr("db", "2 AS part", "lpad(cast(nth AS string), 9, '0') AS k", "line AS unit")
    every = a.unionByName(b).unionByName(c)
    return every.groupBy("db").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "unit"))), lambda x: x["unit"]).alias("units"))


def interactive_tasks(spark: SparkSession, path, contexts: DataFrame) -> DataFrame:
    """One prompt for a task's query and one for its follow-up, where it has one."""
    rows = json_lines(spark, path, "selected_database string, instance_id string, amb_user_query string, query string, follow_up struct<query:string>")
    turns = F.array(F.struct(F.lit("t1").alias("turn"), F.coalesce("amb_user_query", "query").alias("head")), F.struct(F.lit("t2").alias("turn"), F.col("follow_up.query").alias("head")))
    rows = rows.select("file", "at", F.col("instance_id").alias("task"), F.col("selected_database").alias("db"), F.explode(F.filter(turns, lambda x: F.coalesce(x["head"], F.lit("")) != "")).alias("x"))
    rows = order.numbered(rows.select("file", "at", "task", "db", "x.*").join(contexts, "db"), ["file", "at", "turn"])
    return rows.select(F.col("rn").alias("pid"), "task", "db", "turn", "head", "units")


def interactive_prompts(spark: SparkSession, tasks, schema, meanings, knowledge) -> DataFrame:
    """Tasks with their database's context, from <db>_schema.txt, <db>_column_meaning_base.json and <db>_kb.jsonl."""
    db = lambda ending: F.regexp_extract("file", f"([^/]+){ending}$", 1).alias("db")
    a = whole_files(spark, schema).select(db("_schema\\.txt"), "text")
    b = whole_files(spark, meanings).select(db("_column_meaning_base\\.json"), F.from_json("text", "map<string,string>").alias("meaning"))
    c = lines(spark, knowledge).where(F.trim("value") != "")
    c = c.select(db("_kb\\.jsonl"), F.col("at.row").alias("nth"), F.col("value").alias("line"))
    return interactive_tasks(spark, tasks, context_units(a, b, c))
