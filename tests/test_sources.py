"""Readers on small files of each format."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tokenecho.operators import measure, parse
from tokenecho.sources import readers, sinks

LONG = "x" * 90


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_wildchat(spark, tmp_path):
    turn = lambda role, content: {"role": role, "content": content}
    rows = [("b", datetime(2024, 1, 2), [turn("assistant", "hi"), turn("user", "q2")]), ("a", datetime(2024, 1, 1), [turn("system", "only")]), ("c", datetime(2024, 1, 3), [turn("user", "")])]
    spark.createDataFrame(rows, "conversation_hash string, timestamp timestamp, conversation array<struct<role:string,content:string>>").write.parquet(str(tmp_path / "w"))
    assert got(readers.wildchat(spark, str(tmp_path / "w")), "sid", "text") == [(0, "only"), (1, "q2")]
    assert readers.wildchat(spark, str(tmp_path / "w"), 1).count() == 1


def test_paws(spark, tmp_path):
    p = put(tmp_path / "p.jsonl", [{"sentence1": "a", "sentence2": "b"}, {"sentence1": "", "sentence2": "c"}])
    assert got(readers.paws(spark, p), "sid", "text") == [(0, "a"), (1, "b"), (2, "c")]


def test_chat_and_agent_trajectories(spark, tmp_path):
    messages = json.dumps([{"role": "system", "content": "s"}, {"role": "assistant", "content": "d"}, {"role": "user", "content": ""}])
    spark.createDataFrame([("org__repo-1", messages)], "instance_id string, messages string").write.parquet(str(tmp_path / "c"))
    assert got(parse.roles(readers.chat_trajectories(spark, str(tmp_path / "c"))), "msg", "role", "text") == [(0, "system", "s"), (1, "decode", "d")]
    spark.createDataFrame([("i", [("user", "t", "sys"), ("ai", "u", None)])], "instance_id string, trajectory array<struct<role:string,text:string,system_prompt:string>>").write.parquet(str(tmp_path / "a"))
    assert got(parse.with_system_prompts(readers.agent_trajectories(spark, str(tmp_path / "a"))), "msg", "part", "role", "text") == [(0, 0, "system", "sys"), (0, 1, "input", "t"), (1, 1, "decode", "u")]


def test_code_events(spark, tmp_path):
    use = {"message": {"role": "assistant", "content": json.dumps([{"type": "tool_use", "id": "1", "input": {"file_path": "/workspace/x/a.py"}}])}}
    result = {"message": {"role": "user", "content": json.dumps([{"type": "tool_result", "tool_use_id": "1", "content": " 1→a\n 2→b\nend"}, {"type": "tool_result", "tool_use_id": "9", "content": "1→a\n2→b"}])}}
    p = put(tmp_path / "e.jsonl", [{"task_id": "t", "trajectory": [{"message": {"role": "user", "content": "plain"}}, use, result]}])
    events = readers.code_events(spark, p)
    assert got(events.where("kind = 'text'"), "text") == [("plain",)]
    shown = parse.reads(parse.match_calls(events), "arrow")
    assert got(shown.select("path", F.size("lines").alias("n")), "path", "n") == [("?", 2), ("a.py", 2)]


def test_web(spark, tmp_path):
    p = put(tmp_path / "n.jsonl", [{"id": "b", "prompt": "1"}, {"id": "a", "prompt": "2"}, {"id": "b", "prompt": "3"}, {"id": "a", "prompt": "4"}, {"id": "c", "prompt": "5"}])
    assert got(readers.web_prompts(spark, p), "sid", "snap", "task", "text") == [(0, 0, "b", "1"), (0, 1, "b", "3"), (1, 0, "a", "2"), (1, 1, "a", "4")]
    assert got(readers.web_prompts(spark, p, 1), "task") == [("b",), ("b",)]
    p = put(tmp_path / "m.jsonl", [{"annotation_id": "x", "actions": [{"cleaned_html": "<a>"}, {"cleaned_html": ""}, {"cleaned_html": "<b>"}]}, {"annotation_id": "y", "actions": [{"cleaned_html": "<c>"}]}])
    assert got(readers.web_pages(spark, p), "sid", "snap", "text") == [(0, 0, "<a>"), (0, 1, "<b>")]


def test_incidents(spark, tmp_path):
    row = lambda text, kind="function_call_output": {"payload": {"type": kind, "output": text}}
    put(tmp_path / "Scenario-7" / "1.jsonl", [row(LONG + "1"), row("short"), row(LONG, "other"), "not json", row(LONG + "2")])
    assert got(readers.tool_outputs(spark, str(tmp_path / "*" / "*.jsonl")), "sid", "snap", "task") == [(0, 0, "Scenario-7"), (0, 1, "Scenario-7")]
    for name in ("b.yaml", "a.yaml"):
        put(tmp_path / "k" / "one" / name, [LONG + name])
    put(tmp_path / "k" / "two" / "a.yaml", [LONG])
    assert [x[1][-7:-1] for x in got(readers.file_sessions(spark, str(tmp_path / "k")), "snap", "text")] == ["a.yaml", "b.yaml"]


def test_logs(spark, tmp_path):
    p = put(tmp_path / "bgl.log", [f"line {i}" if i % 5 else "" for i in range(60)])
    out = got(readers.log_slices(spark, p, 4, 5), "sid", "snap", "i", "line")
    assert len(out) == 48 and out[0] == (0, 0, 0, "line 1") and out[5][:3] == (0, 1, 0) and out[12][:3] == (1, 0, 0)


def test_traces(spark, tmp_path):
    def call(n, text):
        out = {"openinference.span.kind": "LLM"}
        for i in range(n):
            out |= {f"llm.input_messages.{i}.message.role": "tool", f"llm.input_messages.{i}.message.content": f"{text}{i}"}
        return {"trace_id": "t", "attributes": out}

    p = put(tmp_path / "t.jsonl", [call(1, LONG), call(3, LONG), {"trace_id": "t", "attributes": {"openinference.span.kind": "TOOL"}}])
    assert got(readers.app_traces(spark, p), "snap", "text") == [(i, f"{LONG}{i}") for i in range(3)]


def test_simulations_and_dialogues(spark, tmp_path):
    m = lambda text, role="tool", error=False: {"role": role, "error": error, "content": text}
    p = put(tmp_path / "sim.json", [{"simulations": [{"task_id": "b", "messages": [m(LONG), m(LONG, error=True), m(LONG)]}, {"task_id": "a", "messages": [m(LONG), m(LONG, "user"), m(LONG)]}]}])
    assert got(readers.simulations(spark, p), "sid", "snap", "task") == [(0, 0, "a"), (0, 1, "a"), (1, 0, "b"), (1, 1, "b")]
    p = put(tmp_path / "rag.json", [json.dumps([{"domain": "d", "messages": [{"contexts": [{"text": "p"}, {"text": " "}]}, {"contexts": []}]}])])
    assert got(readers.retrieval_dialogues(spark, p), "snap", "pos", "text") == [(0, 0, "p")]
    docs = put(tmp_path / "docs.json", [{"doc_data": {"dom": {"d1": {"doc_text": "one"}, "d2": {"doc_text": "two"}}}}])
    ref = lambda *ids: [{"doc_id": i} for i in ids]
    dials = put(tmp_path / "dial.json", [{"dial_data": {"dom": [{"dial_id": "x", "turns": [{"role": "user", "references": ref("d2", "d1", "d2", "d9")}, {"role": "agent", "references": ref("d1")}]}]}}])
    assert got(readers.grounded_dialogues(spark, docs, dials), "task", "snap", "pos", "text") == [("x", 0, 0, "two"), ("x", 0, 1, "one")]


def test_knowledge(spark, tmp_path):
    put(tmp_path / "kb" / "1.json", [{"id": "d1", "title": "T", "content": "c"}])
    tasks = put(tmp_path / "tasks.json", [json.dumps([{"id": "t", "required_documents": ["d9", "d1"]}])])
    assert got(readers.knowledge_tasks(spark, tasks, readers.knowledge_documents(spark, str(tmp_path / "kb"))), "task", "text") == [("t", "T\nc")]


def test_schemas(spark, tmp_path):
    put(tmp_path / "db1" / "DDL.csv", ["table_name,DDL", 'ev_20240102,"CREATE 2"', 'ev_20240101,"CREATE ""1"""', "other,CREATE o"])
    schemas = readers.table_schemas(spark, str(tmp_path / "*" / "DDL.csv"))
    assert got(schemas, "db", "units") == [("db1", ['CREATE "1"', "CREATE o"])]
    q = put(tmp_path / "q.jsonl", [{"db": "db1", "instance_id": "i1", "question": "q", "external_knowledge": "k"}, {"db": "none", "instance_id": "i2", "question": "q"}, {"db_id": "db1", "question_id": "3", "question": "r", "evidence": "e"}])
    knowledge = spark.createDataFrame([("k", "more")], "name string, text string")
    out = readers.schema_questions(spark, q, schemas, knowledge)
    assert got(out, "pid", "task", "head") == [(0, "i1", "q\nmore"), (1, "3", "r\ne")]
    assert measure.schema_reuse(out, 2).first()["reused"] > 0
    schema = spark.createDataFrame([("d", "CREATE a\n\nCREATE b")], "db string, text string")
    meanings = spark.createDataFrame([("d", {"y": "2", "x": "1"})], "db string, meaning map<string,string>")
    lines = spark.createDataFrame([("d", 0, "kb")], "db string, nth int, line string")
    units = readers.context_units(schema, meanings, lines)
    assert got(units, "units") == [(["CREATE a", "CREATE b", "x: 1", "y: 2", "kb"],)]
    p = put(tmp_path / "i.jsonl", [{"selected_database": "d", "instance_id": "1", "amb_user_query": "amb", "query": "q", "follow_up": {"query": "f"}}, {"selected_database": "d", "instance_id": "2", "query": "q"}])
    assert got(readers.interactive_tasks(spark, p, units), "task", "turn", "head") == [("1", "t1", "amb"), ("1", "t2", "f"), ("2", "t1", "q")]


def test_sinks(spark, tmp_path):
    for kind in ("json", "parquet"):
        sinks.write(spark.range(3), str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 3


@pytest.mark.parametrize("order", [1, -1])
def test_streamed_ledger(spark, tmp_path, order):
    from tokenecho.streaming.ledger import judge

    schema = "key string, sid long, snap int, s int, n int"
    rows = [("a", 1, 0, 0, 5), ("a", 1, 1, 0, 5), ("a", 2, 0, 0, 5), ("b", 2, 0, 1, 7)][::order]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = judge(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    name = f"judged_{order + 1}"
    q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert got(spark.table(name), "key", "sid", "snap", "reuse") == [("a", 1, 0, "first"), ("a", 1, 1, "in_session"), ("a", 2, 0, "cross_session"), ("b", 2, 0, "first")]
