"""Rows of the study from their files to percentages."""

import json

from tests.test_sources import put

from tokenecho.operators import parse
from tokenecho.plans import rows

A, B = "alpha beta gamma\ndelta epsilon zeta", "eta theta iota\nkappa lambda mu"
COLUMNS = "traj_id string, instance_id string, msg int, role string, text string"


def percentages(df):
    return {k: round(v, 2) for k, v in df.first().asDict().items()}


def test_first_run_of_each_task_counts(spark, tmp_path):
    turns = lambda *texts: json.dumps([{"role": r, "content": t} for r, t in zip(("system", "user", "assistant", "user"), texts)])
    data = [("o__r-2", turns(A, B, "x", B)), ("o__r-1", turns(A, B, "x", A)), ("o__r-2", turns(B, A, "y", A)), ("o__r-3", "[]"), ("o__r-3", turns(B, B, "z", B))]
    spark.createDataFrame(data, "instance_id string, messages string").coalesce(1).write.parquet(str(tmp_path / "s"))
    kept = [("1", i, m, r, t) for i, text in (("o__r-2", (A, B, "x", B)), ("o__r-1", (A, B, "x", A))) for m, (r, t) in enumerate(zip(("system", "user", "assistant", "user"), text))]
    kept = [(str(k // 4), *row[1:]) for k, row in enumerate(kept)]
    expected = rows.coding(spark.createDataFrame(kept, COLUMNS), least=4)
    got = percentages(rows.run_row(spark, "SWE-smith", str(tmp_path / "s"), least=4))
    # A and B are 7 tokens each: of 42, two systems; the second B of the first run, and the first of the second
    assert got == percentages(expected) == {"prefix_pct": 33.33, "pic_pct": 33.33, "pic_proc_pct": 33.33, "in_session": 16.67, "cross_session": 16.67}


def test_system_prompts_reach_the_measure(spark, tmp_path):
    data = [("i1", [("user", A, B), ("ai", "x", None), ("user", A, None)])]
    spark.createDataFrame(data, "instance_id string, trajectory array<struct<role:string,text:string,system_prompt:string>>").write.parquet(str(tmp_path / "a"))
    got = percentages(rows.run_row(spark, "SWE-agent", str(tmp_path / "a"), least=4))
    assert got["prefix_pct"] == 33.33 and got["in_session"] == 33.33 and got["cross_session"] == 0


def test_code_events_reach_the_measure(spark, tmp_path):
    block = lambda **k: json.dumps([k])
    event = lambda role, content: {"message": {"role": role, "content": content}}
    events = [event("user", A), event("assistant", block(type="tool_use", id="1", name="Read", input={"file_path": "/workspace/x.py"})), event("user", block(type="tool_result", tool_use_id="1", content=A)), event("assistant", A)]
    p = put(tmp_path / "e.jsonl", [{"task_id": "t", "trajectory": events}, {"task_id": "t", "trajectory": [event("user", B)]}])
    messages = parse.code_messages(rows.SOURCES["CC-Bench"](spark, p))
    result = messages.where("tool = 'Read' AND role = 'user'").collect()
    assert [(r["text"], r["call"].endswith("x.py")) for r in result] == [(A, True)]
    got = percentages(rows.run_row(spark, "CC-Bench", p, least=4))
    assert got == {"prefix_pct": 0.0, "pic_pct": 50.0, "pic_proc_pct": 50.0, "in_session": 50.0, "cross_session": 0.0}


def test_reads_of_trajectories(spark):
    shown = "result of running `cat -n` on /repo/a.py:\n     1\tone\n     2\ttwo\nend"
    df = spark.createDataFrame([("t", 0, "hello"), ("t", 1, shown), ("u", 0, "nothing")], "traj_id string, msg int, text string")
    out = parse.read_trajectories(df, "cat_n").collect()
    assert [(r["traj_id"], r["n_msgs"], r["msg_chars"], r["read_chars"], len(r["reads"]), [x["text"] for x in r["reads"][0]["lines"]]) for r in out] == [("t", 2, 5 + len(shown), 6, 1, ["one", "two"])]


def test_envelopes_logs_and_dialogues(spark, tmp_path):
    out = lambda body, meta: {"payload": {"type": "function_call_output", "output": json.dumps({"output": body, "metadata": meta})}}
    body = "same words here " * 6
    for k in (1, 2):
        put(tmp_path / f"Scenario-{k}" / "1.jsonl", [out(body, {"t": k}), out("short", {"t": k + 9}), out(body, {"t": k + 5})])
    got = percentages(rows.run_row(spark, "ITBench SRE", str(tmp_path / "*" / "*.jsonl"), least=4))
    assert got["pic_proc_pct"] > got["pic_pct"] == 0 and got["in_session"] > 0
    log = put(tmp_path / "bgl.log", [f"- {i} 2005 node R0{i} x kernel info same error {i % 7}" for i in range(40)])
    assert percentages(rows.run_row(spark, "BGL", log, least=8))["pic_proc_pct"] >= 0
    docs = put(tmp_path / "d.json", [json.dumps({"doc_data": {"dom": {"one": {"doc_text": A}, "two": {"doc_text": B}}}})])
    dial = lambda name, doc: {"dial_id": name, "turns": [{"role": "user", "references": [{"doc_id": doc}]}]}
    dials = put(tmp_path / "t.json", [json.dumps({"dial_data": {"dom": [dial("z", "one"), dial("a", "two"), dial("m", "one"), dial("z", "two")]}})])
    got = percentages(rows.run_row(spark, "MultiDoc2Dial", docs, dials, least=3))
    assert got["prefix_pct"] > 30  # m opens like z, which came first


def test_a_failing_row_does_not_stop_the_others(spark, tmp_path):
    pairs = put(tmp_path / "p.jsonl", [{"sentence1": A, "sentence2": A}])
    got = rows.measured({"BIRD": (str(tmp_path / "none"), str(tmp_path / "none")), "PAWS": (pairs,)}, spark, least=4)
    assert [x["row"] for x in got] == ["BIRD", "PAWS"] and "failed" in got[0] and got[1]["prefix_pct"] == 50.0
