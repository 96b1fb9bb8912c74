"""Rows of the study on small streams."""

import pytest

from tokenecho.plans import rows

A, B = "alpha beta gamma\ndelta epsilon", "zeta eta theta\niota kappa"
KEYS = {"pic_pct", "pic_proc_pct", "in_session", "cross_session"}


@pytest.fixture
def snaps(spark):
    def make(*texts):
        return spark.createDataFrame([(s, k, str(s), t) for s, session in enumerate(texts) for k, t in enumerate(session)], "sid long, snap int, task string, text string")

    return make


def test_treatments_raise_reuse(snaps):
    pages = snaps(*[[f'<a backend_node_id="{i}{k}">some words here\n<b backend_node_id="{k}{i}">more words' for k in range(2)] for i in range(1, 4)])
    out = rows.STUDY["Mind2Web"](pages, least=4).first()
    assert out["pic_proc_pct"] > out["pic_pct"] and KEYS < set(out.asDict())
    traces = snaps(*[[f'q{i}\n{{"release_date": "{i}-{k}", "title": "same words"}}\nend {i}' for k in range(2)] for i in range(3)])
    out = rows.STUDY["AppWorld"](traces, least=20).first()
    assert out["pic_proc_pct"] >= out["pic_pct"]
    outputs = snaps(*[[f'{{"output": "{"same words " * 12}", "metadata": {{"t": {i}{k}}}}}' for k in range(2)] for i in range(3)])
    assert rows.STUDY["ITBench SRE"](outputs, least=8).first()["pic_proc_pct"] > rows.STUDY["ITBench K8s"](outputs, least=8).first()["pic_pct"]


def test_logs_dialogues_and_buckets(spark):
    lines = spark.createDataFrame([(s, 0, i, f"node {s}{i} kernel info t{i}{s} ras cache parity error") for s in range(3) for i in range(4)], "sid long, snap long, i long, line string")
    out = rows.STUDY["BGL"](lines, least=8).first()
    assert out["pic_proc_pct"] >= out["pic_pct"]
    passages = spark.createDataFrame([("d/1", "x", 0, 0, A), ("d/1", "x", 1, 0, A), ("e/2", "y-ibmcloud", 0, 0, A), ("e/2", "y-ibmcloud", 1, 0, B), ("e/2", "y-ibmcloud", 2, 0, B)], "task string, domain string, snap int, pos int, text string")
    assert rows.STUDY["MultiDoc2Dial"](passages, least=3).first()["pic_pct"] > 0
    assert rows.STUDY["MT-RAG"](passages, least=3).first()["cross_session"] == 0
    docs = spark.createDataFrame([("a", A), ("b", B)], "doc_id string, text string")
    tasks = spark.createDataFrame([("t1", 0, "a", A), ("t2", 0, "b", B), ("t3", 0, "b", B), ("t3", 1, "a", A)], "task string, pos int, doc_id string, text string")
    assert rows.STUDY["tau-Knowledge"](tasks, docs, least=12).first()["pic_proc_pct"] >= 0


def test_trajectories_steps_and_schemas(spark):
    messages = spark.createDataFrame([(t, f"org__repo-{t}", m, r, x) for t in (1, 2) for m, r, x in ((0, "system", A), (1, "user", A + B), (2, "assistant", A), (3, "user", A + B))], "traj_id long, instance_id string, msg int, role string, text string")
    out = rows.STUDY["SWE-smith"](messages, least=4).first()
    assert out["pic_pct"] > 0 and out["in_session"] > 0 and out["prefix_pct"] > 0
    prompts = spark.createDataFrame([(s, k, str(s), f"head {s}\nOBSERVATION:\n[{s}{k}] link words here\n[{k}{s}] more words") for s in range(2) for k in range(3)], "sid long, snap int, task string, text string")
    out = rows.STUDY["NNetNav-WA"](prompts, least=4).first()
    assert out["pic_proc_pct"] > out["pic_pct"]
    questions = spark.createDataFrame([(i, str(i // 2), f"question {i}", [A, B]) for i in range(4)], "pid long, task string, head string, units array<string>")
    out = rows.STUDY["LiveSQLBench"](questions, least=4).first()
    assert out["pic_pct"] > 0 and out["in_session"] > 0 and out["prefix_schema_first"] >= out["prefix_schema_after"]
