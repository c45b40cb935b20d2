import json

import pytest

from kgraph import hooks
from kgraph import schema as S
from kgraph.operators import curate
from kgraph.sources import documents as docs

TOPIC = {"id": "t1", "name": "n", "description": "d", "type": "meta", "subject": "s", "domain": "x", "grade_start": 1, "grade_end": 2, "evidence": ["e"], "assessment_prompt": "p"}


def test_strict_graph(spark, tmp_path):
    good = {"topics": [TOPIC], "dependencies": [{"topic_id": "t1", "prerequisite_id": "t2", "strength": "hard", "reason": "r"}]}
    p = tmp_path / "g.json"
    p.write_text(json.dumps(good))
    topics, links, revisits = docs.read_graph(spark, str(p))
    assert topics.first()["misconceptions"] == [] and links.count() == 1 and revisits.count() == 0
    for bad in ({**good, "more": 1}, {"topics": [{**TOPIC, "colour": 1}]}, {"topics": [{**TOPIC, "grade_end": 0}]}, {"topics": [], "dependencies": [{"topic_id": "a", "prerequisite_id": "a", "strength": "hard", "reason": "r"}]}):
        p.write_text(json.dumps(bad))
        with pytest.raises(S.StrictError):
            docs.read_graph(spark, str(p))
    assert S.json_schema()["properties"]["topics"]["items"]["additionalProperties"] is False


def test_ledger_and_swap(spark, tmp_path):
    rows = spark.createDataFrame([("a", "r", "x", None), ("a", "r", "x", None), ("b", "r", "x", "d")], S.DROP)
    path = str(tmp_path / "ledger")
    assert docs.append_ledger(rows, path) == 2 and docs.append_ledger(rows, path) == 0
    assert docs.read_stage(spark, path, S.DROP).count() == 2 and docs.read_stage(spark, str(tmp_path / "no"), S.DROP).count() == 0
    docs.swap(spark.read.parquet(path).limit(1), path)
    assert spark.read.parquet(path).count() == 1


def test_extract_conserves(spark):
    chunks = spark.createDataFrame([(f"c#{i:03d}", "t", "1.2", "f", i) for i in range(4)], S.CHUNK)
    content = {f.name: None for f in S.CONTENT} | {"name": "n", "grade_start": 2, "grade_end": 3}

    def make():
        def call(row):
            if row["ordinal"] == 0:
                raise RuntimeError("no")
            return [] if row["ordinal"] == 1 else [content, {**content, "grade_end": 1}]

        return call

    drafts, drops = curate.extract(chunks, make)
    assert [r["draft_id"] for r in drafts.orderBy("draft_id").collect()] == ["c#002-00", "c#003-00"]
    assert sorted((r["ref"], r["reason"]) for r in drops.collect()) == [("c#000", "EXTRACT_FAILED"), ("c#001", "NO_DRAFTS"), ("c#002-01", "GRADE_RANGE_INVERTED"), ("c#003-01", "GRADE_RANGE_INVERTED")]


def test_faults(spark):
    with pytest.raises(ValueError):
        hooks.Fault(0)
    call = hooks.with_fault(hooks.always(1), hooks.Fault(2))()
    assert call({}) == 1
    with pytest.raises(RuntimeError):
        call({})
    assert call({}) == 1


def test_graph_comes_back(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"topics": [TOPIC, {**TOPIC, "id": "t2", "provenance": None}], "dependencies": [{"topic_id": "t1", "prerequisite_id": "t2", "strength": "hard", "reason": "r"}], "revisits": []}))
    want = [sorted(map(str, x.collect())) for x in docs.read_graph(spark, str(p))]
    first = docs.read_graph(spark, str(p))
    docs.write_graph(*first, str(tmp_path / "folder"))
    docs.export_graph(*first, str(tmp_path / "new" / "out.json"))
    for path in ("folder", "new/out.json"):
        assert [sorted(map(str, x.collect())) for x in docs.read_graph(spark, str(tmp_path / path))] == want
    (tmp_path / "folder" / "topics" / "more.txt").write_text(json.dumps({**TOPIC, "ordinal": 9, "colour": 1}) + "\n")
    with pytest.raises(S.StrictError):
        docs.read_graph(spark, str(tmp_path / "folder"))
    docs.export_rows(first[1], str(tmp_path / "rows.json"))
    assert json.loads((tmp_path / "rows.json").read_text())[0]["reason"] == "r"
    node = S.json_schema()["properties"]["topics"]["items"]
    assert "id" in node["required"] and "provenance" not in node["required"] and node["properties"]["type"]["enum"] and node["properties"]["grade_end"]["maximum"] == 9


def test_registry_is_saved(spark, tmp_path):
    e = spark.createDataFrame([("e1", "n", "d", 1, 2, None, ["a"])], S.REGISTRY_ENTRY)
    path = str(tmp_path / "r.json")
    assert docs.read_registry(spark, path).count() == 0 and docs.registry_settings(spark, path) == ("", 0.6)
    docs.write_registry(e, path, "备注", 0.7)
    docs.write_registry(docs.read_registry(spark, path), path, "备注", 0.7)
    assert docs.registry_settings(spark, path) == ("备注", 0.7) and docs.read_registry(spark, path).first()["aliases"] == ["a"]
    table = str(tmp_path / "table")
    docs.write_registry(e, table)
    docs.write_registry(docs.read_registry(spark, table).unionByName(e.withColumn("id", e["name"])), table)
    assert docs.read_registry(spark, table).count() == 2
    # a crash after the old table moved aside
    (tmp_path / "table").rename(tmp_path / "table.old-x")
    assert docs.read_registry(spark, table).count() == 2


def test_command_line(spark, tmp_path, capsys):
    import io

    from kgraph.__main__ import run

    good = tmp_path / "g.json"
    good.write_text(json.dumps({"topics": [{**TOPIC, "standards": [{"curriculum": "c", "code": "1"}], "provenance": {"method": "m", "review_status": "approved", "confidence": 1}, "misconceptions": [{"statement": "分数越大越好", "probe": "p", "correction_hint": "h"}]}, {**TOPIC, "id": "t2"}], "dependencies": [{"topic_id": "t1", "prerequisite_id": "t2", "strength": "hard", "reason": "r"}]}))
    out = io.StringIO()
    assert run(["validate", str(good)], spark, sink=out) == 1 and "MISSING_PROVENANCE" in out.getvalue()
    assert run(["validate", str(tmp_path / "no.json")], spark, sink=out) == 2
    out = io.StringIO()
    assert run(["compare", str(good), str(good)], spark, sink=out) == 0 and "id: 2 of 2" in out.getvalue() and "1 of 1 statements" in out.getvalue()
    assert run(["schema", str(tmp_path / "s.json")]) == 0
    out = io.StringIO()
    asks = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_topic", "arguments": {"topic_id": "t1"}}}, {"id": 4, "method": "tools/call", "params": {"name": "get_topic", "arguments": {"topic_id": "zz"}}}, {"id": 5, "method": "nope"}]
    assert run(["serve", str(good)], spark, source=[*map(json.dumps, asks), "{"], sink=out) == 0
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, None] and len(got[1]["result"]["tools"]) == 6
    assert json.loads(got[2]["result"]["content"][0]["text"])["id"] == "t1" and got[3]["result"]["isError"] and "error" in got[4]
    assert got[1]["result"]["tools"][0]["inputSchema"]["required"] == ["query"]


def test_structured_answers_and_counting(spark):
    kind = S._struct(judgment=S.T.StringType(), score=S.T.IntegerType())
    calls = spark.sparkContext.accumulator(0)

    def connect():
        return lambda question, shape: None if "silent" in question else {"judgment": "ok", "score": "x" if "wrong" in question else 1}

    ask = lambda row: hooks.prompt("judge", {"name": "Name", "evidence": "Seen"}, row)
    assert ask({"name": "a", "evidence": ["x", "y"]}) == "judge\n\nName: a\n\nSeen:\n- x\n- y" and ask({"name": " "}) == "judge"
    d = spark.createDataFrame([("good",), ("silent",), ("wrong",)], "name string")
    got = {r["name"]: r for r in hooks.mapped(d, hooks.counting(hooks.structured(connect, ask, kind), calls), kind, tries=3).collect()}
    assert got["good"]["result"]["score"] == 1 and got["silent"]["error"].startswith("ToolCallMissing") and got["wrong"]["error"].startswith("ValueError")
    assert (got["good"]["attempts"], got["silent"]["attempts"], got["wrong"]["attempts"]) == (1, 3, 1) and calls.value == 5
    assert hooks.ceiling(4) == 8 and hooks.ceiling(100) == 32


def test_encoder(spark):
    from kgraph.functions.scoring import encoder, vector_scorer

    v = vector_scorer(encoder(lambda: lambda texts: [[len(t), t.count("a")] for t in texts]))
    d = spark.createDataFrame([("aa ", "a"), ("b", "aa"), (" ", "a"), (None, "a")], "x string, y string").repartition(1)
    got = [r[0] for r in d.select(v.relevance(v.prepare(d["x"]), v.prepare(d["y"]))).collect()]
    assert [round(g, 6) for g in got] == [1.0, 0.707107, 0.0, 0.0]
