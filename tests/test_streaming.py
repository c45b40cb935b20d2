import pytest

from kgraph.plans.server import Tools
from kgraph.plans.stages import Run
from kgraph.streaming.incremental import chunk_stream


def test_stream_adds_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("1.1 one\n\nplain")
    for _ in range(2):
        chunk_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (src / "b.md").write_text("2.1 two")
    chunk_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()) == ["a#001", "b#001"]
    assert spark.read.parquet(str(tmp_path / "out/dropped")).count() == 1


def test_runs_resume(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert Run(spark, "s", str(tmp_path), "m", "c").stage("one", make).count() == 3
    assert len(calls) == 1
    with pytest.raises(ValueError):
        Run(spark, "s", str(tmp_path), "other", "c")
    Run(spark, "s", str(tmp_path), "m", "c").clear(["one"])
    Run(spark, "s", str(tmp_path), "m", "c").stage("one", make)
    assert len(calls) == 2


def test_tools(spark):
    from kgraph import schema as S
    from kgraph.operators.graph import Graph

    def topic(i, name, said):
        row = {f.name: None for f in S.TOPIC} | {"id": i, "name": name, "description": "d", "grade_start": 1, "grade_end": 2, "misconceptions": [(s, "p", "h") for s in said]}
        return tuple(row[f.name] for f in S.TOPIC)

    t = spark.createDataFrame([topic("a", "圆柱的检验", ["圆柱就是圆"]), topic("b", "土壤的估测", [])], S.TOPIC)
    d = spark.createDataFrame([(1, "a", "b", "hard", "r")], "ordinal bigint, topic_id string, prerequisite_id string, strength string, reason string")
    x = Tools(Graph(t, d, spark.createDataFrame([], "ordinal bigint, earlier_id string, later_id string, note string")))
    assert [r["id"] for r in x.search_topics("圆柱检验")] == ["a"] and x.search_topics("圆柱检验", grade=7) == []
    assert x.match_misconceptions("学生说圆柱就是圆")[0]["id"] == "a" and x.match_misconceptions("没有关系") == []
    assert x.get_topic("a")["provenance"]["method"] == "unknown"
    assert x.get_prerequisites("a")[0]["id"] == "b"
    assert [s["id"] for s in x.plan_path("a")["steps"]] == ["b", "a"]
    assert x.get_graph_stats()["grade_distribution"] == {1: 2, 2: 2}
