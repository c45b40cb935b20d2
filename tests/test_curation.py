import pytest

from kgraph import hooks
from kgraph import schema as S
from kgraph.plans.curation import Models, curated
from kgraph.plans.stages import Run

TEXT = """1.1 alpha 1

1.2 beta 2

1.3 Ａlpha 1

1.4 gamma 2

1.5 delta 3

1.6 broken 3

1.7 omega 3

1.8 sigma 3

no number"""


def models():
    """Local functions, so that workers needn't import this file."""
    fields = [f.name for f in S.CONTENT]

    def content(row):
        name, grade = row["text"].split()
        blank = dict.fromkeys(fields)
        return [blank | {"name": name, "description": f"about {name}", "type": "conceptual", "subject": "s", "domain": "d", "grade_start": int(grade), "grade_end": int(grade), "evidence": [name], "misconceptions": [{"statement": name, "probe": "p", "correction_hint": "h"}]}]

    def propose(row):
        if row["name"] == "sigma":
            raise RuntimeError("down")
        pool = {c["name"]: c["draft_id"] for c in row["pool"]}
        edge = lambda i, s="hard": {"prerequisite_draft_id": i, "strength": s, "reason": "r"}
        if row["name"] == "delta":
            return [edge(pool["alpha"], "soft"), edge(pool["alpha"]), edge(pool["gamma"]), edge("nowhere"), edge(row["draft_id"])]
        if row["name"] == "gamma":
            return [edge(pool["beta"])]
        return [edge(pool["alpha"])] if "alpha" in pool else []

    def fidelity(row):
        if row["name"] == "broken":
            raise RuntimeError("no answer")
        return {"reviewer": "f", "judgment": "fabricated" if row["name"] == "beta" else "faithful", "reason": "", "approved": None}

    def name_desc(row):
        if row["name"] == "omega":
            raise RuntimeError("no answer")
        return {"reviewer": "n", "judgment": "topic_mismatch" if row["name"] == "beta" else "consistent", "reason": "", "approved": None}

    def edge_reason(row):
        if row["target_name"] == "sigma" or row["prerequisite_name"] == "gamma":
            return {"reviewer": "e", "judgment": None, "reason": "", "approved": False}
        return {"reviewer": "e", "judgment": None, "reason": "", "approved": True}

    hook = lambda f: lambda: f
    return Models(hook(content), hooks.always((True, "same")), hook(propose), [hook(fidelity)], [hook(name_desc)], [hook(edge_reason)])


def test_text_becomes_a_graph(spark, tmp_path):
    texts = spark.createDataFrame([("a.md", TEXT)], "source_file string, text string")
    entries = spark.createDataFrame([("e1", "alpha", "d", 1, 2, "about alpha", [])], S.REGISTRY_ENTRY)
    run = Run(spark, "s", str(tmp_path), "m", "c")
    out = curated(run, texts, entries, models(), "c", "m")
    names = {r["id"]: r["name"] for r in out.graph.topics.collect()}
    assert sorted(names.values()) == ["alpha", "delta", "gamma", "sigma"] and names["e1"] == "alpha"
    assert [(names[r["topic_id"]], names[r["prerequisite_id"]], r["strength"]) for r in out.graph.dependencies.collect()] == [("delta", "alpha", "hard")]
    assert [tuple(r)[:2] for r in out.merges.collect()] == [("a#001-00", "a#003-00")]
    drops = sorted((r["stage"], r["ref"], r["reason"]) for r in out.drops.collect())
    assert drops == sorted([
        ("chunk", "a¶009", "NO_STANDARD_CODE"),
        ("edges", "a#005-00", "UNKNOWN_PREREQUISITE"),
        ("edges", "a#005-00", "NON_CANDIDATE_PREREQUISITE"),
        ("edges", "a#008-00", "EDGES_FAILED"),
        ("review", "a#002-00", "REVIEW_REJECTED"),
        ("review", "a#006-00", "FIDELITY_JUDGE_FAILED"),
        ("review", "a#007-00", "NAME_JUDGE_FAILED"),
        ("review", "a#004-00<-a#002-00", "EDGE_PREREQUISITE_REJECTED"),
        ("review", "a#002-00<-a#001-00", "EDGE_TARGET_REJECTED"),
        ("review", "a#006-00<-a#001-00", "EDGE_TARGET_REJECTED"),
        ("review", "a#007-00<-a#001-00", "EDGE_TARGET_REJECTED"),
        ("review", "a#005-00<-a#004-00", "REVIEW_REJECTED"),
        ("review", "a#004-00", "ORPHANED_BY_REJECTION"),
        ("assemble", "a#005-00<-a#001-00", "DUPLICATE_EDGE"),
    ])
    assert {r["detail"] for r in out.drops.where("ref = 'a#002-00' AND reason = 'REVIEW_REJECTED'").collect()} == {"fidelity,name_desc"}
    assert out.registry.count() == 4 and "EMPTY_GENERATION" not in {r["code"] for r in out.findings.collect()}
    again = curated(Run(spark, "s", str(tmp_path), "m", "c"), texts, entries, Models(None, None, None, [1], [1], [1]), "c", "m")
    assert again.graph.topics.count() == 4


def test_no_judges(spark, tmp_path):
    with pytest.raises(ValueError):
        curated(Run(spark, "s", str(tmp_path), "m", "c"), None, None, Models(None, None, None), "c", "m")


def test_retention_by_statements(spark):
    from kgraph import schema as S
    from kgraph.operators.curate import retention

    kind = f"id string, name string, misconceptions array<{S.MISCONCEPTION.simpleString()}>"
    m = lambda *xs: [(x, "same probe", "same hint") for x in xs]
    a = spark.createDataFrame([("t1", "n", m("分数越大越好", "小数没有意义")), ("t2", "n", m("圆就是球")), ("t3", "n", None), ("gone", "n", m("x"))], kind)
    b = spark.createDataFrame([("t1", "n", m("分数越大 越好", "小数都没有意义", "新的")), ("t2", "other", m("abc")), ("t3", "n", m("y")), ("new", "n", m("x"))], kind)
    r = retention(a, b, [0.5]).first()
    assert (r["statements"], r["verbatim"], r["matched"], r["lost"], r["added"], r["hollowed"], r["renamed"]) == (3, 1, 2, 1, 3, 1, 1)
    assert abs(r["median_score"] - (1 + 0.8) / 2) < 1e-9
    none = retention(a.limit(0), b, [0.5]).first()
    assert (none["statements"], none["matched"], none["median_score"]) == (0, 0, 0.0)


def test_call_levels(spark):
    from kgraph.operators.evaluate import level_results

    rows = [(1, 0.0, 2.0, None, None), (1, 1.0, 3.0, None, None), (1, 2.0, 4.0, 429, None), (1, 2.5, 2.5, None, "HTTP 429"), (1, 3.0, 5.0, 500, "x"), (2, 1.0, 1.0, 429, None)]
    got = {r["level"]: r for r in level_results(spark.createDataFrame(rows, "level int, started double, ended double, status int, error string"), "level").collect()}
    a, b = got[1], got[2]
    assert (a["requests"], a["ok"], a["rate_limited"], a["failed"], a["wall"], a["throughput"], a["p50"], a["p95"], a["peak"]) == (5, 2, 2, 1, 5.0, 0.4, 2.0, 2.0, 2)
    assert (b["requests"], b["ok"], b["throughput"], b["p50"], b["peak"]) == (1, 0, 0.0, 0.0, 0)
