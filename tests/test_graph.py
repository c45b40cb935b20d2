import re

import pytest
from pyspark.sql import functions as F

from kgraph.functions.text import bigrams, plain, spoken_math
from kgraph.operators import curate, evaluate
from kgraph.operators.graph import Graph, TopicNotFound, chain_lengths, kahn_order, longest_chain, plan_path, prerequisites
from kgraph.operators.matching import greedy


def graph(spark, links, topics="abcdef"):
    t = spark.createDataFrame([(c, f"name {c}", i % 3 + 1) for i, c in enumerate(topics)], "id string, name string, grade_start int")
    t = t.selectExpr("*", "grade_start + 1 AS grade_end", "repeat(id, 70) AS description", "CAST(NULL AS struct<method:string,review_status:string,reviewer:string,reviewed_at:string,confidence:double>) AS provenance")
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(links)], "ordinal bigint, topic_id string, prerequisite_id string, strength string, reason string")
    return Graph(t, d, spark.createDataFrame([], "ordinal bigint, earlier_id string, later_id string, note string"))


def test_walk_reports_first_discovery(spark):
    g = graph(spark, [("a", "b", "hard", "1"), ("a", "c", "soft", "2"), ("b", "d", "hard", "3"), ("c", "d", "hard", "4"), ("d", "a", "hard", "5"), ("a", "zz", "hard", "6")])
    start = spark.createDataFrame([("a",)], "id string")
    got = {(r["level"], r["id"], r["required_by"]) for r in prerequisites(g, start, 3).collect()}
    assert got == {(1, "b", "a"), (1, "c", "a"), (2, "d", "b")}
    assert {r["id"] for r in prerequisites(g, start, 1, include_soft=False).collect()} == {"b"}
    assert prerequisites(g, start, 0).collect() == []


def test_plan(spark):
    g = graph(spark, [("a", "b", "hard", ""), ("b", "c", "hard", ""), ("a", "d", "soft", ""), ("e", "f", "hard", ""), ("f", "e", "hard", "")])
    steps, skipped, cyclic = plan_path(g, "a", ["c"])
    assert [r["id"] for r in steps.collect()] == ["d", "b", "a"] and skipped == ["c"] and not cyclic
    first = steps.first()
    assert first["grade_end"] == first["grade_start"] + 1 and first["summary"].endswith("…") and first["provenance"]["review_status"] == "unreviewed" and first["revisits"] == []
    notes = Graph(g.topics, g.dependencies, spark.createDataFrame([(2, "a", "f", "later"), (1, "b", "a", "x"), (3, "a", "zz", "lost")], "ordinal bigint, earlier_id string, later_id string, note string"))
    got = {r["id"]: [(n["direction"], n["other_id"]) for n in r["revisits"]] for r in plan_path(notes, "a", ["c"])[0].collect()}
    assert got == {"d": [], "b": [("later", "a")], "a": [("earlier", "b"), ("later", "f")]}
    assert plan_path(g, "e")[2]
    with pytest.raises(TopicNotFound):
        plan_path(g, "a", ["nope"])


def test_order_puts_cycles_last():
    assert kahn_order([("a", 2), ("b", 1), ("c", 3)], [("a", "b"), ("b", "a"), ("c", "a")]) == (["b", "a", "c"], True)
    assert kahn_order([("a", 1), ("b", 1), ("c", 2), ("x", 1)], [("a", "b"), ("b", "a"), ("x", "c")]) == (["c", "x", "a", "b"], True)


def test_greedy_equals_sequential(spark):
    import random

    rng = random.Random(2)
    pairs = [(f"l{rng.randrange(12)}", f"r{rng.randrange(12)}", rng.randrange(5)) for _ in range(60)]
    pairs = sorted({(a, b): (a, b, s) for a, b, s in pairs}.values())
    want, used = set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    df = spark.createDataFrame(pairs, "l string, r string, s int")
    assert {(r["l"], r["r"]) for r in greedy(df, "l", "r", [F.negative("s").alias("o"), F.col("l").alias("i"), F.col("r").alias("j")]).collect()} == want


def spoken(text):
    """The plain statement of the two passes."""
    digits = dict(zip("零一二三四五六七八九十", [*"0123456789", "10"], strict=True))
    signs = {"加": "+", "减": "-", "乘": "×", "除以": "÷"}
    n = r"(\d+|[零一二三四五六七八九十])"
    d = lambda x: digits.get(x, x)
    text = re.sub(n + "分之" + n, lambda m: d(m[2]) + "/" + d(m[1]), text)
    return re.sub(n + r"\s*(加|减|乘|除以)\s*" + n, lambda m: d(m[1]) + signs[m[2]] + d(m[3]), text)


def test_text(spark):
    texts = ["三分之二", "3 加 五 减 1", "加法", "A　b", "", "6×2", "3÷4", "3/4", "3乘4", "12除以四", "两加三", "三 分之二", "十分之一比12分之5小", "九加 ２", "1\x1c加\x1d二", "七减三加二", "\ue000三\ue001"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert [r[0] for r in rows.select(spoken_math(F.col("t"))).collect()] == [*map(spoken, texts), None]
    got = [r[0] for r in rows.select(plain(F.col("t"))).collect()]
    assert got == [*("".join(ch for ch in spoken(t).lower() if not ch.isspace()) for t in texts), None] and got[1] == "3+5减1"
    assert [r[0] for r in rows.select(bigrams(plain(F.col("t")))).collect()][:5] == [["2/", "/3"], ["3+", "+5", "5减", "减1"], ["加法"], ["ab"], []]


def test_longest_chain(spark):
    g = graph(spark, [("b", "a", "hard", ""), ("c", "b", "hard", ""), ("d", "c", "hard", ""), ("d", "a", "soft", ""), ("e", "d", "hard", ""), ("e", "a", "hard", "")])
    assert {tuple(r) for r in chain_lengths(g).collect()} == {("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("f", 1)}
    assert tuple(longest_chain(g).first()) == (5, False)
    g = graph(spark, [("a", "b", "hard", ""), ("b", "a", "hard", ""), ("c", "a", "hard", ""), ("e", "d", "hard", "")])
    assert {tuple(r) for r in chain_lengths(g).collect()} == {("d", 1), ("e", 2), ("f", 1)}
    assert tuple(longest_chain(g).first()) == (2, True)
    assert tuple(longest_chain(graph(spark, [("a", "a", "hard", "")])).first()) == (1, True)
    assert tuple(longest_chain(graph(spark, [], topics="")).first()) == (0, False)


def test_chunks_conserve_paragraphs(spark):
    d = spark.createDataFrame([("a.b.md", "1.2 first\r\n\r\nno number\n\n1 single level\n \n2.1.3　second\nline"), ("c.md", None), ("d.md", "")], "source_file string, text string")
    good, drops = curate.chunks(d)
    assert [(r["id"], r["standard_code"], r["text"]) for r in good.orderBy("id").collect()] == [("a.b#001", "1.2", "first"), ("a.b#002", "2.1.3", "second\nline")]
    assert drops.count() == 2


def test_fuzzy_names_equal_all_pairs(spark):
    import difflib
    import itertools

    names = ["圆柱的检验", "圆柱检验", "圆锥的检验", "检验圆柱的", "圆", "aaab", "aaba", "aab", "土壤", ""]
    want = set()
    for a, b in itertools.combinations(sorted({n for n in names if n}), 2):
        m = sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) / min(len(a), len(b))
        if m >= 0.85:
            want.add((a, b))
    got = curate.fuzzy_names(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")).collect()
    assert {(r["a"], r["b"]) for r in got} == want


def test_thresholds_and_levels(spark):
    assert evaluate.threshold_range(0.05, 0.2, 0.05) == [0.05, 0.1, 0.15, 0.2] and evaluate.threshold_range(0.5, 0.4, 0.1) == []
    lv = spark.createDataFrame([(1, 0, 1.0), (4, 0, 9.6), (8, 0, 10.0), (16, 3, 20.0)], "concurrency int, rate_limited int, throughput double")
    assert evaluate.recommended_level(lv) == 4 and evaluate.recommended_level(lv.where("rate_limited > 0")) == 1
    with pytest.raises(ValueError):
        evaluate.recommended_level(lv.limit(0))
