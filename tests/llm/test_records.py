import random

import numpy as np
import pytest

from kgraph.llm import consensus, groups, looks, mixture, reference_list

LABELS = {"x": ["a", "b", "c"], "y": ["approved", "rejected"]}


def test_groups_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"{g}-{rng.randrange(30):02d}", f"{g}-{rng.randrange(30):02d}") for g in range(6) for _ in range(25)]
    pairs += [(f"chain{i:03d}", f"chain{i + 1:03d}") for i in range(60)] + [("hub", f"s{i:04d}") for i in range(1500)] + [("solo", "solo"), (None, "n"), ("n", None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    d = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", "1 AS v", "2 AS u")
    rows = groups.groups(d, "a", "b", least_hot=200).collect()
    assert len(rows) == len(parent) and {(r["group_id"], r["member_id"]) for r in rows} == {(find(x), x) for x in parent}
    assert groups.groups(d.limit(0), "a", "b").collect() == []


def votes(spark, seed=1, items=400):
    """Six annotators: good ones, a careless one, one that answers by a shifted list, one that likes the first label."""
    rng = random.Random(seed)
    truth, rows = {}, []
    for i in range(items):
        t = truth[f"i{i}"] = rng.randrange(3)
        for r in range(7):
            right = rng.random() < (0.9 if r < 3 else 0.88)
            vote = t if right else rng.randrange(3)
            vote = rng.randrange(3) if r == 3 else (t + 1) % 3 if r in (4, 5) and right else 0 if r == 6 and rng.random() < 0.7 else vote
            rows.append((f"i{i}", "x", f"r{r}", vote))
    return truth, spark.createDataFrame(rows, "target string, aspect string, reviewer string, code int")


def test_consensus_recovers_truth_both_ways(spark):
    truth, v = votes(spark)
    items, people = consensus.fit(v, {"x": 3, "y": 2}, rounds=8)
    got = {r["target"]: r["judgment"] for r in consensus.labelled(items, LABELS).collect()}
    assert np.mean([got[i] == "abc"[t] for i, t in truth.items()]) > 0.95
    skill = {r["reviewer"]: r["ability"] for r in people.where("code = 0").collect()}
    assert skill["r0"] > 0.8 > 0.5 > skill["r3"] > skill["r4"]


def test_both_ways_of_summing_agree(spark):
    """Several settings: four labels beside two, one label only, rejections and approvals without a judgment, silent annotators."""
    rng = random.Random(5)
    for sizes in ({"x": 4, "y": 2}, {"x": 2, "y": 3}):
        rows = []
        for i in range(60):
            for aspect, n in sizes.items():
                t = rng.randrange(n)
                rows += [(f"i{i}", aspect, f"r{r}", None if r == 5 else t if rng.random() < 0.75 else rng.choice([-1, -2, *range(n)])) for r in range(6) if rng.random() < 0.8]
        v = spark.createDataFrame(rows, "target string, aspect string, reviewer string, code int")
        names = {a: [f"{a}{k}" for k in range(n)] for a, n in sizes.items()}
        got = []
        for most in (0, 20_000):
            items, people = consensus.fit(v, sizes, most=most)
            got.append(({(r["target"], r["aspect"]): (r["judgment"], r["confidence"]) for r in consensus.labelled(items, names).collect()}, {(r["aspect"], r["reviewer"]): r["ability"] for r in people.where("code = 0").collect()}))
        for a, b in zip(*got, strict=True):
            assert a.keys() == b.keys()
            for k in a:
                x, y = (a[k], b[k]) if isinstance(a[k], tuple) else ((None, a[k]), (None, b[k]))
                assert x[0] == y[0] and abs(x[1] - y[1]) < 1e-6, (k, x, y)


def test_votes_are_cleaned(spark):
    s = "target string, aspect string, votes array<struct<reviewer:string,approved:boolean,reason:string,judgment:string>>, ingested_at timestamp"
    from datetime import datetime as D

    v = lambda r, j, ok=True: (r, ok, None, j)
    d = spark.createDataFrame([("t", "x", [v("R_1", " B "), v("r-1 ", "b"), v("r2", None, False), v("r3", None, None), v(None, "a")], D(2025, 1, 1)), ("t", "x", [v("r-1", "c")], D(2025, 1, 2)), ("t", "y", [v("r1", None, False)], None), ("t", "z", [v("r1", "a")], None), (None, "x", [v("r1", "a")], None), ("u", "x", None, None), ("w", "x", [], None)], s)
    got = {tuple(r) for r in consensus.votes_of(d, LABELS).collect()}
    assert got == {("t", "x", "r-1", 2), ("t", "x", "r2", -1), ("t", "x", "r3", None), ("t", "x", "", 0), ("t", "y", "r1", 1)}
    items, _ = consensus.fit(consensus.votes_of(d.where("target = 'none'"), LABELS), {"x": 3, "y": 2}, rounds=2)
    assert items.collect() == []
    a = {r["aspect"]: r for r in consensus.agreement(consensus.votes_of(d, LABELS)).collect()}
    assert a["x"]["votes"] == 2 and a["x"]["observed"] == 0


ENTRIES = [(f"e{c}{a}", f"{c}的{a}", [f"别名{c}{a}"]) for c in ("圆柱", "数轴", "土壤", "等腰三角形") for a in ("检验", "估测", "历史故事") if (c, a) != ("数轴", "估测")] + [("e圆柱检验", "圆柱的检验", None), ("", None, []), (None, "无", [])]


def test_reference_list(spark):
    e = spark.createDataFrame(ENTRIES, "id string, name string, aliases array<string>")
    want = {"圆柱的检验": "e圆柱检验", "学会圆柱检验（选修）": "e圆柱检验", "检验/圆柱": "e圆柱检验", "圓柱的檢驗": "e圆柱检验", "土壤的历史史故事": "e土壤历史故事", "土壤的历故事": "e土壤历史故事", "等三角形的估测": "e等腰三角形估测", "别名数轴检验": "e数轴检验", "数轴的估测": None, "竹竿舞的检验": None, "圆柱展示课": None, "": None, "——": None, None: None}
    d = spark.createDataFrame([(f"d{i}", t, "x") for i, t in enumerate(want)], "draft_id string, text string, id string")
    got = {r["text"]: r for r in reference_list.assign(d.unionByName(d), e, "draft_id", "text", around=(["学会"], ["选修"])).collect()}
    assert {k: r["entry_id"] for k, r in got.items()} == want
    assert got[""]["how"] == got[None]["how"] == "empty" and len(got) == len(want)
    assert {r["entry_id"] for r in reference_list.assign(d, e.limit(0), "draft_id", "text").collect()} == {None}


def test_frames_are_learned(spark):
    e = spark.createDataFrame(ENTRIES, "id string, name string, aliases array<string>")
    texts = [f"{h}{n}{t}" for _, n, _ in ENTRIES[:8] for h, t in (("备课：", ""), ("", "第3课时"), ("备课", "第十一课时"), ("", "（二稿）"))] + ["独有圆柱的检验", "备课 土壤的历史史故事", "等三角形的估测 第2课时"]
    d = spark.createDataFrame([(x,) for x in texts], "text string")
    looked = looks.unify(d, "text", "looks")
    listed = {i: (n, a or []) for i, n, a in ENTRIES if i and n}
    heads, tails = reference_list.frames(looked, listed, reference_list.simplified(spark))
    assert heads == ["备课"] and set(tails) >= {"#稿", "第#课时"}
    got = {r["text"]: r["entry_id"] for r in reference_list.assign(d, e, "text", "text").collect()}
    assert got["备课 土壤的历史史故事"] == "e土壤历史故事" and got["等三角形的估测 第2课时"] == "e等腰三角形估测"


def test_cube_keeps_balance():
    rng = np.random.default_rng(0)
    x = np.stack([np.ones(800), rng.integers(1, 9000, 800)], 1)
    p = np.full(800, 0.37)
    f = mixture.flight(p, x, rng)
    assert np.allclose(p @ x, f @ x) and ((f > 0) & (f < 1)).sum() <= 2
    done = mixture.landing(f, x)
    assert set(done) <= {0.0, 1.0} and abs((done - p) @ x[:, 1]) < 9000


def test_mixture(spark):
    rows = [(i, "水" * (5 + i % 40), ("A-x", "b", " a_X ")[i % 3]) for i in range(900)] + [(900, None, "b"), (901, "", "b"), (902, "水", None), (903, "水", "other")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS id", "2 AS p")
    t = spark.createDataFrame([("a_x", 0.3, 1), ("b", 0.6, 3), ("gone", 0.1, 2), (None, 0.5, 1), ("nil", None, None)], "source string, target_share double, max_repeats int")
    copies, report = mixture.plan(d, t)
    c = copies.collect()
    cap = {"a_x": 1, "b": 3}
    assert all(1 <= r["copies"] <= cap[r["source"]] for r in c) and len({r["doc_id"] for r in c}) == len(c) and not {r["doc_id"] for r in c} & {900, 901, 902, 903}
    share = {r["source"]: r["actual_share"] for r in report.collect()}
    assert abs(share["a_x"] - 1 / 3) < 0.005 and abs(share["b"] - 2 / 3) < 0.005 and share["gone"] == 0 == share["nil"]
    assert mixture.plan(d, t.limit(0))[0].collect() == [] and mixture.plan(d.limit(0), t)[0].collect() == []


def test_mixture_with_long_documents(spark):
    """A few texts of many times the usual length, one of half its source's tokens: the shares still come out."""
    rng = random.Random(2)
    rows = [(i, "水" * (5 + i % 40), "abc"[i % 3]) for i in range(1500)] + [(2000 + i, "水" * rng.randint(500, 2500), "abc"[i % 3]) for i in range(9)] + [(3000, "水" * 9000, "b")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.31, 1), ("b", 0.5, 3), ("c", 0.19, 2)], "source string, target_share double, max_repeats int")
    for seed in (1, 2, 3):
        copies, report = mixture.plan(d, t, seed=seed)
        assert all(abs(r["actual_share"] - r["target_share"]) < 0.003 for r in report.collect())
        assert all(1 <= r["copies"] <= {"a": 1, "b": 3, "c": 2}[r["source"]] for r in copies.collect())
    with pytest.raises(ValueError):
        mixture.plan(d, t, most_targets=2)
