import random

from kgraph.operators.hierarchy import hierarchy, paths
from kgraph.plans import records


def graph():
    """(pairs (child, parent)): a tree with cross links, two cycles in the middle of it, a loop, and topics below each."""
    rng = random.Random(3)
    pairs = [(f"n{i:02d}", f"n{rng.randrange(i):02d}") for i in range(1, 25) for _ in range(rng.choice((1, 1, 2)))]
    pairs += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c2", "n03"), ("under", "c3"), ("deeper", "under"), ("deeper", "n05")]
    return pairs + [("s", "s"), ("below", "s"), ("below", "n07"), ("x", "y"), ("y", "x"), ("z", "y"), ("x", "deeper")]


def reachable(pairs):
    kids, out = {}, {}
    for c, p in pairs:
        kids.setdefault(p, set()).add(c)
    for v in {x for e in pairs for x in e}:
        seen, todo = set(), [v]
        while todo:
            for k in kids.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out[v] = seen
    return out


def parts(spark, pairs):
    df = spark.createDataFrame(pairs, "child string, parent string")
    return hierarchy(df, "child", "parent", spark.createDataFrame([("lone",)], "id string"))


def test_below_cycles(spark):
    pairs = graph()
    r = reachable(pairs)
    cyc = {v: min(u for u in r[v] if v in r[u]) for v in r if v in r[v]}
    got = parts(spark, pairs)
    rows = {x["topic_id"]: x for x in records.nodes(got).collect()}
    assert set(rows) == set(r) | {"lone"}
    assert {k for k, x in rows.items() if x["status"] == "cycle"} == set(cyc)
    assert {k for k, x in rows.items() if x["status"] == "behind"} == {v for c in cyc for v in r[c]} - set(cyc)
    for x in rows.values():
        steps = x["path"].split("/")
        assert steps[-1] == cyc.get(x["topic_id"], x["topic_id"]) and steps[0] == x["root"] and len(steps) == x["depth"] + 1
        assert all(b in r[a] for a, b in zip(steps, steps[1:], strict=False))
    assert rows["below"]["path"].endswith("/below") and rows["deeper"]["depth"] > 0
    assert {tuple(x) for x in records.expanded(got).collect()} == {(a, b) for a in r for b in r[a] if cyc.get(a, a) != cyc.get(b, b)}
    top = {cyc.get(v, v) for v in r} - {cyc.get(b, b) for a in r for b in r[a] if cyc.get(a, a) != cyc.get(b, b)}
    want = {(v, t) for t in top for v in r if v in r[t] or v == t or cyc.get(v) == t} | {("lone", "lone")}
    assert {tuple(x) for x in records.roots(got).collect()} == want


def test_all_parents_count(spark):
    pairs = graph()
    r = reachable(pairs)
    cyc = {v: min(u for u in r[v] if v in r[u]) for v in r if v in r[v]}
    h = parts(spark, pairs)
    rows = {x["topic_id"]: x["descendants"] for x in records.nodes(h).collect()}
    assert rows == {v: sum(cyc.get(b, b) != cyc.get(v, v) for b in r[v]) for v in r} | {"lone": 0}
    above = {}
    for c, p in pairs:
        if cyc.get(c, c) != cyc.get(p, p):
            above.setdefault(cyc.get(c, c), set()).add(cyc.get(p, p))
    every = lambda v: [[*q, v] for p in above[v] for q in every(p)] if v in above else [[v]]
    want = sorted((v, q) for v in {cyc.get(x, x) for x in r} | {"lone"} for q in every(v))
    assert sorted(tuple(x) for x in paths(h).collect()) == want and len(want) > len(rows)
