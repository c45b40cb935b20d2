import random

from kgraph.operators.hierarchy import cycle_paths, cycles, descendants, hierarchy, stabbed
from kgraph.plans import records


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "child string, parent string, lft int")


def reachable(pairs):
    out = {}
    for c, p in pairs:
        if c is not None and p is not None:
            out.setdefault(p, set()).add(c)
    reach = {}
    for v in {x for e in pairs for x in e if x is not None}:
        seen, todo = set(), list(out.get(v, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[v] = seen
    return reach


def brute_cycles(pairs):
    r = reachable([e for e in pairs if None not in e])
    return {(min(u for u in r[v] if v in r[u]), v) for v in r if v in r[v]}


def test_cycles_of_random_graphs(spark):
    rng = random.Random(5)
    pairs = []
    for g in range(12):
        n = rng.randint(2, 14)
        pairs += [(f"{g}-{rng.randrange(n):02d}", f"{g}-{rng.randrange(n):02d}") for _ in range(rng.randint(1, 2 * n))]
    ring = [f"r{i}" for i in range(40)]
    rng.shuffle(ring)
    pairs += list(zip(ring, ring[1:] + ring[:1], strict=True)) + [(f"t{i}", f"t{i - 1}") for i in range(1, 20)] + [("t0", ring[0])]
    pairs += [(None, "x"), ("x", None), ("", "x"), ("x", "")] + pairs[:5]
    got = {tuple(r) for r in cycles(edges(spark, pairs), "child", "parent").collect()}
    assert got == brute_cycles(pairs)


def test_cycle_paths(spark):
    rng = random.Random(8)
    pairs = [(f"{g}-{rng.randrange(9):02d}", f"{g}-{rng.randrange(9):02d}") for g in range(8) for _ in range(16)] + [("s", "s")]
    ring = [f"r{i:02d}" for i in range(33)]
    pairs += list(zip(ring[1:] + ring[:1], ring, strict=True))
    df = edges(spark, pairs)
    found = cycles(df, "child", "parent")
    paths = {r["cycle_id"]: r["path"] for r in cycle_paths(df, "child", "parent", found).collect()}
    sets = {}
    for r in found.collect():
        sets.setdefault(r["cycle_id"], set()).add(r["node"])
    assert paths.keys() == sets.keys() and paths["s"] == ["s"] and paths["r00"] == ring
    for c, p in paths.items():
        assert set(p) <= sets[c] and len(set(p)) == len(p) and p[0] == min(p)
        assert all((b, a) in set(pairs) for a, b in zip(p, p[1:] + p[:1], strict=True))
    assert cycle_paths(edges(spark, []), "child", "parent", found.limit(0)).collect() == []


def test_no_links(spark):
    assert cycles(edges(spark, []), "child", "parent").collect() == []
    h = hierarchy(edges(spark, [(None, "a")]), "child", "parent", spark.createDataFrame([("b",)], "id string"))
    assert [(r["topic_id"], r["status"], r["depth"], r["descendants"]) for r in records.nodes(h).collect()] == [("b", "tree", 0, 0)]
    assert descendants(h).collect() == [] and records.roots(h).collect() == [("b", "b")]
    assert records.nodes(hierarchy(edges(spark, []), "child", "parent")).collect() == []


def test_ranges_and_ancestry(spark):
    rng = random.Random(9)
    pairs = [(f"n{i:02d}", f"n{rng.randrange(i):02d}") for i in range(1, 40) for _ in range(rng.choice((1, 1, 2)))]
    pairs += [("s", "s"), ("below", "s"), ("c1", "c2"), ("c2", "c1"), ("under", "c1"), ("deeper", "under"), ("n03/x", "n07"), ("y", "n03/x"), ("x", "n11")]
    h = hierarchy(edges(spark, pairs), "child", "parent")
    rows = {r["topic_id"]: r for r in records.nodes(h).collect()}
    assert {k for k, r in rows.items() if r["status"] == "cycle"} == {"s", "c1", "c2"}
    assert {k for k, r in rows.items() if r["status"] == "behind"} == {"below", "under", "deeper"}
    assert rows["c1"]["lft"] == rows["c2"]["lft"] and rows["c1"]["rgt"] - rows["c1"]["lft"] == 3
    sets = {r["v"]: r for r in h.sets.collect()}
    taken = sorted(i for r in sets.values() for i in range(r["lft"], r["lft"] + r["weight"]))
    assert taken == list(range(1, len(rows) + 1))
    for v, r in sets.items():
        assert r["path"][-1] == v and r["path"][0] == r["root"] and len(r["path"]) == r["depth"] + 1
        assert {u for u, s in sets.items() if r["lft"] < s["lft"] <= r["rgt"]} == {u for u, s in sets.items() if v in s["path"][:-1]}
    tree = {k for k, r in rows.items() if r["status"] == "tree"}
    reach = reachable([e for e in pairs if e[0] in tree and e[1] in tree])
    got = [tuple(r) for r in records.ancestry(h).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, d) for a in reach for d in reach[a]}
    some = spark.createDataFrame([("n00",), ("n05",)], "id string")
    assert {tuple(r) for r in descendants(h, some).collect()} == {(a, d) for a in ("n00", "n05") for d in reach[a]}


def test_stabbed(spark):
    rng = random.Random(1)
    ranges = [(i, *sorted((rng.randrange(9000), rng.randrange(9000)))) for i in range(40)] + [(90, 5, 4), (91, 7, 7), (92, 0, 9000)]
    points = [(i, rng.randrange(9001)) for i in range(300)] + [(900, 7)]
    a, b = spark.createDataFrame(ranges, "a int, lo long, hi long"), spark.createDataFrame(points, "p int, at long")
    got = [tuple(r) for r in stabbed(a, b).select("a", "p").collect()]
    assert sorted(got) == sorted((i, p) for i, lo, hi in ranges for p, at in points if lo <= at <= hi)
