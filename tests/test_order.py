import random

from kgraph.operators.order import before


def test_running_sums(spark):
    """A hot group, a null group and a null order; other columns stay."""
    rng = random.Random(4)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), None if i == 0 else i * 5 % 301, rng.randrange(5), str(i)) for i in range(301)]
    got = before(spark.createDataFrame(rows, "g string, o int, n int, v string").repartition(7), ["g"], ["o"], "n").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["before"] == sum(n for g, o, n, _ in rows if g == r["g"] and (o if o is not None else -1) < (r["o"] if r["o"] is not None else -1))
    assert before(spark.createDataFrame([], "g string, o int, n int"), ["g"], ["o"], "n").collect() == []
