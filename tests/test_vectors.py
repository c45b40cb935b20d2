import random

from kgraph.operators import vectors


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(60)] + [(90, None), (None, [1.0] * 4), (91, [0.0] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)

    def score(x, y):
        n = (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
        return int(max(0.0, sum(a * b for a, b in zip(x, y, strict=True)) / n if n else 0.0) * 1e5 + 0.5) / 1e5

    whole = [(i, v) for i, v in rows if i is not None and v is not None]
    want = {(i, k + 1, j, s) for i, v in whole if i % 8 == 0 for k, (s, j) in enumerate(sorted(((score(v, w), j) for j, w in whole if j != i), key=lambda x: (-x[0], x[1]))[:4])}
    assert {tuple(r) for r in vectors.nearest(d, d.where("vec_id % 8 = 0"), 4).collect()} == want
    assert vectors.nearest(d, d.limit(0), 4).collect() == []
