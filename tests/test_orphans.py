from datetime import datetime as D

import numpy as np
from pyspark.sql import functions as F

from kgraph.operators import orphans


def test_kinds_and_periods(spark):
    jan, feb, mar = D(2025, 1, 5), D(2025, 2, 5), D(2025, 3, 5)
    keys = spark.createDataFrame([("a", jan, None), ("a", mar, None), ("b", mar, None), ("c", jan, feb), ("d", feb, D(2025, 2, 20)), (None, jan, None), ("n", None, None)], "id string, at timestamp, gone timestamp")
    refs = spark.createDataFrame([(1, "a", feb), (2, "b", feb), (2, "b", D(2025, 4, 1)), (3, "c", feb), (4, "d", D(2025, 2, 10)), (5, "d", mar), (6, "zz", jan), (7, "", jan), (8, None, jan), (9, "b", D(2025, 3, 6)), (10, "q", None), (11, "n", jan), (12, "b", D(2025, 3, 1))], "row bigint, key string, at timestamp")
    k = orphans.parents(keys, "s", "id", "at", "gone")
    r = orphans.references(refs, "s", "t", "row", "key", F.col("key"), "at")
    got = {(x["row_id"], x["kind"], x["period"]) for x in orphans.orphans(r, k).collect()}
    assert got == {(2, "late", "2025-02"), (3, "deleted", "2025-02"), (5, "deleted", "2025-03"), (6, "missing", "2025-01"), (7, "missing", "2025-01"), (10, "missing", None), (12, "late", "2025-03")}


def test_empty(spark):
    k = orphans.parents(spark.createDataFrame([], "id string, at timestamp, gone timestamp"), "s", "id", "at", "gone")
    r = orphans.references(spark.createDataFrame([], "row bigint, key string, at timestamp"), "s", "t", "row", "key", F.col("key"), "at")
    assert orphans.orphans(r, k).collect() == []


def test_containers():
    rng = np.random.default_rng(1)
    every = np.arange(orphans.RANGE)
    for bits, kind in ((every, b"r"), (every[100:9000], b"r"), (rng.choice(every, 20_000, replace=False), b"b"), (every[::3][:50], b"p"), (every[:1], b"p"), (every[-2:], b"p"), (every[:0], b"p"), (every[-9:], b"r")):
        data = orphans.packed(bits.copy())
        assert data[:1] == kind and (np.flatnonzero(orphans.opened(data)) == np.sort(bits)).all() and len(data) <= 4097
