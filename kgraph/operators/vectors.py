"""Nearest vectors of a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.operators.graph import ranked
from kgraph.operators.order import before
from kgraph.session import cut

#: Query vectors that one pass over the rows takes, whatever their number: a bounded matrix for every task.
BLOCK = 4096


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 5) -> DataFrame:
    """(query_id, rank, key, score): the k vectors of highest cosine for each query, itself left out; ties go to the smaller key.

    Exact, over all rows. Scores are rounded before they are ranked; a negative one is 0. Null vectors and null keys take no part, vectors of
    zeros score 0, another length than the first query's is an error. Each block of queries is one narrow pass of matrix products, in which a task keeps the best k of
    its rows for a query; only these meet in a shuffle.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    some = lambda d: d.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key IS NOT NULL AND v IS NOT NULL")
    rows = some(vectors)
    q = cut(before(some(queries).withColumn("one", F.lit(1)).withColumn("all", F.lit(0)), ["all"], ["key"], "one", "n").select("key", "v", F.expr(f"n div {BLOCK}").alias("block")))
    best = None
    for b in range((q.agg(F.max("block")).first()[0] if not q.isEmpty() else -1) + 1):
        held = q.where(F.col("block") == b).orderBy("key").collect()  # at most BLOCK rows
        ids = np.array([r["key"] for r in held])
        m = _unit(np.array([r["v"] for r in held], dtype=float))
        shared = spark.sparkContext.broadcast((ids, m))

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            kept = None
            for part in parts:
                if not len(part):
                    continue
                at = part["key"].to_numpy()
                x = np.stack(part["v"].to_numpy())
                if x.shape[1] != m.shape[1]:
                    raise ValueError("vectors of different lengths")
                s = np.floor(np.maximum(m @ _unit(x).T, 0.0) * 10**digits + 0.5) / 10**digits
                for i, own in enumerate(ids):
                    ok = at != own
                    # a total order, so that ties at the edge are settled as in the end
                    top = np.lexsort((at[ok], -s[i][ok]))[:k]
                    new = pd.DataFrame({"query_id": own, "key": at[ok][top], "score": s[i][ok][top]})
                    kept = [new] if kept is None else [*kept, new]
                if kept is not None and len(kept) > 4 * len(ids):
                    kept = [_best(pd.concat(kept), k)]
            if kept:
                yield _best(pd.concat(kept), k)

        found = rows.mapInPandas(run, f"query_id {kind}, key {kind}, score double")
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = rows.select(F.col("key").alias("query_id"), "key", F.lit(0.0).alias("score")).limit(0)
    return ranked(best, ["query_id"], [F.desc("score"), F.asc("key")], k).select("query_id", "rank", F.col("key").alias(key), "score")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best(d: pd.DataFrame, k: int) -> pd.DataFrame:
    return d.sort_values(["query_id", "score", "key"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
