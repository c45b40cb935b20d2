"""One-to-one matching of scored pairs, best first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.session import cut


def greedy(pairs: DataFrame, left: str, right: str, order: list) -> DataFrame:
    """The pairs that taking the best free pair again and again would take, in the strict order given.

    Each round keeps the pairs that are best for both of their ends, then removes those ends. With a strict total order
    that's the sequential result; rounds are few, each with partial minima only.
    """
    key = F.struct(*order)
    rest = cut(pairs.withColumn("_o", key))
    out = None
    while rest.take(1):
        a = rest.groupBy(left).agg(F.min("_o").alias("_a"))
        b = rest.groupBy(right).agg(F.min("_o").alias("_b"))
        best = cut(rest.join(a, left).join(b, right).where("_o = _a AND _o = _b").drop("_a", "_b"))
        out = best if out is None else out.unionByName(best)
        rest = cut(rest.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti"))
    return (out if out is not None else rest).drop("_o")
