"""Measures of retrieval, judges, drift and latency."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.operators.graph import ranked
from kgraph.operators.order import before


def threshold_range(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... up to stop, never beyond it, to 4 decimals."""
    if step <= 0:
        raise ValueError("a step must be positive")
    a, b, s = (Decimal(str(x)) for x in (start, stop, step))
    return [float(round(a + i * s, 4)) for i in range(int((b - a) / s) + 1)] if b >= a else []


def frontier(cases: DataFrame, scored: DataFrame, thresholds: list[float], k: int = 3) -> DataFrame:
    """(threshold, recall, empty_accuracy, cases, empty_cases).

    cases (case_id, expected array<string>), scored (case_id, id, raw, score): scored once for all thresholds. For each case,
    the first k admitted ids by score then id. recall is over cases that expect something (0 if none), empty_accuracy over
    the others (1 if none). Top k under a threshold on raw: a case's hits are found by ranking each threshold's admitted
    rows, pruned a group before the shuffle.
    """
    spark = cases.sparkSession
    t = F.broadcast(spark.createDataFrame([(x,) for x in thresholds], "threshold double"))
    admitted = scored.join(t, F.col("raw") >= F.col("threshold"))
    top = ranked(admitted, ["threshold", "case_id"], [F.desc("score"), F.asc("id")], k)
    hits = top.join(cases.select("case_id", F.explode("expected").alias("id")), ["case_id", "id"], "left_semi").select("threshold", "case_id").distinct().withColumn("hit", F.lit(1))
    some = top.select("threshold", "case_id").distinct().withColumn("some", F.lit(1))
    grid = cases.select("case_id", (F.size("expected") == 0).alias("empty")).join(t)
    d = grid.join(hits, ["threshold", "case_id"], "left").join(some, ["threshold", "case_id"], "left")
    full, none = F.count_if(~F.col("empty")), F.count_if("empty")
    return d.groupBy("threshold").agg(F.coalesce(F.try_divide(F.count_if(~F.col("empty") & F.col("hit").isNotNull()), full), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(F.count_if(F.col("empty") & F.col("some").isNull()), none), F.lit(1.0)).alias("empty_accuracy"), full.alias("cases"), none.alias("empty_cases"))


def operating_point(points: DataFrame, least_empty: float) -> DataFrame:
    """The row of best recall among those with empty_accuracy >= least_empty; the lowest threshold of equal ones; or no row."""
    return points.where(F.col("empty_accuracy") >= least_empty).orderBy(F.desc("recall"), "threshold").limit(1)


def stale_cases(cases: DataFrame, topics: DataFrame) -> DataFrame:
    """(case_id, missing): cases that expect ids which the graph lacks."""
    want = cases.select("case_id", F.explode("expected").alias("id"))
    return want.join(topics.select("id"), "id", "left_anti").groupBy("case_id").agg(F.sort_array(F.collect_set("id")).alias("missing"))


def confusion(df: DataFrame, expected: str, got: str, labels: list[str]) -> DataFrame:
    """(expected, one column a label): counts."""
    return df.groupBy(F.col(expected).alias("expected")).pivot(got, labels).count().na.fill(0)


def class_scores(df: DataFrame, expected: str, got: str) -> DataFrame:
    """(label, precision, recall, expected_count, got_count); 0 where a denominator is 0."""
    n = df.groupBy(expected, got).agg(F.count("*").alias("n"))
    e = n.groupBy(F.col(expected).alias("label")).agg(F.sum("n").alias("expected_count"), F.sum(F.when(F.col(expected) == F.col(got), F.col("n")).otherwise(0)).alias("right"))
    g = n.groupBy(F.col(got).alias("label")).agg(F.sum("n").alias("got_count"))
    d = e.join(g, "label", "full").fillna(0)
    return d.select("label", F.coalesce(F.try_divide("right", "got_count"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("right", "expected_count"), F.lit(0.0)).alias("recall"), "expected_count", "got_count")


def latency_levels(df: DataFrame, level: str, value: str) -> DataFrame:
    """(level, requests, p50, p95): the interpolated median, and the nearest-rank 95th percentile.

    Exact order statistics: values are combined with their counts before the shuffle, and ranks are running sums over ranges of
    values, so a level of a third of all rows is spread.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(level, value).agg(F.count("*").alias("n"))
    total = n.groupBy(level).agg(F.sum("n").alias("requests"))
    d = before(n, [level], [value], "n").join(total, level)
    at = F.greatest(F.lit(1), F.least(F.col("requests"), F.bround(F.lit(0.95) * F.col("requests") + F.lit(0.5)).cast("long")))
    low, high = F.expr("(requests + 1) div 2"), F.expr("least(requests, requests div 2 + 1)")
    holds = lambda rank: F.min(F.when((F.col("before") < rank) & (rank <= F.col("before") + F.col("n")), F.col(value)))
    return d.groupBy(level).agg(F.first("requests").alias("requests"), ((holds(low) + holds(high)) / 2).alias("p50"), holds(at).alias("p95"))


def level_results(calls: DataFrame, level: str) -> DataFrame:
    """(level, requests, ok, rate_limited, failed, wall, throughput, p50, p95, peak) of measured calls.

    calls (level, started, ended, status, error); started and ended in seconds. A call without status and error is ok, one with status 429 or an error that
    says so is rate-limited, any other failed; the three add up. Throughput counts ok calls only; percentiles are of their
    durations, 0 without any; wall is from the first start to the last end. peak is the largest number of calls under way at once: one
    that ends when another starts is over.
    """
    limited = is_rate_limited(F.col("status"), F.col("error"))
    d = calls.withColumn("_how", F.when(limited, "limited").when(F.col("status").isNull() & F.col("error").isNull(), "ok").otherwise("failed"))
    n = d.groupBy(level).agg(F.count("*").alias("requests"), F.count_if(F.col("_how") == "ok").alias("ok"), F.count_if(limited).alias("rate_limited"), F.count_if(F.col("_how") == "failed").alias("failed"), (F.max("ended") - F.min("started")).alias("wall"))
    took = latency_levels(d.where("_how = 'ok'").withColumn("_took", F.col("ended") - F.col("started")), level, "_took").drop("requests")
    steps = F.array(F.struct(F.col("started").alias("at"), F.lit(1).alias("turn")), F.struct(F.col("ended").alias("at"), F.lit(-1).alias("turn")))
    moves = d.where("started < ended").select(level, F.inline(steps)).groupBy(level, "at", "turn").agg(F.sum("turn").alias("by"))
    peak = before(moves, [level], ["at", "turn"], "by").groupBy(level).agg(F.max(F.col("before") + F.col("by")).alias("peak"))
    out = n.join(took, level, "left").join(peak, level, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(level, "requests", "ok", "rate_limited", "failed", "wall", F.when(F.col("wall") > 0, F.col("ok") / F.col("wall")).otherwise(F.lit(0.0)).alias("throughput"), zero("p50").alias("p50"), zero("p95").alias("p95"), F.coalesce("peak", F.lit(0)).alias("peak"))


def recommended_level(levels: DataFrame, share: float = 0.95) -> int:
    """The smallest level without refusals whose throughput is at least `share` of the best such; 1 if all had refusals.

    levels (concurrency, rate_limited, throughput); no levels at all are an error.
    """
    if levels.isEmpty():
        raise ValueError("no levels were measured")
    clean = levels.where("rate_limited = 0")
    best = clean.agg(F.max("throughput")).first()[0]
    if best is None:
        return 1
    return clean.where(F.col("throughput") >= share * best).agg(F.min("concurrency")).first()[0]


def is_rate_limited(status, text):
    return F.coalesce(status == 429, F.lit(False)) | F.coalesce(F.contains(text, F.lit("429")), F.lit(False))


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(both, either, jaccard) of the distinct non-null values of a column in two tables; jaccard is 0 for two empty ones."""
    x = a.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_a", F.lit(1))
    y = b.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_b", F.lit(1))
    d = x.join(y, column, "full").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count("*").alias("either"))
    return d.withColumn("jaccard", F.coalesce(F.try_divide("both", "either"), F.lit(0.0)))
