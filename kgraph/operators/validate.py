"""Checks of a graph: each gives findings (code, severity, message, context)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph.operators.graph import Graph
from kgraph.operators.hierarchy import cycle_paths, cycles
from kgraph.operators.serve import isolated
from kgraph.operators.skew import hot_join
from kgraph.session import cut

COVERAGE_LEAST = 0.9


def _finding(df: DataFrame, code: Column | str, severity: Column | str, message: Column, **context: Column) -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    pairs = [x for k, v in context.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(col(code).alias("code"), col(severity).alias("severity"), message.alias("message"), F.create_map(*pairs).alias("context"))


def ends(g: Graph) -> DataFrame:
    """(kind, ordinal, field, id): both ends of every link."""
    d = g.dependencies.select(F.lit("dependency").alias("kind"), "ordinal", F.inline(F.array(F.struct(F.lit("topic_id").alias("field"), F.col("topic_id").alias("id")), F.struct(F.lit("prerequisite_id").alias("field"), F.col("prerequisite_id").alias("id")))))
    r = g.revisits.select(F.lit("revisit").alias("kind"), "ordinal", F.inline(F.array(F.struct(F.lit("earlier_id").alias("field"), F.col("earlier_id").alias("id")), F.struct(F.lit("later_id").alias("field"), F.col("later_id").alias("id")))))
    return d.unionByName(r)


def dangling(g: Graph) -> DataFrame:
    """One finding an end that is no topic."""
    lost = ends(g).where("id IS NOT NULL").join(g.topics.select("id").distinct(), "id", "left_anti")
    return _finding(lost, "DANGLING_REF", "error", F.concat_ws(" ", "kind", F.lit("names"), "id"), kind=F.col("kind"), field=F.col("field"), id=F.col("id"))


def isolated_topics(g: Graph) -> DataFrame:
    return _finding(isolated(g), "ISOLATED_TOPIC", "warning", F.concat(F.lit("no link touches "), "id"), id=F.col("id"))


def with_ends(links: DataFrame, topics: DataFrame, low: str, high: str) -> DataFrame:
    """Links with the first grades of both ends (low_grade, high_grade); dangling links are left out."""
    t = topics.select("id", "grade_start").distinct()
    return links.join(t.toDF(low, "low_grade"), low).join(t.toDF(high, "high_grade"), high)


def grade_inversions(g: Graph) -> DataFrame:
    """A prerequisite of a later first grade than its topic: an error if hard, a warning otherwise."""
    bad = with_ends(g.dependencies, g.topics, "prerequisite_id", "topic_id").where("low_grade > high_grade")
    return _finding(bad, "GRADE_INVERSION", F.when(F.col("strength") == "hard", "error").otherwise("warning"), F.concat_ws(" ", "prerequisite_id", F.lit("comes after"), "topic_id"), topic_id=F.col("topic_id"), prerequisite_id=F.col("prerequisite_id"))


def revisits_not_advancing(g: Graph) -> DataFrame:
    bad = with_ends(g.revisits, g.topics, "earlier_id", "later_id").where("high_grade <= low_grade")
    return _finding(bad, "REVISIT_NOT_ADVANCING", "error", F.concat_ws(" ", "later_id", F.lit("isn't later than"), "earlier_id"), earlier_id=F.col("earlier_id"), later_id=F.col("later_id"))


def coverage(topics: DataFrame) -> DataFrame:
    """(topics, aligned, ratio): topics with a standard; one row, none for an empty table."""
    d = topics.agg(F.count("*").alias("topics"), F.count_if(F.size(F.coalesce("standards", F.array())) > 0).alias("aligned"))
    return d.where("topics > 0").withColumn("ratio", F.col("aligned") / F.col("topics"))


def unaligned(topics: DataFrame) -> DataFrame:
    """(id): topics without a standard."""
    return topics.where(F.size(F.coalesce("standards", F.array())) == 0).select("id")


def low_coverage(g: Graph, listed: int = 1000) -> DataFrame:
    """A finding if too few topics have a standard, with the first `listed` of those that have none by id; `unaligned` gives them all."""
    bad = coverage(g.topics).where(F.col("ratio") < COVERAGE_LEAST)
    first = unaligned(g.topics).where("id IS NOT NULL").orderBy("id").limit(listed).agg(F.concat_ws(",", F.sort_array(F.collect_list("id"))).alias("ids"))
    return _finding(bad.join(F.broadcast(first)), "LOW_STANDARDS_COVERAGE", "error", F.format_string("%d of %d topics have a standard", "aligned", "topics"), topics=F.col("topics"), aligned=F.col("aligned"), unaligned=F.col("ids"))


def missing_provenance(g: Graph) -> DataFrame:
    return _finding(g.topics.where("provenance IS NULL"), "MISSING_PROVENANCE", "error", F.concat(F.lit("no provenance: "), "id"), id=F.col("id"))


def cycle_findings(g: Graph) -> DataFrame:
    """One finding a set of topics that require each other, with its size and one path around, from prerequisite to topic and back to its
    start; the members are in `hierarchy.cycles`."""
    known = g.topics.select("id").distinct()
    e = hot_join(g.dependencies.select("topic_id", "prerequisite_id"), known.toDF("topic_id"), ["topic_id"], "left_semi")
    e = cut(hot_join(e, known.toDF("prerequisite_id"), ["prerequisite_id"], "left_semi"))
    members = cut(cycles(e, "topic_id", "prerequisite_id"))
    sets = members.groupBy("cycle_id").agg(F.count("*").alias("n")).join(cycle_paths(e, "topic_id", "prerequisite_id", members), "cycle_id")
    path = F.concat_ws(" → ", F.concat("path", F.slice("path", 1, 1)))
    return _finding(sets, "CYCLE", "error", F.concat(F.col("n").cast("string"), F.lit(" topics require each other: "), path), cycle_id=F.col("cycle_id"), topics=F.col("n"), path=path)


def name_description(g: Graph, judge: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Findings of a judge (df -> df with judgment added); without one, a single note that the check was skipped."""
    if judge is None:
        return _finding(g.topics.sparkSession.range(1), "CONSISTENCY_SKIPPED", "warning", F.lit("no judge was given"), reason=F.lit("no judge"))
    seen = judge(g.topics.select("id", "name", "description")).where("judgment <> 'consistent'")
    whole = F.col("judgment") == "topic_mismatch"
    return _finding(seen, F.when(whole, "NAME_DESC_MISMATCH").otherwise("NAME_DESC_SCOPE_MISMATCH"), F.when(whole, "error").otherwise("warning"), F.concat_ws(" ", "id", "judgment"), id=F.col("id"))


SUITE = (cycle_findings, dangling, isolated_topics, grade_inversions, revisits_not_advancing, low_coverage, missing_provenance)


def run_all(g: Graph, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All findings with the check's place in the suite (seq)."""
    parts = [f(g).withColumn("seq", F.lit(i)) for i, f in enumerate(SUITE)] + [name_description(g, judge).withColumn("seq", F.lit(len(SUITE)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def has_errors(findings: DataFrame) -> bool:
    return not findings.where("severity = 'error'").isEmpty()


def summarised(findings: DataFrame, samples: int = 5) -> DataFrame:
    """(code, severity, findings, samples): errors first, then by count; the first messages in order as samples.

    Counting and sampling are separate aggregates: samples are ranked and pruned before they are gathered.
    """
    from kgraph.operators.graph import ranked

    n = findings.groupBy("code", "severity").agg(F.count("*").alias("findings"))
    few = ranked(findings.select("code", "severity", "message"), ["code", "severity"], ["message"], samples).groupBy("code", "severity").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "message"))), lambda x: x["message"]).alias("samples"))
    return n.join(few, ["code", "severity"]).orderBy("severity", F.desc("findings"), "code")


def empty_generation(g: Graph) -> DataFrame:
    """A finding if the graph has no topics at all."""
    return _finding(g.topics.agg(F.count("*").alias("n")).where("n = 0"), "EMPTY_GENERATION", "error", F.lit("no topic was made"), topics=F.col("n"))
