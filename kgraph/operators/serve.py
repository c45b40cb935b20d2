"""The six served queries: search, matching of observations, one topic, prerequisites, a learning path, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph.functions.scoring import LITERAL, Scorer, match_score, search_score, shared_grams
from kgraph.functions.text import summary
from kgraph.operators.graph import Graph, TopicNotFound, provenance_or_default, ranked


def cards(topics: DataFrame, score: Column | None = None) -> DataFrame:
    """(id, name, summary, grade_start, grade_end, review_status, score) of topics."""
    p = provenance_or_default(F.col("provenance"))
    return topics.select("id", "name", summary(F.col("description")).alias("summary"), "grade_start", "grade_end", p["review_status"].alias("review_status"), F.bround(score, 4).alias("score") if score is not None else F.lit(None).cast("double").alias("score"))


def get_topic(g: Graph, topic_id: str) -> DataFrame:
    found = g.topics.where(F.col("id") == topic_id)
    if found.isEmpty():
        raise TopicNotFound(f"unknown topic id: {topic_id}")
    return found.withColumn("provenance", provenance_or_default(F.col("provenance")))


def _limit(n: int) -> int:
    if n < 0:
        raise ValueError("a limit can't be negative")
    return n


def search_topics(g: Graph, query: str, grade: int | None = None, limit: int = 5, scorer: Scorer = LITERAL) -> DataFrame:
    """Cards of the topics nearest to the query. The raw best of name and description is admitted at the threshold;
    the weighted score ranks, then the id. The grade filter comes before any scoring."""
    t = g.topics if grade is None else g.topics.where(F.lit(grade).between(F.col("grade_start"), F.col("grade_end")))
    q = scorer.prepare(F.lit(query))
    d = t.withColumns({"_n": scorer.relevance(q, scorer.prepare(F.col("name"))), "_d": scorer.relevance(q, scorer.prepare(F.col("description")))})
    d = d.where(F.greatest("_n", "_d") >= scorer.least).withColumn("_s", search_score(F.col("_n"), F.col("_d")))
    return cards(d.orderBy(F.desc("_s"), "id").limit(_limit(limit)), F.col("_s")).orderBy(F.desc("score"), "id")


def misconception_rows(topics: DataFrame) -> DataFrame:
    """(id, name, position, statement, probe, correction_hint): one row a misconception; topics without any have none."""
    return topics.select("id", "name", F.posexplode("misconceptions").alias("position", "m")).select("id", "name", "position", "m.*")


def match_misconceptions(g: Graph, observation: str, limit: int = 5, scorer: Scorer = LITERAL) -> DataFrame:
    """(id, name, position, statement, probe, correction_hint, score) nearest to an observation."""
    q = scorer.prepare(F.lit(observation))
    rel = lambda c: scorer.relevance(q, scorer.prepare(F.col(c)))
    d = misconception_rows(g.topics).withColumns({"_s": rel("statement"), "_p": rel("probe"), "_h": rel("correction_hint")})
    d = d.where(F.greatest("_s", "_p", "_h") >= scorer.least).withColumn("score", match_score(F.col("_s"), F.col("_p"), F.col("_h")))
    return d.orderBy(F.desc("score"), "id", "position").limit(_limit(limit)).drop("_s", "_p", "_h")


def match_all(topics: DataFrame, observations: DataFrame, limit: int = 5) -> DataFrame:
    """(case_id, rank, id, position, score): `match_misconceptions` by bigrams for every observation (case_id, text) at once."""
    m = misconception_rows(topics).withColumn("row", F.struct("id", "position"))
    found = None
    for f in ("statement", "probe", "correction_hint"):
        s = shared_grams(observations, m, "case_id", "row", "text", f)
        s = s.select("case_id", "row", F.lit(f).alias("field"), (F.col("shared") / F.least("n_query", "n_text")).alias("share"))
        found = s if found is None else found.unionByName(s)
    best = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("share"))), F.lit(0.0)).alias(f)
    d = found.groupBy("case_id", "row").agg(best("statement"), best("probe"), best("correction_hint"))
    d = d.where(F.greatest("statement", "probe", "correction_hint") >= LITERAL.least).select("case_id", "row.id", "row.position", match_score(F.col("statement"), F.col("probe"), F.col("correction_hint")).alias("score"))
    return ranked(d, ["case_id"], [F.desc("score"), F.asc("id"), F.asc("position")], _limit(limit)).select("case_id", "rank", "id", "position", "score")


def corpus_texts(topics: DataFrame) -> DataFrame:
    """(text): the distinct searchable texts: names, descriptions, and the three strings of each misconception."""
    own = topics.select(F.explode(F.array("name", "description")).alias("text"))
    m = misconception_rows(topics).select(F.explode(F.array("statement", "probe", "correction_hint")).alias("text"))
    return own.unionByName(m).where("text IS NOT NULL").distinct()


def grade_distribution(topics: DataFrame) -> DataFrame:
    """(grade, topics): a topic counts once for every grade it spans; without an end it counts for its start."""
    span = F.when(F.coalesce("grade_end", "grade_start") >= F.col("grade_start"), F.sequence("grade_start", F.coalesce("grade_end", "grade_start")))
    return topics.select(F.explode(span).alias("grade")).groupBy("grade").agg(F.count("*").alias("topics"))


def codes_by_curriculum(topics: DataFrame) -> DataFrame:
    """(curriculum, codes): sorted distinct codes."""
    return topics.select(F.explode("standards").alias("s")).select("s.*").distinct().groupBy("curriculum").agg(F.sort_array(F.collect_list("code")).alias("codes"))


def review_status_counts(topics: DataFrame) -> DataFrame:
    return topics.groupBy(provenance_or_default(F.col("provenance"))["review_status"].alias("review_status")).agg(F.count("*").alias("topics"))


def connected_ids(g: Graph) -> DataFrame:
    """(id): every end of any link, dangling ones too."""
    a = g.dependencies.select(F.explode(F.array("topic_id", "prerequisite_id")).alias("id"))
    return a.unionByName(g.revisits.select(F.explode(F.array("earlier_id", "later_id")).alias("id"))).where("id IS NOT NULL").distinct()


def isolated(g: Graph) -> DataFrame:
    return g.topics.join(connected_ids(g), "id", "left_anti")


def graph_counts(g: Graph) -> DataFrame:
    """One row: topics, dependencies, hard, soft, revisits, isolated."""
    t = g.topics.agg(F.count("*").alias("topics"))
    d = g.dependencies.agg(F.count("*").alias("dependencies"), F.count_if(F.col("strength") == "hard").alias("hard"), F.count_if(F.col("strength") == "soft").alias("soft"))
    r = g.revisits.agg(F.count("*").alias("revisits"))
    i = isolated(g).agg(F.count("*").alias("isolated"))
    one = lambda x: F.broadcast(x)  # noqa: E731 -- each is exactly one row
    return t.join(one(d)).join(one(r)).join(one(i))
