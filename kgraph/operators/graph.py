"""The graph view of topic tables, and walks over it."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgraph.functions.text import summary
from kgraph.operators import hierarchy
from kgraph.operators.skew import hot_join
from kgraph.session import cut


class TopicNotFound(ValueError):
    """An id that the graph doesn't have."""


@dataclass(frozen=True)
class Graph:
    """topics (id, ...), dependencies (ordinal, topic_id, prerequisite_id, strength, reason), revisits (ordinal, earlier_id, later_id, note)."""

    topics: DataFrame
    dependencies: DataFrame
    revisits: DataFrame

    def require(self, ids: list[str]) -> None:
        known = {r[0] for r in self.topics.where(F.col("id").isin(ids)).select("id").distinct().limit(len(ids)).collect()}
        if missing := sorted(set(ids) - known):
            raise TopicNotFound(f"unknown topic ids: {', '.join(missing)}")


def provenance_or_default(c: Column) -> Column:
    """A missing provenance as method unknown, unreviewed, no confidence."""
    lacking = F.struct(F.lit("unknown").alias("method"), F.lit("unreviewed").alias("review_status"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("reviewed_at"), F.lit(0.0).alias("confidence"))
    return F.coalesce(c, lacking)


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row a key in the given order; by pre-aggregation, so that a key of many rows is no window of its own."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(key, "_r.*")


def prerequisites(g: Graph, starts: DataFrame, depth: int = 2, include_soft: bool = True) -> DataFrame:
    """(start, level, id, required_by, strength, reason): the walk upward from every start (column id), level by level.

    A node is reported once a start, at its first discovery: lowest level, then the order in which its finder was found, then the
    dependency's ordinal. Ends that are no topics are skipped; the start itself is never reported; depth <= 0 gives nothing.
    """
    known = g.topics.select(F.col("id").alias("prerequisite_id")).distinct()
    e = g.dependencies if include_soft else g.dependencies.where("strength <> 'soft'")
    e = cut(hot_join(e, known, ["prerequisite_id"], "left_semi").select(F.col("topic_id").alias("at"), "prerequisite_id", "ordinal", "strength", "reason"))
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct()
    front = seen.withColumn("rank", F.array().cast("array<bigint>"))
    seen = cut(seen)
    out = None
    for level in range(1, depth + 1):
        step = front.join(e, "at").select("start", F.col("prerequisite_id").alias("id"), F.col("at").alias("required_by"), "strength", "reason", F.concat("rank", F.array("ordinal")).alias("rank"))
        step = step.groupBy("start", "id").agg(F.min_by(F.struct("required_by", "strength", "reason", "rank"), "rank").alias("x")).select("start", "id", "x.*")
        step = cut(step.join(seen.withColumnRenamed("at", "id"), ["start", "id"], "left_anti"))
        if not step.take(1):
            break
        found = step.select("start", F.lit(level).alias("level"), "id", "required_by", "strength", "reason")
        out = found if out is None else out.unionByName(found)
        front = step.select("start", F.col("id").alias("at"), "rank")
        seen = cut(seen.unionByName(front.select("start", "at")))
    if out is None:
        out = starts.limit(0).select(F.col("id").alias("start"), F.lit(0).alias("level"), F.col("id"), F.col("id").alias("required_by"), F.lit("").alias("strength"), F.lit("").alias("reason"))
    return out


def ancestors(g: Graph, starts: DataFrame, include_soft: bool = True) -> DataFrame:
    """(id): the starts (column id) with everything upstream of any of them; safe on cycles."""
    e = g.dependencies if include_soft else g.dependencies.where("strength <> 'soft'")
    known = g.topics.select(F.col("id").alias("prerequisite_id")).distinct()
    e = cut(hot_join(e, known, ["prerequisite_id"], "left_semi").select(F.col("topic_id").alias("id"), F.col("prerequisite_id").alias("up")).distinct())
    seen = cut(starts.select("id").distinct())
    front = seen
    while True:
        front = cut(hot_join(e, front, ["id"], "left_semi").select(F.col("up").alias("id")).distinct().join(seen, "id", "left_anti"))
        if not front.take(1):
            return seen
        seen = cut(seen.unionByName(front))


def kahn_order(steps: list[tuple[str, int]], links: list[tuple[str, str]]) -> tuple[list[str], bool]:
    """Ids so that prerequisites come first, always the ready one of lowest (grade, id); what is on or behind a cycle comes last, in the same order."""
    grade = dict(steps)
    waits: dict[str, set[str]] = {i: set() for i in grade}
    after: dict[str, list[str]] = {i: [] for i in grade}
    for topic, need in links:
        if topic in grade and need in grade and need not in waits[topic]:
            waits[topic].add(need)
            after[need].append(topic)
    open_ = {i: len(w) for i, w in waits.items()}
    ready = [(grade[i], i) for i, n in open_.items() if n == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        _, i = heapq.heappop(ready)
        out.append(i)
        for j in after[i]:
            open_[j] -= 1
            if open_[j] == 0:
                heapq.heappush(ready, (grade[j], j))
    rest = sorted(set(grade) - set(out), key=lambda i: (grade[i], i))
    return out + rest, bool(rest)


def plan_path(g: Graph, target: str, known_ids: list[str] | None = None, include_soft: bool = True) -> tuple[DataFrame, list[str], bool]:
    """(steps, skipped_known, has_cycle): what is left to learn for the target, in order.

    steps (step, id, name, grade_start, grade_end, summary, provenance, revisits, is_target); revisits are the notes of `revisit_notes` in
    their order. Known ids take away themselves and all upstream of them; an unknown id is a TopicNotFound. The remaining closure of one target is ordered in one place, since the order is sequential.
    """
    known_ids = known_ids or []
    g.require([target, *known_ids])
    spark = g.topics.sparkSession
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    need = ancestors(g, ids([target]), include_soft)
    have = ancestors(g, ids(known_ids), include_soft) if known_ids else ids([])
    left = cut(need.join(have, "id", "left_anti"))
    skipped = [r[0] for r in need.join(have, "id", "left_semi").orderBy("id").collect()]
    rows = latest(g.topics, "id", "grade_start", "name").join(left, "id")
    e = g.dependencies if include_soft else g.dependencies.where("strength <> 'soft'")
    inner = e.join(left.withColumnRenamed("id", "topic_id"), "topic_id", "left_semi").join(left.withColumnRenamed("id", "prerequisite_id"), "prerequisite_id", "left_semi")
    links = inner.groupBy("topic_id").agg(F.collect_set("prerequisite_id").alias("needs")).withColumnRenamed("topic_id", "id")

    def order(part: pd.DataFrame) -> pd.DataFrame:
        pairs = [(i, n) for i, needs in zip(part["id"], part["needs"], strict=True) if needs is not None for n in needs]
        done, cyclic = kahn_order(list(zip(part["id"], part["grade_start"], strict=True)), pairs)
        at = {i: k + 1 for k, i in enumerate(done)}
        return pd.DataFrame({"step": part["id"].map(at).astype("int32"), "id": part["id"], "name": part["name"], "grade_start": part["grade_start"], "is_target": part["id"] == target, "has_cycle": cyclic})

    order_rows = rows.select("id", "name", "grade_start").join(links, "id", "left")
    steps = cut(order_rows.withColumn("plan", F.lit(1)).groupBy("plan").applyInPandas(order, "step int, id string, name string, grade_start int, is_target boolean, has_cycle boolean").orderBy("step"))
    cyclic = steps.select("has_cycle").head()
    notes = revisit_notes(g).join(left, "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "direction", "other_id", "other_name", "note"))).alias("revisits"))
    cards = rows.select("id", "grade_end", summary(F.col("description")).alias("summary"), provenance_or_default(F.col("provenance")).alias("provenance"))
    whole = steps.join(cards, "id").join(notes, "id", "left").withColumn("revisits", F.coalesce("revisits", F.array().cast(notes.schema["revisits"].dataType)))
    return whole.select("step", "id", "name", "grade_start", "grade_end", "summary", "provenance", "revisits", "is_target").orderBy("step"), skipped, bool(cyclic and cyclic[0])


def _known_links(g: Graph) -> DataFrame:
    """(parent, child): links between topics, distinct, without those of a topic to itself."""
    ids = g.topics.select("id").distinct()
    e = g.dependencies.select(F.col("prerequisite_id").alias("parent"), F.col("topic_id").alias("child")).where("parent <> child").distinct()
    return cut(hot_join(hot_join(e, ids.withColumnRenamed("id", "parent"), ["parent"], "left_semi"), ids.withColumnRenamed("id", "child"), ["child"], "left_semi"))


def chain_lengths(g: Graph) -> DataFrame:
    """(id, length): topics on the longest prerequisite chain that ends at id, over the nodes that no cycle is upstream of."""
    return hierarchy.chain_lengths(_known_links(g), g.topics.select("id"))[0].withColumnRenamed("v", "id")


def longest_chain(g: Graph) -> DataFrame:
    """(longest_chain, has_cycle): one row; the longest of `chain_lengths`, 0 without any, and whether topics require each other
    or themselves."""
    rows, odd = hierarchy.chain_lengths(_known_links(g), g.topics.select("id"))
    known = g.topics.select(F.col("id").alias("topic_id")).distinct()
    own = hot_join(g.dependencies.where("topic_id = prerequisite_id").select("topic_id"), known, ["topic_id"], "left_semi")
    loops = odd.select("v").unionByName(own.select(F.col("topic_id").alias("v"))).agg((F.count("*") > 0).alias("has_cycle"))
    return rows.agg(F.coalesce(F.max("length"), F.lit(0)).alias("longest_chain")).join(F.broadcast(loops))


def revisit_notes(g: Graph) -> DataFrame:
    """(id, direction, other_id, other_name, note, ordinal): spiral links seen from both ends; other ends that aren't topics are left out."""
    later = g.revisits.select(F.col("earlier_id").alias("id"), F.lit("later").alias("direction"), F.col("later_id").alias("other_id"), "note", "ordinal")
    earlier = g.revisits.select(F.col("later_id").alias("id"), F.lit("earlier").alias("direction"), F.col("earlier_id").alias("other_id"), "note", "ordinal")
    names = g.topics.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    return later.unionByName(earlier).join(names, "other_id").select("id", "direction", "other_id", "other_name", "note", "ordinal")


def ranked(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of every group in the order, with their rank; Spark prunes groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
