"""The whole way from source texts to a graph: every stage of `curate` over one resumable run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph import schema as S
from kgraph.operators import curate, validate
from kgraph.operators.graph import Graph
from kgraph.operators.hierarchy import cycles
from kgraph.plans.stages import Run


@dataclass(frozen=True)
class Models:
    """The hooks of a run. extractor: chunk -> contents; same_topic: {a, b} -> (same, reason); proposer: target with pool ->
    proposals; judges: draft or edge -> vote."""

    extractor: Callable
    same_topic: Callable
    proposer: Callable
    fidelity: list[Callable] = field(default_factory=list)
    names: list[Callable] = field(default_factory=list)
    edges: list[Callable] = field(default_factory=list)


@dataclass(frozen=True)
class Curated:
    graph: Graph
    registry: DataFrame
    drops: DataFrame
    merges: DataFrame
    outcomes: DataFrame
    findings: DataFrame


def deduplicated(drafts: DataFrame, judge) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drafts, merges, drops): candidates folded by the judge within their connected parts, then names made unique."""
    pairs = curate.cut(curate.duplicate_pairs(drafts))
    # links both ways make every connected part one strongly connected set
    parts = curate.cut(cycles(pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))), "i", "j").toDF("group_id", "draft_id"))
    folded, merges, failed = curate.folded(drafts, pairs, parts, judge)
    chunk = drafts.select("draft_id", "chunk_id")
    live = curate.cut(drafts.join(parts, "draft_id", "left_anti").unionByName(folded.join(chunk, "draft_id").select(*drafts.columns)))
    named, clashed = curate.unclashed(live.select("draft_id", "content.name", "content.grade_start"))
    out = live.join(named.select("draft_id", "name"), "draft_id").withColumn("content", F.col("content").withField("name", F.col("name"))).select(*drafts.columns)
    return out, merges, failed.unionByName(clashed)


def curated(run: Run, texts: DataFrame, entries: DataFrame, models: Models, curriculum: str, model: str, parallel: int | None = None) -> Curated:
    """texts (source_file, text) and registry entries -> the graph with everything that was rejected, and the findings.

    Each stage is written before the next reads it, its drops with it. The registry with its new entries comes out; putting it
    in the old one's place is the caller's.
    """
    if not (models.fidelity and models.names and models.edges):
        raise ValueError("every aspect needs a judge")
    chunks, d1 = run.stages(["chunks", "chunks-drops"], lambda: curate.chunks(texts))
    drafts, d2 = run.stages(["drafts", "drafts-drops"], lambda: curate.extract(chunks, models.extractor, parallel))
    single, merges, d3 = run.stages(["deduped", "merges", "deduped-drops"], lambda: deduplicated(drafts, models.same_topic))
    edges, d4 = run.stages(["edges", "edges-drops"], lambda: curate.proposed_edges(single, models.proposer, parallel))
    kept, seen, d5 = run.stages(["reviewed", "reviewed-log", "reviewed-drops"], lambda: curate.reviewed_drafts(single, models.fidelity, models.names, parallel))

    def links():
        between, cut_off = curate.reviewed_edges(edges, kept)
        good, log, rejected = curate.judged_edges(between, kept, models.edges, parallel)
        once, double = curate.single_edges(good, "target_draft_id", "prerequisite_draft_id", "strength", ["ordinal"])
        lone = curate.drop_rows(curate.orphaned(kept, edges, good), "review", F.col("draft_id"), curate.ORPHANED_BY_REJECTION, F.lit(""))
        twice = curate.drop_rows(double, "assemble", F.concat_ws("<-", "target_draft_id", "prerequisite_draft_id"), curate.DUPLICATE_EDGE, F.col("strength"))
        return once, log, cut_off.unionByName(rejected).unionByName(lone).unionByName(twice)

    final, seen_edges, d6 = run.stages(["links", "links-log", "links-drops"], links)
    ids, registry = run.stages(["ids", "registry"], lambda: curate.assigned(kept.select(F.col("draft_id").alias("id"), "content.*"), entries))
    topics, dependencies = run.stages(["topics", "dependencies"], lambda: curate.assembled(kept, final, ids, curriculum, model))
    spark = run.spark
    revisits = spark.createDataFrame([], S.T.StructType([S.T.StructField("ordinal", S.T.LongType()), *S.REVISIT.fields]))
    g = Graph(topics, dependencies.withColumn("ordinal", F.monotonically_increasing_id()), revisits)
    # the names were judged in review already
    said = seen.where("aspect = 'name_desc'").select(F.col("target").alias("draft_id"), F.col("votes")[0]["judgment"].alias("judgment"))
    said = ids.select(F.col("id").alias("draft_id"), F.col("topic_id").alias("id")).join(said, "draft_id").select("id", "judgment")
    findings = run.stage("findings", lambda: validate.run_all(g, lambda t: t.join(said, "id")).drop("seq").unionByName(validate.empty_generation(g)))
    drops = d1
    for d in (d2, d3, d4, d5, d6):
        drops = drops.unionByName(d)
    return Curated(g, registry, drops, merges, seen.unionByName(seen_edges), findings)
