"""Queries of the graph, validation, curation and evaluation operators over the curriculum tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph import schema as S
from kgraph.functions.scoring import LITERAL, search_score, shared_grams
from kgraph.functions.text import bigrams, plain, topic_id
from kgraph.operators import curate, evaluate, serve, validate
from kgraph.operators.graph import Graph, ancestors, chain_lengths, latest, longest_chain, plan_path, prerequisites, ranked, revisit_notes
from kgraph.operators.matching import greedy
from kgraph.operators.order import before
from kgraph.operators.skew import hot_join
from kgraph.operators.vectors import nearest
from kgraph.session import cut, ship
from kgraph.sources.documents import new_rows
from kgraph.sources.tables import table


def topics(spark: SparkSession, d: str) -> DataFrame:
    """One row a topic: its first arrival."""
    return latest(table(spark, d, "topics"), "id", F.col("ingested_at"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """One row a delivered edge with both ends; ordinal is dep_id."""
    t = table(spark, d, "dependencies").where("topic_id IS NOT NULL AND prerequisite_id IS NOT NULL")
    return latest(t.select("dep_id", "topic_id", "prerequisite_id", "strength", "reason", "ingested_at"), "dep_id", F.col("ingested_at")).drop("ingested_at").withColumnRenamed("dep_id", "ordinal")


def graph(spark: SparkSession, d: str, spiral: bool = False) -> Graph:
    """Topics and their links; with spiral also revisits: a topic is revisited by the topic of the same name with the next later (grade, id)."""
    t = topics(spark, d)
    if not spiral:
        return Graph(t, links(spark, d), spark.createDataFrame([], "ordinal bigint, earlier_id string, later_id string, note string"))
    at = before(t.where("name IS NOT NULL").select("id", "name", "grade_start", F.lit(1).alias("one")), ["name"], ["grade_start", "id"], "one", "k")
    r = at.select("name", "k", F.col("id").alias("earlier_id")).join(at.select("name", (F.col("k") - 1).alias("k"), F.col("id").alias("later_id")), ["name", "k"])
    return Graph(t, links(spark, d), r.select(F.xxhash64("earlier_id").alias("ordinal"), "earlier_id", "later_id", F.col("name").alias("note")))


def drafts(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "drafts").where("draft_id IS NOT NULL"), "draft_id", F.col("ingested_at"))


def kept_drafts(spark: SparkSession, d: str) -> DataFrame:
    return drafts(spark, d).where("deleted_at IS NULL")


def proposed(spark: SparkSession, d: str) -> DataFrame:
    """(edge_id, target_draft_id, prerequisite_draft_id, strength, reason), once a delivered edge."""
    t = table(spark, d, "proposed_edges").select("edge_id", "target_draft_id", F.col("edge.prerequisite_draft_id").alias("prerequisite_draft_id"), F.col("edge.strength").alias("strength"), F.col("edge.reason").alias("reason"), "ingested_at")
    return latest(t.where("target_draft_id IS NOT NULL AND prerequisite_draft_id IS NOT NULL"), "edge_id", F.col("ingested_at")).drop("ingested_at")


def votes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "review_log").where("target IS NOT NULL")
    v = t.select("target", "aspect", F.explode("votes").alias("v")).select("target", "aspect", F.lower(F.trim("v.reviewer")).alias("reviewer"), F.regexp_replace(F.lower(F.trim("v.judgment")), "[ -]", "_").alias("judgment"), F.col("v.approved").alias("approved"))
    return v.distinct()


# -- projections and filters


def topic_cards(spark, d):
    return serve.cards(topics(spark, d)).drop("score")


def topics_of_grade5(spark, d):
    return topics(spark, d).where(F.lit(5).between(F.col("grade_start"), F.coalesce("grade_end", "grade_start"))).select("id", "name", "grade_start", "grade_end")


QUERY = "条形统计图的估测"


def search_fraction_texts(spark, d):
    """All topics that the query finds by the better of name and description, as in search_topics."""
    q = LITERAL.prepare(F.lit(QUERY))
    t = topics(spark, d).select("id", "name", *[LITERAL.relevance(q, LITERAL.prepare(F.col(c))).alias(k) for c, k in (("name", "n"), ("description", "d"))])
    return t.where(F.greatest("n", "d") >= LITERAL.least).select("id", "name", F.round(search_score(F.col("n"), F.col("d")), 6).alias("score"))


def searched_topics(spark, d):
    """The served search: five cards."""
    return serve.search_topics(graph(spark, d), QUERY).select("id", "name", "summary", "score")


def matched_observation(spark, d):
    """The served matching of one observation: five misconceptions."""
    x = serve.match_misconceptions(graph(spark, d), "孩子说角的大小和边长有关，没有零就不用管")
    return x.select("id", "position", "statement", F.round("score", 6).alias("score"))


def topic_details(spark, d):
    """The served topic: of the smallest id without provenance, with the default one."""
    g = graph(spark, d)
    first = g.topics.where("provenance IS NULL").agg(F.min("id")).first()[0]
    x = serve.get_topic(g, first)
    return x.select("id", "name", "description", "grade_start", "grade_end", F.col("provenance.method").alias("method"), F.col("provenance.review_status").alias("review_status"), F.col("provenance.confidence").alias("confidence"))


def learning_path(spark, d):
    """The served path: to the topic at the end of the longest chain (the smallest id of several), the smallest topic upstream being known."""
    g = graph(spark, d, spiral=True)
    target = chain_lengths(g).orderBy(F.desc("length"), "id").first()["id"]
    above = ancestors(g, spark.createDataFrame([(target,)], "id string")).where(F.col("id") != target).agg(F.min("id")).first()[0]
    steps, _, _ = plan_path(g, target, [above] if above else [])
    return steps.select("step", "id", "name", "grade_start", F.size("revisits").alias("revisits"), "is_target")


def spoken_forms(spark, d):
    """(text, plain): fractions and operations in words and signs, of the numbers of all line items."""
    n = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("a"), F.col("l_quantity").cast("int").alias("b")).distinct()
    word = F.substring(F.lit("零一二三四五六七八九十"), F.col("a") + 1, F.lit(1))
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    forms = [F.concat(b, F.lit("分之"), word), F.concat(word, F.lit(" 分之"), b), F.concat(word, F.lit("加　"), b, F.lit(" 减 1")), F.concat(a, F.lit("×"), b, F.lit("比"), a, F.lit("乘"), b, F.lit("大")), F.concat(b, F.lit("除以"), word, F.lit("和"), b, F.lit("÷"), a), F.concat(F.lit("两加"), word, F.lit(" Ab"))]
    return n.select(F.explode(F.array(*forms)).alias("text")).select("text", plain(F.col("text")).alias("plain")).distinct()


def text_corpus(spark, d):
    return serve.corpus_texts(topics(spark, d))


def misconception_list(spark, d):
    return serve.misconception_rows(topics(spark, d)).select("id", "position", "statement")


def new_topic_ids(spark, d):
    return topics(spark, d).select("id", topic_id(F.col("name"), F.col("domain"), F.col("grade_start")).alias("made_id"))


def _chunked(spark, d):
    """Every document as a source file, whatever its source, as the curation run takes every text."""
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), F.greatest(F.lit(12), F.length(F.col("doc_id").cast("string"))), "0"), F.lit(".md"))
    return curate.chunks(table(spark, d, "documents").select(name.alias("source_file"), "text"))


def chunk_texts(spark, d):
    """Numbered paragraphs of all documents."""
    return _chunked(spark, d)[0].select("id", "standard_code", F.length("text").alias("chars"), "ordinal")


def chunk_drops(spark, d):
    return _chunked(spark, d)[1].select("stage", "ref", "reason")


def inverted_grades(spark, d):
    x = kept_drafts(spark, d).where("content.grade_end < content.grade_start")
    return curate.drop_rows(x, "extract", F.col("draft_id"), curate.GRADE_RANGE_INVERTED, F.concat_ws("-", "content.grade_start", "content.grade_end"))


# -- joins


def link_names(spark, d):
    g = graph(spark, d)
    t = g.topics.select("id", "name")
    named = hot_join(g.dependencies, t.toDF("topic_id", "topic"), ["topic_id"])
    return hot_join(named, t.toDF("prerequisite_id", "prerequisite"), ["prerequisite_id"]).select("ordinal", "topic", "prerequisite", "strength")


def same_code_drafts(spark, d):
    return curate.code_candidates(kept_drafts(spark, d)).select("draft_id", F.col("group_key").alias("code"))


def same_folded_names(spark, d):
    """Kept drafts that share a name in folded form, which SQL can't repeat."""
    ship(spark)
    return curate.name_candidates(kept_drafts(spark, d)).select("draft_id", "group_key")


def similar_draft_names(spark, d):
    """Fuzzy pairs among the names of kept drafts."""
    ship(spark)
    return curate.fuzzy_names(kept_drafts(spark, d).select("content.name")).select("a", "b", F.round("score", 6).alias("score"))


def similar_entry_names(spark, d):
    """Fuzzy pairs among the registry's names."""
    ship(spark)
    return curate.fuzzy_names(table(spark, d, "registry_entries").select("name")).select("a", "b", F.round("score", 6).alias("score"))


def prerequisite_pool_sizes(spark, d):
    return curate.prerequisite_counts(topics(spark, d))


def registry_claims(spark, d):
    return curate.claims(topics(spark, d), table(spark, d, "registry_entries")).select("id", "entry_id", F.round("score", 6).alias("score"))


def registry_assignment(spark, d):
    """Each entry claimed by at most one topic."""
    c = cut(curate.claims(topics(spark, d), table(spark, d, "registry_entries")))
    return greedy(c, "id", "entry_id", [F.negative("score").alias("s"), F.col("id").alias("i"), F.col("entry_id").alias("e")]).select("id", "entry_id", F.round("score", 6).alias("score"))


def unknown_prerequisites(spark, d):
    return curate.checked_edges(proposed(spark, d), drafts(spark, d))[1]


def review_unresolved(spark, d):
    return curate.resolved_edges(proposed(spark, d), kept_drafts(spark, d))[1]


def edge_prefilter_kept(spark, d):
    return curate.reviewed_edges(proposed(spark, d), kept_drafts(spark, d))[0].select("edge_id")


def edge_prefilter_drops(spark, d):
    return curate.reviewed_edges(proposed(spark, d), kept_drafts(spark, d))[1]


def _fidelity():
    """A stand-in that goes by rules: no evidence is fabricated, a span without the name an elaboration; a nameless draft is a failure."""

    def judge(row):
        if row["name"] is None:
            raise RuntimeError("a draft without a name")
        seen = len(row["evidence"]) if row["evidence"] is not None else 0
        how = "fabricated" if not seen else "faithful" if row["name"] in (row["source_span"] or "") else "reasonable_elaboration"
        return {"reviewer": "rules", "approved": None, "reason": None, "judgment": how}

    return judge


def _naming():
    """Rules again: a description that's missing is a failure, one without the name's first character another topic."""

    def judge(row):
        if row["description"] is None:
            raise RuntimeError("a draft without a description")
        return {"reviewer": "rules", "approved": None, "reason": None, "judgment": "consistent" if row["name"][:1] in row["description"] else "topic_mismatch"}

    return judge


def _ordering():
    """Rules: an edge is approved if its prerequisite isn't of a later grade; without a reason it's a failure."""

    def judge(row):
        if not row["reason"]:
            raise RuntimeError("an edge without a reason")
        later = (row["prerequisite_grade_start"] or 0) > (row["target_grade_start"] or 0)
        return {"reviewer": "rules", "approved": not later, "reason": None, "judgment": None}

    return judge


def _reviewed(spark, d):
    ship(spark)
    return curate.reviewed_drafts(kept_drafts(spark, d).select("draft_id", "standard_codes", "content"), [_fidelity], [_naming])


def draft_review(spark, d):
    """Votes of both aspects on all kept drafts, by judges that go by rules."""
    x = _reviewed(spark, d)[1]
    return x.select("target", "aspect", F.col("votes")[0]["judgment"].alias("judgment"), "approved")


def draft_review_drops(spark, d):
    return _reviewed(spark, d)[2]


def _judged_edges(spark, d):
    ship(spark)
    return curate.judged_edges(proposed(spark, d), kept_drafts(spark, d).select("draft_id", "content"), [_ordering])


def edge_review(spark, d):
    """Edges that pass review."""
    return _judged_edges(spark, d)[0].select("edge_id")


def edge_review_drops(spark, d):
    return _judged_edges(spark, d)[2]


def assembled_links(spark, d):
    """Links of the graph that kept drafts and their single edges make, topics named by their drafts."""
    kept = kept_drafts(spark, d)
    between = curate.reviewed_edges(proposed(spark, d), kept)[0]
    once = curate.single_edges(between.where("target_draft_id <> prerequisite_draft_id"), "target_draft_id", "prerequisite_draft_id", "strength", ["edge_id"])[0]
    ids = kept.select(F.col("draft_id").alias("id"), F.concat(F.lit("t_"), "draft_id").alias("topic_id"))
    return curate.assembled(kept, once, ids, "cn", "rules")[1]


def orphaned_drafts(spark, d):
    kept, e = kept_drafts(spark, d), proposed(spark, d)
    return curate.orphaned(kept, e, curate.reviewed_edges(e, kept)[0])


# -- aggregations


def graph_stats(spark, d):
    return serve.graph_counts(graph(spark, d, spiral=True))


def grade_histogram(spark, d):
    return serve.grade_distribution(topics(spark, d))


def curriculum_codes(spark, d):
    return serve.codes_by_curriculum(topics(spark, d)).select("curriculum", F.concat_ws(",", "codes").alias("codes"))


def review_statuses(spark, d):
    return serve.review_status_counts(topics(spark, d))


def standards_coverage(spark, d):
    return validate.coverage(topics(spark, d))


def unanimous_reviews(spark, d):
    return curate.unanimous(votes(spark, d)).select("target", "aspect", "approved", "votes")


def mapped_votes(spark, d):
    v = votes(spark, d)
    return v.groupBy("aspect", "judgment", curate.approves(F.col("aspect"), F.col("judgment"), F.col("approved")).alias("approves")).agg(F.count("*").alias("votes"))


def single_edges(spark, d):
    return curate.single_edges(proposed(spark, d), "target_draft_id", "prerequisite_draft_id", "strength", ["edge_id"])[0].select("edge_id", "target_draft_id", "prerequisite_draft_id", "strength")


def duplicate_edges(spark, d):
    return curate.single_edges(proposed(spark, d), "target_draft_id", "prerequisite_draft_id", "strength", ["edge_id"])[1].select("edge_id")


def merged_evidence(spark, d):
    """Kept and dropped draft of every merge, united."""
    m = table(spark, d, "merges").where("kept_draft_id <> dropped_draft_id").select("kept_draft_id", "dropped_draft_id").distinct()
    c = drafts(spark, d).select("draft_id", F.col("content.evidence").alias("evidence"), "standard_codes", F.col("content.misconceptions").alias("misconceptions"))
    side = lambda k: m.withColumn("key", F.concat_ws("|", "kept_draft_id", "dropped_draft_id")).join(c.withColumnRenamed("draft_id", k), k).select("key", "evidence", "standard_codes", "misconceptions")
    u = curate.merged(side("kept_draft_id"), side("dropped_draft_id"))
    lines = lambda c: F.concat_ws("\n", F.sort_array(c))
    return u.select("key", lines(F.col("evidence")).alias("evidence"), lines(F.col("standard_codes")).alias("codes"), lines(F.col("misconceptions.statement")).alias("misconceptions"))


# -- graph walks


def prerequisites_depth2(spark, d):
    g = graph(spark, d)
    return prerequisites(g, g.topics.select("id"), 2).select("start", "level", "id", "required_by")


def prerequisites_hard(spark, d):
    g = graph(spark, d)
    return prerequisites(g, g.topics.select("id"), 2, include_soft=False).select("start", "level", "id", "required_by")


def chains(spark, d):
    return chain_lengths(graph(spark, d))


def longest_chain_of_all(spark, d):
    return longest_chain(graph(spark, d))


def spiral_notes(spark, d):
    return revisit_notes(graph(spark, d, spiral=True)).select("id", "direction", "other_id", "other_name")


# -- findings


def dangling_links(spark, d):
    f = validate.dangling(graph(spark, d, spiral=True))
    return f.groupBy("code", "severity", F.col("context")["field"].alias("field"), F.col("context")["id"].alias("id")).agg(F.count("*").alias("findings"))


def isolated_topics(spark, d):
    return serve.isolated(graph(spark, d, spiral=True)).select("id")


def grade_inversions(spark, d):
    g = graph(spark, d)
    return validate.with_ends(g.dependencies, g.topics, "prerequisite_id", "topic_id").where("low_grade > high_grade").select("ordinal", F.when(F.col("strength") == "hard", "error").otherwise("warning").alias("severity"))


def revisits_not_advancing(spark, d):
    g = graph(spark, d, spiral=True)
    return validate.with_ends(g.revisits, g.topics, "earlier_id", "later_id").where("high_grade <= low_grade").select("earlier_id", "later_id")


def missing_provenance(spark, d):
    return validate.missing_provenance(graph(spark, d)).select("code", "severity", F.col("context")["id"].alias("id"))


def finding_summary(spark, d):
    return validate.summarised(validate.run_all(graph(spark, d, spiral=True))).select("code", "severity", "findings")


def all_findings(spark, d):
    """Every finding with what it's about: ids of cycles, of ends that are no topic, of topics and of links."""
    c = F.col("context")
    about = F.coalesce(c["cycle_id"], F.concat_ws("|", c["field"], c["id"], c["prerequisite_id"], c["topic_id"], c["earlier_id"], c["later_id"], c["topics"], c["aligned"], c["unaligned"], c["reason"]))
    return validate.run_all(graph(spark, d, spiral=True)).select("code", "severity", about.alias("about"))


def content_violations(spark, d):
    """Broken rules of a topic among the contents of kept drafts, which nobody has checked yet."""
    x = kept_drafts(spark, d).select("draft_id", "content.*", F.col("draft_id").alias("id"), F.lit(None).cast(S.PROVENANCE).alias("provenance"))
    return S.violations(x, S.TOPIC_RULES, "draft_id")


# -- evaluation


def _cases(spark, d):
    """Aliases as observations that mean their entry."""
    e = table(spark, d, "registry_entries").where("id IS NOT NULL")
    return e.select("id", F.explode("aliases").alias("text")).where("length(text) > 0").groupBy(F.col("text").alias("case_id")).agg(F.sort_array(F.collect_set("id")).alias("expected"))


def _all_cases(spark, d):
    """_cases, and names of topics that are no entry's name or alias, which expect nothing."""
    e = table(spark, d, "registry_entries")
    known = e.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text")).select(plain(F.col("text")).alias("k")).where("k IS NOT NULL").distinct()
    t = topics(spark, d).select(F.col("name").alias("case_id"), plain(F.col("name")).alias("k")).where("length(k) > 0").distinct()
    return _cases(spark, d).unionByName(t.join(known, "k", "left_anti").select("case_id", F.array().cast("array<string>").alias("expected")))


def _scored(spark, d, cases=None):
    e = table(spark, d, "registry_entries").where("id IS NOT NULL AND name IS NOT NULL").select("id", "name").groupBy("id").agg(F.min("name").alias("name"))
    s = shared_grams((_cases(spark, d) if cases is None else cases).select("case_id", F.col("case_id").alias("text")), e, "case_id", "id", "text", "name")
    x = F.col("shared") / F.least("n_query", "n_text")
    return s.select("case_id", "id", "shared", "n_query", "n_text", x.alias("raw"), x.alias("score"))


def literal_match_top3(spark, d):
    """The three entries whose names are nearest to each alias, with the counts that make the score."""
    return ranked(_scored(spark, d).where("raw >= 0.2"), ["case_id"], [F.desc("score"), F.asc("id")], 3).select("case_id", "rank", "id", "shared", "n_query", "n_text")


def observation_top5(spark, d):
    """The five misconceptions nearest to each alias as an observation, of all topics, by statement, probe and hint."""
    x = serve.match_all(topics(spark, d), _cases(spark, d).select("case_id", F.col("case_id").alias("text")))
    return x.select("case_id", "rank", "id", "position", F.round("score", 6).alias("score"))


def _frontier(spark, d):
    c = cut(_all_cases(spark, d))
    # raw and score are one here, so the first three hold the first three above any threshold
    first = cut(ranked(_scored(spark, d, c), ["case_id"], [F.desc("score"), F.asc("id")], 3).drop("rank"))
    return evaluate.frontier(c, first, evaluate.threshold_range(0.05, 0.95, 0.05))


def retrieval_frontier(spark, d):
    """Recall over the cases that expect something, and how often those that expect nothing get nothing, for every threshold."""
    return _frontier(spark, d).select("threshold", F.round("recall", 6).alias("recall"), F.round("empty_accuracy", 6).alias("empty_accuracy"), "cases", "empty_cases")


def operating_point(spark, d):
    """The best recall at which nine in ten of the cases that expect nothing get nothing."""
    return evaluate.operating_point(_frontier(spark, d), 0.9).select("threshold", F.round("recall", 6).alias("recall"), F.round("empty_accuracy", 6).alias("empty_accuracy"))


def _judged(spark, d):
    """Every vote beside the most frequent judgment of its item, the first by name of equal ones; of edges by approval alone."""
    v = votes(spark, d).withColumn("judgment", F.when(F.col("aspect") == "edge_reason", F.when(F.col("approved"), "approved").when(~F.col("approved"), "rejected")).otherwise(F.col("judgment"))).where("judgment IS NOT NULL")
    n = v.groupBy("target", "aspect", "judgment").agg(F.count("*").alias("n"))
    top = n.groupBy("target", "aspect").agg(F.min_by("judgment", F.struct(-F.col("n"), "judgment")).alias("expected"))
    return v.join(top, ["target", "aspect"])


LABELS = ["faithful", "reasonable_elaboration", "fabricated", "consistent", "scope_mismatch", "topic_mismatch", "approved", "rejected"]


def judge_confusion(spark, d):
    return evaluate.confusion(_judged(spark, d), "expected", "judgment", LABELS)


def judge_scores(spark, d):
    x = evaluate.class_scores(_judged(spark, d), "expected", "judgment")
    return x.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "expected_count", "got_count")


def latency_levels(spark, d):
    x = evaluate.latency_levels(table(spark, d, "events"), "event_type", "value")
    return x.select("event_type", "requests", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def call_levels(spark, d):
    """Events as calls of `value` minutes, a level a type; one user in ten is refused, one in seventeen fails."""
    e = table(spark, d, "events").where("value IS NOT NULL AND ts IS NOT NULL")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    status = F.when(F.col("user_id") % 10 == 0, 429)
    error = F.when((F.col("user_id") % 10 != 0) & (F.col("user_id") % 17 == 0), "timeout")
    # whole microseconds, since sums of fractions depend on their order
    x = evaluate.level_results(e.select("event_type", at.alias("started"), (at + F.round(F.col("value") * 60)).alias("ended"), status.alias("status"), error.alias("error")), "event_type")
    return x.select("event_type", "requests", "ok", "rate_limited", "failed", F.round("wall", 3).alias("wall"), F.round("throughput", 9).alias("throughput"), F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"), F.col("peak").cast("long").alias("peak"))


def ledger_append(spark, d):
    """All events appended to a ledger that holds those of even ids: what is new by (event_type, user_id)."""
    e = table(spark, d, "events").select("event_type", "user_id", "event_id")
    old = e.where("event_id % 2 = 0").select("event_type", "user_id").distinct()
    return new_rows(e.select("event_type", "user_id"), old, ["event_type", "user_id"])


def snapshot_overlap(spark, d):
    """Names of all topics against those not withdrawn."""
    t = topics(spark, d)
    return evaluate.overlap(t, t.where("deleted_at IS NULL"), "name").select("both", "either", F.round("jaccard", 6).alias("jaccard"))


def statement_retention(spark, d):
    """Misconceptions of all topics against those that the not withdrawn ones keep, less the first of each list."""
    t = topics(spark, d)
    later = t.where("deleted_at IS NULL").select("id", F.when(F.col("grade_start") > 6, F.upper("name")).otherwise(F.concat("name", F.lit("（修订）"))).alias("name"), F.slice("misconceptions", 2, F.greatest(F.lit(1), F.size("misconceptions"))).alias("misconceptions"))
    x = curate.retention(t.select("id", "name", "misconceptions"), later, [0.3, 0.6, 0.9])
    return x.withColumn("median_score", F.round("median_score", 6))


def nearest_vectors(spark, d):
    """The three vectors of highest cosine for each vector whose id is divisible by 20, against all."""
    ship(spark)
    e = table(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 20 = 0"), 3)


def event_props(spark, d):
    p = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select(F.explode(F.map_keys(p)).alias("key")).groupBy("key").agg(F.count("*").alias("events"))


_ALL = (
    topic_cards, topics_of_grade5, search_fraction_texts, searched_topics, matched_observation, topic_details, learning_path, spoken_forms, text_corpus, misconception_list, new_topic_ids,
    chunk_texts, chunk_drops, inverted_grades, link_names, same_folded_names, same_code_drafts, similar_entry_names, similar_draft_names, prerequisite_pool_sizes,
    registry_claims, registry_assignment, unknown_prerequisites, review_unresolved, edge_prefilter_kept, edge_prefilter_drops, orphaned_drafts, draft_review, draft_review_drops,
    edge_review, edge_review_drops, assembled_links, graph_stats, grade_histogram, curriculum_codes, review_statuses, standards_coverage, unanimous_reviews, mapped_votes,
    single_edges, duplicate_edges, merged_evidence, prerequisites_depth2, prerequisites_hard, chains, longest_chain_of_all, spiral_notes, dangling_links, isolated_topics,
    grade_inversions, revisits_not_advancing, missing_provenance, finding_summary, all_findings, content_violations, literal_match_top3, observation_top5, retrieval_frontier, operating_point,
    judge_confusion, judge_scores, latency_levels, call_levels, ledger_append, snapshot_overlap, statement_retention, nearest_vectors, event_props,
)
QUERIES = {f.__name__: f for f in _ALL}
