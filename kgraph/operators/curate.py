"""Stages from numbered text to a graph, each a function of DataFrames; rejected rows come out as drops with a reason."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph import schema as S
from kgraph.functions.likeness import similar_pairs
from kgraph.functions.scoring import CLAIM_DESCRIPTION, CLAIM_LEAST, CLAIM_NAME, claim_score, shared_share
from kgraph.functions.text import bigrams, body_of, code_of, folded_name, occurrences, padded, paragraphs, plain, summary, topic_id
from kgraph.hooks import PROGRAMMING, mapped
from kgraph.operators.matching import greedy
from kgraph.operators.order import before
from kgraph.operators.skew import hot_join, hot_keys
from kgraph.session import BROADCAST_BYTES, cut, small_or_plain

# Reasons of drops.
NO_STANDARD_CODE, EXTRACT_FAILED, NO_DRAFTS, GRADE_RANGE_INVERTED = "NO_STANDARD_CODE", "EXTRACT_FAILED", "NO_DRAFTS", "GRADE_RANGE_INVERTED"
SAME_TOPIC_JUDGE_FAILED, SAME_NAME_DIFFERENT_TOPIC = "SAME_TOPIC_JUDGE_FAILED", "SAME_NAME_DIFFERENT_TOPIC"
EDGES_FAILED, UNKNOWN_PREREQUISITE, NON_CANDIDATE_PREREQUISITE = "EDGES_FAILED", "UNKNOWN_PREREQUISITE", "NON_CANDIDATE_PREREQUISITE"
FIDELITY_JUDGE_FAILED, NAME_JUDGE_FAILED, EDGE_JUDGE_FAILED = "FIDELITY_JUDGE_FAILED", "NAME_JUDGE_FAILED", "EDGE_JUDGE_FAILED"
REVIEW_REJECTED, UNKNOWN_REVIEW_TARGET, UNKNOWN_EDGE_PREREQUISITE = "REVIEW_REJECTED", "UNKNOWN_REVIEW_TARGET", "UNKNOWN_EDGE_PREREQUISITE"
EDGE_TARGET_REJECTED, EDGE_PREREQUISITE_REJECTED, ORPHANED_BY_REJECTION, DUPLICATE_EDGE = "EDGE_TARGET_REJECTED", "EDGE_PREREQUISITE_REJECTED", "ORPHANED_BY_REJECTION", "DUPLICATE_EDGE"
FUZZY_LEAST, GRADE_GAP, EMPTY_RETRIES = 0.85, 2, 2
#: Names of either side that meet in a cell, pairs that a task bounds on average, and tasks at most.
CELL, PAIRS_A_TASK, MOST_TASKS = 2048, 1_000_000, 2000


def drop_rows(df: DataFrame, stage: str, ref: Column, reason: Column | str, detail: Column) -> DataFrame:
    return df.select(F.lit(stage).alias("stage"), ref.cast("string").alias("ref"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), detail.cast("string").alias("detail"))


def chunks(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (source_file, text) -> (chunks, drops): paragraphs that start with a number of two or more levels.

    A chunk's ordinal counts accepted paragraphs of its file from 1, its id is the file's stem and that ordinal. Numbering is
    an array operation within the row of the file, so no file's paragraphs are gathered again.
    """
    p = texts.select("source_file", F.posexplode(F.filter(paragraphs(F.coalesce("text", F.lit(""))), lambda x: F.length(code_of(x)) > 0)).alias("pos", "p"))
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    n = F.col("pos") + 1
    good = p.select(padded(stem, "#", n, 3).alias("id"), body_of(F.col("p")).alias("text"), code_of(F.col("p")).alias("standard_code"), "source_file", n.cast("int").alias("ordinal"))
    other = texts.select("source_file", F.posexplode(paragraphs(F.coalesce("text", F.lit("")))).alias("pos", "p")).where(F.length(code_of(F.col("p"))) == 0)
    return good, drop_rows(other, "chunk", padded(stem, "¶", F.col("pos") + 1, 3), NO_STANDARD_CODE, summary(F.col("p")))


def extract(parts: DataFrame, extractor, parallel: int | None = None) -> tuple[DataFrame, DataFrame]:
    """chunks -> (drafts, drops) by an extractor hook: row -> list of contents.

    An empty answer is asked for again twice; an exception isn't. A draft with its grades in the wrong order is dropped
    alone, not with its batch. Draft ids are the chunk's with a two-digit number, so their order is extraction order.
    """
    done = cut(mapped(parts, extractor, S.T.ArrayType(S.CONTENT), EMPTY_RETRIES, parallel))
    failed = drop_rows(done.where("error IS NOT NULL"), "extract", F.col("id"), EXTRACT_FAILED, F.col("error"))
    empty = drop_rows(done.where("error IS NULL AND (result IS NULL OR size(result) = 0)"), "extract", F.col("id"), NO_DRAFTS, F.concat(F.lit("attempts: "), F.col("attempts").cast("string")))
    d = done.where("error IS NULL").select("id", "standard_code", F.posexplode("result").alias("pos", "content")).select(padded(F.col("id"), "-", F.col("pos"), 2).alias("draft_id"), F.col("id").alias("chunk_id"), F.array("standard_code").alias("standard_codes"), "content")
    inverted = F.col("content.grade_end") < F.col("content.grade_start")
    bad = drop_rows(d.where(inverted), "extract", F.col("draft_id"), GRADE_RANGE_INVERTED, F.concat_ws("-", "content.grade_start", "content.grade_end"))
    return d.where(~F.coalesce(inverted, F.lit(False))), failed.unionByName(empty).unionByName(bad)


def name_candidates(drafts: DataFrame, key: Column | None = None) -> DataFrame:
    """(group_key, draft_id): drafts that share a folded name with another; the pairs of a group are left unexpanded."""
    d = drafts.select("draft_id", (key if key is not None else folded_name(F.col("content.name"))).alias("group_key")).where("group_key IS NOT NULL")
    many = d.groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1").select("group_key")
    return d.join(many, "group_key", "left_semi")


def code_candidates(drafts: DataFrame) -> DataFrame:
    """(group_key, draft_id): drafts that share a standard code with another."""
    d = drafts.select("draft_id", F.explode(F.array_distinct("standard_codes")).alias("group_key"))
    many = d.groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1").select("group_key")
    return d.join(many, "group_key", "left_semi")


def fuzzy_names(names: DataFrame, column: str = "name", least: float = FUZZY_LEAST) -> DataFrame:
    """(a, b, score): pairs of different folded names, a < b, of containment `least` or more.

    Lossless blocking: two names whose matching blocks cover a share t of the shorter have, by counting, at least one
    common occurrence of a character among the shorter's first len - ceil(t * len) + 1 in any fixed order; the order is rare ones
    first. Occurrences of one character in a name are told apart by number, so overlaps are of multisets. A pair is taken where
    the first of them meets, so once, and never stands as a row: names that differ only in their digits make nearly all the pairs
    of their pattern. The names of an occurrence meet in cells of at most about CELL by CELL, bounded and scored within Python.
    """
    d = cut(names.select(folded_name(F.col(column)).alias("a")).where("length(a) > 0").distinct())
    parts = d.select("a", F.explode(occurrences(F.col("a"))).alias("t"))
    seen = parts.groupBy("t").agg(F.count("*").alias("n"))
    ordered = cut(parts.join(small_or_plain(seen, 40), "t").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("ts")))
    n = F.size("ts")
    # a rounding error of the product must not shorten the prefix
    first = n - F.greatest(F.lit(1), F.ceil(F.lit(least) * n - 1e-6).cast("int")) + 1
    short = ordered.select("a", F.posexplode(F.slice("ts", 1, first)).alias("p", "t"), "ts").where("t.n > 1").select("t.t", "t.n", "a", F.slice(F.col("ts.t"), 1, F.col("p")).alias("earlier"))
    long_ = ordered.select("a", F.explode("ts").alias("t")).where("t.n > 1").select("t.t", "a")
    sizes = cut(short.groupBy("t").agg(F.count("*").alias("ns"), F.first("n").alias("nl")))
    pairs = sizes.agg(F.sum(F.col("ns") * F.col("nl"))).first()[0] or 0
    cells = small_or_plain(sizes.select("t", F.ceil(F.col("ns") / CELL).alias("rows"), F.ceil(F.col("nl") / CELL).alias("columns")), 60)
    at = lambda of: F.pmod(F.xxhash64("a"), F.col(of))
    over = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1))
    mine = short.join(cells, "t").select("t", at("rows").alias("i"), over("columns").alias("j"), "a", "earlier")
    theirs = long_.join(cells, "t").select("t", over("rows").alias("i"), at("columns").alias("j"), "a", F.lit(None).cast("array<string>").alias("earlier"))
    # the number of tasks is by pairs: adaptive execution would put these few bytes into one
    both = mine.unionByName(theirs).repartition(max(1, min(MOST_TASKS, -(-pairs // PAIRS_A_TASK))), "t", "i", "j")

    def scored(x: pd.DataFrame) -> pd.DataFrame:
        own = x["earlier"].notna()
        s = x[own]
        a, b, score = similar_pairs(s["a"].tolist(), s["earlier"].tolist(), x.loc[~own, "a"].tolist(), least)
        return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object), "score": pd.Series(score, dtype="float64")})

    return both.groupBy("t", "i", "j").applyInPandas(scored, "a string, b string, score double")


def duplicate_pairs(drafts: DataFrame) -> DataFrame:
    """(i, j), i < j, distinct: drafts of one folded name, of one standard code, or of names of containment FUZZY_LEAST."""
    groups = name_candidates(drafts).unionByName(code_candidates(drafts))
    same = groups.toDF("group_key", "i").join(groups.toDF("group_key", "j"), "group_key").where("i < j").select("i", "j")
    named = drafts.select("draft_id", folded_name(F.col("content.name")).alias("f"))
    near = fuzzy_names(drafts.select(F.col("content.name").alias("name"))).join(named.toDF("x", "a"), "a").join(named.toDF("y", "b"), "b")
    return same.unionByName(near.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))).distinct()


def prerequisite_counts(topics: DataFrame, gap: int = GRADE_GAP) -> DataFrame:
    """(id, candidates): how many prerequisites each topic may be offered: other topics of the same first grade with a
    smaller id, or of a grade up to `gap` lower. Counted, not paired: grade totals plus the rank of an id in its grade.
    """
    d = topics.select("id", F.col("grade_start").alias("g")).where("id IS NOT NULL AND g IS NOT NULL").distinct().withColumn("one", F.lit(1))
    total = d.groupBy("g").agg(F.count("*").alias("n"))
    lower = total.select(F.explode(F.sequence(F.col("g") + 1, F.col("g") + gap)).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("lower"))
    return hot_join(before(d, ["g"], ["id"], "one"), lower, ["g"], "left").select("id", (F.col("before") + F.coalesce("lower", F.lit(0))).alias("candidates"))


def prerequisite_pairs(targets: DataFrame, pool: DataFrame, gap: int = GRADE_GAP) -> DataFrame:
    """(target_id, prerequisite_id): the candidates themselves for a stated set of targets, by an equi-join on exploded grades."""
    t = targets.select(F.col("id").alias("target_id"), F.col("grade_start").alias("tg")).withColumn("g", F.explode(F.sequence(F.greatest(F.lit(1), F.col("tg") - gap), "tg")))
    p = pool.select(F.col("id").alias("prerequisite_id"), F.col("grade_start").alias("g"))
    return t.join(p, "g").where("prerequisite_id <> target_id AND (g < tg OR prerequisite_id < target_id)").select("target_id", "prerequisite_id")


def _parted(edges: DataFrame, known: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
    """(edges whose end isn't known, those whose is); an end may hold a third of all edges."""
    hot = hot_keys(edges, [end])
    return tuple(hot_join(edges, known, [end], how, hot).select(*edges.columns) for how in ("left_anti", "left_semi"))


def checked_edges(edges: DataFrame, drafts: DataFrame, pool: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """edges (target_draft_id, prerequisite_draft_id, ...) -> (kept, drops): unknown prerequisites, then known ones that weren't
    candidates (the target itself, or, with a pool (target_draft_id, prerequisite_draft_id), what isn't in it)."""
    known = drafts.select(F.col("draft_id").alias("prerequisite_draft_id")).distinct()
    bad, ok = _parted(edges, known, "prerequisite_draft_id")
    own = ok.where("target_draft_id = prerequisite_draft_id")
    rest = ok.where("target_draft_id <> prerequisite_draft_id")
    if pool is not None:
        own = own.unionByName(rest.join(pool, ["target_draft_id", "prerequisite_draft_id"], "left_anti"))
        rest = rest.join(pool, ["target_draft_id", "prerequisite_draft_id"], "left_semi")
    drop = lambda d, why: drop_rows(d, "edges", F.col("target_draft_id"), why, F.coalesce("prerequisite_draft_id", F.lit("")))
    return rest, drop(bad, UNKNOWN_PREREQUISITE).unionByName(drop(own, NON_CANDIDATE_PREREQUISITE))


PROPOSAL = S.T.StructType([S.T.StructField(f, S.T.StringType()) for f in ("prerequisite_draft_id", "strength", "reason")])


def proposed_edges(drafts: DataFrame, proposer, parallel: int | None = None) -> tuple[DataFrame, DataFrame]:
    """drafts -> (edges (target_draft_id, ordinal, prerequisite_draft_id, strength, reason), drops) by a proposer hook.

    The hook gets a target (draft_id, name, description, grade_start) with its whole pool of candidates (the same fields) and
    gives a list of PROPOSAL. A target without candidates isn't asked; one that fails loses its own proposals only.
    """
    c = drafts.select("draft_id", "content.name", "content.description", "content.grade_start")
    ids = cut(prerequisite_pairs(*[c.select(F.col("draft_id").alias("id"), "grade_start")] * 2).toDF("target_draft_id", "prerequisite_draft_id"))
    pool = ids.join(c.withColumnRenamed("draft_id", "prerequisite_draft_id"), "prerequisite_draft_id")
    pool = pool.groupBy(F.col("target_draft_id").alias("draft_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("prerequisite_draft_id").alias("draft_id"), "name", "description", "grade_start"))).alias("pool"))
    done = cut(mapped(c.join(pool, "draft_id"), proposer, S.T.ArrayType(PROPOSAL), parallel=parallel).drop("pool"))
    failed = drop_rows(done.where("error IS NOT NULL"), "edges", F.col("draft_id"), EDGES_FAILED, F.col("error"))
    edges = done.where("error IS NULL").select(F.col("draft_id").alias("target_draft_id"), F.posexplode("result").alias("ordinal", "p")).select("target_draft_id", "ordinal", "p.*")
    kept, drops = checked_edges(edges, drafts, ids)
    return kept.select(*edges.columns), failed.unionByName(drops)


# The judgment that rejects, by aspect.
REJECTING = {"fidelity": "fabricated", "name_desc": "topic_mismatch"}


def approves(aspect: Column, judgment: Column, approved: Column) -> Column:
    """A three-way judgment as approval: only the aspect's rejecting one rejects; without a judgment `approved` counts."""
    out = approved
    for a, bad in REJECTING.items():
        out = F.when((aspect == a) & judgment.isNotNull(), judgment != bad).otherwise(out)
    return out


def unanimous(votes: DataFrame) -> DataFrame:
    """votes (target, aspect, approved) -> (target, aspect, approved, votes): approved if there are votes and all approve;
    a vote without an answer doesn't approve."""
    return votes.groupBy("target", "aspect").agg(F.bool_and(F.coalesce("approved", F.lit(False))).alias("approved"), F.count("*").alias("votes"))


def _panel(judges):
    """The judges as one hook: the votes of all of them, or the first one's failure."""

    def make():
        calls = [j() for j in judges]
        return lambda row: [call(row) for call in calls]

    return make


def _voted(rows: DataFrame, judges, aspect: str, target: Column, parallel: int | None) -> DataFrame:
    """rows with _target, _error, _votes and _ok: all judges approve. A judge gives {reviewer, judgment, reason, approved}, of which
    approved counts only without a judgment (`approves`); no answer doesn't approve."""
    if not judges:
        raise ValueError(f"no judges for {aspect}: nothing would be reviewed")
    done = cut(mapped(rows, _panel(judges), S.T.ArrayType(S.VOTE), parallel=parallel))
    said = F.transform("result", lambda v: F.struct(v["reviewer"].alias("reviewer"), F.coalesce(approves(F.lit(aspect), v["judgment"], v["approved"]), F.lit(False)).alias("approved"), v["reason"].alias("reason"), v["judgment"].alias("judgment")))
    return done.select(*rows.columns, target.alias("_target"), F.col("error").alias("_error"), said.alias("_votes")).withColumn("_ok", F.forall("_votes", lambda v: v["approved"]))


def _outcomes(done: DataFrame, aspect: str) -> DataFrame:
    return done.where("_error IS NULL").select(F.col("_target").alias("target"), F.lit(aspect).alias("aspect"), F.col("_votes").alias("votes"), F.col("_ok").alias("approved"))


def reviewed_drafts(drafts: DataFrame, fidelity_judges, name_judges, parallel: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """drafts -> (kept, outcomes (target, aspect, votes, approved), drops): fidelity, then name against description.

    Both aspects are judged even if the first rejects; a judge's failure drops the draft, after one of fidelity without a
    vote on the name. The hooks get draft_id, standard_codes and the fields of the content.
    """
    flat = drafts.select("draft_id", "standard_codes", "content.*")
    a = _voted(flat, fidelity_judges, "fidelity", F.col("draft_id"), parallel)
    b = _voted(flat.join(a.where("_error IS NULL").select("draft_id"), "draft_id", "left_semi"), name_judges, "name_desc", F.col("draft_id"), parallel)
    both = a.where("_error IS NULL").select("draft_id", F.col("_ok").alias("_f")).join(b.where("_error IS NULL").select("draft_id", F.col("_ok").alias("_n")), "draft_id")
    failed = F.concat_ws(",", F.when(~F.col("_f"), "fidelity"), F.when(~F.col("_n"), "name_desc"))
    drops = drop_rows(a.where("_error IS NOT NULL"), "review", F.col("draft_id"), FIDELITY_JUDGE_FAILED, F.col("_error"))
    drops = drops.unionByName(drop_rows(b.where("_error IS NOT NULL"), "review", F.col("draft_id"), NAME_JUDGE_FAILED, F.col("_error")))
    drops = drops.unionByName(drop_rows(both.where("NOT (_f AND _n)"), "review", F.col("draft_id"), REVIEW_REJECTED, failed))
    kept = drafts.join(both.where("_f AND _n").select("draft_id"), "draft_id", "left_semi")
    return kept, _outcomes(a, "fidelity").unionByName(_outcomes(b, "name_desc")), drops


def judged_edges(edges: DataFrame, drafts: DataFrame, judges, parallel: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges between drafts -> (kept, outcomes, drops). A hook gets the edge, with both ends' names, descriptions and grades
    as target_* and prerequisite_*."""
    known, lost = resolved_edges(edges, drafts)
    rows = known
    for end in ("target", "prerequisite"):
        rows = rows.join(drafts.select(F.col("draft_id").alias(f"{end}_draft_id"), *[F.col(f"content.{f}").alias(f"{end}_{f}") for f in ("name", "description", "grade_start")]), f"{end}_draft_id")
    done = _voted(rows, judges, "edge_reason", F.concat_ws("<-", "target_draft_id", "prerequisite_draft_id"), parallel)
    drops = lost.unionByName(drop_rows(done.where("_error IS NOT NULL"), "review", F.col("_target"), EDGE_JUDGE_FAILED, F.col("_error")))
    drops = drops.unionByName(drop_rows(done.where("_error IS NULL AND NOT _ok"), "review", F.col("_target"), REVIEW_REJECTED, F.lit("edge_reason")))
    return done.where("_error IS NULL AND _ok").select(*edges.columns), _outcomes(done, "edge_reason"), drops


def reviewed_edges(edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between kept drafts, drops): a rejected target drops the edge, else a rejected prerequisite does."""
    ids = kept.select("draft_id").distinct()
    t, rest = _parted(edges, ids.withColumnRenamed("draft_id", "target_draft_id"), "target_draft_id")
    p, ok = _parted(rest, ids.withColumnRenamed("draft_id", "prerequisite_draft_id"), "prerequisite_draft_id")
    drop = lambda d, why: drop_rows(d, "review", F.concat_ws("<-", "target_draft_id", "prerequisite_draft_id"), why, F.coalesce("prerequisite_draft_id", F.lit("")))
    return ok, drop(t, EDGE_TARGET_REJECTED).unionByName(drop(p, EDGE_PREREQUISITE_REJECTED))


def resolved_edges(edges: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends are drafts, drops): one drop an unknown target, one an edge of an unknown prerequisite."""
    ids = drafts.select("draft_id").distinct()
    lost, rest = _parted(edges, ids.withColumnRenamed("draft_id", "target_draft_id"), "target_draft_id")
    lost = lost.select("target_draft_id").distinct()
    bad, ok = _parted(rest, ids.withColumnRenamed("draft_id", "prerequisite_draft_id"), "prerequisite_draft_id")
    drops = drop_rows(lost, "review", F.col("target_draft_id"), UNKNOWN_REVIEW_TARGET, F.lit("")).unionByName(drop_rows(bad, "review", F.concat_ws("<-", "target_draft_id", "prerequisite_draft_id"), UNKNOWN_EDGE_PREREQUISITE, F.coalesce("prerequisite_draft_id", F.lit(""))))
    return ok, drops


def orphaned(kept: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(draft_id): kept drafts with proposed edges before review and none after."""
    t = lambda d: d.select(F.col("target_draft_id").alias("draft_id")).distinct()
    return kept.select("draft_id").distinct().join(t(before), "draft_id", "left_semi").join(t(after), "draft_id", "left_anti")


def single_edges(edges: DataFrame, target: str, prerequisite: str, strength: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, losers): one edge a pair, a hard one before a soft one, then the first in the order.

    The winner is a partial minimum, so a pair of any number of edges is combined before the shuffle; the rest are the losers.
    """
    rank = F.struct((F.coalesce(F.col(strength), F.lit("")) != "hard").alias("soft"), *order)
    best = edges.groupBy(target, prerequisite).agg(F.min(rank).alias("_w"))
    d = edges.withColumn("_r", rank).join(best.withColumnsRenamed({target: "_t", prerequisite: "_p"}), F.col(target).eqNullSafe(F.col("_t")) & F.col(prerequisite).eqNullSafe(F.col("_p")))
    return d.where("_r = _w").drop("_r", "_w", "_t", "_p"), d.where("_r <> _w").drop("_r", "_w", "_t", "_p")


def claims(topics: DataFrame, entries: DataFrame, least: float = CLAIM_LEAST) -> DataFrame:
    """(id, entry_id, score): entries of the same domain with overlapping grades and a score of at least `least`, once a pair.

    A pair without a common bigram in its names can't reach the threshold with any description, so pairs come from an equi-join on
    (domain, bigram of the name), each side's forms made once; shared bigrams are counted before the shuffle, and only pairs whose
    names score enough meet their descriptions. Entries are broadcast only while they fit the bound. Repeated rows of an entry count once, rows that
    differ each by themselves, and the best score of a pair stays.
    """
    side = lambda d, key, end: d.select(F.col(key).alias("k"), "domain", F.col("grade_start").alias("a"), end.alias("b"), bigrams(plain(F.col("name"))).alias("n"), bigrams(plain(F.coalesce("description", F.lit("")))).alias("d")).where("k IS NOT NULL AND domain IS NOT NULL AND size(n) > 0").distinct()
    t = cut(side(topics, "id", F.coalesce("grade_end", "grade_start")).withColumn("row", F.xxhash64("k", "domain", "a", "b", "n", "d")))
    e = cut(side(entries, "id", F.coalesce("grade_end", F.lit(9))).withColumn("row", F.xxhash64("k", "domain", "a", "b", "n", "d")))
    grams = lambda d, p: d.select("domain", F.col("row").alias(p), F.col("a").alias(f"{p}a"), F.col("b").alias(f"{p}b"), F.size("n").alias(f"{p}n"), F.explode("n").alias("gram"))
    met = grams(t, "t").join(small_or_plain(grams(e, "e"), 60, BROADCAST_BYTES), ["domain", "gram"]).where("ta <= eb AND ea <= tb")
    named = met.groupBy("t", "e").agg((F.count("*") / F.least(F.first("tn"), F.first("en"))).alias("name"))
    # a name score below this can't reach the threshold with any description
    named = named.where(F.col("name") >= (least - CLAIM_DESCRIPTION) / CLAIM_NAME - 1e-9)
    d = named.join(t.select(F.col("row").alias("t"), F.col("k").alias("id"), F.col("d").alias("td")), "t").join(small_or_plain(e.select(F.col("row").alias("e"), F.col("k").alias("entry_id"), F.col("d").alias("ed")), 2000, BROADCAST_BYTES), "e")
    scored = d.select("id", "entry_id", claim_score(F.col("name"), shared_share(F.col("td"), F.col("ed"))).alias("score")).where(F.col("score") >= least)
    return scored.groupBy("id", "entry_id").agg(F.max("score").alias("score"))


def assigned(topics: DataFrame, entries: DataFrame, least: float = CLAIM_LEAST) -> tuple[DataFrame, DataFrame]:
    """(id, topic_id, claimed), and the registry with new entries: each entry is claimed once, best score first, then by name.

    Unclaimed topics get an id of their name, domain and first grade, and become entries; a name that differs from its
    entry's is added to its aliases, the entry's own name never changes.
    """
    c = claims(topics, entries, least).join(topics.select("id", "name").distinct(), "id")
    taken = cut(greedy(c, "id", "entry_id", [F.negative("score").alias("s"), F.col("name"), F.col("id").alias("i"), F.col("entry_id").alias("e")]).select("id", "entry_id", F.col("name").alias("new_name")))
    ids = topics.join(taken.select("id", "entry_id"), "id", "left").select("id", F.coalesce("entry_id", topic_id(F.col("name"), F.col("domain"), F.col("grade_start"))).alias("topic_id"), F.col("entry_id").isNotNull().alias("claimed"))
    alias = taken.select(F.col("entry_id").alias("id"), "new_name")
    old = entries.join(alias, "id", "left").withColumn("aliases", F.when(F.col("new_name").isNotNull() & (F.col("new_name") != F.col("name")), F.array_distinct(F.concat(F.coalesce("aliases", F.array()), F.array("new_name")))).otherwise(F.col("aliases"))).drop("new_name")
    fresh = topics.join(taken.select("id"), "id", "left_anti").select(topic_id(F.col("name"), F.col("domain"), F.col("grade_start")).alias("id"), "name", "domain", "grade_start", F.coalesce("grade_end", F.lit(9)).alias("grade_end"), "description", F.array().cast("array<string>").alias("aliases")).dropDuplicates(["id"])
    return ids, old.select(*fresh.columns).unionByName(fresh.join(old.select("id"), "id", "left_anti"))


def assembled(drafts: DataFrame, edges: DataFrame, ids: DataFrame, curriculum: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(topics, dependencies) of drafts with their ids (id = draft_id, topic_id); both ends of an edge must have one, and no
    two drafts the same, else ValueError."""
    ids = ids.select(F.col("id").alias("draft_id"), "topic_id")
    if clash := ids.groupBy("topic_id").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect():
        raise ValueError("ids used twice: " + ", ".join(r["topic_id"] for r in clash))
    c = F.col("content")
    none = lambda kind: F.array().cast(S.T.ArrayType(kind))
    topics = drafts.join(ids, "draft_id").select(F.col("topic_id").alias("id"), c["name"].alias("name"), c["description"].alias("description"), c["type"].alias("type"), c["subject"].alias("subject"), c["domain"].alias("domain"), c["grade_start"].alias("grade_start"), c["grade_end"].alias("grade_end"), c["evidence"].alias("evidence"), c["assessment_prompt"].alias("assessment_prompt"), c["misconceptions"].alias("misconceptions"), F.transform("standard_codes", lambda x: F.struct(F.lit(curriculum).alias("curriculum"), x.alias("code"))).alias("standards"), none(S.TEXTBOOK_UNIT).alias("textbook_units"), F.struct(F.lit(f"llm-extract/{model}").alias("method"), F.lit("unreviewed").alias("review_status"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("reviewed_at"), F.lit(0.0).alias("confidence")).alias("provenance"))
    a = ids.toDF("target_draft_id", "topic_id")
    b = ids.toDF("prerequisite_draft_id", "prerequisite_id")
    out = edges.join(a, "target_draft_id", "left").join(b, "prerequisite_draft_id", "left").select("topic_id", "prerequisite_id", "strength", "reason")
    if not out.where("topic_id IS NULL OR prerequisite_id IS NULL").isEmpty():
        raise ValueError("an edge names a draft without an id")
    return topics, out


def merged(base: DataFrame, other: DataFrame) -> DataFrame:
    """base and other (key, evidence, standard_codes, misconceptions) by key -> the united record: distinct in order, a misconception once a
    statement."""
    o = other.select("key", F.col("evidence").alias("e2"), F.col("standard_codes").alias("c2"), F.col("misconceptions").alias("m2"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    strings, sets = "array<string>", S.T.ArrayType(S.MISCONCEPTION)
    extra = F.filter(none("m2", sets), lambda m: ~F.exists(none("misconceptions", sets), lambda x: x["statement"] == m["statement"]))
    return base.join(o, "key").select("key", F.array_distinct(F.concat(none("evidence", strings), none("e2", strings))).alias("evidence"), F.array_distinct(F.concat(none("standard_codes", strings), none("c2", strings))).alias("standard_codes"), F.concat(none("misconceptions", sets), extra).alias("misconceptions"))


def better_base(a: Column, b: Column) -> Column:
    """True if record a is the one to keep: more evidence, then the longer description, then the smaller id."""
    key = lambda x: F.struct(-F.size(F.coalesce(x["content"]["evidence"], F.array())), -F.length(F.coalesce(x["content"]["description"], F.lit(""))), x["draft_id"])
    return key(a) < key(b)


def folded(drafts: DataFrame, pairs: DataFrame, components: DataFrame, judge) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survivor ids, merges, drops): pairs (i, j, i < j) of candidates resolved one after the other within each component.

    components (group_id, draft_id). The judge hook sees the records as merged so far, so a component is a sequence and one task;
    components are of candidate duplicates. Its failure keeps both records.
    """
    rows = drafts.join(components, "draft_id").withColumn("record", F.to_json(F.struct("draft_id", "standard_codes", "content")))
    links = pairs.join(components.toDF("group_id", "i"), "i").groupBy("group_id").agg(F.to_json(F.sort_array(F.collect_set(F.struct("i", "j")))).alias("links"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        import json

        ask = judge()
        live = {r["draft_id"]: r for r in map(json.loads, g["record"])}
        out = []
        for link in json.loads(g["links"].iloc[0] or "[]"):
            a, b = live.get(link["i"]), live.get(link["j"])
            if a is None or b is None:
                continue
            try:
                same, why = ask({"a": a, "b": b})
            except PROGRAMMING:
                raise
            except Exception as e:  # noqa: BLE001
                out.append(["drop", f"{a['draft_id']}|{b['draft_id']}", "", f"{type(e).__name__}: {e}"])
                continue
            if not same:
                continue
            size = lambda r: (-len(r["content"].get("evidence") or []), -len(r["content"].get("description") or ""), r["draft_id"])
            keep, gone = sorted((a, b), key=size)
            for f in ("evidence", "misconceptions"):
                have = keep["content"].get(f) or []
                known = {x if f == "evidence" else x["statement"] for x in have}
                keep["content"][f] = have + [x for x in gone["content"].get(f) or [] if (x if f == "evidence" else x["statement"]) not in known]
            keep["standard_codes"] = list(dict.fromkeys([*(keep.get("standard_codes") or []), *(gone.get("standard_codes") or [])]))
            del live[gone["draft_id"]]
            out.append(["merge", keep["draft_id"], gone["draft_id"], why])
        out += [["keep", i, "", json.dumps(r, ensure_ascii=False)] for i, r in live.items()]
        return pd.DataFrame(out, columns=["what", "a", "b", "text"])

    done = cut(rows.join(links, "group_id", "left").groupBy("group_id").applyInPandas(run, "what string, a string, b string, text string"))
    kept = done.where("what = 'keep'").select(F.from_json("text", S.T.StructType([f for f in S.DRAFT if f.name != "chunk_id"])).alias("r")).select("r.*")
    merges = done.where("what = 'merge'").select(F.col("a").alias("kept_draft_id"), F.col("b").alias("dropped_draft_id"), F.col("text").alias("reason"))
    return kept, merges, drop_rows(done.where("what = 'drop'"), "dedupe", F.col("a"), SAME_TOPIC_JUDGE_FAILED, F.col("text"))


def unclashed(drafts: DataFrame, most_rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(drafts (draft_id, name, grade_start, ...), drops): names made unique.

    Of drafts that share a folded name and a first grade the smallest id stays; if the grades then differ, each name
    gets its grade as a suffix. Rounds repeat while a new name clashes again; after the last, the smallest id alone keeps a name.
    """
    d, drops = drafts, None
    for k in range(most_rounds + 1):
        d = cut(d.withColumn("_f", folded_name(F.col("name"))))
        by = ["_f"] if k == most_rounds else ["_f", "grade_start"]
        # renamed, since the group's columns would else be taken for d's own
        first = d.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min("draft_id").alias("_k"))
        same = None
        for c in by:
            one = F.col(c).eqNullSafe(F.col(f"_by_{c}"))
            same = one if same is None else same & one
        j = d.join(first, same).select(*d.columns, "_k")
        lost = drop_rows(j.where("draft_id <> _k"), "dedupe", F.col("draft_id"), SAME_NAME_DIFFERENT_TOPIC, F.concat_ws(" ", "name", "_k"))
        drops = lost if drops is None else drops.unionByName(lost)
        d = j.where("draft_id = _k").drop("_k")
        many = d.groupBy("_f").agg(F.count("*").alias("_n"))
        d = cut(d.join(many, "_f", "left").withColumn("name", F.when(F.col("_n") > 1, F.concat("name", F.lit("（"), F.col("grade_start").cast("string"), F.lit("年级）"))).otherwise(F.col("name"))))
        again = d.where("_n > 1").take(1)
        d = d.drop("_f", "_n")
        if not again:
            break
    return d, drops


def retention(earlier: DataFrame, later: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, statements, verbatim, matched, lost, added, hollowed, renamed, median_score): how misconceptions of topics in both snapshots
    are matched one to one, by their statements alone.

    earlier and later have id, name and misconceptions, one row an id. Pairs are scored once for all thresholds; a statement meets only those of its own
    topic. verbatim: matched and equal in plain form. added: of the later snapshot, unmatched. hollowed: topics that had statements and
    keep none. renamed: topics of another name. median_score is of the matched, 0 without any.
    """
    both = cut(earlier.select("id", F.col("name").alias("n1"), F.col("misconceptions").alias("m1")).join(later.select("id", F.col("name").alias("n2"), F.col("misconceptions").alias("m2")), "id"))
    rows = lambda p: both.select("id", F.posexplode(f"m{p}").alias("pos", "m")).select("id", F.col("pos").alias(f"pos{p}"), plain(F.coalesce("m.statement", F.lit(""))).alias(f"key{p}"))
    grams = lambda p: rows(p).withColumn(f"g{p}", bigrams(F.col(f"key{p}")))
    scored = grams(1).join(grams(2), "id").withColumn("score", shared_share(F.col("g1"), F.col("g2")))
    scored = cut(scored.select("id", "pos1", "pos2", "score", (F.col("key1") == F.col("key2")).alias("verbatim")).where(F.col("score") >= min(thresholds, default=1.0)))
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    had = both.where(size("m1") > 0)
    whole = both.agg(F.coalesce(F.sum(size("m1")), F.lit(0)).alias("statements"), F.coalesce(F.sum(size("m2")), F.lit(0)).alias("later"), F.count_if(~F.col("n1").eqNullSafe(F.col("n2"))).alias("renamed"), F.count_if(size("m1") > 0).alias("full"))
    out = None
    for t in thresholds:
        m = greedy(scored.where(F.col("score") >= t).withColumns({"l": F.struct("id", "pos1"), "r": F.struct("id", "pos2")}), "l", "r", [F.negative("score").alias("s"), F.col("id").alias("i"), F.col("pos1").alias("x"), F.col("pos2").alias("y")])
        kept = m.select("id").distinct().join(had.select("id"), "id").agg(F.count("*").alias("kept"))
        one = m.agg(F.count_if("verbatim").alias("verbatim"), F.count("*").alias("matched"), F.coalesce(F.percentile("score", 0.5), F.lit(0.0)).alias("median_score")).join(F.broadcast(whole)).join(F.broadcast(kept))
        one = one.select(F.lit(t).alias("threshold"), "statements", "verbatim", "matched", (F.col("statements") - F.col("matched")).alias("lost"), (F.col("later") - F.col("matched")).alias("added"), (F.col("full") - F.col("kept")).alias("hollowed"), "renamed", "median_score")
        out = one if out is None else out.unionByName(one)
    return out
