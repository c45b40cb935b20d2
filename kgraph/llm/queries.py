"""Queries of the text and label operators over one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm import consensus, groups, looks, mixture, pieces, reference_list, tokens
from kgraph.operators.skew import hot_join
from kgraph.session import cut, ship
from kgraph.sources.tables import table

# The judgments of each aspect, in the order of the table's description.
JUDGMENTS = {
    "fidelity": ["faithful", "reasonable_elaboration", "fabricated"],
    "name_desc": ["consistent", "scope_mismatch", "topic_mismatch"],
    "edge_reason": ["approved", "rejected"],
}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "drafts").select(F.lit("name").alias("field"), F.col("draft_id").alias("key"), F.col("content.name").alias("text"))
    said = table(spark, d, "topics").select(F.lit("statement").alias("field"), F.col("id").alias("key"), F.explode("misconceptions.statement").alias("text"))
    return names.unionByName(said)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return looks.same_looks(_texts(spark, d))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """(field, key, text, looks): every distinct text of every record with its one form."""
    ship(spark)
    return looks.unify(_texts(spark, d).distinct(), "text", "looks")


def _named(spark: SparkSession, d: str) -> DataFrame:
    """(draft_id, text, entry_id, how), once a draft; a draft of several names means the smallest entry of theirs."""
    drafts = table(spark, d, "drafts").select("draft_id", F.col("content.name").alias("text")).where("draft_id IS NOT NULL").distinct()
    found = cut(reference_list.assign(drafts, table(spark, d, "registry_entries"), "draft_id", "text"))
    return hot_join(drafts.where("text IS NOT NULL"), found.where("text IS NOT NULL"), ["text"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _named(spark, d).where("entry_id IS NOT NULL").groupBy("draft_id").agg(F.min("entry_id").alias("entry_id"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """(draft_id, name, how): drafts whose name means no entry; how is null for a null name."""
    ship(spark)
    drafts = table(spark, d, "drafts").where("draft_id IS NOT NULL AND content.name IS NULL").select("draft_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("how")).distinct()
    return _named(spark, d).where("entry_id IS NULL").select("draft_id", F.col("text").alias("name"), "how").unionByName(drafts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.groups(table(spark, d, "merges"), "kept_draft_id", "dropped_draft_id", "group_id", "draft_id")


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(group_id, drafts): how many drafts each group has."""
    return p3_found(spark, d).groupBy("group_id").agg(F.count("*").alias("drafts"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return consensus.votes_of(table(spark, d, "review_log"), JUDGMENTS)


_SIZES = {a: len(x) for a, x in JUDGMENTS.items()}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    items, _ = consensus.fit(_votes(spark, d), _SIZES)
    return consensus.labelled(items, JUDGMENTS).select("target", "aspect", "judgment")


def p5_reviewers(spark: SparkSession, d: str) -> DataFrame:
    """(aspect, reviewer, votes, ability, skill): share of right votes on an item of middle ease, and the same above chance."""
    ship(spark)
    _, people = consensus.fit(_votes(spark, d), _SIZES)
    return people.where("code = 0").select("aspect", "reviewer", "votes", F.round("ability", 4).alias("ability"), F.round("skill", 4).alias("skill"))


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    x = consensus.agreement(_votes(spark, d))
    return x.select("aspect", "items", "votes", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return tokens.encode(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """(source, documents, tokens, restored): how many texts the decoder gives back unchanged, by source as stored."""
    ship(spark)
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    both = tokens.decode(tokens.encode(docs), "ids", "again").select("doc_id", F.size("ids").alias("n"), F.xxhash64("again").alias("h"))
    d2 = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("g"))
    return d2.join(both, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.count_if(F.col("g") == F.col("h")).alias("restored"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return mixture.plan(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return mixture.plan(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    """Documents that are split: every one of them has a first piece, and no other document has one."""
    return pieces.split(table(spark, d, "documents")).where("piece = 0").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return pieces.split(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_unmatched, p3_found, p3_sizes, p5_found, p5_reviewers, p5_agreement, p7_ids, p7_roundtrip, p8_mix, p8_shares, p9_found, p9_pieces)}

_LINKED = """
WITH RECURSIVE e AS (SELECT DISTINCT kept_draft_id AS a, dropped_draft_id AS b FROM merges WHERE kept_draft_id IS NOT NULL AND dropped_draft_id IS NOT NULL),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, k.b FROM reach r JOIN ways k ON r.b = k.a),
g AS (SELECT min(b) AS group_id, a AS draft_id FROM reach GROUP BY a)
"""
# a reviewer's latest vote on an item, known labels only
_SPELLED = "regexp_replace(lower(trim({0})), '[\\s_-]+', '{1}', 'g')"
_CODES = f"""
WITH v AS (SELECT target, aspect, ingested_at AS moment, unnest(votes) AS x FROM review_log WHERE target IS NOT NULL AND aspect IN ('fidelity', 'name_desc', 'edge_reason')),
w AS (SELECT target, aspect, moment, coalesce({_SPELLED.format("x.reviewer", "-")}, '') AS reviewer, {_SPELLED.format("x.judgment", "_")} AS judgment, x.approved AS approved FROM v WHERE x IS NOT NULL),
one AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY target, aspect, reviewer ORDER BY moment DESC NULLS LAST, judgment NULLS FIRST, approved NULLS FIRST) = 1),
c AS (SELECT target, aspect, reviewer, CASE WHEN aspect = 'edge_reason' THEN CASE WHEN judgment IN ('approved', 'rejected') THEN judgment WHEN approved THEN 'approved' WHEN NOT approved THEN 'rejected' END
  WHEN aspect = 'fidelity' AND judgment IN ('faithful', 'reasonable_elaboration', 'fabricated') THEN judgment
  WHEN aspect = 'name_desc' AND judgment IN ('consistent', 'scope_mismatch', 'topic_mismatch') THEN judgment
  END AS code FROM one),
per AS (SELECT target, aspect, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY ALL),
item AS (SELECT target, aspect, sum(n) AS m, sum(n * (n - 1)) AS same FROM per GROUP BY ALL HAVING sum(n) > 1),
seen AS (SELECT aspect, count(*) AS items, sum(m)::BIGINT AS votes, sum(same / (m - 1)) / sum(m) AS observed FROM item GROUP BY aspect),
share AS (SELECT aspect, code, sum(n) AS n FROM per JOIN item USING (target, aspect) GROUP BY ALL),
chance AS (SELECT aspect, sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS expected FROM share GROUP BY aspect)
"""

ORACLES: dict[str, str] = {
    "p3_found": _LINKED + "SELECT group_id, draft_id FROM g",
    "p3_sizes": _LINKED + "SELECT group_id, count(*) AS drafts FROM g GROUP BY group_id",
    "p5_agreement": _CODES + "SELECT aspect, items, votes, round(observed, 9) AS observed, round(expected, 9) AS expected, round(CASE WHEN expected = 1 THEN 1 ELSE 1 - (1 - observed) / (1 - expected) END, 9) AS alpha FROM seen JOIN chance USING (aspect)",
}
