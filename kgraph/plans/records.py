"""Queries over links and references of the curriculum tables (problems 4 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.operators import hierarchy, orphans
from kgraph.operators.skew import hot_join
from kgraph.session import ship
from kgraph.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles(table(spark, d, "dependencies"), "topic_id", "prerequisite_id").select("cycle_id", F.col("node").alias("topic_id"))


def _hierarchy(spark: SparkSession, d: str) -> hierarchy.Hierarchy:
    """Of dependencies, with the ids of topics."""
    return hierarchy.hierarchy(table(spark, d, "dependencies"), "topic_id", "prerequisite_id", table(spark, d, "topics").select("id"))


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(topic_id, status, parent, root, depth, path, lft, rgt, descendants): one row an id.

    status is tree, cycle (on a cycle) or behind (below one). In parent, root and path (ids joined by '/'), a cycle is one node and
    has its cycle_id of p4_found; the topics on it share its place. Of several parents the smallest gives parent, root,
    depth, path and the range; p4_paths and p4_roots have the others'. descendants counts the ids below over all links.
    """
    return nodes(_hierarchy(spark, d))


def nodes(h: hierarchy.Hierarchy) -> DataFrame:
    rows = hot_join(h.members, h.sets.join(hierarchy.descendant_counts(h), "v"), ["v"])
    return rows.select(F.col("node").alias("topic_id"), "status", "parent", "root", "depth", F.concat_ws("/", "path").alias("path"), "lft", "rgt", "descendants")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """(topic_id, path): every path from a root to an id, over all its parents; a cycle is one node, as in p4_nodes."""
    h = _hierarchy(spark, d)
    return h.members.join(hierarchy.paths(h), "v").select(F.col("node").alias("topic_id"), F.concat_ws("/", "path").alias("path"))


def p4_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """(ancestor, descendant) among topics that are neither on a cycle nor below one; p4_descendants has all."""
    return ancestry(_hierarchy(spark, d))


def ancestry(h: hierarchy.Hierarchy) -> DataFrame:
    # what is above such a topic is such a topic too
    clean = h.members.where("status = 'tree'").select(F.col("v").alias("descendant")).distinct()
    return hot_join(hierarchy.descendants(h), clean, ["descendant"], "left_semi").select("ancestor", "descendant")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """(ancestor, descendant): all pairs of ids, those on cycles and below them too. Ids of one cycle are no pair; p4_found has them."""
    return expanded(_hierarchy(spark, d))


def expanded(h: hierarchy.Hierarchy) -> DataFrame:
    m = h.members.select("node", "v")
    above = hierarchy.descendants(h).join(m.toDF("a", "ancestor"), "ancestor")
    return above.join(m.toDF("b", "descendant"), "descendant").select(F.col("a").alias("ancestor"), F.col("b").alias("descendant"))


def p4_roots(spark: SparkSession, d: str) -> DataFrame:
    """(topic_id, root_id): every id with each root above it, a root with itself. A cycle with nothing above it is a root by
    its cycle_id."""
    return roots(_hierarchy(spark, d))


def roots(h: hierarchy.Hierarchy) -> DataFrame:
    top = h.sets.where("parent IS NULL").select("v")
    every = hierarchy.descendants(h, top).select(F.col("descendant").alias("v"), F.col("ancestor").alias("root_id")).unionByName(top.select("v", F.col("v").alias("root_id")))
    return every.join(h.members.select("v", F.col("node").alias("topic_id")), "v").select("topic_id", "root_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    dep, edge = table(spark, d, "dependencies"), table(spark, d, "proposed_edges")
    keys = orphans.parents(table(spark, d, "topics"), "topic", "id", "ingested_at", "deleted_at").unionByName(orphans.parents(table(spark, d, "drafts"), "draft", "draft_id", "ingested_at", "deleted_at"))
    refs = orphans.references(dep, "topic", "dependencies", "dep_id", "topic_id", F.col("topic_id"), "ingested_at")
    refs = refs.unionByName(orphans.references(dep, "topic", "dependencies", "dep_id", "prerequisite_id", F.col("prerequisite_id"), "ingested_at"))
    refs = refs.unionByName(orphans.references(edge, "draft", "proposed_edges", "edge_id", "prerequisite_draft_id", F.col("edge.prerequisite_draft_id"), "ingested_at"))
    return orphans.orphans(refs, keys)


def p6_monthly(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, field_name, kind, period, failing): how many references fail, by table and month."""
    return p6_found(spark, d).groupBy("table_name", "field_name", "kind", "period").agg(F.count("*").alias("failing"))


QUERIES = {f.__name__: f for f in (p4_found, p4_nodes, p4_ancestry, p4_descendants, p4_roots, p4_paths, p6_found, p6_monthly)}

_ORPHANS = """
WITH refs AS (
  SELECT 'dependencies' AS table_name, dep_id AS row_id, 'topic_id' AS field_name, topic_id AS key, min(ingested_at) AS at
  FROM dependencies WHERE topic_id IS NOT NULL GROUP BY dep_id, topic_id
  UNION ALL SELECT 'dependencies', dep_id, 'prerequisite_id', prerequisite_id, min(ingested_at)
  FROM dependencies WHERE prerequisite_id IS NOT NULL GROUP BY dep_id, prerequisite_id
  UNION ALL SELECT 'proposed_edges', edge_id, 'prerequisite_draft_id', edge.prerequisite_draft_id, min(ingested_at)
  FROM proposed_edges WHERE edge.prerequisite_draft_id IS NOT NULL GROUP BY edge_id, edge.prerequisite_draft_id),
keys AS (
  SELECT 'dependencies' AS table_name, id AS key, min(ingested_at) AS first, min(deleted_at) AS gone FROM topics WHERE id IS NOT NULL GROUP BY id
  UNION ALL SELECT 'proposed_edges', draft_id, min(ingested_at), min(deleted_at) FROM drafts WHERE draft_id IS NOT NULL GROUP BY draft_id),
found AS (
  SELECT r.table_name, r.row_id, r.field_name,
    CASE WHEN k.key IS NULL THEN 'missing' WHEN k.first > r.at THEN 'late' WHEN k.gone <= r.at THEN 'deleted' END AS kind,
    strftime(r.at, '%Y-%m') AS period
  FROM refs r LEFT JOIN keys k ON r.table_name = k.table_name AND r.key = k.key)
"""

_REACH = """
WITH RECURSIVE e AS (
  SELECT DISTINCT prerequisite_id AS a, topic_id AS b FROM dependencies WHERE prerequisite_id IS NOT NULL AND topic_id IS NOT NULL),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
"""

# every id with what stands for it (its cycle's smallest id), and the links between those
_STANDS = (
    _REACH
    + """, cyc AS (SELECT x.a AS node, min(x.b) AS v FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
ids AS (SELECT id AS node FROM topics WHERE id IS NOT NULL UNION SELECT a FROM e UNION SELECT b FROM e),
m AS (SELECT i.node, coalesce(c.v, i.node) AS v, c.v IS NOT NULL AS looped FROM ids i LEFT JOIN cyc c ON i.node = c.node),
g AS (SELECT DISTINCT p.v AS p, c.v AS c FROM e JOIN m p ON e.a = p.node JOIN m c ON e.b = c.node WHERE p.v <> c.v),
pairs AS (SELECT DISTINCT x.v AS a, y.v AS b FROM reach r JOIN m x ON r.a = x.node JOIN m y ON r.b = y.node WHERE x.v <> y.v)
"""
)

ORACLES = {
    "p4_found": _REACH + "SELECT min(x.b) AS cycle_id, x.a AS topic_id FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
    "p4_ancestry": _REACH
    + """, odd AS (SELECT a AS v FROM reach WHERE a = b UNION SELECT r.b FROM reach r JOIN reach c ON r.a = c.a AND c.a = c.b)
SELECT DISTINCT a AS ancestor, b AS descendant FROM reach WHERE a NOT IN (SELECT v FROM odd) AND b NOT IN (SELECT v FROM odd)""",
    "p4_descendants": _STANDS + "SELECT x.node AS ancestor, y.node AS descendant FROM pairs r JOIN m x ON r.a = x.v JOIN m y ON r.b = y.v",
    "p4_roots": _STANDS
    + """, tops AS (SELECT DISTINCT v FROM m WHERE v NOT IN (SELECT c FROM g))
SELECT m.node AS topic_id, r.a AS root_id FROM pairs r JOIN tops t ON r.a = t.v JOIN m ON r.b = m.v
UNION ALL SELECT m.node, m.v FROM m JOIN tops t ON m.v = t.v""",
    "p4_paths": _STANDS
    + """, p AS (SELECT DISTINCT v, [v] AS path FROM m WHERE v NOT IN (SELECT c FROM g)
  UNION ALL SELECT g.c, list_append(p.path, g.c) FROM p JOIN g ON p.v = g.p)
SELECT m.node AS topic_id, array_to_string(p.path, '/') AS path FROM p JOIN m ON p.v = m.v""",
    "p4_nodes": _STANDS
    + """, w AS (SELECT v, count(*) AS n FROM m GROUP BY v),
first AS (SELECT c AS v, min(p) AS parent FROM g GROUP BY c),
p AS (SELECT v, [v] AS path FROM w WHERE v NOT IN (SELECT v FROM first)
  UNION ALL SELECT f.v, list_append(p.path, f.v) FROM p JOIN first f ON p.v = f.parent),
steps AS (SELECT unnest(path) AS a, v FROM p),
size AS (SELECT s.a AS v, sum(w.n) AS size FROM steps s JOIN w ON s.v = w.v GROUP BY s.a),
low AS (SELECT p.v, p.path, 1 + coalesce(sum(w.n) OVER (ORDER BY p.path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM p JOIN w ON p.v = w.v),
many AS (SELECT r.a AS v, sum(w.n) AS n FROM pairs r JOIN w ON r.b = w.v GROUP BY r.a),
behind AS (SELECT DISTINCT r.b AS v FROM pairs r JOIN m ON r.a = m.v WHERE m.looped)
SELECT m.node AS topic_id, CASE WHEN m.looped THEN 'cycle' WHEN b.v IS NOT NULL THEN 'behind' ELSE 'tree' END AS status,
  f.parent, l.path[1] AS root, CAST(len(l.path) - 1 AS INTEGER) AS depth, array_to_string(l.path, '/') AS path,
  CAST(l.lft AS BIGINT) AS lft, CAST(l.lft + s.size - 1 AS BIGINT) AS rgt, CAST(coalesce(k.n, 0) AS BIGINT) AS descendants
FROM m JOIN low l ON m.v = l.v JOIN size s ON m.v = s.v LEFT JOIN first f ON m.v = f.v LEFT JOIN many k ON m.v = k.v LEFT JOIN behind b ON m.v = b.v""",
    "p6_found": _ORPHANS + "SELECT table_name, row_id, field_name, kind, period FROM found WHERE kind IS NOT NULL",
    "p6_monthly": _ORPHANS + "SELECT table_name, field_name, kind, period, count(*) AS failing FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
