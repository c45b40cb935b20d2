"""SQL of the curriculum queries, independent of the operators."""

from __future__ import annotations

_T = "t AS (SELECT * FROM topics QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
_E = "e AS (SELECT dep_id AS ordinal, topic_id, prerequisite_id, strength, reason FROM dependencies WHERE topic_id IS NOT NULL AND prerequisite_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dep_id ORDER BY ingested_at) = 1)"
_R = "r AS (SELECT * FROM (SELECT id AS earlier_id, name, lead(id) OVER (PARTITION BY name ORDER BY grade_start, id) AS later_id FROM t) WHERE later_id IS NOT NULL AND name IS NOT NULL)"
_D = "dr AS (SELECT * FROM drafts WHERE draft_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY ingested_at) = 1), kd AS (SELECT * FROM dr WHERE deleted_at IS NULL)"
_P = "p0 AS MATERIALIZED (SELECT edge_id, target_draft_id, struct_extract(edge, 'prerequisite_draft_id') AS prerequisite_draft_id, struct_extract(edge, 'strength') AS strength, ingested_at FROM proposed_edges), p AS (SELECT edge_id, target_draft_id, prerequisite_draft_id, strength FROM p0 WHERE target_draft_id IS NOT NULL AND prerequisite_draft_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at) = 1)"
_P0 = _P.replace("AS strength, ingested_at", "AS strength, struct_extract(edge, 'reason') AS reason, ingested_at").replace("prerequisite_draft_id, strength FROM p0", "prerequisite_draft_id, strength, reason FROM p0")
_V = "v AS (SELECT DISTINCT target, aspect, lower(trim(x.reviewer)) AS reviewer, regexp_replace(lower(trim(x.judgment)), '[ -]', '_', 'g') AS judgment, x.approved AS approved FROM (SELECT target, aspect, unnest(votes) AS x FROM review_log WHERE target IS NOT NULL))"
_ENDS = "ends AS (SELECT 'topic_id' AS field, topic_id AS id FROM e UNION ALL SELECT 'prerequisite_id', prerequisite_id FROM e UNION ALL SELECT 'earlier_id', earlier_id FROM r UNION ALL SELECT 'later_id', later_id FROM r)"
_BLANK = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
_DIGITS = dict(zip("零一二三四五六七八九十", [*"0123456789", "10"], strict=True))
_SIGNS = {"加": "+", "减": "-", "乘": "×", "除以": "÷"}
_NUMBER = r"(\p{Nd}+|[零一二三四五六七八九十])"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _signs(column: str, pattern: str, to: str, words: dict[str, str]) -> str:
    """The words among what a pattern captures replaced; what is captured stands between two noncharacters meanwhile."""
    e = f"regexp_replace({column}, '{pattern}', '{to}', 'g')".replace("<", "\ufdd0").replace(">", "\ufdd1")
    for word, sign in words.items():
        e = f"replace({e}, '\ufdd0{word}\ufdd1', '{sign}')"
    return f"replace(replace({e}, '\ufdd0', ''), '\ufdd1', '')"


def _plain(column: str) -> str:
    e = _signs(column, f"{_NUMBER}分之{_NUMBER}", r"<\2>/<\1>", _DIGITS)
    e = _signs(e, f"{_NUMBER}{_BLANK}*({'|'.join(_SIGNS)}){_BLANK}*{_NUMBER}", r"<\1><\2><\3>", _DIGITS | _SIGNS)
    return f"regexp_replace(lower({e}), '{_BLANK}', '', 'g')"


def _grams(column: str) -> str:
    pairs = "CASE WHEN length(x) >= 2 THEN list_distinct(list_transform(range(1, length(x)), lambda i: substring(x, i, 2))) WHEN length(x) = 1 THEN [x] WHEN x = '' THEN []::VARCHAR[] END"
    return f"list_transform([{_plain(column)}], lambda x: {pairs})[1]"


_CASES = """
w AS (SELECT DISTINCT id, text FROM (SELECT id, unnest(aliases) AS text FROM registry_entries WHERE id IS NOT NULL) WHERE length(text) > 0),
n AS (SELECT id, min(name) AS name FROM registry_entries WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY id),
q AS (SELECT text AS case_id, list_sort(list(id)) AS expected FROM w GROUP BY text)
"""
_SCORED = (
    _CASES
    + f""", qg AS (SELECT case_id, {_grams("case_id")} AS g FROM q), ng AS (SELECT id, {_grams("name")} AS g FROM n),
sc AS (SELECT case_id, id, len(list_intersect(qg.g, ng.g)) AS shared, len(qg.g) AS n_query, len(ng.g) AS n_text FROM qg, ng),
s AS (SELECT *, shared / least(n_query, n_text) AS raw FROM sc WHERE shared > 0)
"""
)
# the aliases, and names of topics that are no entry's name or alias, which expect nothing
_ALL_CASES = (
    _T
    + ", "
    + _CASES
    + f""", known AS (SELECT {_plain("text")} AS k FROM (SELECT name AS text FROM registry_entries UNION ALL SELECT unnest(aliases) FROM registry_entries) WHERE text IS NOT NULL),
aq AS (SELECT case_id, false AS empty FROM q UNION ALL SELECT name, true FROM (SELECT DISTINCT name, {_plain("name")} AS k FROM t) WHERE length(k) > 0 AND k NOT IN (SELECT k FROM known)),
qg AS (SELECT case_id, {_grams("case_id")} AS g FROM aq), ng AS (SELECT id, {_grams("name")} AS g FROM n),
sc AS (SELECT case_id, id, len(list_intersect(qg.g, ng.g)) AS shared, len(qg.g) AS n_query, len(ng.g) AS n_text FROM qg, ng),
s AS (SELECT *, shared / least(n_query, n_text) AS raw FROM sc WHERE shared > 0)
"""
)
_FRONTIER = (
    _ALL_CASES
    + """, th AS (SELECT round(0.05 * i, 2)::DOUBLE AS threshold FROM range(1, 20) x(i)),
top AS (SELECT threshold, s.case_id, s.id FROM s JOIN th ON s.raw >= th.threshold QUALIFY row_number() OVER (PARTITION BY threshold, s.case_id ORDER BY raw DESC, s.id) <= 3),
hits AS (SELECT DISTINCT threshold, case_id FROM top JOIN w ON top.case_id = w.text AND top.id = w.id),
answered AS (SELECT DISTINCT threshold, case_id FROM top),
f AS (SELECT th.threshold, round(count(hits.case_id) FILTER (NOT aq.empty) / count(*) FILTER (NOT aq.empty), 6) AS recall,
    round(count(*) FILTER (aq.empty AND answered.case_id IS NULL) / count(*) FILTER (aq.empty), 6) AS empty_accuracy,
    count(*) FILTER (NOT aq.empty) AS cases, count(*) FILTER (aq.empty) AS empty_cases
  FROM aq CROSS JOIN th LEFT JOIN hits ON hits.threshold = th.threshold AND hits.case_id = aq.case_id
  LEFT JOIN answered ON answered.threshold = th.threshold AND answered.case_id = aq.case_id GROUP BY th.threshold)
"""
)
_JUDGED = (
    _V
    + """, j AS (SELECT target, aspect, reviewer, approved, CASE WHEN aspect = 'edge_reason' THEN CASE WHEN approved THEN 'approved' WHEN NOT approved THEN 'rejected' END ELSE judgment END AS judgment FROM v),
top AS (SELECT target, aspect, judgment AS expected FROM (SELECT target, aspect, judgment, count(*) AS n FROM j WHERE judgment IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY target, aspect ORDER BY n DESC, judgment) = 1),
x AS (SELECT j.*, top.expected FROM j JOIN top USING (target, aspect) WHERE judgment IS NOT NULL)
"""
)
_LABELS = ("faithful", "reasonable_elaboration", "fabricated", "consistent", "scope_mismatch", "topic_mismatch", "approved", "rejected")
_QUERY, _SEEN = "'条形统计图的估测'", "'孩子说角的大小和边长有关，没有零就不用管'"
_M = "m AS (SELECT id, (p - 1)::INTEGER AS position, misconceptions[p].statement AS statement, misconceptions[p].probe AS probe, misconceptions[p].correction_hint AS hint FROM (SELECT id, misconceptions, unnest(generate_series(1, len(misconceptions))) AS p FROM t))"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0 END"


_SEARCH = _with(
    _T,
    f"x AS (SELECT *, {_grams(_QUERY)} AS q, {_grams('name')} AS ng, {_grams('description')} AS dg FROM t)",
    f"sc AS (SELECT *, {_share('q', 'ng')} AS n, {_share('q', 'dg')} AS d FROM x)",
)
_MATCH = f"g AS (SELECT *, {_grams('statement')} AS sg, {_grams('probe')} AS pg, {_grams('hint')} AS hg FROM m)"
_PARAGRAPHS = r"""lines AS (SELECT lpad(doc_id::VARCHAR, greatest(12, length(doc_id::VARCHAR))::INTEGER, '0') AS stem, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM documents),
parts AS (SELECT stem, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t　]*(?:\n[ \t　]*)+'), lambda p: regexp_replace(p, '^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+$', '', 'g')), lambda p: length(p) > 0) AS ps FROM lines),
p AS (SELECT stem, k, ps[k] AS p, regexp_extract(ps[k], '(?s)^(\p{Nd}+(?:\.\p{Nd}+)+)[ 　]+(.+)$', 1) AS code, regexp_extract(ps[k], '(?s)^(\p{Nd}+(?:\.\p{Nd}+)+)[ 　]+(.+)$', 2) AS body FROM (SELECT stem, ps, unnest(generate_series(1, len(ps))) AS k FROM parts))
"""
_REVIEWED = (
    _D
    + """, f AS (SELECT draft_id, content, content.name IS NULL AS failed, CASE WHEN coalesce(len(content.evidence), 0) = 0 THEN 'fabricated' WHEN contains(coalesce(content.source_span, ''), content.name) THEN 'faithful' ELSE 'reasonable_elaboration' END AS judgment FROM kd),
n AS (SELECT draft_id, content.description IS NULL AS failed, CASE WHEN contains(content.description, substring(content.name, 1, 1)) THEN 'consistent' ELSE 'topic_mismatch' END AS judgment FROM f WHERE NOT failed)
"""
)
_LEVELS = """
SELECT event_type, count(value) AS requests, round(quantile_cont(value, 0.5), 6) AS p50,
  round(list_sort(list(value))[greatest(1, least(count(value), CAST(round_even(0.95 * count(value) + 0.5, 0) AS BIGINT)))], 6) AS p95
FROM events WHERE value IS NOT NULL GROUP BY event_type
"""


def _walk(hard: str) -> str:
    """Two levels; a first discovery is the lowest level, then the smallest pair of ordinals."""
    return (
        _with(_T, _E)
        + f""", k AS (SELECT e.topic_id AS a, e.prerequisite_id AS b, e.ordinal AS o FROM e WHERE e.prerequisite_id IN (SELECT id FROM t) {hard}),
l1 AS (SELECT t.id AS start, k.b AS id, k.a AS required_by, [k.o] AS rk FROM t JOIN k ON k.a = t.id WHERE k.b <> t.id QUALIFY row_number() OVER (PARTITION BY t.id, k.b ORDER BY k.o) = 1),
l2 AS (SELECT l1.start, k.b AS id, k.a AS required_by FROM l1 JOIN k ON k.a = l1.id
  WHERE k.b <> l1.start AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.start = l1.start AND x.id = k.b)
  QUALIFY row_number() OVER (PARTITION BY l1.start, k.b ORDER BY l1.rk[1], k.o) = 1)
SELECT start, 1::INTEGER AS level, id, required_by FROM l1 UNION ALL SELECT start, 2, id, required_by FROM l2"""
    )


_CHAINS = (
    "WITH RECURSIVE "
    + ", ".join((_T, _E))
    + """, k AS (SELECT DISTINCT prerequisite_id AS a, topic_id AS b FROM e WHERE prerequisite_id <> topic_id AND prerequisite_id IN (SELECT id FROM t) AND topic_id IN (SELECT id FROM t)),
reach AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM reach r JOIN k ON r.b = k.a),
odd AS (SELECT a AS v FROM reach WHERE a = b UNION SELECT r.b FROM reach r JOIN reach c ON r.a = c.a AND c.a = c.b),
w AS (SELECT id, 1 AS length FROM t WHERE id NOT IN (SELECT v FROM odd) UNION SELECT k.b, w.length + 1 FROM w JOIN k ON w.id = k.a WHERE k.b NOT IN (SELECT v FROM odd))
"""
)
_CALLS = """
WITH c AS (SELECT event_type, epoch_us(ts) / 1000000 AS started, epoch_us(ts) / 1000000 + round(value * 60) AS ended, user_id % 10 = 0 AS refused, user_id % 10 <> 0 AND user_id % 17 = 0 AS broken FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT event_type, list_sort(list(ended - started)) AS took FROM c WHERE NOT refused AND NOT broken GROUP BY event_type),
turns AS (SELECT event_type, started AS moment, 1 AS turn FROM c WHERE started < ended UNION ALL SELECT event_type, ended, -1 FROM c WHERE started < ended),
peak AS (SELECT event_type, max(n)::BIGINT AS peak FROM (SELECT event_type, sum(turn) OVER (PARTITION BY event_type ORDER BY moment, turn ROWS UNBOUNDED PRECEDING) AS n FROM turns) GROUP BY event_type),
n AS (SELECT event_type, count(*) AS requests, count(*) FILTER (NOT refused AND NOT broken) AS ok, count(*) FILTER (refused) AS rate_limited, count(*) FILTER (broken) AS failed, max(ended) - min(started) AS wall FROM c GROUP BY event_type)
SELECT event_type, requests, ok, rate_limited, failed, round(wall, 3) AS wall, round(ok / wall, 9) AS throughput, round(coalesce(list_median(took), 0), 3) AS p50,
  round(took[greatest(1, least(len(took), CAST(round_even(0.95 * len(took) + 0.5, 0) AS BIGINT)))], 3) AS p95, peak
FROM n JOIN l USING (event_type) JOIN peak USING (event_type)
"""


_CLAIMS = _with(_T, f"a AS (SELECT id, domain, grade_start AS x, coalesce(grade_end, grade_start) AS y, {_grams('name')} AS n, {_grams("coalesce(description, '')")} AS d FROM t), b AS (SELECT DISTINCT id AS entry_id, domain, grade_start AS x, coalesce(grade_end, 9) AS y, {_grams('name')} AS n, {_grams("coalesce(description, '')")} AS d FROM registry_entries)", f"s AS (SELECT a.id, b.entry_id, 0.7 * ({_share('a.n', 'b.n')}) + 0.3 * ({_share('a.d', 'b.d')}) AS score FROM a JOIN b ON a.domain = b.domain AND a.x <= b.y AND b.x <= a.y)", "c AS (SELECT id, entry_id, max(score) AS score FROM s WHERE score >= 0.6 AND id IS NOT NULL AND entry_id IS NOT NULL GROUP BY ALL)")


def _greedy() -> str:
    """Ranked pairs p (part, r, l, k, ...) taken one after the other, in every part by itself, unless an end is taken."""
    return f"""g AS (SELECT DISTINCT part, 0::BIGINT AS r, []::VARCHAR[] AS lefts, []::VARCHAR[] AS rights, []::BIGINT[] AS chosen FROM p
UNION ALL SELECT p.part, p.r, CASE WHEN ok THEN list_append(lefts, p.l) ELSE lefts END, CASE WHEN ok THEN list_append(rights, p.k) ELSE rights END, CASE WHEN ok THEN list_append(chosen, p.r) ELSE chosen END
  FROM (SELECT p.*, g.lefts, g.rights, g.chosen, NOT list_contains(g.lefts, p.l) AND NOT list_contains(g.rights, p.k) AS ok FROM g JOIN p ON p.part = g.part AND p.r = g.r + 1) p),
took AS (SELECT part, unnest(chosen) AS r FROM g QUALIFY row_number() OVER (PARTITION BY part ORDER BY g.r DESC) = 1)"""


# misconceptions of topics in both snapshots, with their places, and how alike their statements are
_KEPT = (
    _T
    + f""", later AS (SELECT id, CASE WHEN grade_start > 6 THEN upper(name) ELSE name || '（修订）' END AS name, misconceptions[2:] AS ms FROM t WHERE deleted_at IS NULL),
two AS (SELECT t.id, t.name AS n1, coalesce(t.misconceptions, []) AS m1, later.name AS n2, coalesce(later.ms, []) AS m2 FROM t JOIN later ON t.id = later.id),
x AS (SELECT id, k AS pos, {_plain("coalesce(m1[k].statement, '')")} AS key FROM (SELECT id, m1, unnest(generate_series(1, len(m1))) AS k FROM two)),
y AS (SELECT id, k AS pos, {_plain("coalesce(m2[k].statement, '')")} AS key FROM (SELECT id, m2, unnest(generate_series(1, len(m2))) AS k FROM two)),
xg AS (SELECT *, {_grams("key")} AS g FROM x), yg AS (SELECT *, {_grams("key")} AS g FROM y),
s AS (SELECT xg.id, xg.pos AS a, yg.pos AS b, xg.key = yg.key AS verbatim, {_share("xg.g", "yg.g")} AS score FROM xg JOIN yg ON xg.id = yg.id),
th AS (SELECT unnest([0.3, 0.6, 0.9])::DOUBLE AS threshold),
p AS (SELECT threshold || '|' || s.id AS part, threshold, s.*, a::VARCHAR AS l, b::VARCHAR AS k, row_number() OVER (PARTITION BY threshold, s.id ORDER BY score DESC, a, b) AS r FROM s JOIN th ON s.score >= th.threshold),
"""
)

ORACLES = {
    "topic_cards": _with(_T) + "SELECT id, name, CASE WHEN length(description) > 60 THEN substring(description, 1, 60) || '…' ELSE description END AS summary, grade_start, grade_end, CASE WHEN provenance IS NULL THEN 'unreviewed' ELSE provenance.review_status END AS review_status FROM t",
    "topics_of_grade5": _with(_T) + "SELECT id, name, grade_start, grade_end FROM t WHERE 5 BETWEEN grade_start AND coalesce(grade_end, grade_start)",
    "search_fraction_texts": _SEARCH + "SELECT id, name, round(greatest(n, 0.5 * d), 6) AS score FROM sc WHERE greatest(n, d) >= 0.2",
    "searched_topics": _SEARCH + "SELECT id, name, CASE WHEN length(description) > 60 THEN substring(description, 1, 60) || '…' ELSE description END AS summary, round_even(greatest(n, 0.5 * d), 4) AS score FROM sc WHERE greatest(n, d) >= 0.2 ORDER BY greatest(n, 0.5 * d) DESC, id LIMIT 5",
    "matched_observation": _with(_T, _M, f"g AS (SELECT *, {_grams(_SEEN)} AS q, {_grams('statement')} AS sg, {_grams('probe')} AS pg, {_grams('hint')} AS hg FROM m)", f"sc AS (SELECT *, {_share('q', 'sg')} AS s, {_share('q', 'pg')} AS p, {_share('q', 'hg')} AS h FROM g)")
    + "SELECT id, position, statement, round(greatest(s, 0.5 * greatest(p, h)), 6) AS score FROM sc WHERE greatest(s, p, h) >= 0.2 ORDER BY greatest(s, 0.5 * greatest(p, h)) DESC, id, position LIMIT 5",
    "topic_details": _with(_T) + "SELECT id, name, description, grade_start, grade_end, 'unknown' AS method, 'unreviewed' AS review_status, 0.0::DOUBLE AS confidence FROM t WHERE id = (SELECT min(id) FROM t WHERE provenance IS NULL)",
    "spoken_forms": f"""WITH n AS (SELECT DISTINCT l_linenumber::INTEGER AS a, floor(l_quantity)::INTEGER AS b FROM lineitem), w AS (SELECT *, substring('零一二三四五六七八九十', a + 1, 1) AS w FROM n),
x AS (SELECT DISTINCT unnest([b || '分之' || w, w || ' 分之' || b, w || '加　' || b || ' 减 1', a || '×' || b || '比' || a || '乘' || b || '大', b || '除以' || w || '和' || b || '÷' || a, '两加' || w || ' Ab']) AS text FROM w)
SELECT text, {_plain("text")} AS plain FROM x""",
    "chunk_texts": _with(_PARAGRAPHS) + "SELECT stem || '#' || lpad(o::VARCHAR, greatest(3, length(o::VARCHAR))::INTEGER, '0') AS id, code AS standard_code, length(body)::INTEGER AS chars, o::INTEGER AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY k) AS o FROM p WHERE code <> '')",
    "chunk_drops": _with(_PARAGRAPHS) + "SELECT 'chunk' AS stage, stem || '¶' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INTEGER, '0') AS ref, 'NO_STANDARD_CODE' AS reason FROM p WHERE code = ''",
    "registry_claims": _CLAIMS + "SELECT id, entry_id, round(score, 6) AS score FROM c",
    "registry_assignment": _CLAIMS.replace("WITH ", "WITH RECURSIVE ", 1) + ", p AS (SELECT 'all' AS part, id AS l, entry_id AS k, score, row_number() OVER (ORDER BY score DESC, id, entry_id) AS r FROM c), " + _greedy() + " SELECT p.l AS id, p.k AS entry_id, round(p.score, 6) AS score FROM took JOIN p USING (part, r)",
    "statement_retention": "WITH RECURSIVE " + _KEPT + _greedy()
    + """, m AS (SELECT p.threshold, p.id, p.verbatim, p.score FROM took JOIN p USING (part, r)),
n AS (SELECT sum(len(m1)) AS statements, sum(len(m2)) AS later, count(*) FILTER (n1 IS DISTINCT FROM n2) AS renamed, count(*) FILTER (len(m1) > 0) AS had FROM two)
SELECT th.threshold, n.statements::BIGINT AS statements, count(*) FILTER (m.verbatim) AS verbatim, count(m.id) AS matched, (n.statements - count(m.id))::BIGINT AS lost, (n.later - count(m.id))::BIGINT AS added,
  n.had - count(DISTINCT m.id) AS hollowed, n.renamed, round(coalesce(median(m.score), 0), 6) AS median_score
FROM th CROSS JOIN n LEFT JOIN m ON m.threshold = th.threshold GROUP BY th.threshold, n.statements, n.later, n.had, n.renamed""",
    "learning_path": _CHAINS.replace(_E, _E + ", " + _R)
    + """, target AS (SELECT id FROM (SELECT id, max(length) AS n FROM w GROUP BY id) ORDER BY n DESC, id LIMIT 1),
up AS (SELECT a AS id FROM reach WHERE b = (SELECT id FROM target) UNION SELECT id FROM target),
known AS (SELECT min(id) AS id FROM up WHERE id <> (SELECT id FROM target)),
have AS (SELECT id FROM known WHERE id IS NOT NULL UNION SELECT a FROM reach WHERE b = (SELECT id FROM known)),
need AS (SELECT t.id, t.name, t.grade_start, coalesce(list(DISTINCT k.a) FILTER (k.a IS NOT NULL AND k.a IN (SELECT id FROM up) AND k.a NOT IN (SELECT id FROM have)), []) AS pre
  FROM t LEFT JOIN k ON k.b = t.id WHERE t.id IN (SELECT id FROM up) AND t.id NOT IN (SELECT id FROM have) GROUP BY t.id, t.name, t.grade_start),
walk AS (SELECT []::VARCHAR[] AS done UNION ALL SELECT list_append(done, nxt) FROM (SELECT done, min_by(id, struct_pack(g := grade_start, i := id)) AS nxt FROM walk, need WHERE NOT list_contains(done, id) AND len(list_filter(pre, lambda x: NOT list_contains(done, x))) = 0 GROUP BY done)),
whole AS (SELECT done FROM walk ORDER BY len(done) DESC LIMIT 1),
notes AS (SELECT earlier_id AS id FROM r UNION ALL SELECT later_id FROM r)
SELECT list_position((SELECT done FROM whole), id)::INTEGER AS step, id, name, grade_start, (SELECT count(*) FROM notes n WHERE n.id = need.id)::INTEGER AS revisits, id = (SELECT id FROM target) AS is_target FROM need""",
    "draft_review": _with(_REVIEWED) + "SELECT draft_id AS target, 'fidelity' AS aspect, judgment, judgment <> 'fabricated' AS approved FROM f WHERE NOT failed UNION ALL SELECT draft_id, 'name_desc', judgment, judgment <> 'topic_mismatch' FROM n WHERE NOT failed",
    "draft_review_drops": _with(_REVIEWED)
    + """SELECT 'review' AS stage, draft_id AS ref, 'FIDELITY_JUDGE_FAILED' AS reason, 'RuntimeError: a draft without a name' AS detail FROM f WHERE failed
UNION ALL SELECT 'review', draft_id, 'NAME_JUDGE_FAILED', 'RuntimeError: a draft without a description' FROM n WHERE failed
UNION ALL SELECT 'review', f.draft_id, 'REVIEW_REJECTED', concat_ws(',', CASE WHEN f.judgment = 'fabricated' THEN 'fidelity' END, CASE WHEN n.judgment = 'topic_mismatch' THEN 'name_desc' END) FROM f JOIN n ON f.draft_id = n.draft_id WHERE NOT n.failed AND (f.judgment = 'fabricated' OR n.judgment = 'topic_mismatch')""",
    "edge_review": _with(_D, _P0) + "SELECT p.edge_id FROM p JOIN kd a ON p.target_draft_id = a.draft_id JOIN kd b ON p.prerequisite_draft_id = b.draft_id WHERE length(p.reason) > 0 AND coalesce(b.content.grade_start, 0) <= coalesce(a.content.grade_start, 0)",
    "edge_review_drops": _with(_D, _P0, "k AS (SELECT p.*, a.content.grade_start AS hi, b.content.grade_start AS lo FROM p JOIN kd a ON p.target_draft_id = a.draft_id JOIN kd b ON p.prerequisite_draft_id = b.draft_id)")
    + """SELECT DISTINCT 'review' AS stage, target_draft_id AS ref, 'UNKNOWN_REVIEW_TARGET' AS reason, '' AS detail FROM p WHERE target_draft_id NOT IN (SELECT draft_id FROM kd)
UNION ALL SELECT 'review', target_draft_id || '<-' || prerequisite_draft_id, 'UNKNOWN_EDGE_PREREQUISITE', prerequisite_draft_id FROM p WHERE target_draft_id IN (SELECT draft_id FROM kd) AND prerequisite_draft_id NOT IN (SELECT draft_id FROM kd)
UNION ALL SELECT 'review', target_draft_id || '<-' || prerequisite_draft_id, 'EDGE_JUDGE_FAILED', 'RuntimeError: an edge without a reason' FROM k WHERE coalesce(length(reason), 0) = 0
UNION ALL SELECT 'review', target_draft_id || '<-' || prerequisite_draft_id, 'REVIEW_REJECTED', 'edge_reason' FROM k WHERE length(reason) > 0 AND coalesce(lo, 0) > coalesce(hi, 0)""",
    "assembled_links": _with(_D, _P0) + "SELECT 't_' || target_draft_id AS topic_id, 't_' || prerequisite_draft_id AS prerequisite_id, strength, reason FROM p WHERE target_draft_id IN (SELECT draft_id FROM kd) AND prerequisite_draft_id IN (SELECT draft_id FROM kd) AND target_draft_id <> prerequisite_draft_id QUALIFY row_number() OVER (PARTITION BY target_draft_id, prerequisite_draft_id ORDER BY coalesce(strength, '') <> 'hard', edge_id) = 1",
    "observation_top5": _with(_T, _CASES, _M, _MATCH, f"qg AS (SELECT case_id, {_grams('case_id')} AS q FROM q)", f"sc AS (SELECT case_id, id, position, {_share('q', 'sg')} AS s, {_share('q', 'pg')} AS p, {_share('q', 'hg')} AS h FROM qg, g)")
    + ", best AS (SELECT case_id, id, position, greatest(s, 0.5 * greatest(p, h)) AS score FROM sc WHERE greatest(s, p, h) >= 0.2) SELECT case_id, (row_number() OVER w)::INTEGER AS rank, id, position, round(score, 6) AS score FROM best WINDOW w AS (PARTITION BY case_id ORDER BY score DESC, id, position) QUALIFY row_number() OVER w <= 5",
    "text_corpus": _with(_T, "m AS (SELECT unnest(misconceptions) AS m FROM t)") + "SELECT DISTINCT text FROM (SELECT name AS text FROM t UNION ALL SELECT description FROM t UNION ALL SELECT m.statement FROM m UNION ALL SELECT m.probe FROM m UNION ALL SELECT m.correction_hint FROM m) WHERE text IS NOT NULL",
    "misconception_list": _with(_T) + "SELECT id, (p - 1)::INTEGER AS position, misconceptions[p].statement AS statement FROM (SELECT id, misconceptions, unnest(generate_series(1, len(misconceptions))) AS p FROM t)",
    "new_topic_ids": _with(_T) + "SELECT id, 't_' || substring(sha1(concat_ws('|', name, domain, grade_start::VARCHAR)), 1, 10) AS made_id FROM t",
    "inverted_grades": _with(_D) + "SELECT 'extract' AS stage, draft_id AS ref, 'GRADE_RANGE_INVERTED' AS reason, concat_ws('-', content.grade_start, content.grade_end) AS detail FROM kd WHERE content.grade_end < content.grade_start",
    "link_names": _with(_T, _E) + "SELECT e.ordinal, a.name AS topic, b.name AS prerequisite, e.strength FROM e JOIN t a ON e.topic_id = a.id JOIN t b ON e.prerequisite_id = b.id",
    "same_code_drafts": _with(_D) + "SELECT draft_id, code FROM (SELECT draft_id, unnest(list_distinct(standard_codes)) AS code FROM kd) QUALIFY count(*) OVER (PARTITION BY code) > 1",
    "prerequisite_pool_sizes": _with(_T) + "SELECT a.id, (SELECT count(*) FROM t b WHERE b.id <> a.id AND (b.grade_start BETWEEN a.grade_start - 2 AND a.grade_start - 1 OR b.grade_start = a.grade_start AND b.id < a.id)) AS candidates FROM t a WHERE a.id IS NOT NULL AND a.grade_start IS NOT NULL",
    "unknown_prerequisites": _with(_D, _P) + "SELECT 'edges' AS stage, target_draft_id AS ref, CASE WHEN prerequisite_draft_id IN (SELECT draft_id FROM dr) THEN 'NON_CANDIDATE_PREREQUISITE' ELSE 'UNKNOWN_PREREQUISITE' END AS reason, prerequisite_draft_id AS detail FROM p WHERE prerequisite_draft_id NOT IN (SELECT draft_id FROM dr) OR prerequisite_draft_id = target_draft_id",
    "review_unresolved": _with(_D, _P)
    + """SELECT DISTINCT 'review' AS stage, target_draft_id AS ref, 'UNKNOWN_REVIEW_TARGET' AS reason, '' AS detail FROM p WHERE target_draft_id NOT IN (SELECT draft_id FROM kd)
UNION ALL SELECT 'review', target_draft_id || '<-' || prerequisite_draft_id, 'UNKNOWN_EDGE_PREREQUISITE', prerequisite_draft_id FROM p WHERE target_draft_id IN (SELECT draft_id FROM kd) AND prerequisite_draft_id NOT IN (SELECT draft_id FROM kd)""",
    "edge_prefilter_kept": _with(_D, _P) + "SELECT edge_id FROM p WHERE target_draft_id IN (SELECT draft_id FROM kd) AND prerequisite_draft_id IN (SELECT draft_id FROM kd)",
    "edge_prefilter_drops": _with(_D, _P) + "SELECT 'review' AS stage, target_draft_id || '<-' || prerequisite_draft_id AS ref, CASE WHEN target_draft_id NOT IN (SELECT draft_id FROM kd) THEN 'EDGE_TARGET_REJECTED' ELSE 'EDGE_PREREQUISITE_REJECTED' END AS reason, prerequisite_draft_id AS detail FROM p WHERE target_draft_id NOT IN (SELECT draft_id FROM kd) OR prerequisite_draft_id NOT IN (SELECT draft_id FROM kd)",
    "orphaned_drafts": _with(_D, _P) + "SELECT draft_id FROM kd WHERE draft_id IN (SELECT target_draft_id FROM p) AND draft_id NOT IN (SELECT target_draft_id FROM p WHERE prerequisite_draft_id IN (SELECT draft_id FROM kd))",
    "graph_stats": _with(_T, _E, _R, _ENDS) + "SELECT (SELECT count(*) FROM t) AS topics, (SELECT count(*) FROM e) AS dependencies, (SELECT count(*) FROM e WHERE strength = 'hard') AS hard, (SELECT count(*) FROM e WHERE strength = 'soft') AS soft, (SELECT count(*) FROM r) AS revisits, (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM ends)) AS isolated",
    "grade_histogram": _with(_T) + "SELECT grade::INTEGER AS grade, count(*) AS topics FROM (SELECT unnest(generate_series(grade_start, coalesce(grade_end, grade_start))) AS grade FROM t) GROUP BY grade",
    "curriculum_codes": _with(_T, "s AS (SELECT unnest(standards) AS s FROM t)") + "SELECT s.curriculum AS curriculum, string_agg(DISTINCT s.code, ',' ORDER BY s.code) AS codes FROM s GROUP BY 1",
    "review_statuses": _with(_T) + "SELECT CASE WHEN provenance IS NULL THEN 'unreviewed' ELSE provenance.review_status END AS review_status, count(*) AS topics FROM t GROUP BY 1",
    "standards_coverage": _with(_T) + "SELECT count(*) AS topics, count(*) FILTER (len(standards) > 0) AS aligned, count(*) FILTER (len(standards) > 0) / count(*) AS ratio FROM t",
    "unanimous_reviews": _with(_V) + "SELECT target, aspect, bool_and(coalesce(approved, false)) AS approved, count(*) AS votes FROM v GROUP BY target, aspect",
    "mapped_votes": _with(_V) + "SELECT aspect, judgment, CASE WHEN aspect = 'fidelity' AND judgment IS NOT NULL THEN judgment <> 'fabricated' WHEN aspect = 'name_desc' AND judgment IS NOT NULL THEN judgment <> 'topic_mismatch' ELSE approved END AS approves, count(*) AS votes FROM v GROUP BY ALL",
    "single_edges": _with(_P) + "SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY target_draft_id, prerequisite_draft_id ORDER BY coalesce(strength, '') <> 'hard', edge_id) = 1",
    "duplicate_edges": _with(_P) + "SELECT edge_id FROM p QUALIFY row_number() OVER (PARTITION BY target_draft_id, prerequisite_draft_id ORDER BY coalesce(strength, '') <> 'hard', edge_id) > 1",
    "merged_evidence": _with(_D, "m AS (SELECT DISTINCT kept_draft_id, dropped_draft_id FROM merges WHERE kept_draft_id <> dropped_draft_id)")
    + """SELECT m.kept_draft_id || '|' || m.dropped_draft_id AS key,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(a.content.evidence, []), coalesce(b.content.evidence, [])))), chr(10)) AS evidence,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(a.standard_codes, []), coalesce(b.standard_codes, [])))), chr(10)) AS codes,
  array_to_string(list_sort(list_concat(coalesce(list_transform(a.content.misconceptions, lambda x: x.statement), []),
    coalesce(list_filter(list_transform(b.content.misconceptions, lambda x: x.statement), lambda x: NOT coalesce(list_contains(list_transform(a.content.misconceptions, lambda y: y.statement), x), false)), []))), chr(10)) AS misconceptions
FROM m JOIN dr a ON m.kept_draft_id = a.draft_id JOIN dr b ON m.dropped_draft_id = b.draft_id""",
    "prerequisites_depth2": _walk(""),
    "prerequisites_hard": _walk("AND strength <> 'soft'"),
    "chains": _CHAINS + "SELECT id, max(length)::INTEGER AS length FROM w GROUP BY id",
    "longest_chain_of_all": _CHAINS + "SELECT coalesce(max(length), 0)::INTEGER AS longest_chain, (SELECT count(*) > 0 FROM odd) OR EXISTS (SELECT 1 FROM e WHERE topic_id = prerequisite_id AND topic_id IN (SELECT id FROM t)) AS has_cycle FROM w",
    "spiral_notes": _with(_T, _R) + "SELECT earlier_id AS id, 'later' AS direction, later_id AS other_id, name AS other_name FROM r UNION ALL SELECT later_id, 'earlier', earlier_id, name FROM r",
    "dangling_links": _with(_T, _E, _R, _ENDS) + "SELECT 'DANGLING_REF' AS code, 'error' AS severity, field, id, count(*) AS findings FROM ends WHERE id NOT IN (SELECT id FROM t) GROUP BY ALL",
    "isolated_topics": _with(_T, _E, _R, _ENDS) + "SELECT id FROM t WHERE id NOT IN (SELECT id FROM ends)",
    "grade_inversions": _with(_T, _E) + "SELECT e.ordinal, CASE WHEN e.strength = 'hard' THEN 'error' ELSE 'warning' END AS severity FROM e JOIN t a ON e.prerequisite_id = a.id JOIN t b ON e.topic_id = b.id WHERE a.grade_start > b.grade_start",
    "revisits_not_advancing": _with(_T, _R) + "SELECT r.earlier_id, r.later_id FROM r JOIN t a ON r.earlier_id = a.id JOIN t b ON r.later_id = b.id WHERE b.grade_start <= a.grade_start",
    "missing_provenance": _with(_T) + "SELECT 'MISSING_PROVENANCE' AS code, 'error' AS severity, id FROM t WHERE provenance IS NULL",
    "finding_summary": "WITH RECURSIVE "
    + ", ".join((_T, _E, _R, _ENDS))
    + """, k AS (SELECT DISTINCT prerequisite_id AS a, topic_id AS b FROM e WHERE prerequisite_id IN (SELECT id FROM t) AND topic_id IN (SELECT id FROM t)),
reach AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM reach r JOIN k ON r.b = k.a),
cyc AS (SELECT x.a, min(x.b) AS c FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
f AS (SELECT 'CYCLE' AS code, 'error' AS severity, count(DISTINCT c) AS findings FROM cyc
UNION ALL SELECT 'DANGLING_REF', 'error', count(*) FROM ends WHERE id NOT IN (SELECT id FROM t)
UNION ALL SELECT 'ISOLATED_TOPIC', 'warning', count(*) FROM t WHERE id NOT IN (SELECT id FROM ends)
UNION ALL SELECT 'GRADE_INVERSION', CASE WHEN e.strength = 'hard' THEN 'error' ELSE 'warning' END, count(*) FROM e JOIN t a ON e.prerequisite_id = a.id JOIN t b ON e.topic_id = b.id WHERE a.grade_start > b.grade_start GROUP BY 2
UNION ALL SELECT 'REVISIT_NOT_ADVANCING', 'error', count(*) FROM r JOIN t a ON r.earlier_id = a.id JOIN t b ON r.later_id = b.id WHERE b.grade_start <= a.grade_start
UNION ALL SELECT 'LOW_STANDARDS_COVERAGE', 'error', CASE WHEN count(*) FILTER (len(standards) > 0) / count(*) < 0.9 THEN 1 ELSE 0 END FROM t
UNION ALL SELECT 'MISSING_PROVENANCE', 'error', count(*) FROM t WHERE provenance IS NULL
UNION ALL SELECT 'CONSISTENCY_SKIPPED', 'warning', 1)
SELECT code, severity, findings::BIGINT AS findings FROM f WHERE findings > 0""",
    "all_findings": "WITH RECURSIVE "
    + ", ".join((_T, _E, _R, _ENDS))
    + """, k AS (SELECT DISTINCT prerequisite_id AS a, topic_id AS b FROM e WHERE prerequisite_id IN (SELECT id FROM t) AND topic_id IN (SELECT id FROM t)),
reach AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM reach r JOIN k ON r.b = k.a),
cyc AS (SELECT x.a, min(x.b) AS c FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT DISTINCT 'CYCLE' AS code, 'error' AS severity, c AS about FROM cyc
UNION ALL SELECT 'DANGLING_REF', 'error', field || '|' || id FROM ends WHERE id NOT IN (SELECT id FROM t)
UNION ALL SELECT 'ISOLATED_TOPIC', 'warning', id FROM t WHERE id NOT IN (SELECT id FROM ends)
UNION ALL SELECT 'GRADE_INVERSION', CASE WHEN e.strength = 'hard' THEN 'error' ELSE 'warning' END, prerequisite_id || '|' || topic_id FROM e JOIN t a ON e.prerequisite_id = a.id JOIN t b ON e.topic_id = b.id WHERE a.grade_start > b.grade_start
UNION ALL SELECT 'REVISIT_NOT_ADVANCING', 'error', earlier_id || '|' || later_id FROM r JOIN t a ON r.earlier_id = a.id JOIN t b ON r.later_id = b.id WHERE b.grade_start <= a.grade_start
UNION ALL SELECT 'LOW_STANDARDS_COVERAGE', 'error', concat_ws('|', count(*), count(*) FILTER (len(standards) > 0), (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM t WHERE id IS NOT NULL AND coalesce(len(standards), 0) = 0 ORDER BY id LIMIT 1000))) FROM t HAVING count(*) FILTER (len(standards) > 0) / count(*) < 0.9
UNION ALL SELECT 'MISSING_PROVENANCE', 'error', id FROM t WHERE provenance IS NULL
UNION ALL SELECT 'CONSISTENCY_SKIPPED', 'warning', 'no judge'""",
    "content_violations": _with(_D)
    + """SELECT draft_id AS key, rule FROM (
SELECT draft_id, unnest(list_filter([
  CASE WHEN coalesce(content.type IN ('conceptual', 'procedural', 'representational', 'language', 'meta'), false) THEN NULL ELSE 'type' END,
  CASE WHEN coalesce(content.grade_start BETWEEN 1 AND 9 AND content.grade_end BETWEEN 1 AND 9, false) THEN NULL ELSE 'grade_range' END,
  CASE WHEN coalesce(content.grade_end >= content.grade_start, false) THEN NULL ELSE 'grade_order' END,
  CASE WHEN coalesce(len(content.evidence) > 0, false) THEN NULL ELSE 'evidence' END,
  CASE WHEN content.name IS NOT NULL AND content.description IS NOT NULL THEN NULL ELSE 'required' END], lambda x: x IS NOT NULL)) AS rule FROM kd)""",
    "literal_match_top3": _with(_SCORED) + "SELECT case_id, (row_number() OVER w)::INTEGER AS rank, id, shared, n_query::INTEGER AS n_query, n_text::INTEGER AS n_text FROM s WHERE raw >= 0.2 WINDOW w AS (PARTITION BY case_id ORDER BY raw DESC, id) QUALIFY row_number() OVER w <= 3",
    "retrieval_frontier": _with(_FRONTIER) + "SELECT * FROM f",
    "operating_point": _with(_FRONTIER) + "SELECT threshold, recall, empty_accuracy FROM f WHERE empty_accuracy >= 0.9 ORDER BY recall DESC, threshold LIMIT 1",
    "judge_confusion": _with(_JUDGED) + "SELECT expected, " + ", ".join(f"count(*) FILTER (judgment = '{x}') AS {x}" for x in _LABELS) + " FROM x GROUP BY expected",
    "judge_scores": _with(_JUDGED, "l AS (SELECT DISTINCT judgment AS label FROM x UNION SELECT DISTINCT expected FROM x)")
    + """SELECT label, round(coalesce((SELECT count(*) FROM x WHERE judgment = label AND expected = label) / nullif((SELECT count(*) FROM x WHERE judgment = label), 0), 0), 6) AS precision,
  round(coalesce((SELECT count(*) FROM x WHERE judgment = label AND expected = label) / nullif((SELECT count(*) FROM x WHERE expected = label), 0), 0), 6) AS recall,
  (SELECT count(*) FROM x WHERE expected = label) AS expected_count, (SELECT count(*) FROM x WHERE judgment = label) AS got_count FROM l""",
    "latency_levels": _LEVELS,
    "call_levels": _CALLS,
    "ledger_append": "SELECT DISTINCT event_type, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 2 = 0 AND o.event_type IS NOT DISTINCT FROM e.event_type AND o.user_id IS NOT DISTINCT FROM e.user_id)",
    "snapshot_overlap": _with(_T) + "SELECT count(DISTINCT name) FILTER (deleted_at IS NULL) AS both, count(DISTINCT name) AS either, round(count(DISTINCT name) FILTER (deleted_at IS NULL) / count(DISTINCT name), 6) AS jaccard FROM t",
    "nearest_vectors": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3""",
    "event_props": "SELECT key, count(*) AS events FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
}
