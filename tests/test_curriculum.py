import difflib
import random
import re
import unicodedata
from datetime import datetime

from kgraph import schema as S
from kgraph.functions import likeness
from kgraph.operators import curate, serve
from kgraph.operators.graph import Graph
from kgraph.plans import catalogue, curriculum

AT = datetime(2026, 1, 1)


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_documents_of_any_source_are_chunked(spark, tmp_path):
    sources = ["standard_text", "standard-text", "STANDARD_TEXT", "standard_text ", None, "notes"]
    d = written(spark, tmp_path, "documents", [(i, "1.1 one\n\nplain", s) for i, s in enumerate(sources)], "doc_id long, text string, source string")
    assert sorted(r["id"] for r in curriculum.chunk_texts(spark, d).collect()) == [f"{i:012d}#001" for i in range(6)]
    assert sorted(r["ref"] for r in curriculum.chunk_drops(spark, d).collect()) == [f"{i:012d}¶002" for i in range(6)]


def test_duplicate_names_of_drafts(spark, tmp_path):
    names = ["分数的认识", "分数 的认识", "分数·的认识", "分数　的认识", "ＡＢ分数", "ab分数", "小数乘法的应用", "小数乘法应用", "小数除法", "!!", None, "条形统计图的估测", "条形统计图估侧"]
    rows = [(f"d{i:02d}", (n,), AT, AT if n == "小数除法" else None) for i, n in enumerate(names)]
    d = written(spark, tmp_path, "drafts", rows, "draft_id string, content struct<name: string>, ingested_at timestamp, deleted_at timestamp")
    fold = {r[0]: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", r[1][0]).lower()) for r in rows if r[1][0] is not None and r[3] is None}
    same = {(i, f) for i, f in fold.items() if list(fold.values()).count(f) > 1}
    assert {tuple(r) for r in curriculum.same_folded_names(spark, d).collect()} == same and len(same) == 6
    share = lambda a, b: sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) / min(len(a), len(b))
    keys = sorted(set(fold.values()) - {""})
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if share(a, b) >= 0.85}
    assert {(r["a"], r["b"]) for r in curriculum.similar_draft_names(spark, d).collect()} == want and want


def test_similar_names_of_one_pattern(spark, monkeypatch):
    """Names that differ in their digits, and ones whose common part holds characters beyond 16 bits or more than 64, in cells of few names."""
    monkeypatch.setattr(curate, "CELL", 16)
    r, long = random.Random(1), "".join(chr(0x4E00 + k) for k in range(70))
    names = [f"kitemodel{r.randrange(10**6):06d}拼装" for _ in range(60)] + [f"口算卡{r.randrange(10**5):05d}abc填空的认识{'x' * (k % 3)}" for k in range(40)]
    names += ["𠀀乙丙丁戊己庚", "甲乙丙丁戊己庚辛", "𠀀𠀁𠀂𠀃𠀄𠀅𠀆", "𠀀𠀁𠀂𠀃𠀄𠀅", long, long[5:] + "一", long[::-1], long[:64] + "yz"]
    names = sorted(set(names))
    share = lambda a, b: sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) / min(len(a), len(b))
    want = {(a, b): s for i, a in enumerate(names) for b in names[i + 1 :] if (s := share(a, b)) >= 0.85}
    got = curate.fuzzy_names(spark.createDataFrame([(x,) for x in names], "name string")).collect()
    assert {(x["a"], x["b"]): x["score"] for x in got} == want and len(got) == len(want) > 50
    assert ("甲乙丙丁戊己庚辛", "𠀀乙丙丁戊己庚") in want and tuple(sorted((long, long[5:] + "一"))) in want


def test_few_pairs_of_a_pattern_are_matched_by_blocks(monkeypatch):
    """Of the 180,000 pairs of a pattern, matching blocks are made for little more than those that are close enough."""
    r, calls, real = random.Random(2), [], likeness.containment_of
    monkeypatch.setattr(likeness, "containment_of", lambda a, b: calls.append((a, b)) or real(a, b))
    names = sorted({f"kitemodel{r.randrange(10**8):08d}拼装" for _ in range(600)})
    a, b, score = likeness.similar_pairs(names, [[]] * len(names), names, 0.85)
    assert 0 < len(a) <= len(calls) < 2 * len(a) + 50 and len(calls) == len(set(calls)) and min(score) >= 0.85


def test_containment_is_of_difflib_blocks():
    r = random.Random(3)
    text = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randrange(1, most)))
    for k in range(3000):
        a, b = (text("abcdefghij"[: 1 + k % 10], 260 if k % 30 == 0 else 30) for _ in range(2))
        assert likeness.containment_of(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) / min(len(a), len(b))
    assert likeness.containment_of("", "a") == 0.0


def test_whole_retrieval(spark, tmp_path):
    blank = {f.name: None for f in S.TOPIC}
    m = lambda *x: dict(zip(("statement", "probe", "correction_hint"), x, strict=True))
    rows = [
        blank | {"id": "t1", "name": "甲乙丙丁", "description": "条形统计图的估测方法", "misconceptions": [m("分数越大越好", None, "条形图的比较"), m("小数乘法", "看图例", "查一查溶解")]},
        blank | {"id": "t2", "name": "溶解的检验", "description": "x", "misconceptions": [m("查一查溶解的糖", "分数", None)]},
        blank | {"id": "t3", "name": "戊己庚辛", "description": None, "misconceptions": None},
    ]
    written(spark, tmp_path, "topics", [tuple(r[f.name] for f in S.TOPIC) + (AT,) for r in rows], S.T.StructType([*S.TOPIC.fields, S.T.StructField("ingested_at", S.T.TimestampType())]))
    d = written(spark, tmp_path, "registry_entries", [("e1", "溶解的检验", ["回头查一查溶解", "分数大"])], "id string, name string, aliases array<string>")
    got = {}
    for r in curriculum.observation_top5(spark, d).orderBy("rank").collect():
        got.setdefault(r["case_id"], []).append((r["id"], r["position"], r["score"]))
    g = Graph(curriculum.topics(spark, d), None, None)
    for text in ("回头查一查溶解", "分数大"):
        assert got[text] == [(r["id"], r["position"], round(r["score"], 6)) for r in serve.match_misconceptions(g, text).collect()]
    assert catalogue.FLAGSHIP == "observation_top5"
    assert {r["id"] for r in curriculum.search_fraction_texts(spark, d).collect()} == {"t1"}
    f = {round(r["threshold"], 2): r for r in curriculum.retrieval_frontier(spark, d).collect()}
    assert {(r["cases"], r["empty_cases"]) for r in f.values()} == {(2, 2)} and f[0.95]["empty_accuracy"] == 1.0
