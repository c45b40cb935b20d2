import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from kgraph.llm import bpe, looks, pieces, tokens
from kgraph.llm.bpe import BYTE_BPE_50K, Decoder, Transducer, loaded


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as P
    import tiktoken

    with open(BYTE_BPE_50K, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(machine, text):
    b = machine.encode(text)
    return [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]


def test_transducer_equals_reference(encoding):
    rng = random.Random(4)
    parts = ["'", "s", "re", "ll", "'ve", " ", "  ", "\n", "　", "\t", "a", "the", "水", "平行", "12", "½", "é", "é", "—", "。", "!", "==", "-" * 9, "\r\n", "🙂", "\x1c", "\x85", "​", "\0", " " * 70, "x" * 40]
    machine = loaded()
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert ids(machine, text) == encoding.encode_ordinary(text), repr(text)
    small = Transducer(machine.ranks, most_transitions=50)
    decoder = Decoder(machine.ranks)
    long = "".join(rng.choice(parts) for _ in range(60_000))
    assert len(long) > 2 * bpe.SLICE and ids(small, long) == encoding.encode_ordinary(long) and len(small.states) < len(long)
    for text in ("水平 test 平行线。" * 30, "", "a"):
        assert ids(small, text) == encoding.encode_ordinary(text)
        assert decoder.decode(ids(small, text)) == text


def test_encode_table(spark, encoding):
    d = spark.createDataFrame([(1, "水 平", 3), (2, "", 4), (3, None, 5), (None, "a", 6), (4, "字" * 200_000, 7), (1, "水 平", 3)], "doc_id bigint, text string, ids int")
    rows = tokens.encode(d).collect()
    assert len(rows) == 6
    got = {r["doc_id"]: r["ids"] for r in rows}
    assert got[1] == encoding.encode_ordinary("水 平") and got[2] == [] and got[3] == [] and len(got[4]) == 400_000
    back = tokens.decode(tokens.encode(d)).where("doc_id = 1").first()
    assert back["text"] == "水 平"
    assert tokens.encode(d.limit(0)).collect() == []


SAME = [("α", "a"), ("ρυ", "pu"), ("ՍՏ", "US"), ("Ꭺ", "A"), ("Ӏ", "I"), ("ɡ", "g"), ("ハ", "八"), ("ＡＢ １", "AB 1"), ("café", "café"), ("a​b", "ab"), ("x y", "x y"), (" z　", "z"), ("АВ", "AB"), ("ο", "o"), ("⼝算", "口算"), ("タ阳", "夕阳"), ("力", "力"), ("ﬁn", "fin"), ("ё", "ë"), ("ｶﾞ", "ガ")]
OTHER = [("士", "土"), ("0", "O"), ("1", "l"), ("A", "a"), ("café", "cafe"), ("m²", "m2"), ("①", "1"), ("½", "1/2"), ("點", "点"), ("a b", "ab"), ("lǜ", "lü")]


def test_looks(spark):
    d = spark.createDataFrame([(x,) for p in SAME + OTHER for x in p] + [(None,), ("",), ("​ ",)], "t string")
    form = {r["t"]: r["u"] for r in looks.unify(d, "t", "u").collect()}
    assert all(form[a] == form[b] for a, b in SAME), [(a, form[a], form[b]) for a, b in SAME if form[a] != form[b]]
    assert all(form[a] != form[b] for a, b in OTHER)
    assert form[None] is None and form[""] == "" == form["​ "]


def test_same_looks(spark):
    rows = [("f", f"k{i:02d}", "题") for i in range(30)] + [("f", "v1", "题 "), ("f", "v2", "​题"), ("f", "v2", "​题"), ("f", None, "题"), ("f", "w", None), ("g", "k01", "题 "), ("f", "k00", "题 ")]
    d = spark.createDataFrame(rows, "field string, key string, text string").withColumnRenamed("field", "field")
    got = [tuple(r) for r in looks.same_looks(d, chunk=5).collect()]
    texts = {}
    for f, k, t in rows:
        if k and t:
            texts.setdefault((f, k), set()).add(t)
    want = {(f, a, b) for (f, a), x in texts.items() for (g, b), y in texts.items() if f == g and a < b and any(s != t for s in x for t in y)}
    assert len(got) == len(set(got)) and set(got) == want
    assert looks.same_looks(d.limit(0)).collect() == []


def test_same_looks_of_one_hot_spelling(spark):
    """100,000 rows of one spelling and ten others: each of the ten pairs with all, the rows of the one never with each other."""
    hot = spark.range(100_000).selectExpr("'f' AS field", "concat('h', id) AS key", "'题目' AS text")
    few = spark.range(10).selectExpr("'f' AS field", "concat('r', id) AS key", "concat('题', repeat('\u200b', int(id) + 1), '目') AS text")
    began = time.time()
    got = looks.same_looks(hot.unionByName(few)).groupBy(F.substring("key_a", 1, 1).alias("a"), F.substring("key_b", 1, 1).alias("b")).count().collect()
    assert {(r["a"], r["b"]): r["count"] for r in got} == {("h", "r"): 1_000_000, ("r", "r"): 45}
    assert time.time() - began < 60


def test_pieces():
    machine = loaded()
    rng = random.Random(1)
    words = ["水平线。", "画一画，", "数一数！", "\n\n", "# 标题\n", "abc "]
    text = "".join(rng.choice(words) for _ in range(3000))
    found = pieces.pieces_of(text, machine, limit=600, overlap=50, least=200)
    assert found[0][0] == 0 and found[-1][1] == len(text) and len(found) > 5
    for a, b in zip(found, found[1:], strict=False):
        assert a[0] < b[0] < a[1] < b[1] and 50 <= b[3] <= 53
    assert all(machine.count(text[f[0] : f[1]]) == f[2] <= 600 for f in found)
    assert {f[4] for f in found[:-1]} <= {"heading", "paragraph", "sentence"}
    other = pieces.pieces_of("水平线。画一画，" + text, machine, limit=600, overlap=50, least=200)
    old, new = [f[1] for f in found], {f[1] - 8 for f in other}
    assert len(set(old) & new) > 0.9 * len(old)
    assert all(f[2] <= 300 for f in pieces.pieces_of("字" * 5000, machine, limit=300, overlap=20, least=100))
    assert pieces.pieces_of("", machine) == [(0, 0, 0, 0, "end")]


def test_split(spark):
    d = spark.createDataFrame([(1, "字" * 30), (2, "字" * 3), (3, None), (4, ""), (1, "字" * 30)], "doc_id bigint, text string")
    found = pieces.split(d, limit=20, overlap=4, least=8)
    assert [r["doc_id"] for r in found.where("piece = 0").collect()] == [1, 1]
    with pytest.raises(ValueError):
        pieces.pieces_of("字" * 30, loaded(), limit=20, overlap=10)
    assert {r["doc_id"] for r in pieces.split(d, limit=20, overlap=4, least=8).collect()} == {1}
