"""One form for texts that look alike (problem 1): DuckDB inside Arrow partitions.

The comparison form of a text is built by embedded SQL, in this order: invisible characters are removed
(regexp_replace), nfc_normalize composes accents and resolves canonical doubles of ideographs, translate maps every
single-character form (widths, blanks, radicals, look-alikes of other scripts), replace maps the few forms of several
characters, nfc_normalize composes once more what mapping made composable, and blanks at the ends go. Case, accents,
tones, superscripts, subscripts, circled digits, fractions, traditional forms and blanks inside stay.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.operators.skew import LEAST_HOT, hot_join
from kgraph.session import cut

# Same-shaped characters that Unicode's confusables lack or give another prototype.
OTHER_SHAPES = ("ІԚɑɡ⺝⺩⺫⺮⺰⻎⻦⻱", "IQag月王目竹纟辶鸟龟")
#: Blocks of parts of ideographs, whose prototypes are ideographs.
RADICAL_BLOCKS = ((0x2E80, 0x2FDF),)
#: Compatibility forms are taken over only of these kinds: other kinds (super, sub, circle, fraction, square) can be seen.
KINDS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Of the general kind <compat>, only these blocks keep their look: radicals, ligatures, Roman numerals, the micro sign.
LIKE_BLOCKS = ((0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0x2160, 0x217F), (0xB5, 0xB5))
BLANKS = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters without a look besides the category Cf: joiners, fillers and variation selectors.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0\ufe00-\ufe0f\U000e0100-\U000e01ef"


@cache
def same_shapes(spark: SparkSession) -> dict[str, str]:
    """Characters of other scripts and code blocks with the character of the same shape, by Unicode's confusables (the data of
    the ICU library that Spark brings, read in one call).

    Taken over are letters outside the Latin script whose prototype is an unaccented Latin letter, and syllables or radicals whose
    prototype is an ideograph. Prototypes among letters of one script, among ideographs, and of digits and signs
    aren't: these can be told apart. The prototype of a capital I is a small l, so capitals go back to I.
    """
    kinds = spark._jvm.com.ibm.icu.text.SpoofChecker
    checker = kinds.Builder().setChecks(kinds.CONFUSABLE).build()
    latin, parts = [], []
    for code in [*range(0x370, 0xD800), *range(0x10000, 0x1F000)]:
        ch = chr(code)
        name = unicodedata.name(ch, "")
        if any(a <= code <= b for a, b in RADICAL_BLOCKS) or name.startswith(("KATAKANA LETTER", "BOPOMOFO LETTER")):
            parts.append(ch)
        elif unicodedata.category(ch) in ("Lu", "Ll", "Lo") and not name.startswith(("LATIN", "CJK", "HANGUL", "YI SYLLABLE")):
            latin.append(ch)
    forms = checker.getSkeleton("\n".join(latin + parts)).split("\n")
    out = {}
    for i, (ch, to) in enumerate(zip(latin + parts, forms, strict=True)):
        if i < len(latin):
            if len(to) == 1 and to.isascii() and to.isalpha():
                out[ch] = "I" if to == "l" and unicodedata.category(ch) == "Lu" else to
        elif len(to) == 1 and unicodedata.name(to, "").startswith("CJK UNIFIED"):
            out[ch] = to
    return out | dict(zip(*OTHER_SHAPES, strict=True))


def tables(shapes: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Characters with their one-character forms, and those with longer forms; from Unicode's data by the rules above."""
    base = {b: " " for b in BLANKS} | shapes
    skip = set(range(0xD800, 0xE000))
    for code in range(0xA0, 0x1F000):
        if code in skip:
            continue
        ch = chr(code)
        how = unicodedata.decomposition(ch)
        if how.startswith(KINDS) or how.startswith("<compat>") and any(a <= code <= b for a, b in LIKE_BLOCKS):
            to = unicodedata.normalize("NFKC", ch)
            if not to.startswith(" ") or len(to) == 1:
                base.setdefault(ch, to)
    # forms of forms: an accented look-alike, a wide form of a look-alike
    for code in range(0xA0, 0x3100):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0] in base and ch not in base:
            base[ch] = unicodedata.normalize("NFC", base[parts[0]] + parts[1:])
    out = {ch: unicodedata.normalize("NFC", "".join(base.get(c, c) for c in to)) for ch, to in base.items()}
    return {a: b for a, b in out.items() if len(b) == 1}, {a: b for a, b in out.items() if len(b) > 1}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Code ranges whose mappings are looked up together; a text without a character of the range skips its step.
RANGES = (("\t", "\r"), ("\x80", "\u024f"), ("\u0250", "\u0fff"), ("\u1000", "\u1fff"), ("\u2000", "\u2fff"), ("\u3000", "\u31ff"), ("\u3200", "\ufaff"), ("\ufb00", "\ufeff"), ("\uff00", "\uffff"), ("\U00010000", "\U0010ffff"))


def expression(column: str, shapes: dict[str, str]) -> str:
    """The DuckDB expression of the comparison form."""
    one, longer = tables(shapes)
    e = f"nfc_normalize(CASE WHEN regexp_matches({column}, '[\\p{{Cf}}{INVISIBLE}]') THEN regexp_replace({column}, '[\\p{{Cf}}{INVISIBLE}]', '', 'g') ELSE {column} END)"
    step = lambda e, test, to: f"list_transform([{e}], lambda x: CASE WHEN regexp_matches(x, {_quoted('[' + test + ']')}) THEN {to} ELSE x END)[1]"
    for low, high in RANGES:
        if these := [c for c in one if low <= c <= high]:
            e = step(e, f"{low}-{high}", f"translate(x, {_quoted(''.join(these))}, {_quoted(''.join(one[c] for c in these))})")
    for low, high in RANGES:
        chain = "x"
        if these := [c for c in longer if low <= c <= high]:
            for c in these:
                chain = f"replace({chain}, {_quoted(c)}, {_quoted(longer[c])})"
            e = step(e, "".join(these), chain)
    return f"trim(nfc_normalize({e}), ' ')"


def unify(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with the comparison form of text_col; null stays null, a text of blanks and invisible characters becomes ''.

    A narrow pass over Arrow batches. Row count and every other column stay; an older column of the name out is replaced.
    """
    df = df.drop(out) if out in df.columns and out != text_col else df
    names = df.columns
    at = names.index(text_col)
    sql = f"SELECT {expression('t', same_shapes(df.sparkSession))} AS u FROM texts ORDER BY k"

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        for b in batches:
            con.register("texts", pa.table({"k": pa.array(range(b.num_rows), pa.int64()), "t": b.column(at).cast(pa.string())}))
            got = con.sql(sql).to_arrow_table().column(0).combine_chunks().cast(pa.string())
            con.unregister("texts")
            keep = [(n, c) for n, c in zip(names, b.columns) if n != out]
            yield pa.RecordBatch.from_arrays([c for _, c in keep] + [got], [n for n, _ in keep] + [out])

    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])
    return df.mapInArrow(run, schema)


def same_looks(texts: DataFrame, chunk: int = 500) -> DataFrame:
    """(field, key_a, key_b): pairs of different keys with texts that look the same but are stored differently.

    texts has field, key, text. Each pair once, key_a < key_b; null keys and null texts take no part; a key with several
    texts pairs if any two of them do. Other columns are ignored.

    Spellings are paired, not rows: each distinct (field, text) is unified once, and within a class of one look every two
    different spellings make a pair. Every such pair stands for at least one pair of rows (unless one key holds both), so nothing is
    compared in vain: the rows of one spelling, a third of all say, never meet each other. The keys of a spelling are
    held in chunks of about `chunk`, chosen by hash; a pair of spellings becomes a row for every two of their chunks,
    spread evenly before they are expanded, so a task holds a few products of two chunks, however many rows a spelling or a class has.
    """
    d = texts.select("field", "key", "text").where("key IS NOT NULL AND text IS NOT NULL").distinct()
    spelled = cut(unify(d.groupBy("field", "text").agg(F.count("*").alias("n")), "text", "looks"))
    # classes of one spelling leave; the spellings of a class are salted on one side and repeated on the other
    many = spelled.groupBy("field", "looks").agg(F.count("*").alias("v")).where("v > 1").select("field", "looks", F.ceil(F.col("v") / chunk).cast("int").alias("salts"))
    s = spelled.join(many, ["field", "looks"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    a = s.select("field", "looks", F.col("text").alias("ta"), F.col("chunks").alias("ca"), F.pmod(F.xxhash64("text"), F.col("salts")).cast("int").alias("salt"))
    b = s.select("field", "looks", F.col("text").alias("tb"), F.col("chunks").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = a.join(b, ["field", "looks", "salt"]).where("ta < tb")
    cells = pairs.select("field", "ta", "tb", F.explode(F.sequence(F.lit(0), F.col("ca") - 1)).alias("ka"), "cb").select("field", "ta", "tb", "ka", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("kb"))
    hot = s.where(F.col("n") > LEAST_HOT).orderBy(F.desc("n")).limit(1000).select("field", "text").collect()
    held = hot_join(d, s.select("field", "text", "chunks"), ["field", "text"], hot=hot).groupBy("field", "text", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("k")).agg(F.collect_list("key").alias("keys"))
    x = cells.join(held.toDF("field", "ta", "ka", "keys_a"), ["field", "ta", "ka"]).join(held.toDF("field", "tb", "kb", "keys_b"), ["field", "tb", "kb"])
    x = x.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ta", "tb", "ka", "kb")
    x = x.select("field", F.explode("keys_a").alias("a"), "keys_b").select("field", "a", F.explode("keys_b").alias("b")).where("a <> b")
    return x.select("field", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
