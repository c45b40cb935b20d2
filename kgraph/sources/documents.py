"""Text, JSON and state: what the pipeline reads and writes besides tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph import schema as S


def source_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, text): every *.md of a folder, whole; in order of the file name wherever order matters."""
    d = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return d.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))


def write_stage(df: DataFrame, path: str) -> None:
    """A stage's rows as a table; nulls stay, an older table at the path is replaced."""
    df.write.mode("overwrite").parquet(path)


def _json_lines(df: DataFrame) -> Iterator[str]:
    """The rows as JSON, nulls kept, a partition at a time on the driver: never all at once."""
    text = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    return (r["value"] for r in text.toLocalIterator(prefetchPartitions=True))


def _write_text(path: str, parts: Iterator[str]) -> None:
    """Written beside the path first, so that a reader never sees half of it; folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as f:
        f.writelines(parts)
    os.replace(beside, path)


def _array(df: DataFrame) -> Iterator[str]:
    yield "["
    for i, line in enumerate(_json_lines(df)):
        yield (",\n" if i else "\n") + line
    yield "\n]"


def export_rows(df: DataFrame, path: str) -> None:
    """A stage as one readable JSON array in a local file, a row a line; rows pass the driver one partition at a time."""
    _write_text(path, _array(df))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_stage(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stage's rows; a stage that doesn't exist yet is empty."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


LEDGER_KEY = ["stage", "ref", "reason", "detail"]


def new_rows(rows: DataFrame, ledger: DataFrame, key: list[str] = LEDGER_KEY) -> DataFrame:
    """Rows that the ledger lacks, each once; nulls compare equal."""
    same = None
    for k in key:
        c = rows[k].eqNullSafe(ledger[k])
        same = c if same is None else same & c
    return rows.dropDuplicates(key).join(ledger, same, "left_anti")


def append_ledger(rows: DataFrame, path: str, key: list[str] = LEDGER_KEY) -> int:
    """Append what isn't there yet; writing the same rows twice leaves one. The number of rows added."""
    spark = rows.sparkSession
    fresh = new_rows(rows, read_stage(spark, path, rows.schema), key).persist()
    try:
        if n := fresh.count():
            fresh.write.mode("append").parquet(path)
        return n
    finally:
        fresh.unpersist()


def swap(df: DataFrame, path: str) -> None:
    """Replace a table that the rows may be read from: written beside it, then the old one moves aside and the new one in its place.

    At every moment the path or one of the two beside it holds a whole table; `recovered` finds it after a crash between the moves.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    new, old = f"{path}.new-{name}", f"{path}.old-{name}"
    df.write.parquet(new)
    if _exists(spark, path):
        _move(spark, path, old)
    _move(spark, new, path)
    p = spark._jvm.org.apache.hadoop.fs.Path(old)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _move(spark: SparkSession, a: str, b: str) -> None:
    jvm = spark._jvm
    x, y = jvm.org.apache.hadoop.fs.Path(a), jvm.org.apache.hadoop.fs.Path(b)
    if not x.getFileSystem(spark._jsc.hadoopConfiguration()).rename(x, y):
        raise OSError(f"{a} couldn't be moved to {b}")


def recovered(spark: SparkSession, path: str) -> str:
    """The path, after putting in place what an interrupted `swap` left beside it: the new table if it was finished, else the old one."""
    if not _exists(spark, path):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.*-*")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        found = sorted(str(x.getPath()) for x in fs.globStatus(p) or [])
        whole = [x for x in found if ".new-" in x and _exists(spark, f"{x}/_SUCCESS")] or [x for x in found if ".old-" in x]
        if whole:
            _move(spark, whole[-1], path)
    return path


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, dependencies, revisits) of one graph document, or of the folder that `write_graph` made; strict, with defaults and list
    positions (ordinal)."""
    if _exists(spark, f"{path}/topics"):
        found = [S.strict_lines(spark, f"{path}/{name}", T.StructType([T.StructField("ordinal", T.LongType()), *kind])) for name, kind in PARTS.items()]
    else:
        doc = S.strict_document(spark, path)
        found = [doc.select(F.posexplode(F.coalesce(name, F.array().cast(T.ArrayType(kind)))).alias("ordinal", "x")).select(F.col("ordinal").cast("long").alias("ordinal"), "x.*") for name, kind in PARTS.items()]
    topics, dependencies, revisits = found
    for c, kind in (("misconceptions", S.MISCONCEPTION), ("standards", S.STANDARD), ("textbook_units", S.TEXTBOOK_UNIT)):
        topics = topics.withColumn(c, F.coalesce(c, F.array().cast(T.ArrayType(kind))))
    for df, rules, key in ((topics, S.TOPIC_RULES, "id"), (dependencies, S.DEPENDENCY_RULES, "ordinal"), (revisits, S.REVISIT_RULES, "ordinal")):
        if bad := S.violations(df, rules, key).limit(5).collect():
            raise S.StrictError(f"{path}: " + ", ".join(f"{r['key']} breaks {r['rule']}" for r in bad))
    return topics, dependencies, revisits


PARTS = {"topics": S.TOPIC, "dependencies": S.DEPENDENCY, "revisits": S.REVISIT}


def _parts(topics: DataFrame, dependencies: DataFrame, revisits: DataFrame) -> dict[str, DataFrame]:
    return dict(zip(PARTS, (topics, dependencies, revisits), strict=True))


def write_graph(topics: DataFrame, dependencies: DataFrame, revisits: DataFrame, path: str) -> None:
    """A folder that `read_graph` reads: one JSON line a record, nulls kept, so no document has to fit one task. Records without an ordinal get one."""
    for name, df in _parts(topics, dependencies, revisits).items():
        d = df if "ordinal" in df.columns else df.withColumn("ordinal", F.monotonically_increasing_id())
        d = d.select("ordinal", *[f.name for f in PARTS[name]])
        d.select(F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(os.path.join(path, name))


def export_graph(topics: DataFrame, dependencies: DataFrame, revisits: DataFrame, path: str) -> None:
    """The graph as one JSON document in a local file, nulls kept, in the order of ordinals; `read_graph` reads it back. Topics come by id."""

    def text() -> Iterator[str]:
        for i, (name, df) in enumerate(_parts(topics, dependencies, revisits).items()):
            yield ("{" if not i else ",") + f"\n{json.dumps(name)}: "
            order = "ordinal" if "ordinal" in df.columns else PARTS[name][0].name
            yield from _array(df.orderBy(order).select(*[f.name for f in PARTS[name]]))
        yield "\n}\n"

    _write_text(path, text())


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry entries from a JSON document or a table; none if the path doesn't exist. A missing last grade is the last there is."""
    if path.endswith(".json"):
        if not _exists(spark, path):
            return spark.createDataFrame([], S.REGISTRY_ENTRY)
        d = S.strict_document(spark, path, S.REGISTRY).select(F.explode("entries").alias("e")).select("e.*")
        return d.withColumn("grade_end", F.coalesce("grade_end", F.lit(9)))
    return read_stage(spark, recovered(spark, path), S.REGISTRY_ENTRY)


def registry_settings(spark: SparkSession, path: str, threshold: float = 0.6) -> tuple[str, float]:
    """(note, threshold) of a registry document; '' and the default where it says nothing or doesn't exist."""
    if not path.endswith(".json") or not _exists(spark, path):
        return "", threshold
    r = S.strict_document(spark, path, S.REGISTRY).first()
    return r["_note"] or "", threshold if r["threshold"] is None else r["threshold"]


def write_registry(entries: DataFrame, path: str, note: str = "", threshold: float = 0.6) -> None:
    """The registry in the place of the one that the entries may come from: a JSON document with note and threshold, or a table."""
    e = entries.select(*[f.name for f in S.REGISTRY_ENTRY])
    if not path.endswith(".json"):
        return swap(e, path)

    def text() -> Iterator[str]:
        yield f'{{"_note": {json.dumps(note, ensure_ascii=False)},\n"threshold": {json.dumps(threshold)},\n"entries": '
        yield from _array(e.orderBy("id", "name"))
        yield "}\n"

    return _write_text(path, text())


def cases(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a label document {"cases": [...]}."""
    return spark.read.schema(T.StructType([T.StructField("cases", T.ArrayType(schema))])).option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")


_FOREIGN_TOPIC = "array<struct<id:string,name:string,description:string,type:string,subject:string,domain:string,ageRangeStart:int,ageRangeEnd:int,evidence:array<string>,assessmentPrompt:string,standards:array<string>>>"
_FOREIGN_LINK = "array<struct<topicId:string,prerequisiteId:string,strength:string,reason:string>>"


def grade_of_age(age):
    return F.greatest(F.lit(1), F.least(F.lit(9), age - 5)).cast("int")


def foreign_taxonomy(spark: SparkSession, topics_path: str, dependencies_path: str) -> tuple[DataFrame, DataFrame]:
    """(topics, dependencies) of another taxonomy's two documents: ages as grades, `curriculum:code` split at the first colon,
    missing evidence as one placeholder, self links left out, no provenance."""
    t = spark.read.schema(f"topics {_FOREIGN_TOPIC}").option("multiLine", True).json(topics_path).select(F.explode("topics").alias("t")).select("t.*")
    codes = F.transform(F.filter(F.coalesce("standards", F.array()), lambda s: (F.instr(s, ":") > 0) & (F.length(F.substring_index(s, ":", 1)) < F.length(s) - 1)), lambda s: F.struct(F.substring_index(s, ":", 1).alias("curriculum"), F.substring(s, F.instr(s, ":") + 1, F.length(s)).alias("code")))
    topics = t.select("id", "name", "description", F.lower("type").alias("type"), "subject", "domain", grade_of_age(F.col("ageRangeStart")).alias("grade_start"), grade_of_age(F.col("ageRangeEnd")).alias("grade_end"), F.when(F.size(F.coalesce("evidence", F.array())) > 0, F.col("evidence")).otherwise(F.array(F.lit("(not given)"))).alias("evidence"), F.col("assessmentPrompt").alias("assessment_prompt"), F.array().cast(T.ArrayType(S.MISCONCEPTION)).alias("misconceptions"), codes.alias("standards"), F.array().cast(T.ArrayType(S.TEXTBOOK_UNIT)).alias("textbook_units"), F.lit(None).cast(S.PROVENANCE).alias("provenance"))
    d = spark.read.schema(f"dependencies {_FOREIGN_LINK}").option("multiLine", True).json(dependencies_path).select(F.posexplode("dependencies").alias("ordinal", "d"))
    links = d.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("d.topicId").alias("topic_id"), F.col("d.prerequisiteId").alias("prerequisite_id"), F.lower("d.strength").alias("strength"), F.col("d.reason").alias("reason"))
    return topics, links.where("topic_id <> prerequisite_id")


def write_json_schema(path: str, schema: T.DataType = S.GRAPH) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(S.json_schema(schema), f, ensure_ascii=False, indent=2)


def report(summary: DataFrame) -> tuple[str, int]:
    """Findings by code as text, and the exit code: 1 if any is an error."""
    rows = summary.collect()
    lines = [f"{r['severity']} {r['code']}: {r['findings']}\n" + "".join(f"  - {m}\n" for m in r["samples"]) for r in rows]
    return "".join(lines) or "no findings\n", int(any(r["severity"] == "error" for r in rows))
