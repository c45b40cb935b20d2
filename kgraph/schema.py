"""Declared schemas, a strict loader, and the constraints as one table of predicates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _i, _d, _b = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MISCONCEPTION = _struct(statement=_s, probe=_s, correction_hint=_s)
STANDARD = _struct(curriculum=_s, code=_s)
TEXTBOOK_UNIT = _struct(edition=_s, volume=_s, unit=_s, title=_s)
PROVENANCE = _struct(method=_s, review_status=_s, reviewer=_s, reviewed_at=_s, confidence=_d)
TOPIC = _struct(id=_s, name=_s, description=_s, type=_s, subject=_s, domain=_s, grade_start=_i, grade_end=_i, evidence=T.ArrayType(_s), assessment_prompt=_s, misconceptions=T.ArrayType(MISCONCEPTION), standards=T.ArrayType(STANDARD), textbook_units=T.ArrayType(TEXTBOOK_UNIT), provenance=PROVENANCE)
DEPENDENCY = _struct(topic_id=_s, prerequisite_id=_s, strength=_s, reason=_s)
REVISIT = _struct(earlier_id=_s, later_id=_s, note=_s)
GRAPH = _struct(topics=T.ArrayType(TOPIC), dependencies=T.ArrayType(DEPENDENCY), revisits=T.ArrayType(REVISIT))
CONTENT = _struct(name=_s, description=_s, type=_s, subject=_s, domain=_s, grade_start=_i, grade_end=_i, evidence=T.ArrayType(_s), assessment_prompt=_s, misconceptions=T.ArrayType(MISCONCEPTION), source_span=_s)
CHUNK = _struct(id=_s, text=_s, standard_code=_s, source_file=_s, ordinal=_i)
DRAFT = _struct(draft_id=_s, chunk_id=_s, standard_codes=T.ArrayType(_s), content=CONTENT)
EDGE = _struct(target_draft_id=_s, edge=_struct(prerequisite_draft_id=_s, strength=_s, reason=_s))
VOTE = _struct(reviewer=_s, approved=_b, reason=_s, judgment=_s)
REVIEW = _struct(target=_s, aspect=_s, votes=T.ArrayType(VOTE), approved=_b)
DROP = _struct(stage=_s, ref=_s, reason=_s, detail=_s)
MERGE = _struct(kept_draft_id=_s, dropped_draft_id=_s, reason=_s)
REGISTRY_ENTRY = _struct(id=_s, name=_s, domain=_s, grade_start=_i, grade_end=_i, description=_s, aliases=T.ArrayType(_s))
REGISTRY = _struct(_note=_s, threshold=_d, entries=T.ArrayType(REGISTRY_ENTRY))

# The closed sets of the model.
TYPES = ("conceptual", "procedural", "representational", "language", "meta")
STRENGTHS = ("hard", "soft")
STATUSES = ("unreviewed", "approved", "rejected")

#: (rule, SQL that holds for a good topic)
TOPIC_RULES = (
    ("type", f"type IN {TYPES}"),
    ("grade_range", "grade_start BETWEEN 1 AND 9 AND grade_end BETWEEN 1 AND 9"),
    ("grade_order", "grade_end >= grade_start"),
    ("evidence", "size(evidence) > 0"),
    ("confidence", "provenance IS NULL OR provenance.confidence BETWEEN 0 AND 1"),
    ("required", "id IS NOT NULL AND name IS NOT NULL AND description IS NOT NULL"),
)
DEPENDENCY_RULES = (("strength", f"strength IN {STRENGTHS}"), ("reason", "length(reason) > 0"), ("self", "topic_id <> prerequisite_id"))
REVISIT_RULES = (("note", "length(note) > 0"), ("self", "earlier_id <> later_id"))


class StrictError(ValueError):
    """Input that the declared schema doesn't allow."""


def violations(df: DataFrame, rules, key: str) -> DataFrame:
    """(key, rule): one row a broken rule; a rule whose value is null is broken. One pass."""
    bad = F.filter(F.array(*[F.when(F.expr(f"coalesce({sql}, false)"), F.lit(None)).otherwise(F.lit(name)) for name, sql in rules]), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(bad).alias("rule"))


def _unknown(value, kind, at: str) -> list[str]:
    if isinstance(kind, T.ArrayType):
        return [x for i, v in enumerate(value or []) for x in _unknown(v, kind.elementType, f"{at}[{i}]")]
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        known = {f.name: f.dataType for f in kind}
        out = [f"{at}.{k}" for k in value if k not in known]
        return out + [x for k, v in value.items() if k in known for x in _unknown(v, known[k], f"{at}.{k}")]
    return []


def _strict(texts: DataFrame, path: str, schema: T.StructType) -> None:
    """Malformed JSON and unknown keys are errors. Each text (value) is looked at where it lies; only what is wrong comes back."""

    def look(parts):
        for part in parts:
            bad = []
            for t in part["value"]:
                try:
                    extra = _unknown(json.loads(t), schema, "$")
                    bad += [f"unknown keys {', '.join(extra[:5])}"] if extra else []
                except ValueError as e:
                    bad.append(str(e))
            yield pd.DataFrame({"problem": pd.Series(bad[:5], dtype="object")})

    if bad := texts.mapInPandas(look, "problem string").limit(5).collect():
        raise StrictError(f"{path}: " + "; ".join(r["problem"] for r in bad))


def strict_document(spark: SparkSession, path: str, schema: T.StructType = GRAPH) -> DataFrame:
    """One JSON document as one row; malformed text and keys that the schema lacks are errors at load time."""
    _strict(spark.read.text(path, wholetext=True), path, schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def strict_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document a line, as strict."""
    _strict(spark.read.text(path), path, schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: What JSON Schema says beyond types: closed sets, ranges and least lengths, by field.
LIMITS = {
    "type": {"enum": list(TYPES)}, "strength": {"enum": list(STRENGTHS)}, "review_status": {"enum": list(STATUSES)}, "evidence": {"minItems": 1},
    "grade_start": {"minimum": 1, "maximum": 9}, "grade_end": {"minimum": 1, "maximum": 9}, "confidence": {"minimum": 0, "maximum": 1}, "reason": {"minLength": 1}, "note": {"minLength": 1},
}
#: Fields that may be left out or null; all others are required.
OPTIONAL = {"misconceptions", "standards", "textbook_units", "provenance", "reviewer", "reviewed_at", "dependencies", "revisits"}


def json_schema(schema: T.DataType = GRAPH) -> dict:
    """The JSON Schema (2020-12) of a declared type."""

    def of(t, name: str = "") -> dict:
        if isinstance(t, T.ArrayType):
            out = {"type": "array", "items": of(t.elementType)}
        elif isinstance(t, T.StructType):
            out = {"type": "object", "additionalProperties": False, "properties": {f.name: of(f.dataType, f.name) for f in t}, "required": [f.name for f in t if f.name not in OPTIONAL]}
        else:
            out = {"type": {"string": "string", "int": "integer", "double": "number", "boolean": "boolean"}[t.simpleString()]}
        out |= LIMITS.get(name, {})
        return {"anyOf": [out, {"type": "null"}]} if name in OPTIONAL and not isinstance(t, T.ArrayType) else out

    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **of(schema)}
