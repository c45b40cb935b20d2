"""Whole-corpus encoding with a public byte-level BPE vocabulary (problem 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm.bpe import BYTE_BPE_50K, Decoder, loaded

#: Texts handed to Arrow at once: small, since one text can be very long.
BATCH_BYTES = 4 << 20


def _id_lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) >> 2 for p in packed], dtype=np.int64)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _slices(column: pa.Array) -> list[tuple[int, int]]:
    """Row ranges whose texts stay near BATCH_BYTES."""
    out, start, held = [], 0, 0
    for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
        held += n or 0
        if held >= BATCH_BYTES:
            out.append((start, i + 1))
            start, held = i + 1, 0
    if start < len(column):
        out.append((start, len(column)))
    return out


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(id, ids array<int>): the ids of every text, whole, without special tokens.

    An empty text and a null text have the empty list. A null id is kept. Rows are as many as in df; other columns
    are not read, whatever their names. One narrow pass: no shuffle, and no state but the transducer of the worker.
    """

    def run(batches):
        import pyarrow.compute  # noqa: F401

        machine = loaded(path)
        for b in batches:
            for i, j in _slices(b.column(1)):
                texts = b.column(1).slice(i, j - i).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _id_lists([machine.encode(t) if t else b"" for t in texts])], ["id", "ids"])

    d = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", d.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return d.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def counted(df: DataFrame, text_col: str, path: str = BYTE_BPE_50K, out: str = "n_tokens", drop_text: bool = True) -> DataFrame:
    """df with the number of tokens of text_col (0 for an empty or null text); the text itself is left out unless kept."""
    keep = [c for c in df.columns if c != text_col or not drop_text]
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        machine = loaded(path)
        for b in batches:
            for i, j in _slices(b.column(at)):
                part = b.slice(i, j - i)
                n = pa.array([machine.count(t) if t else 0 for t in part.column(at).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(df_at[c]) for c in keep] + [n], keep + [out])

    df_at = {c: k for k, c in enumerate(df.columns)}
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType())])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """df with the text of its ids, decoded token by token; null ids give null, an unknown id is an error."""
    names = df.columns
    at = names.index(ids_col)

    def run(batches):
        d = Decoder(loaded(path).ranks)
        for b in batches:
            texts = [None if x is None else d.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def may_exceed(text: Column, limit: int) -> Column:
    """False only where a text has at most limit tokens for certain: every token covers at least one byte."""
    return F.coalesce(F.octet_length(text) > limit, F.lit(False))
