"""Similarity of texts and vectors, and how scores combine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.functions.text import bigrams, plain

# Weights of the second field, and of a claim's name and description; the admission thresholds.
SEARCH_DESCRIPTION, MATCH_SIDE, CLAIM_NAME, CLAIM_DESCRIPTION = 0.5, 0.5, 0.7, 0.3
LITERAL_LEAST, VECTOR_LEAST, CLAIM_LEAST = 0.20, 0.75, 0.6

#: Vectors that one task of `encoder` keeps.
MOST_KNOWN = 50_000


def shared_share(a: Column, b: Column) -> Column:
    """Size of the intersection over the size of the smaller set; 0 if either is empty or null."""
    low = F.least(F.size(a), F.size(b))
    return F.when(low > 0, F.size(F.array_intersect(a, b)) / low).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 if negative or a norm is 0; arrays of different lengths are an error."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    value = F.when(both > 0, F.greatest(F.lit(0.0), dot / both)).otherwise(F.lit(0.0))
    return F.when(F.size(a) != F.size(b), F.raise_error("vectors of different lengths").cast("double")).otherwise(value)


def search_score(name: Column, description: Column) -> Column:
    return F.greatest(name, SEARCH_DESCRIPTION * description)


def match_score(statement: Column, probe: Column, hint: Column) -> Column:
    return F.greatest(statement, MATCH_SIDE * F.greatest(probe, hint))


def claim_score(name: Column, description: Column) -> Column:
    return CLAIM_NAME * name + CLAIM_DESCRIPTION * description


@dataclass(frozen=True)
class Scorer:
    """A way to score: `prepare` makes a text column's form once a row, `relevance` compares two forms, `least` admits."""

    prepare: Callable[[Column], Column]
    relevance: Callable[[Column, Column], Column]
    least: float


LITERAL = Scorer(lambda c: bigrams(plain(c)), shared_share, LITERAL_LEAST)


def vector_scorer(encode: Callable[[Column], Column], least: float = VECTOR_LEAST) -> Scorer:
    """Scores by the vectors of an encoder (a batch UDF); blank texts have no vector and score 0."""
    return Scorer(lambda c: F.when(F.length(F.trim(c)) > 0, encode(F.trim(c))), lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(cosine(a, b)), least)


def encoder(load: Callable[[], Callable[[list[str]], list]]) -> Callable[[Column], Column]:
    """The batch UDF of an embedding model for `vector_scorer`: load is called once a worker task, when its first text comes, and gives texts ->
    vectors. Each distinct trimmed text of a task is encoded once; vectors come out at length 1, null for a null or blank text."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known = None, {}
        for part in parts:
            keys = [None if x is None or not x.strip() else x.strip() for x in part]
            new = sorted({k for k in keys if k is not None and k not in known})
            if len(known) + len(new) > MOST_KNOWN:
                known, new = {}, sorted({k for k in keys if k is not None})
            if new:
                model = model or load()
                v = np.asarray(model(new), dtype=float)
                known.update(zip(new, (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist(), strict=True))
            yield pd.Series([None if k is None else known[k] for k in keys])

    return encode


def shared_grams(queries: DataFrame, texts: DataFrame, query_id: str, text_id: str, query: str, text: str) -> DataFrame:
    """(query_id, text_id, shared, n_query, n_text) of every pair with a common bigram, over whole texts.

    An equi-join on bigrams with a counted pair, so it's exact for any threshold above 0 and never a cross join.
    """
    q = queries.select(F.col(query_id).alias("_q"), bigrams(plain(F.col(query))).alias("_a"))
    t = texts.select(F.col(text_id).alias("_t"), bigrams(plain(F.col(text))).alias("_b"))
    q = q.select("_q", F.size("_a").alias("n_query"), F.explode("_a").alias("_g"))
    t = t.select("_t", F.size("_b").alias("n_text"), F.explode("_b").alias("_g"))
    return q.join(t, "_g").groupBy("_q", "_t").agg(F.count("*").alias("shared"), F.first("n_query").alias("n_query"), F.first("n_text").alias("n_text")).withColumnsRenamed({"_q": query_id, "_t": text_id})
