"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A key of fewer rows is never hot.
LEAST_HOT = 10_000


def hot_keys(many: DataFrame, on: list[str], most: int = 1000, least: int = LEAST_HOT) -> list:
    """The `most` heaviest keys with more than `least` rows, so every key of over 1/most of the rows; no null ones."""
    heavy = many.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > least).dropna()
    return heavy.orderBy(F.desc("_n")).limit(most).select(*on).collect()


def hot_join(many: DataFrame, one: DataFrame, on: list[str], how: str = "inner", hot: list | None = None) -> DataFrame:
    """many join one on columns of equal name; `one` has at most one row a key, `many` any number.

    The rows of `one` for the hot keys of `many` (`hot_keys`, unless given) are broadcast, at most as many rows as there
    are hot keys, and the rows of `many` stay where they are. All other keys take a shuffle join. how is inner, left,
    left_semi or left_anti; null keys match nothing, as in SQL, and with left and left_anti stay.
    """
    if hot is None:
        hot = hot_keys(many, on)
    if not hot:
        return many.join(one, on, how)
    keys = F.broadcast(many.sparkSession.createDataFrame(hot, many.select(*on).schema))
    a = many.join(keys, on, "left_semi").join(F.broadcast(one.join(keys, on, "left_semi")), on, how)
    b = many.join(keys, on, "left_anti").join(one, on, how)
    return a.unionByName(b)
