"""References to records that don't exist (problem 6): bitmaps of key ranges and periods.

Keys become integers by a dictionary that is written once. References, arrivals and deletions are each a bitmap for every range
of 32,768 keys and every month; a key with a tenth of the rows is one bit. Bitmaps are compressed (`packed`): as positions, as runs or as
plain bits, whichever is least, so that sparse months and full ranges cost little. For a range and a month, the keys that are surely good are
those that had arrived in an earlier month and aren't deleted up to the month's end; reference AND NOT good leaves bits,
which are decoded. What the months can't settle is settled row by row for the decoded keys only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.operators.skew import hot_join
from kgraph.session import cut, written

ALWAYS = "0000-00"
#: Keys of a bitmap.
RANGE = 32768


def _month(c: str):
    return F.date_format(c, "yyyy-MM")


def parents(df: DataFrame, space: str, key: str, at: str, gone: str) -> DataFrame:
    """(space, key, first, gone): a record's first arrival and its deletion, over all its rows; null keys are no records."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.min(at).alias("first"), F.min(gone).alias("gone")).select(F.lit(space).alias("space"), "key", "first", "gone")


def references(df: DataFrame, space: str, table: str, row: str, field: str, key, at: str) -> DataFrame:
    """(space, table_name, row_id, field_name, key, at): non-null references, a repeated one at its first arrival."""
    return df.select(F.col(row).alias("row_id"), key.cast("string").alias("key"), F.col(at).alias("at")).where("key IS NOT NULL").groupBy("row_id", "key").agg(F.min("at").alias("at")).select(F.lit(space).alias("space"), F.lit(table).alias("table_name"), "row_id", F.lit(field).alias("field_name"), "key", "at")


def packed(bits: np.ndarray) -> bytes:
    """A set of bit numbers below 32,768 as its least container: a letter and positions (p, 2 bytes a bit), the first and last of each run (r, 4
    bytes a run) or plain bits (b, 4 KiB)."""
    bits = np.sort(bits).astype("<u2")
    ends = np.flatnonzero(np.diff(bits.astype(np.int32)) != 1)
    runs = np.stack([bits[np.r_[0, ends + 1]], bits[np.r_[ends, len(bits) - 1]]]) if len(bits) else np.zeros((2, 0), "<u2")
    if min(bits.nbytes, runs.nbytes) >= RANGE // 8:
        return b"b" + np.packbits(_flags(bits), bitorder="little").tobytes()
    return b"r" + runs.tobytes() if runs.nbytes < bits.nbytes else b"p" + bits.tobytes()


def _flags(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(RANGE, bool)
    out[bits] = True
    return out


def opened(data: bytes) -> np.ndarray:
    """The flags of a container."""
    kind, data = data[:1], data[1:]
    if kind == b"b":
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(bool)
    numbers = np.frombuffer(data, "<u2")
    if kind == b"p":
        return _flags(numbers)
    steps = np.zeros(RANGE + 1, np.int32)
    first, last = numbers.reshape(2, -1)
    steps[first] += 1
    steps[last.astype(np.int64) + 1] -= 1
    return np.cumsum(steps)[:RANGE] > 0


def _pack(batches):
    for b in batches:
        bits = pa.array([packed(x.values.to_numpy()) for x in b.column(4)], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], bits], ["space", "bucket", "kind", "period", "bits"])


def _suspects(g: pd.DataFrame) -> pd.DataFrame:
    """One range: the bits of references that aren't surely good in their month."""
    maps = {(k, p): b for k, p, b in zip(g["kind"], g["period"], g["bits"], strict=True)}
    here, gone, at, codes = np.zeros(RANGE, bool), np.zeros(RANGE, bool), [], []
    for p in sorted({p for _, p in maps}):
        if ("deleted", p) in maps:
            gone |= opened(maps["deleted", p])
        if ("arrived", p) in maps and p == ALWAYS:
            here |= opened(maps["arrived", p])
        if ("reference", p) in maps:
            bits = np.flatnonzero(opened(maps["reference", p]) & ~(here & ~gone))
            codes.extend(bits.tolist())
            at.extend([p] * len(bits))
        if ("arrived", p) in maps and p != ALWAYS:
            here |= opened(maps["arrived", p])
    return pd.DataFrame({"space": g["space"].iloc[0], "bucket": int(g["bucket"].iloc[0]), "bit": pd.Series(codes, dtype="int64"), "period": pd.Series(at, dtype="object")})


def orphans(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, kind, period): each reference that fails; refs and keys as made above.

    kind: missing, if no record has the key; else late, if its first arrival is after the reference's; else deleted, if its
    deletion is at or before the reference's arrival. An empty string is a key. A reference without a time can only be missing, and
    its period is null; a record without a time has always been there.
    """
    refs, keys = cut(refs.withColumn("period", F.coalesce(_month("at"), F.lit(ALWAYS)))), cut(keys)
    used = cut(refs.select("space", "key", "period").distinct())
    words = keys.select("space", "key").unionByName(used.select("space", "key")).distinct()
    words = written(words.repartitionByRange("space", "key").withColumn("code", F.monotonically_increasing_id()), "dictionary")
    arrived = keys.select("space", "key", F.lit("arrived").alias("kind"), F.coalesce(_month("first"), F.lit(ALWAYS)).alias("period"))
    gone = keys.where("gone IS NOT NULL").select("space", "key", F.lit("deleted").alias("kind"), _month("gone").alias("period"))
    bits = used.withColumn("kind", F.lit("reference")).unionByName(arrived).unionByName(gone).join(words, ["space", "key"])
    # a key is once in a map, and a map has at most RANGE keys
    maps = bits.groupBy("space", F.bitmap_bucket_number("code").alias("bucket"), "kind", "period").agg(F.collect_list(F.bitmap_bit_position("code").cast("int")).alias("bits"))
    maps = maps.mapInArrow(_pack, "space string, bucket long, kind string, period string, bits binary")
    bad = maps.groupBy("space", "bucket").applyInPandas(_suspects, "space string, bucket long, bit long, period string")
    back = words.withColumns({"bucket": F.bitmap_bucket_number("code"), "bit": F.bitmap_bit_position("code")})
    keyed = cut(bad.join(back, ["space", "bucket", "bit"]).select("space", "key", "period"))
    rows = hot_join(refs, keyed, ["space", "key", "period"], "left_semi")
    rows = hot_join(rows, keys.withColumn("known", F.lit(True)), ["space", "key"], "left")
    kind = F.when(F.col("known").isNull(), "missing").when(F.col("first") > F.col("at"), "late").when(F.col("gone") <= F.col("at"), "deleted")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("table_name", "row_id", "field_name", "kind", F.nullif("period", F.lit(ALWAYS)).alias("period"))
