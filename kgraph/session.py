"""Session helpers: the shared checkpoint folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size stays under this bound.
BROADCAST_BYTES = 16 << 20
#: Rows that one task of a loop's round takes.
ROWS_A_TASK = 50_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only on a local master that names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="kgraph-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably in the shared folder, so that lineage ends here and a lost executor costs nothing upstream.

    A checkpoint keeps the size that the planner had estimated for its plan. In a loop of joins these estimates multiply, until
    planning itself takes minutes, so the rows are taken up without them; adaptive execution sees the real sizes.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def cut_counting(df: DataFrame, those: Column) -> tuple[DataFrame, int]:
    """`cut`, and how many of the rows fulfil a condition, counted while they're written instead of by another job."""
    seen = Observation()
    done = cut(df.observe(seen, F.count_if(those).alias("n")))
    return done, seen.get["n"]


@contextmanager
def rounds(spark: SparkSession, rows: int):
    """For the eager rounds of a loop over tables of about `rows` rows: one job a round, with partitions to fit the rows.

    Adaptive execution runs every shuffle and broadcast of a plan as a job of its own, which for hundreds of small plans costs more than
    they do. The settings are the session's and are put back; they change no result, only plans made meanwhile.
    """
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], str(max(2, min(int(old[names[1]]), -(-rows // ROWS_A_TASK)))))
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: columnar, with file statistics for the planner."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/kgraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_plain(df: DataFrame, bytes_per_row: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the counted rows fit the bound; beyond it the planner's shuffle join applies."""
    return F.broadcast(df) if df.count() * bytes_per_row <= bound else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that don't share the driver's path; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="kgraph-code-"), "kgraph.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join("kgraph", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
