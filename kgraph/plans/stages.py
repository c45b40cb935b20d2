"""Stages with a manifest: a run goes on where it stopped, but only as the same run."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgraph.sources.documents import _exists, write_stage


def run_id(source: str, out: str) -> str:
    """The name of a run: 16 hex digits of the absolute source and output paths."""
    return hashlib.sha256(f"{os.path.abspath(source)}|{os.path.abspath(out)}".encode()).hexdigest()[:16]


class Run:
    """Named stages below a folder; each is written once and read back.

    The manifest row (source, out, model, curriculum) of the first call binds later ones: another value is a ValueError.
    """

    def __init__(self, spark: SparkSession, source: str, out: str, model: str, curriculum: str):
        self.spark, self.out = spark, out
        mine = (source, out, model, curriculum)
        path = f"{out}/manifest"
        if _exists(spark, f"{path}/_SUCCESS"):
            held = tuple(spark.read.parquet(path).first())
            if held != mine:
                raise ValueError(f"the run in {out} was made with {held}, not {mine}")
        else:
            write_stage(spark.createDataFrame([mine], "source string, out string, model string, curriculum string"), path)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows, made only if it wasn't finished before; a half-written stage is made anew."""
        path = f"{self.out}/{name}"
        if not _exists(self.spark, f"{path}/_SUCCESS"):
            write_stage(make(), path)
        return self.spark.read.parquet(path)

    def stages(self, names: list[str], make: Callable[[], tuple[DataFrame, ...]]) -> list[DataFrame]:
        """The several outputs of one step, in the order of names; unless all were finished, all are made anew."""
        if not all(_exists(self.spark, f"{self.out}/{n}/_SUCCESS") for n in names):
            self.clear(names)
            for n, df in zip(names, make(), strict=True):
                write_stage(df, f"{self.out}/{n}")
        return [self.spark.read.parquet(f"{self.out}/{n}") for n in names]

    def clear(self, names: list[str]) -> None:
        """Forget stages, so that they are made again."""
        for n in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{n}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
