"""Running sums and positions in an order, without a group ever being one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgraph.session import cut


def before(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "before") -> DataFrame:
    """df with out: the sum of value over the rows of the same group that come earlier in the order, 0 for its first. Null keys are a group.

    The order should be strict within a group; null and NaN orders come where Spark sorts them. Rows are range-partitioned by group and order, so a
    group of a third of all rows spans many partitions; sums run within each part of a group, and over the few totals that a
    group has a partition.
    """
    # the partition of a row is kept, since another run's ranges could differ
    d = cut(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = d.groupBy(*by, "_part").agg(F.sum(value).alias("_t"))
    held = totals.withColumn("_earlier", earlier(Window.partitionBy(*by).orderBy("_part"), "_t")).drop("_t")
    held = held.withColumnsRenamed({c: f"_{c}" for c in [*by, "_part"]})
    same = d["_part"] == held["__part"]
    for c in by:
        same = same & d[c].eqNullSafe(held[f"_{c}"])
    inside = d.withColumn("_inside", earlier(Window.partitionBy(*by, "_part").orderBy(*order), value))
    return inside.join(held, same).withColumn(out, F.col("_inside") + F.col("_earlier")).select(*df.columns, out)
