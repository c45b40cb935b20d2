"""Groups from pairs (problem 3): hash-to-min over rows (vertex, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.operators.skew import LEAST_HOT, hot_join
from kgraph.session import cut, cut_counting, rounds

#: Hexadecimal digits of a hash before an id; ids of one hash follow each other in their own order.
DIGITS = 7


def groups(pairs: DataFrame, left: str, right: str, group: str = "group_id", member: str = "member_id", least_hot: int = LEAST_HOT) -> DataFrame:
    """(group, member): every id of a pair without nulls, with the smallest id linked to it directly or indirectly.

    A pair with a null on either side is no link and its other side doesn't occur for it; a self pair makes its id
    occur; repeated pairs and either direction count once. Ids are compared as stored, the smallest is by code point.
    No pairs give no rows.

    The minimum that is sent is by a hash of the ids, then by the ids: along a chain of ids in order, clusters of true minima would
    double until a chain of n ids had n * n rows, while in a random order only few ids are minima. The smallest id of a group is
    taken at the end, by one partial minimum a group.

    Each round, every vertex v sends its cluster to the smallest member m of it, and m to every other member. A cluster is
    never one value: it's the rows (v, member), and a round is one partial minimum a vertex and two rows for each row. Vertices of
    more than least_hot rows are joined by broadcast where their rows lie, at most 1,000 of them; each has over a thousandth of
    all rows or shares its task with others like it. A row whose two ends have different minima crosses; what no row crosses is
    stable, leaves with its minimum as its group, and isn't sent again. Rounds end when nothing crosses, after about log(longest chain).
    """
    hashed = lambda c: F.concat(F.lpad(F.hex(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(16**DIGITS))), DIGITS, "0"), F.col(c).cast("string"))
    e = pairs.select(hashed(left).alias("v"), hashed(right).alias("u")).where("v IS NOT NULL AND u IS NOT NULL")
    ends = F.array(F.struct(F.col("v").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct(F.col("v").alias("v"), F.col("v").alias("u")), F.struct(F.col("u").alias("v"), F.col("u").alias("u")))
    rows, n = cut_counting(e.select(F.inline(ends)).distinct(), F.lit(True))
    out = None
    while True:
        with rounds(pairs.sparkSession, n):
            low, many = cut_counting(rows.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), F.col("n") > least_hot)
            # rows go both ways, so what is hot as v is hot as u, and a minimum of many vertices holds them all
            hot = low.where(F.col("n") > least_hot).orderBy(F.desc("n")).limit(1000).select("v").collect() if many else []
            low = low.select("v", "m")
            near = hot_join(rows, low, ["v"], hot=hot)
            far = low.select(F.col("v").alias("u"), F.col("m").alias("m2"))
            touched = hot_join(near, far, ["u"], hot=hot).where("m <> m2").select(F.explode(F.array("m", "m2")).alias("m")).distinct()
            open_, crossing = cut_counting(touched, F.lit(True))
            stable = low if not crossing else hot_join(low, open_, ["m"], "left_anti", hot=hot)
            out = stable if out is None else out.unionByName(stable)
            if not crossing:
                break
            on = hot_join(rows, hot_join(low, open_, ["m"], "left_semi", hot=hot), ["v"], hot=hot)
            sent = on.select(F.inline(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))))
            rows, n = cut_counting(sent.distinct(), F.lit(True))
    found = cut(out.select("m", F.substring("v", DIGITS + 1, 1 << 30).alias("v")))
    least = found.groupBy("m").agg(F.min("v").alias("g"))
    return hot_join(found, least, ["m"]).select(F.col("g").alias(group), F.col("v").alias(member))
