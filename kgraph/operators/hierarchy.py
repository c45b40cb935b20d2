"""Parent-child links to hierarchies (problem 4): cycles, nested-set ranges, ancestors and descendants.

Links may give a node several parents. The parent of smallest id makes the node's place in the forest; the others are cross links,
which count for ancestors and descendants. Subtree sizes go upward, each node then takes the range after its earlier
siblings by prefix sums, and whatever is below a node is the range of its own and those of the cross links that it reaches.
No step walks the levels one by one: along chains, pointers are doubled, so rounds grow with the logarithm of the depth; only
nodes with several parents are peeled in waves. What no wave reaches reveals the cycles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgraph.operators.order import before
from kgraph.operators.skew import LEAST_HOT, hot_join, hot_keys
from kgraph.session import cut, cut_counting, rounds

#: Ranges are cut into aligned blocks of at most 2^LEVELS positions.
LEVELS = 10
#: The end of an id that stands in for a link of a node to itself.
SELF = "\0self"


def links(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(parent, child), distinct; rows with a null on either side are no links, an empty string is an id."""
    return df.select(F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("child")).where("parent IS NOT NULL AND child IS NOT NULL").distinct()


def _tops(single: DataFrame) -> DataFrame:
    """single (v, t): the one parent of v. (v, t, open, hops): the nearest ancestor that isn't such a v itself, and how many links
    on it is; open where there is none, which only happens on or behind a cycle of such nodes."""
    spark = single.sparkSession
    known = single.select(F.col("v").alias("t"), F.lit(True).alias("go"))
    j, n = cut_counting(hot_join(single, known, ["t"], "left").select("v", "t", F.coalesce("go", F.lit(False)).alias("open"), F.lit(1).cast("long").alias("hops")), F.col("open"))
    left = None
    while n and n != left:
        left = n
        with rounds(spark, 2 * n):
            for _ in range(2 if n <= LEAST_HOT else 1):
                step = j.select(F.col("v").alias("t"), F.col("t").alias("t2"), F.col("open").alias("o2"), F.col("hops").alias("h2"))
                # n rows can't hold a key of more rows than that
                moved = hot_join(j.where("open"), step, ["t"], hot=[] if n <= LEAST_HOT else None).select("v", F.col("t2").alias("t"), F.col("o2").alias("open"), (F.col("hops") + F.col("h2")).alias("hops"))
                j = j.where("NOT open").unionByName(moved)
            j, n = cut_counting(j, F.col("open"))
    return j


def contracted(e: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Links without self links -> the tops of nodes with one parent (`_tops`); the links (a, m, open, hops) into nodes m with several, each
    from the top a of a parent, hops links above m; and how many these are. So long stretches of single parents are one link."""
    kids = cut(e.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("t")))
    tops = _tops(kids.where("n = 1").select(F.col("child").alias("v"), "t"))
    several = hot_join(e, kids.where("n > 1").select("child"), ["child"], "left_semi")
    up = hot_join(several.withColumnRenamed("parent", "v"), tops, ["v"], "left")
    up = up.groupBy(F.coalesce("t", "v").alias("a"), F.col("child").alias("m")).agg(F.max(F.coalesce("open", F.lit(False))).alias("open"), (F.max(F.coalesce("hops", F.lit(0))) + 1).alias("hops"))
    return tops, *cut_counting(up, F.lit(True))


def unprocessed(e: DataFrame) -> DataFrame:
    """(v): nodes on a cycle or behind one, found as those that processing from the roots never reaches.

    e are links without self links. Nodes with one parent take the state of their top; the others are processed in
    waves, each wave once all their parents' tops are.
    """
    return _unreached(*contracted(e))


def _unreached(tops: DataFrame, alive: DataFrame, n: int) -> DataFrame:
    alive = alive.select("a", "m", "open")
    left = None
    while n and n != left:
        left = n
        with rounds(tops.sparkSession, n):
            hot = [] if n <= LEAST_HOT else hot_keys(alive, ["a"])
            for _ in range(2):  # two waves a checkpoint; more would double the plan each time
                waits = alive.select(F.col("m").alias("a")).distinct().withColumn("waits", F.lit(True))
                alive = hot_join(alive, waits, ["a"], "left", hot=hot).where("open OR waits").select("a", "m", "open")
            alive, n = cut_counting(alive, F.lit(True))
    stuck = alive.select(F.col("m").alias("v")).distinct()
    behind = tops.where("open").select("v").unionByName(hot_join(tops.where("NOT open").select(F.col("t"), "v"), stuck.withColumnRenamed("v", "t"), ["t"], "left_semi").select("v"))
    return stuck.unionByName(behind).distinct()


def _strides(e: DataFrame, levels: int = 8) -> DataFrame:
    """e with links from a node to those 2, 4, 8, ... links on, along stretches where each node has one parent or one child.

    They change nothing about what reaches what, but let labels pass a long stretch in few rounds; what is longer than
    2^levels takes more rounds, with the same result. Distinct over both sides, at most 2 * levels links a node.
    """
    up = e.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("t")).where("n = 1").select(F.lit(True).alias("up"), F.col("child").alias("v"), "t")
    on = e.groupBy("parent").agg(F.count("*").alias("n"), F.min("child").alias("t")).where("n = 1").select(F.lit(False).alias("up"), F.col("parent").alias("v"), "t")
    j, n = cut_counting(up.unionByName(on), F.lit(True))
    out = e
    for _ in range(min(levels, max(0, n.bit_length() - 1))):
        with rounds(e.sparkSession, n):
            step = j.select("up", F.col("v").alias("t"), F.col("t").alias("t2"))
            j, n = cut_counting(hot_join(j, step, ["up", "t"], hot=[] if n <= LEAST_HOT else None).select("up", "v", F.col("t2").alias("t")), F.lit(True))
        out = out.unionByName(j.select(F.when(F.col("up"), F.col("t")).otherwise(F.col("v")).alias("parent"), F.when(F.col("up"), F.col("v")).otherwise(F.col("t")).alias("child")))
    return out.where("parent <> child").distinct()


def _labels(e: DataFrame, n: int) -> DataFrame:
    """(v, f, b): the smallest id that v reaches and the smallest that reaches v, itself included; e has n links.

    A label is a node that is reached, so its own label is taken over too: distances double in each round. Both kinds of
    label are rows of one table (down, v, l), so a round is one pass.
    """
    ways = F.array(F.struct(F.lit(True).alias("down"), F.col("parent").alias("v"), F.col("child").alias("u")), F.struct(F.lit(False).alias("down"), F.col("child").alias("v"), F.col("parent").alias("u")))
    spark, few = e.sparkSession, 2 * n <= LEAST_HOT
    with rounds(spark, 2 * n):
        way = cut(e.select(F.inline(ways)))
        lab = cut(way.select("down", "v", F.col("v").alias("l")).distinct())
        hot = [] if few else hot_keys(way, ["down", "u"])
        moved = 1
        while moved:
            for _ in range(2 if few else 1):
                near = hot_join(way, lab.withColumnRenamed("v", "u"), ["down", "u"], hot=hot).select("down", "v", "l")
                far = hot_join(lab, lab.select("down", F.col("v").alias("l"), F.col("l").alias("m")), ["down", "l"], hot=[] if few else None).select("down", "v", F.col("m").alias("l"))
                every = lab.select("down", "v", "l", F.col("l").alias("old")).unionByName(near.unionByName(far).withColumn("old", F.lit(None).cast("string")))
                now = every.groupBy("down", "v").agg(F.min("l").alias("l"), F.min("old").alias("old"))
                lab = now.select("down", "v", "l")
            now, moved = cut_counting(now, F.col("l") < F.col("old"))
            lab = now.select("down", "v", "l")
        return cut(lab.groupBy("v").agg(F.min(F.when(F.col("down"), F.col("l"))).alias("f"), F.min(F.when(~F.col("down"), F.col("l"))).alias("b")))


def _cycles(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cycle_id, node) of every node on a cycle of `links`, and (v) of every node on a cycle or behind one."""
    # a link of a node to itself is a cycle with a node that no table has
    made = F.concat("child", F.lit(SELF))
    own = whole.where("parent = child").select(F.inline(F.array(F.struct(F.col("parent").alias("parent"), made.alias("child")), F.struct(made.alias("parent"), F.col("child").alias("child")))))
    e = cut(whole.where("parent <> child").unionByName(own))
    odd, some = cut_counting(unprocessed(e), F.lit(True))
    none = odd.select(F.col("v").alias("cycle_id"), F.col("v").alias("node"))
    if not some:
        return none, odd
    e = hot_join(hot_join(e.withColumnRenamed("child", "v"), odd, ["v"], "left_semi").withColumnsRenamed({"v": "child", "parent": "v"}), odd, ["v"], "left_semi").withColumnRenamed("v", "parent")
    # strides are links between nodes that reach each other in the whole, so they hold in every later part of it too
    e, n = cut_counting(_strides(cut(e)), F.lit(True))
    found = None
    while n:
        lab = _labels(e, n)
        part = lab.where("f = b").select(F.col("f").alias("cycle_id"), F.col("v").alias("node"))
        found = part if found is None else found.unionByName(part)
        with rounds(e.sparkSession, n):
            # links between nodes of different labels can't be on a cycle
            for end in ("parent", "child"):
                e = hot_join(e, lab.where("f <> b").select(F.col("v").alias(end), F.struct("f", "b").alias(f"{end}_label")), [end], hot=[] if n <= LEAST_HOT else None)
            e, n = cut_counting(e.where("parent_label = child_label").select("parent", "child"), F.lit(True))
    real = found.groupBy("cycle_id").agg(F.count("*").alias("n")).where("n > 1").select("cycle_id")
    keep = ~F.endswith("v", F.lit(SELF))
    return cut(hot_join(found, real, ["cycle_id"], "left_semi").where(~F.endswith("node", F.lit(SELF)))), odd.where(keep)


def cycles(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(cycle_id, node): every id on a cycle of links, with the smallest id that it reaches and is reached from.

    A link of an id to itself is a cycle. Nulls make no link; ids needn't occur in any other table; no links, no rows.
    Unprocessed nodes are split exactly: ids whose smallest reached and smallest reaching id agree form one component; then
    links between ids of different labels can't be on a cycle and go, and the rest is labelled again.
    """
    return _cycles(links(df, child, parent))[0]


def chain_lengths(e: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((v, length), (v) left out): nodes on the longest chain of links that ends at v, for the nodes (one column) that are on no
    cycle and below none. e (parent, child), distinct, without self links, between nodes.

    Lengths pass over `contracted` links, so rounds grow with the depth of nodes with several parents, not with that of chains.
    """
    tops, up, n = contracted(e)
    odd = cut(_unreached(tops, up, n))
    bad = odd.withColumnRenamed("v", "m")
    up, n = cut_counting(hot_join(up, bad, ["m"], "left_anti").select("a", "m", "hops"), F.lit(True))
    # a top that isn't such an m is a root, of length 1
    best = cut(up.groupBy(F.col("m").alias("v")).agg(F.max(F.col("hops") + 1).alias("length")))
    grew = n
    with rounds(e.sparkSession, n):
        hot = [] if n <= LEAST_HOT else hot_keys(up, ["a"])
        while grew:
            sent = hot_join(up, best.withColumnRenamed("v", "a"), ["a"], hot=hot).groupBy(F.col("m").alias("v")).agg(F.max(F.col("length") + F.col("hops")).alias("more"))
            now = best.join(sent, "v", "left").select("v", F.greatest("length", F.coalesce("more", "length")).alias("length"), F.coalesce(F.col("more") > F.col("length"), F.lit(False)).alias("grew"))
            now, grew = cut_counting(now, F.col("grew"))
            best = now.select("v", "length")
    whole = nodes.toDF("v").distinct().join(odd, "v", "left_anti")
    below = hot_join(tops.where("NOT open").select("v", "t", "hops"), best.select(F.col("v").alias("t"), "length"), ["t"], "left").select("v", (F.col("hops") + F.coalesce("length", F.lit(1))).alias("chained"))
    rows = whole.join(best, "v", "left").join(below, "v", "left").select("v", F.coalesce("length", "chained", F.lit(1)).cast("int").alias("length"))
    return rows, odd


def cycle_paths(df: DataFrame, child: str, parent: str, members: DataFrame) -> DataFrame:
    """(cycle_id, path): of every set of `cycles` (members) one cycle, as an array of ids from parent to child, from its smallest id on.

    Each node goes on to its smallest child within the set; whoever follows that has to come round. What is left of a set after more
    steps than it has nodes is on such a cycle; of these the one with the smallest id is taken. Steps are doubled.
    """
    m = members.select("cycle_id", F.col("node").alias("v"))
    e = links(df, child, parent)
    inner = hot_join(hot_join(e.withColumnRenamed("parent", "v"), m, ["v"]).withColumnsRenamed({"v": "parent", "child": "v", "cycle_id": "c"}), m, ["v"]).where("c = cycle_id")
    step, n = cut_counting(inner.groupBy("cycle_id", F.col("parent").alias("v")).agg(F.min("v").alias("next")), F.lit(True))
    far, k = step.select("v", F.col("next").alias("t")), 1
    with rounds(df.sparkSession, n):
        while k <= n:
            up = far.select(F.col("v").alias("t"), F.col("t").alias("t2"))
            far, k = cut(hot_join(far, up, ["t"], hot=[] if n <= LEAST_HOT else None).select("v", F.col("t2").alias("t"))), 2 * k
    on = cut(hot_join(step, far.select(F.col("t").alias("v")).distinct(), ["v"], "left_semi"))
    # the smallest id of every such cycle, by doubling once more; one with its own smallest id is a start
    seen, k = cut(on.select("cycle_id", "v", F.col("next").alias("t"), F.least("v", "next").alias("low"))), 1
    with rounds(df.sparkSession, n):
        while k <= n:
            up = seen.select(F.col("v").alias("t"), F.col("t").alias("t2"), F.col("low").alias("low2"))
            seen, k = cut(seen.join(up, "t").select("cycle_id", "v", F.col("t2").alias("t"), F.least("low", "low2").alias("low"))), 2 * k
        start = seen.groupBy("cycle_id").agg(F.min("low").alias("low"))
        mine = cut(seen.join(start, ["cycle_id", "low"]).select("cycle_id", "low", "v").join(on.select("v", "next"), "v"))
        # the way back to the start as arrays; a start's own is the whole way round
        w = mine.select("cycle_id", "low", "v", F.when(F.col("next") != F.col("low"), F.col("next")).alias("j"), F.array("v").alias("path"))
        w, open_ = cut_counting(w, F.col("j").isNotNull())
        while open_:
            up = w.select(F.col("v").alias("j"), F.col("j").alias("j2"), F.col("path").alias("more"))
            w2 = w.join(up, "j", "left").select("cycle_id", "low", "v", F.col("j2").alias("j"), F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"))
            w, open_ = cut_counting(w2, F.col("j").isNotNull())
    return w.where("v = low").select("cycle_id", "path")


@dataclass(frozen=True)
class Hierarchy:
    """links (parent, child), acyclic, with each cycle as one node; members (node, v, status): v stands for node in the links, the
    cycle_id for an id on a cycle, else the id itself; status is tree, cycle, or behind (below one).

    sets (v, parent, root, depth, path, lft, rgt, weight): one row a v. Of several parents the smallest counts; path is an array
    of ids; positions run through the whole forest, a v takes as many as it has members, and all that is below it in the forest
    takes (lft + weight - 1, rgt].
    """

    links: DataFrame
    members: DataFrame
    sets: DataFrame


def _forest(tree: DataFrame) -> DataFrame:
    """tree (v, p, weight), p null at a root -> the sets of a `Hierarchy`. Siblings are in the order of their ids.

    Sizes go upward: the nodes within distance 2^k below v are summed from the 2^k-th ancestors. Offsets are prefix sums of
    siblings' sizes (`order.before`), then summed downward by doubling.
    """
    spark = tree.sparkSession
    s, n = cut_counting(tree.select("v", F.col("p").alias("j"), F.col("weight").cast("long").alias("size")), F.lit(True))
    rows, open_ = n, 1
    with rounds(spark, rows):
        while open_:
            below = s.where("j IS NOT NULL").groupBy(F.col("j").alias("v")).agg(F.sum("size").alias("more"))
            up = s.select(F.col("v").alias("j"), F.col("j").alias("j2"))
            s2 = hot_join(s, up, ["j"], "left", hot=[] if rows <= LEAST_HOT else None).select("v", F.col("j2").alias("j"), "size")
            s, open_ = cut_counting(s2.join(below, "v", "left").select("v", "j", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), F.col("j").isNotNull())
    placed = before(tree.join(s.select("v", "size"), "v"), ["p"], ["v"], "size")
    # below its parent, a node's offset is its parent's own positions and all earlier siblings' sizes
    own = tree.select(F.col("v").alias("p"), F.col("weight").alias("above"))
    placed = hot_join(placed, own, ["p"], "left")
    w, open_ = cut_counting(placed.select("v", "p", "size", "weight", F.col("p").alias("j"), (F.col("before") + F.coalesce("above", F.lit(1))).alias("lft"), F.array("v").alias("path")), F.col("j").isNotNull())
    with rounds(spark, rows):
        while open_:
            up = w.select(F.col("v").alias("j"), F.col("j").alias("j2"), F.col("lft").alias("l2"), F.col("path").alias("s2"))
            w2 = hot_join(w, up, ["j"], "left", hot=[] if rows <= LEAST_HOT else None)
            w, open_ = cut_counting(w2.select("v", "p", "size", "weight", F.col("j2").alias("j"), (F.col("lft") + F.coalesce("l2", F.lit(0))).alias("lft"), F.when(F.col("s2").isNull(), F.col("path")).otherwise(F.concat("s2", "path")).alias("path")), F.col("j").isNotNull())
    return w.select("v", F.col("p").alias("parent"), F.col("path")[0].alias("root"), (F.size("path") - 1).alias("depth"), "path", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), "weight")


def hierarchy(df: DataFrame, child: str, parent: str, nodes: DataFrame | None = None) -> Hierarchy:
    """The `Hierarchy` of the links of df; nodes adds ids without links (one column). Links inside a cycle are left out; all others
    stay, so whatever is above or below a cycle keeps its place. Ids are never taken apart, whatever characters they have."""
    whole = cut(links(df, child, parent))
    ids = whole.select(F.explode(F.array("parent", "child")).alias("node"))
    if nodes is not None:
        ids = ids.unionByName(nodes.toDF("node").select(F.col("node").cast("string")).where("node IS NOT NULL"))
    loops, odd = _cycles(whole)
    members = ids.distinct().join(loops, "node", "left").join(odd.select(F.col("v").alias("node"), F.lit(True).alias("odd")), "node", "left")
    status = F.when(F.col("cycle_id").isNotNull(), "cycle").when(F.col("odd"), "behind").otherwise("tree")
    members = cut(members.select("node", F.coalesce("cycle_id", "node").alias("v"), status.alias("status")))
    stands = loops.select(F.col("node").alias("child"), F.col("cycle_id").alias("c"))
    e = hot_join(whole, stands, ["child"], "left").select("parent", F.coalesce("c", "child").alias("child"))
    e = hot_join(e, stands.toDF("parent", "c"), ["parent"], "left").select(F.coalesce("c", "parent").alias("parent"), "child")
    e = cut(e.where("parent <> child").distinct())
    first = e.groupBy(F.col("child").alias("v")).agg(F.min("parent").alias("p"))
    tree = members.groupBy("v").agg(F.count("*").alias("weight")).join(first, "v", "left")
    return Hierarchy(e, members, _forest(cut(tree.select("v", "p", "weight"))))


def _blocks(low: Column, high: Column) -> Column:
    """The aligned blocks (level, number) that make up the positions low to high - 1, of at most 2^LEVELS positions each."""
    edges = []
    for k in range(LEVELS):
        lo, hi = F.shiftright(low + F.lit((1 << k) - 1), k), F.shiftright(high, k)
        block = lambda at, k=k: F.struct(F.lit(k).alias("level"), at.cast("long").alias("number"))
        edges += [F.when((lo < hi) & (lo % 2 == 1), block(lo)), F.when((lo < hi) & (hi % 2 == 1), block(hi - 1))]
    lo, hi = F.shiftright(low + F.lit((1 << LEVELS) - 1), LEVELS), F.shiftright(high, LEVELS)
    top = F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda x: F.struct(F.lit(LEVELS).alias("level"), x.cast("long").alias("number"))))
    return F.concat(F.filter(F.array(*edges), lambda x: x.isNotNull()), F.coalesce(top, F.array().cast("array<struct<level:int,number:bigint>>")))


def stabbed(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """ranges (lo, hi, ...) and points (at, ...) -> the other columns of each pair with lo <= at <= hi, once a pair.

    An equi-join on aligned blocks: a range is a few of them at its ends and large ones between, a point is in one of every
    level. All that meet belong together, so the join does no work but its output. Blocks have a bounded number of positions, so
    a range over a third of all points is as many keys as it has blocks.
    """
    a = ranges.where("lo <= hi").withColumn("_block", F.explode(_blocks(F.col("lo"), F.col("hi") + 1))).drop("lo", "hi")
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("at", k).cast("long").alias("number")) for k in range(LEVELS + 1)])
    return a.join(points.withColumn("_block", F.explode(levels)).drop("at"), "_block").drop("_block")


def below(h: Hierarchy, starts: DataFrame | None = None) -> DataFrame:
    """(a, lo, hi): for every v (or those of starts, one column) the positions of all that is below it over all links, as
    ranges without overlap.

    Within the forest that is a node's own range. A cross link (p, c) adds c's range to all that are above p; the closure is taken among
    cross links only, by doubling. Of ranges inside each other the outer counts.
    """
    s = h.sets
    cross = h.links.join(s.select(F.col("v").alias("child"), F.col("parent").alias("first")), "child").where("parent <> first").select(F.col("parent").alias("p"), F.col("child").alias("c"))
    cross, n = cut_counting(cross, F.lit(True))
    own = s.select(F.col("v").alias("a"), (F.col("lft") + F.col("weight")).alias("lo"), F.col("rgt").alias("hi"))
    if starts is not None:
        own = own.join(starts.toDF("a").distinct(), "a", "left_semi")
    if not n:
        return own.where("lo <= hi")
    # every start or cross child a that is at or above the parent p of a cross link
    ends = cross.select(F.col("p").alias("v")).distinct().join(s.select("v", F.col("lft").alias("at")), "v")
    want = s.select(F.col("v").alias("a"), F.col("lft").alias("lo"), F.col("rgt").alias("hi"))
    heads = cross.select(F.col("c").alias("a")).distinct()
    if starts is not None:
        want = want.join(starts.toDF("a").unionByName(heads).distinct(), "a", "left_semi")
    above = cut(stabbed(want, ends).withColumnRenamed("v", "p").join(cross, "p").select("a", "c").distinct())
    k, n = cut_counting(above.join(heads, "a", "left_semi"), F.lit(True))
    left = None
    while n and n != left:
        left = n
        k, n = cut_counting(k.unionByName(k.select("a", F.col("c").alias("m")).join(k.select(F.col("a").alias("m"), "c"), "m").select("a", "c")).distinct(), F.lit(True))
    mine = above if starts is None else above.join(starts.toDF("a").distinct(), "a", "left_semi")
    reach = mine.unionByName(mine.select("a", F.col("c").alias("m")).join(k.select(F.col("a").alias("m"), "c"), "m").select("a", "c")).distinct()
    far = reach.join(s.select(F.col("v").alias("c"), F.col("lft").alias("lo"), F.col("rgt").alias("hi")), "c")
    # what lies in the own range is there already
    far = far.join(own.toDF("a", "lo0", "hi0"), "a").where("NOT (lo >= lo0 AND hi <= hi0)").select("a", "lo", "hi")
    w = Window.partitionBy("a").orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    outer = own.where("lo <= hi").unionByName(far).withColumn("upto", F.max("hi").over(w))
    return outer.where("upto IS NULL OR hi > upto").select("a", "lo", "hi")


def descendants(h: Hierarchy, starts: DataFrame | None = None) -> DataFrame:
    """(ancestor, descendant): all pairs of v over all links, or those of some ancestors (one column)."""
    return stabbed(below(h, starts).withColumnRenamed("a", "ancestor"), h.sets.select(F.col("v").alias("descendant"), F.col("lft").alias("at")))


def descendant_counts(h: Hierarchy) -> DataFrame:
    """(v, descendants): how many ids are below, over all links, those of v's own cycle left out; by ranges, not by pairs."""
    return h.sets.select("v").join(below(h).groupBy(F.col("a").alias("v")).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")), "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("descendants"))


def paths(h: Hierarchy) -> DataFrame:
    """(v, path): every path (an array of ids) from a root to each v, over all parents.

    Pieces double in length each round: the piece that starts below a root is continued by all pieces that end at its start.
    Each is the end of at least one whole path, so no round holds more rows than come out; rounds grow with the
    logarithm of the depth.
    """
    start = h.members.select("v").distinct().join(h.links.select(F.col("child").alias("v"), F.col("parent").alias("j")), "v", "left")
    w, open_ = cut_counting(start.select("v", "j", F.array("v").alias("path")), F.col("j").isNotNull())
    while open_:
        up = w.select(F.col("v").alias("j"), F.col("j").alias("j2"), F.col("path").alias("above"))
        longer = w.where("j IS NOT NULL").join(up, "j").select("v", F.col("j2").alias("j"), F.concat("above", "path").alias("path"))
        w, open_ = cut_counting(w.where("j IS NULL").unionByName(longer), F.col("j").isNotNull())
    return w.select("v", "path")
