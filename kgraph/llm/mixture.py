"""Mixing sources to target weights (problem 8): balanced sampling by the cube method.

A source's factor is how often its tokens are needed. Its whole part are full copies of every document; the fraction is an
inclusion probability, equal for the documents of a source, that the cube method turns into a choice: probabilities move
inside the null space of the constraints (tokens, and number of documents) until each is 0 or 1. That is done in blocks
of a bounded number of documents; the two or fewer that a block leaves undecided go on, with their probabilities, into the
next round's blocks, until a source has one block. Only its last one or two documents break the balance (landing).

A long document would make that landing coarse. Documents are therefore decided in tiers by their share of what their source
contributes (TIERS), longest first; after each tier the probability of the source's shorter documents moves so that the tokens still add
up, and only short documents are left to land at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.llm.bpe import BYTE_BPE_50K
from kgraph.llm.consensus import spelled
from kgraph.llm.tokens import counted
from kgraph.session import cut

BLOCK = 2000
#: Least share of its source's contributed tokens of the documents of each tier; the last tier has the rest.
TIERS = (0.1, 0.02, 0.004, 0.0)


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities p moved to 0 or 1 with p @ x kept.

    x are columns of constraints (a sum to be kept each). At most as many as constraints stay between 0 and 1.
    """
    p = p.copy()
    eps = 1e-9
    q = x.shape[1]
    todo = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    hand, at = todo[: q + 1], q + 1
    while len(hand) == q + 1:
        a = x[hand].T
        u = np.linalg.svd(a, full_matrices=True)[2][-1]
        v = p[hand]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 1e-14, (1 - v) / u, np.where(u < -1e-14, -v / u, np.inf)))
            down = np.min(np.where(u > 1e-14, v / u, np.where(u < -1e-14, (v - 1) / u, np.inf)))
        p[hand] = v + (up if rng.random() * (up + down) < down else -down) * u
        hand = [i for i in hand if eps < p[i] < 1 - eps]
        while len(hand) < q + 1 and at < len(todo):
            hand.append(todo[at])
            at += 1
    return np.where(p <= eps, 0.0, np.where(p >= 1 - eps, 1.0, p))


def landing(p: np.ndarray, x: np.ndarray, down: float = np.inf, up: float = np.inf) -> np.ndarray:
    """The 0/1 choice for the few that are left whose sums of x come nearest to those of p, in shares of each sum.

    The last sum may fall short by `down` and go over by `up` without harm, since others make up for it: choices within come
    first.
    """
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    want = p[left] @ x[left]
    scale = np.maximum(np.abs(x[left]).sum(0), 1e-9)

    def cost(b):
        off = np.array([(b >> k) & 1 for k in range(len(left))]) @ x[left] - want
        return max(0.0, off[-1] - up, -off[-1] - down), float((np.abs(off) / scale).sum()), b

    best = min(range(1 << len(left)), key=cost)
    p = p.copy()
    p[left] = [(best >> k) & 1 for k in range(len(left))]
    return p


def _block(last: bool, seed: int):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["p", "size", "id"], ascending=[True, False, True])
        rng = np.random.default_rng([seed, int(key[1]), len(g)])
        x = np.stack([np.ones(len(g)), g["size"].to_numpy(float)], 1)
        p = flight(g["p"].to_numpy(float), x, rng)
        if last:
            p = landing(p, x, float(g["down"].iloc[0]), float(g["up"].iloc[0]))
        return g.drop(columns=["block"]).assign(p=p)

    return run


def balanced(units: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(id, source, size, p, down, up) with 0 <= p <= 1 -> the same rows with p 0 or 1, sums of size and of 1 kept by source.

    Blocks are by hash of the id, about `block` rows each whatever the source's share of all rows. down and up, of a
    source, are what its tokens may fall short or go over at landing.
    """
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done, open_ = units.where("p <= 0 OR p >= 1"), units.where("p > 0 AND p < 1")
    turn = 0
    while True:
        sizes = cut(open_.groupBy("source").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
        most = sizes.agg(F.max("blocks")).first()[0]
        if not most:
            return done
        d = open_.join(F.broadcast(sizes), "source").withColumn("block", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("blocks"))).drop("blocks")
        # a fixed number of parts: a block costs far more than the bytes that adaptive coalescing goes by
        moved = cut(d.repartition(parts, "source", "block").groupBy("source", "block").applyInPandas(_block(most == 1, seed + turn), spec))
        done = done.unionByName(moved.where("p <= 0 OR p >= 1").select(done.columns))
        open_ = moved.where("p > 0 AND p < 1").select(done.columns)
        turn += 1


def chosen(units: DataFrame, p: dict[str, float], given: dict[str, float], seed: int = 7) -> DataFrame:
    """units (id, source, size) -> (id, source, size, p) with p 0 or 1, decided tier by tier.

    p is the inclusion probability of a source's documents, given the tokens that it contributes. Of every tier only sums come to
    the driver, a row a source.
    """
    spark = units.sparkSession
    table = lambda rows, spec: F.broadcast(spark.createDataFrame(rows, spec))  # noqa: E731 -- at most a row a source
    if not p:
        return units.withColumn("p", F.lit(0.0)).limit(0)
    share = F.col("size") / F.col("given")
    tier = F.lit(len(TIERS) - 1)
    for k in range(len(TIERS) - 2, -1, -1):
        tier = F.when(share > TIERS[k], k).otherwise(tier)
    d = cut(units.join(table(list(given.items()), "source string, given double"), "source").select("id", "source", "size", tier.alias("tier")))
    held = {(r["source"], r["tier"]): float(r["s"]) for r in d.groupBy("source", "tier").agg(F.sum("size").alias("s")).collect()}
    below = {x: sum(v for (y, _), v in held.items() if y == x) for x in p}
    p, out = dict(p), None
    for k in sorted({t for _, t in held}):
        here = sorted(x for x in p if (x, k) in held)
        for x in here:
            below[x] -= held[x, k]
        rows = table([(x, p[x], (1 - p[x]) * below[x], p[x] * below[x]) for x in here], "source string, p double, down double, up double")
        done = balanced(d.where(F.col("tier") == k).join(rows, "source").select("id", "source", "size", "p", "down", "up"), seed).select("id", "source", "size", "p")
        if any(below.values()):
            done = cut(done)
            taken = {r["source"]: r["t"] for r in done.groupBy("source").agg(F.sum(F.col("p") * F.col("size")).alias("t")).collect()}
            for x in here:
                if below[x]:
                    p[x] = min(1.0, max(0.0, p[x] + (p[x] * held[x, k] - taken[x]) / below[x]))
        out = done if out is None else out.unionByName(done)
    return out


def plan(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = BYTE_BPE_50K, seed: int = 7, most_targets: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    copies (id, source, n_tokens, copies): every document that is used and how often, at most its source's max_repeats.
    report (source, target_share, max_repeats, documents, tokens, used_documents, used_tokens, actual_share, factor): one
    row a target.

    Sources are compared in one spelling (lower case, one underscore between words). The total is the largest that
    no source's cap forbids: the minimum over sources of max_repeats * tokens / share. A target without any tokens can
    contribute nothing and doesn't limit the total; its share of the result is 0, and the others keep their proportions.
    Documents of other or null sources and documents without tokens aren't used. A null or non-positive share or cap makes a
    target that isn't used. Of repeated targets of a source the largest (share, cap) counts. No usable target: no copies.
    The targets go to every worker, so there must be at most most_targets of them, else ValueError.
    """
    t = targets.select(spelled(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    aims = [r.asDict() for r in t.limit(most_targets + 1).collect()]
    if len(aims) > most_targets:
        raise ValueError(f"over {most_targets} targets")
    spark = docs.sparkSession
    small = lambda rows, spec: F.broadcast(spark.createDataFrame(rows, spec))  # noqa: E731 -- at most a row a target
    used = [a["source"] for a in aims if (a["target_share"] or 0) > 0 and (a["max_repeats"] or 0) > 0]
    d = docs.select(F.col(id_col).alias("id"), spelled(F.col(source_col)).alias("source"), F.col(text_col).cast("string").alias("text"))
    d = d.join(small([(x,) for x in used], "source string"), "source", "left_semi")
    d = cut(counted(d, "text", path, "size"))
    have = {r["source"]: (r["n"], r["s"]) for r in d.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()}
    live = [a for a in aims if a["source"] in used and have.get(a["source"], (0, 0))[1]]
    total = min((a["max_repeats"] * have[a["source"]][1] / a["target_share"] for a in live), default=0)
    factor = {a["source"]: min(float(a["max_repeats"]), a["target_share"] * total / have[a["source"]][1]) for a in live}
    whole = {s: int(np.floor(f + 1e-9)) for s, f in factor.items()}
    picked = chosen(d.where("size > 0").select("id", "source", "size"), {x: max(0.0, f - whole[x]) for x, f in factor.items()}, {x: f * have[x][1] for x, f in factor.items()}, seed)
    how = small(list(whole.items()), "source string, full int")
    copies = cut(picked.join(how, "source").select("id", "source", F.col("size").alias("n_tokens"), (F.col("full") + F.col("p").cast("int")).alias("copies")).where("copies > 0"))
    got = copies.groupBy("source").agg(F.count("*").alias("used_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    rows = [(a["source"], a["target_share"], a["max_repeats"], *have.get(a["source"], (0, 0)), factor.get(a["source"], 0.0)) for a in aims]
    left = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, documents long, tokens long, factor double")
    report = left.join(got, "source", "left").fillna(0, ["used_documents", "used_tokens"])
    sum_ = copies.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all_tokens"))
    report = report.join(F.broadcast(sum_)).select("source", "target_share", "max_repeats", "documents", "tokens", "used_documents", "used_tokens", F.coalesce(F.try_divide(F.col("used_tokens"), F.col("all_tokens")), F.lit(0.0)).alias("actual_share"), "factor")
    return copies.withColumnRenamed("id", id_col), report
