"""Consensus of annotators (problem 5): latent ability and difficulty, fitted by gradient expectation-maximisation.

Each item has a true label k and an ease b; each annotator a matrix of logits A. A vote j has the probability
softmax over j of b * A[k, j]: the easier the item, the sharper the annotator's own habit, right or wrong, shows. The
matrix lets an annotator be good, careless, fond of one label or set on another order of the labels. The ease is a latent
level on a grid (EASE) with learned weights, so the posterior of an item is a table over labels and levels, and what an annotator
contributes is a fixed-size table of expected counts. An iteration is
  E: votes + log probabilities of their annotators -> one partial sum of L*B numbers an item -> posterior,
  M: votes + posteriors -> one partial sum of L*B numbers an (aspect, annotator, vote) -> gradient ascent on A, one
     group of at most L rows an annotator.
While annotators are few enough to hold, E and M's sums are one pass over items with their votes (`_fit_by_tables`).
Sums are combined before every shuffle, so an item or annotator with a third of the votes is no task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph.session import cut, small_or_plain

#: Levels of ease.
EASE = (0.3, 0.7, 1.0, 1.5)
#: Iterations end once the mean log evidence of an item grows by less than this, or after ROUNDS.
GAIN, ROUNDS = 5e-4, 60


def spelled(c: Column, joint: str = "_") -> Column:
    """Lower case, blanks, hyphens and underscores as one joint, none at the ends; '' becomes null."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", joint)
    return F.when(F.length(s) > 0, s)


def votes_of(log: DataFrame, labels: dict[str, list[str]], target: str = "target", aspect: str = "aspect", votes: str = "votes", at: str = "ingested_at") -> DataFrame:
    """(target, aspect, reviewer, code): one row a reviewer and item, whatever rows and repeats it came in.

    code is the label's index; an unknown or null judgment counts by `approved` alone: -1 for a rejection, which is the
    last label of a three-way aspect, -2 for an approval, which is any label but the last; of a two-way aspect approved is
    the label. null: the vote says nothing, but its item exists. If a reviewer voted an item more than once, the latest
    vote counts; of equally late ones the one with the smallest (judgment, approved). A null reviewer is the reviewer ''.
    Null targets and unknown or null aspects are no items.
    """
    d = log.where(F.col(aspect).isin(*labels) & F.col(target).isNotNull()).select(F.col(target).alias("target"), F.col(aspect).alias("aspect"), F.col(at).alias("at"), F.explode(votes).alias("v")).where("v IS NOT NULL")
    d = d.select("target", "aspect", "at", F.coalesce(spelled(F.col("v.reviewer"), "-"), F.lit("")).alias("reviewer"), spelled(F.col("v.judgment")).alias("judgment"), F.col("v.approved").alias("approved"))
    d = d.groupBy("target", "aspect", "reviewer").agg(F.min_by(F.struct("judgment", "approved"), F.struct(-F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(1 << 62))), "judgment", "approved")).alias("x"))
    code = F.lit(None).cast("int")
    for name, those in labels.items():
        named = F.lit(None).cast("int")
        for k, label in enumerate(those):
            named = F.when(F.col("x.judgment") == label, k).otherwise(named)
        plain = F.when(F.col("x.approved"), 0 if len(those) == 2 else -2).when(~F.col("x.approved"), 1 if len(those) == 2 else -1)
        code = F.when(F.col("aspect") == name, F.coalesce(named, plain)).otherwise(code)
    return d.select("target", "aspect", "reviewer", code.cast("int").alias("code"))


def _log_probabilities(a: np.ndarray) -> np.ndarray:
    """[..., label, level, vote] of annotators with logits a[..., label, vote]."""
    z = a[..., :, None, :] * np.asarray(EASE)[:, None]
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def _fit(counts: np.ndarray, steps: int = 60, prior: float = 0.08, diagonal: float = 1.0) -> np.ndarray:
    """Gradient ascent (a step size a cell) on annotators' logits, from expected counts [..., label, level, vote]."""
    n = counts.shape[-1]
    ease = np.asarray(EASE)
    rest = np.broadcast_to(np.eye(n) * diagonal, (*counts.shape[:-3], n, n))
    a, size, old = rest.copy(), np.full(rest.shape, 0.3), np.zeros(rest.shape)
    total = counts.sum(-1, keepdims=True)
    for _ in range(steps):
        p = np.exp(_log_probabilities(a))
        g = ((counts - total * p) * ease[:, None]).sum(-2) - prior * (a - rest)
        size = np.clip(size * np.where(g * old > 0, 1.2, np.where(g * old < 0, 0.5, 1.0)), 1e-4, 1.0)
        a = a + np.sign(g) * size
        old = g
    return a - a.mean(-1, keepdims=True)


def _cells(labels: int) -> list[str]:
    """Names of the cells of a table over labels and levels."""
    return [f"s{i}" for i in range(labels * len(EASE))]


def _by_code(lp: np.ndarray, labels: int) -> np.ndarray:
    """[..., code + 2, label * level] of log probabilities [..., label, level, vote]; -1 is the last vote, -2 any other."""
    n = lp.shape[-1]
    out = np.zeros((*lp.shape[:-3], n + 2, labels, len(EASE)))
    out[..., 0, :n, :] = np.log(np.exp(lp[..., : n - 1]).sum(-1))
    out[..., 1, :n, :] = lp[..., n - 1]
    out[..., 2:, :n, :] = np.moveaxis(lp, -1, -3)
    return out.reshape(*out.shape[:-2], labels * len(EASE))


def _ability(counts: np.ndarray, lp: np.ndarray) -> np.ndarray:
    """Probability of the right vote on an item of middle ease, weighted by the labels met."""
    n = counts.shape[-1]
    weight = counts.sum((-1, -2)) + 1e-6
    right = np.exp(lp[..., np.arange(n), len(EASE) // 2, np.arange(n)])
    return (weight * right).sum(-1) / weight.sum(-1)


def _annotators(sizes: dict[str, int]):
    """applyInPandas: expected counts of one (aspect, reviewer) -> log probabilities a code, and the reliability."""
    labels = max(sizes.values())
    cols = _cells(labels)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        aspect, reviewer = key
        n = sizes[aspect]
        counts = np.zeros((n, len(EASE), n))
        for row in g.itertuples(index=False):
            if row.code >= 0:
                counts[:, :, int(row.code)] += np.asarray([getattr(row, c) for c in cols]).reshape(labels, len(EASE))[:n]
        lp = _log_probabilities(_fit(counts))
        ability, chance = float(_ability(counts, lp)), 1.0 / n
        cells = _by_code(lp, labels)
        out = [[aspect, reviewer, code, cells[code + 2].tolist(), ability, (ability - chance) / (1 - chance), float(counts.sum())] for code in range(-2, n)]
        return pd.DataFrame(out, columns=["aspect", "reviewer", "code", "lp", "ability", "skill", "votes"])

    return run


_ANNOTATOR_SCHEMA = "aspect string, reviewer string, code int, lp array<double>, ability double, skill double, votes double"


def _posterior(sums: DataFrame, prior: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Item sums s0.. -> normalised posterior q0.. and log evidence; labels that an aspect lacks have none."""
    cells = len(_cells(max(sizes.values())))
    n = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("aspect")]
    d = sums.join(prior, "aspect")
    z = [F.when(F.lit(i // len(EASE)) < n, F.col(f"s{i}") + F.col("lw")[i]).otherwise(F.lit(-1e9)) for i in range(cells)]
    d = d.select("target", "aspect", *[x.alias(f"z{i}") for i, x in enumerate(z)]).withColumn("top", F.greatest(*[F.col(f"z{i}") for i in range(cells)]))
    d = d.select("target", "aspect", "top", *[F.exp(F.col(f"z{i}") - F.col("top")).alias(f"z{i}") for i in range(cells)]).withColumn("sum", sum(F.col(f"z{i}") for i in range(cells)))
    return d.select("target", "aspect", (F.col("top") + F.log("sum")).alias("evidence"), *[(F.col(f"z{i}") / F.col("sum")).alias(f"q{i}") for i in range(cells)])


class _Settled:
    """Tells when the mean log evidence of an item has stopped growing; the first posterior has none."""

    def __init__(self):
        self.last = None

    def __call__(self, evidence: float | None) -> bool:
        done = evidence is not None and self.last is not None and evidence - self.last < GAIN
        self.last = evidence
        return done


def fit(votes: DataFrame, sizes: dict[str, int], rounds: int = ROUNDS, most: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(items with posteriors q0.., annotators) once the evidence has settled (GAIN), from majority shares as the first posterior.

    sizes gives the number of labels of every aspect, any number from two. The iteration is one; how its sums are taken follows from what fits
    the workers' memory: up to `most` annotators (of an aspect), their tables go to the workers and an iteration is one pass over the items with one
    small sum (an item then has at most `most` votes); beyond it the sums are joins. The results are equal to rounding.
    """
    people = [tuple(r) for r in votes.select("aspect", "reviewer").distinct().limit(most + 1).collect()]
    return _fit_by_tables(votes, sizes, rounds, sorted(people)) if len(people) <= most else _fit_by_joins(votes, sizes, rounds)


def _fit_by_tables(votes: DataFrame, sizes: dict[str, int], rounds: int, people: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    spark = votes.sparkSession
    names = list(sizes)
    who = spark.createDataFrame([(a, r, i) for i, (a, r) in enumerate(people)], "aspect string, reviewer string, p int")
    d = votes.join(F.broadcast(who), ["aspect", "reviewer"]).groupBy("target", "aspect").agg(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("p", "code"))).alias("v"))
    at = F.create_map(*[F.lit(x) for k, a in enumerate(names) for x in (a, k)])[F.col("aspect")]
    items = cut(d.select("target", "aspect", at.alias("k"), F.col("v.p").alias("p"), F.col("v.code").alias("code")))
    n_of = np.array([sizes[a] for a in names])
    cells, labels = len(EASE), max(sizes.values())
    cols = _cells(labels)
    shape = (len(people), labels, labels, cells)  # person, vote, label, level

    def posterior(batch, table, prior):
        """[items, cells], with the items' votes as flat arrays (item, person, code) and the sum of log evidence."""
        k = batch.column(2).to_numpy()
        sizes_ = batch.column(3).value_lengths().to_numpy()
        p, code = batch.column(3).flatten().to_numpy(), batch.column(4).flatten().to_numpy()
        item = np.repeat(np.arange(len(k)), sizes_)
        n = n_of[k]
        absent = np.arange(labels)[None, :] >= n[:, None]
        evidence = 0.0
        if table is None:
            c = np.full((len(k), labels), 0.01)
            np.add.at(c, (item[code >= 0], code[code >= 0]), 1.0)
            no, yes = item[code == -1], item[code == -2]
            np.add.at(c, (no, n[no] - 1), 1.0)
            for i in range(labels - 1):
                to = yes[i < n[yes] - 1]
                np.add.at(c, (to, i), 1.0 / (n[to] - 1))
            c[absent] = 0.0
            q = np.repeat(c / c.sum(1, keepdims=True) / cells, cells, axis=1)
        else:
            z = prior[k]
            np.add.at(z, item, table[p, code + 2])
            z[np.repeat(absent, cells, axis=1)] = -1e9
            top = z.max(1, keepdims=True)
            z = np.exp(z - top)
            total = z.sum(1, keepdims=True)
            evidence = float((top + np.log(total)).sum())
            q = z / total
        return k, item, p, code, q, evidence

    def expect(table, prior):
        def run(batches):
            counts, shares, seen, evidence = np.zeros((shape[0] * labels, len(cols))), np.zeros((len(names), len(cols))), np.zeros(len(names)), 0.0
            for b in batches:
                k, item, p, code, q, more = posterior(b, table and table.value, prior)
                evidence += more
                ok = code >= 0
                np.add.at(counts, p[ok] * labels + code[ok], q[item[ok]])
                np.add.at(shares, k, q)
                np.add.at(seen, k, 1)
            hit = np.flatnonzero(counts.any(1))
            rows = [(int(i), *counts[i]) for i in hit] + [(-2 - i, *(shares[i])) for i in range(len(names)) if seen[i]]
            rows.append((-1, evidence, *[0.0] * (len(cols) - 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64() if j == 0 else pa.float64()) for j in range(len(cols) + 1)], ["id", *cols])

        return items.mapInArrow(run, "id long, " + ", ".join(f"{c} double" for c in cols)).groupBy("id").agg(*[F.sum(c).alias(c) for c in cols])

    table, prior, stats, settled = None, np.zeros((len(names), len(cols))), None, _Settled()
    for _ in range(rounds):
        counts, shares, evidence = np.zeros((shape[0] * labels, len(cols))), np.zeros((len(names), len(cols))), 0.0
        for r in expect(table, prior).collect():
            if r[0] == -1:
                evidence = r[1]
            else:
                (counts if r[0] >= 0 else shares)[r[0] if r[0] >= 0 else -2 - r[0]] = r[1:]
        if settled(evidence / max(1.0, shares.sum()) if table else None):
            break
        prior = np.log(shares / np.maximum(shares.sum(1, keepdims=True), 1e-9) + 1e-6)
        counts = counts.reshape(shape)
        codes, stats = np.zeros((shape[0], labels + 2, len(cols))), np.zeros((shape[0], 3))
        for a in names:
            mine, n = [i for i, (x, _) in enumerate(people) if x == a], sizes[a]
            if mine:
                c = np.moveaxis(counts[mine][:, :n, :n, :], 1, -1)
                lp = _log_probabilities(_fit(c))
                codes[mine, : n + 2] = _by_code(lp, labels)
                right = _ability(c, lp)
                stats[mine] = np.stack([right, (right - 1 / n) / (1 - 1 / n), c.sum((1, 2, 3))], 1)
        table = spark.sparkContext.broadcast(codes)

    def final(batches):
        for b in batches:
            _, _, _, _, q, _ = posterior(b, table and table.value, prior)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(q[:, i]) for i in range(len(cols))]], ["target", "aspect", *[f"q{i}" for i in range(len(cols))]])

    q = items.mapInArrow(final, "target string, aspect string, " + ", ".join(f"q{i} double" for i in range(len(cols))))
    out = [(a, r, 0, *map(float, stats[i])) for i, (a, r) in enumerate(people)] if stats is not None else []
    return q, spark.createDataFrame(out, "aspect string, reviewer string, code int, ability double, skill double, votes double")


def _fit_by_joins(votes: DataFrame, sizes: dict[str, int], rounds: int) -> tuple[DataFrame, DataFrame]:
    votes = cut(votes.repartition("target", "aspect"))
    n = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("aspect")]
    levels, labels = len(EASE), max(sizes.values())
    cols = _cells(labels)
    got = [F.sum(F.when(F.col("code") == k, 1.0).when((F.col("code") == -1) & (n - 1 == k), 1.0).when((F.col("code") == -2) & (F.lit(k) < n - 1), 1.0 / (n - 1)).otherwise(0.0)) for k in range(labels)]
    items = votes.groupBy("target", "aspect").agg(*[x.alias(f"c{k}") for k, x in enumerate(got)])
    total = sum(F.when(F.lit(k) < n, F.col(f"c{k}") + 0.01).otherwise(0.0) for k in range(labels))
    q = items.select("target", "aspect", F.lit(None).cast("double").alias("evidence"), *[(F.when(F.lit(i // levels) < n, F.col(f"c{i // levels}") + 0.01).otherwise(0.0) / total / levels).alias(f"q{i}") for i in range(len(cols))])
    people, settled = None, _Settled()
    for _ in range(rounds):
        q = cut(q)
        if settled(q.agg(F.avg("evidence")).first()[0]):
            break
        prior = q.groupBy("aspect").agg(F.array(*[F.log(F.avg(f"q{i}") + 1e-6) for i in range(len(cols))]).alias("lw"))
        counts = votes.where("code >= 0").join(q, ["target", "aspect"]).groupBy("aspect", "reviewer", "code").agg(*[F.sum(f"q{i}").alias(f"s{i}") for i in range(len(cols))])
        silent = votes.select("aspect", "reviewer").distinct().select("aspect", "reviewer", F.lit(-1).alias("code"), *[F.lit(0.0).alias(c) for c in cols])
        people = cut(counts.unionByName(silent).groupBy("aspect", "reviewer").applyInPandas(_annotators(sizes), _ANNOTATOR_SCHEMA))
        lp = small_or_plain(people.select("aspect", "reviewer", "code", "lp"), 8 * len(cols) + 64)
        sums = votes.join(lp, ["aspect", "reviewer", "code"], "left").groupBy("target", "aspect").agg(*[F.sum(F.coalesce(F.col("lp")[i], F.lit(0.0))).alias(f"s{i}") for i in range(len(cols))])
        q = _posterior(sums, F.broadcast(prior), sizes)
    return cut(q).drop("evidence"), people


def labelled(items: DataFrame, labels: dict[str, list[str]], out: str = "judgment") -> DataFrame:
    """(target, aspect, out, confidence): the label of the largest posterior; of equal ones the first in the list."""
    b, most = len(EASE), max(len(x) for x in labels.values())
    d = items.select("target", "aspect", *[sum(F.col(f"q{k * b + i}") for i in range(b)).alias(f"p{k}") for k in range(most)])
    top = F.greatest(*[F.col(f"p{k}") for k in range(most)])
    best = F.lit(None).cast("string")
    for aspect, those in labels.items():
        name = F.lit(None).cast("string")
        for k in range(len(those) - 1, -1, -1):
            name = F.when(F.col(f"p{k}") == top, those[k]).otherwise(name)
        best = F.when(F.col("aspect") == aspect, name).otherwise(best)
    return d.select("target", "aspect", best.alias(out), top.alias("confidence"))


def agreement(votes: DataFrame) -> DataFrame:
    """(aspect, items, votes, observed, expected, alpha): chance-corrected agreement over items with two known votes or more.

    alpha = 1 - (1 - observed) / (1 - expected): observed pairs of votes of an item that agree, each item weighing as its
    votes; expected from the label shares. Where all votes have one label, alpha is 1.
    """
    v = votes.where("code >= 0")
    per = v.groupBy("target", "aspect", "code").agg(F.count("*").alias("n"))
    item = per.groupBy("target", "aspect").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    seen = item.groupBy("aspect").agg(F.count("*").alias("items"), F.sum("m").alias("votes"), F.sum(F.col("same") / (F.col("m") - 1)).alias("same"))
    share = per.join(item.select("target", "aspect"), ["target", "aspect"]).groupBy("aspect", "code").agg(F.sum("n").alias("n"))
    chance = share.groupBy("aspect").agg(F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    d = seen.join(chance, "aspect").select("aspect", "items", "votes", (F.col("same") / F.col("votes")).alias("observed"), (F.col("pairs") / (F.col("total") * (F.col("total") - 1))).alias("expected"))
    return d.withColumn("alpha", F.when(F.col("expected") == 1, 1.0).otherwise(1 - (1 - F.col("observed")) / (1 - F.col("expected"))))
