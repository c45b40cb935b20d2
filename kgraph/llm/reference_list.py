"""Freely typed values to the entries of a reference list (problem 2).

A multi-pattern automaton over the list's names and aliases finds mentions inside a value; of overlapping mentions the longest
wins, then the leftmost. Names of a reference list are often composed: the same content under several aspects, the
same aspect of several contents. The list is therefore taken apart first (`Parts`): a name is split where both sides
recur most in other names, and its aliases then show the other words for its content and the other phrasings of its
aspect. The automaton holds whole names, whole aliases, contents, and the fixed pieces of the phrasings. A value
means an entry if it mentions the whole of it, or one content and one aspect whose entry is in the list; a known content with a
known aspect that the list lacks means no entry. Values without such mentions go to token-set similarity over
their rest: first for the aspect, then for the content.

What people put around a title ("review:", "lesson 2") says nothing of what it means. Such frames are learned from the values
themselves: what stands before or after whole mentions of many different entries (`frames`).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm.looks import unify
from kgraph.session import cut

# Numerals and their digits.
NUMERALS = ("零一二两三四五六七八九", "01223456789")
#: A frame stands beside whole mentions of at least so many entries, and of at least this share of all that have something on its side.
FRAME_ENTRIES, FRAME_SHARE = 3, 0.01


@cache
def simplified(spark: SparkSession) -> dict[int, str]:
    """Traditional characters with their simplified forms, as a table for str.translate, by the rules of the ICU library that Spark brings,
    and numerals with their digits."""
    chars = [chr(c) for c in [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)]]
    forms = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate("\n".join(chars)).split("\n")
    return {ord(a): b for a, b in zip(chars, forms, strict=True) if a != b and len(b) == 1} | {ord(a): b for a, b in zip(*NUMERALS, strict=True)}


def fold(text: str, table: dict[int, str]) -> str:
    """The key that mentions are sought in: lower case, simplified, numerals as digits (the table), only letters and digits, no letter
    doubled."""
    return re.sub(r"(\D)\1+", r"\1", re.sub(r"[\W_]+", "", text.lower().translate(table)))


class Parts:
    """Contents and aspects of a reference list, from the list alone."""

    def __init__(self, entries: list[tuple[str, list[str]]]):
        heads, tails = defaultdict(set), defaultdict(set)
        names = {n for n, _ in entries if n}
        for n in names:
            for i in range(1, len(n)):
                heads[n[:i]].add(n[i:])
                tails[n[i:]].add(n[:i])
        self.split: dict[str, tuple[str, str]] = {}
        for n in names:
            score, _, i = max(((len(heads[n[:i]]) * len(tails[n[i:]]), -i, i) for i in range(1, len(n))), default=(0, 0, 0))
            if i and len(heads[n[:i]]) > 1 and len(tails[n[i:]]) > 1:
                self.split[n] = (n[:i], n[i:])
        # a rare name joins the split by a tail that others established
        known = Counter(t for _, t in self.split.values())
        for n in names:
            best = max((t for t, k in known.items() if k > 2 and n.endswith(t) and len(n) > len(t)), key=len, default=None)
            if best and (n not in self.split or known[self.split[n][1]] <= 2):
                self.split[n] = (n[: -len(best)], best)
        shapes, other = defaultdict(Counter), defaultdict(Counter)
        for n, aliases in entries:
            if n not in self.split:
                continue
            head, tail = self.split[n]
            shapes[tail]["\0" + tail] += 1
            for a in aliases:
                if head in a:
                    shapes[tail][a.replace(head, "\0", 1)] += 1
        self.shapes = {t: [s for s, k in c.items() if k > 1 or s == "\0" + t] for t, c in shapes.items()}
        for n, aliases in entries:
            if n not in self.split:
                continue
            head, tail = self.split[n]
            for a in aliases:
                if head in a:
                    continue
                for s in self.shapes[tail]:
                    before, _, after = s.partition("\0")
                    if a.startswith(before) and a.endswith(after) and len(a) > len(before) + len(after):
                        other[head][a[len(before) : len(a) - len(after)]] += 1
        self.contents = {h: [h, *other[h]] for h, _ in self.split.values()}


class Matcher:
    """match(folded value) -> (entry or None, how, score). heads and tails are frames, with # for a run of digits."""

    def __init__(self, entries: dict[str, tuple[str, list[str]]], table: dict[int, str] | None = None, heads: Sequence[str] = (), tails: Sequence[str] = (), least: float = 0.5):
        import ahocorasick

        self.least = least
        self.fold = lambda x: fold(x, table or {})
        fold_ = self.fold
        folded = {i: (fold_(n), [fold_(a) for a in aliases if a and fold_(a)]) for i, (n, aliases) in entries.items() if n and fold_(n)}
        parts = Parts(list(folded.values()))
        self.entry: dict[tuple[str, str], str] = {}
        self.whole: dict[str, str] = {}
        for i, (n, aliases) in sorted(folded.items(), reverse=True):
            for x in [*aliases, n]:
                self.whole[x] = i
            if n in parts.split:
                self.entry[parts.split[n]] = i
        self.content: dict[str, str] = {}
        for h in sorted(parts.contents, reverse=True):
            for x in reversed(parts.contents[h]):
                self.content[x] = h
        # a phrasing is the tuple of its fixed pieces; a joining first character that most tails share is no evidence
        first = Counter(t[0] for t in parts.shapes)
        joint = {c for c, k in first.items() if k > 0.5 * len(parts.shapes)}
        self.joint = joint
        self.phrase: dict[tuple[str, ...], str] = {}
        for t, shapes in parts.shapes.items():
            for s in shapes:
                pieces = tuple(p.lstrip("".join(joint)) if p == t else p for p in s.split("\0") if p)
                if any(pieces):
                    self.phrase[pieces] = t
        either = lambda forms: "|".join(re.escape(f).replace(r"\#", r"\d+") for f in sorted(forms, key=lambda f: (-len(f), f)))
        self.head = re.compile(either(heads)) if heads else None
        counted = [f for f in tails if "#" in f]
        self.number = re.compile(rf"(?<=\D)(?:{either(counted)})$") if counted else None
        self.tails = sorted((f for f in tails if "#" not in f), key=lambda f: (-len(f), f))
        self.automaton = ahocorasick.Automaton()
        for x in {*self.whole, *self.content, *(p for ps in self.phrase for p in ps)}:
            self.automaton.add_word(x, x)
        if len(self.automaton):
            self.automaton.make_automaton()
        df = Counter(c for x in self.content for c in set(x))
        self.idf = {c: math.log(1 + len(self.content) / k) for c, k in df.items()}
        self.rare = math.log(1 + max(1, len(self.content)))
        self.content_sets = {x: Counter(x) for x in self.content}
        self.by_char = defaultdict(set)
        for x in self.content:
            for c in x:
                self.by_char[c].add(x)

    def mentions(self, key: str) -> list[tuple[int, int, str]]:
        """Longest first, then leftmost, none overlapping: (start, end, pattern), in the order of the text."""
        if not len(self.automaton):
            return []
        found = [(end - len(x) + 1, end + 1, x) for end, x in self.automaton.iter(key)]
        found.sort(key=lambda m: (m[0] - m[1], m[0]))
        taken, out = [False] * len(key), []
        for a, b, x in found:
            if not any(taken[a:b]):
                taken[a:b] = [True] * (b - a)
                out.append((a, b, x))
        return sorted(out)

    def weight(self, chars) -> float:
        return sum(self.idf.get(c, self.rare) * k for c, k in chars.items())

    def beside(self, key: str) -> list[tuple[str, str, str]]:
        """(side, form, entry): what stands before and after the one whole mention of a value; digits as #."""
        found = [m for m in self.mentions(key) if m[2] in self.whole] if key not in self.whole else []
        if len(found) != 1:
            return []
        a, b, x = found[0]
        return [(side, re.sub(r"\d+", "#", s), self.whole[x]) for side, s in (("head", key[:a]), ("tail", key[b:])) if s]

    def strip(self, key: str) -> str:
        """The value without frames: two in front of it, one behind, after which a single stray character may follow."""
        if self.number:
            key = self.number.sub("", key)
        for _ in range(2):
            if self.head and (m := self.head.match(key)) and m.end() < len(key):
                key = key[m.end() :]
        for f in self.tails:
            at = key.rfind(f)
            if at > 1 and len(key) - at - len(f) <= 1:
                key = key[:at]
        return key

    def aspects(self, rest: str) -> list[tuple[float, str, str]]:
        """(similarity, aspect, the rest without it), best first."""
        out = []
        have = Counter(rest)
        for pieces, t in self.phrase.items():
            whole = "".join(pieces)
            at, left, exact = 0, rest, True
            for p in pieces:
                k = left.find(p, at)
                if k < 0:
                    exact = False
                    break
                left, at = left[:k] + "\0" + left[k + len(p) :], k + 1
            if exact:
                out.append((1.0 + len(whole) / 100, t, left))
                continue
            want = Counter(whole)
            shared = want & have
            n = sum(shared.values())
            if 2 * n < len(whole):
                continue
            # order tells typing slips from chance: pairs of neighbours that survive
            pairs = sum(whole[i : i + 2] in rest for i in range(len(whole) - 1))
            sim = n / len(whole) - 0.25 * (1 - pairs / max(1, len(whole) - 1))
            left, need = [], Counter(shared)
            for c in reversed(rest):
                if need[c] > 0:
                    need[c] -= 1
                else:
                    left.append(c)
            out.append((sim, t, "".join(reversed(left))))
        out.sort(key=lambda x: (-x[0], x[1]))
        return out

    def short(self, rest: str) -> list[tuple[float, str, str]]:
        """(similarity, aspect, '') of a rest that is all aspect: token sets of characters, best first."""
        have, out = Counter(rest), []
        for pieces, t in self.phrase.items():
            want = Counter("".join(pieces))
            sim = 2 * sum((want & have).values()) / (len(rest) + sum(want.values())) if rest else 0.0
            if sim >= self.least:
                out.append((min(sim, 0.99), t, ""))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def nearest(self, rest: str, spare: int) -> list[tuple[float, str]]:
        """(similarity, content), best first: weighted sets of characters and pairs; only those of the least similarity with at
        most `spare` characters of the rest strange to them, one more for a long content."""
        have = Counter(rest)
        cands = set().union(*(self.by_char.get(c, ()) for c in have)) if have else ()
        total = self.weight(have)
        scores: dict[str, float] = {}
        for x in cands:
            h = self.content[x]
            if len(have.keys() - self.content_sets[x].keys()) > spare + (len(h) > 4):
                continue
            both = self.weight(have & self.content_sets[x])
            sim = 2 * both / (total + self.weight(self.content_sets[x]))
            pairs = sum(x[i : i + 2] in rest for i in range(len(x) - 1))
            sim += 0.05 * pairs / max(1, len(x) - 1)
            if sim >= self.least and sim > scores.get(h, 0):
                scores[h] = sim
        return sorted(((s, h) for h, s in scores.items()), key=lambda x: (-x[0], x[1]))

    def match(self, key: str) -> tuple[str | None, str, float]:
        if not key:
            return None, "empty", 0.0
        if key in self.whole:
            return self.whole[key], "mention", 1.0
        key = self.strip(key)
        found = self.mentions(key)
        whole = [x for _, _, x in found if x in self.whole]
        contents = [m for m in found if m[2] in self.content and m[2] not in self.whole]
        if whole:
            best = max(whole, key=len)
            if len(best) * 2 > len(key):
                rest = key.replace(best, "", 1)
                if not any(m[2] in rest for m in contents):
                    return self.whole[best], "mention", len(best) / len(key)
        joints = "".join(self.joint)
        if contents:
            a, b, x = max(contents, key=lambda m: (m[1] - m[0], -m[0]))
            rest = key[:a] + "\0" + key[b:]
            ways = self.aspects(rest)
            if not ways or ways[0][0] < self.least:
                ways = self.short(rest.replace("\0", "").strip(joints))
            if ways and ways[0][0] >= self.least and self._alone(ways, rest):
                left = ways[0][2].replace("\0", "").strip(joints)
                if len(left) <= max(4, len(x)):
                    how = "mention" if ways[0][0] >= 1 else "similar"
                    return self.entry.get((self.content[x], ways[0][1])), how, min(1.0, ways[0][0])
        best = None
        ways = [w for w in self.aspects(key) if w[0] >= self.least]
        if not ways:
            at = max((key.rfind(c) for c in joints), default=-1)
            ways = [(sim, t, key[:at]) for sim, t, _ in self.short(key[at + 1 :])] if at > 0 else []
        for sim, t, left in ways:
            left = re.sub(f"[\0{joints}]", "", left)
            for csim, h in self.nearest(left, 1 + (sim < 1)):
                score = min(1.0, sim) + csim
                real = (h, t) in self.entry
                cand = (round(score, 6), real, h, t, csim)
                if best is None or cand[:2] > best[:2]:
                    best = cand
        if best is None:
            return None, "unmatched", 0.0
        return self.entry.get((best[2], best[3])), "similar", best[0] / 2

    @staticmethod
    def _alone(ways, rest) -> bool:
        """The best phrasing isn't tied with another aspect."""
        return len(ways) < 2 or ways[1][1] == ways[0][1] or ways[1][0] < ways[0][0]


def frames(looks: DataFrame, listed: dict[str, tuple[str, list[str]]], table: dict[int, str]) -> tuple[list[str], list[str]]:
    """(heads, tails) learned from all of looks (text, looks): forms beside whole mentions of at least FRAME_ENTRIES entries that make up at
    least FRAME_SHARE of all such (form, entry) on their side, so there are at most 1/FRAME_SHARE a side."""

    def run(batches):
        m = Matcher(listed, table)
        for b in batches:
            got = sorted({x for t in b.column(1).to_pylist() if t for x in m.beside(m.fold(t))})
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in range(3)], ["side", "form", "entry"])

    seen = looks.mapInArrow(run, "side string, form string, entry string").distinct().groupBy("side", "form").agg(F.count("*").alias("n"))
    seen = cut(seen)
    most = {r["side"]: r["t"] for r in seen.groupBy("side").agg(F.sum("n").alias("t")).collect()}
    out = []
    for side in ("head", "tail"):
        least = max(FRAME_ENTRIES, most.get(side, 0) * FRAME_SHARE)
        out.append(sorted(r["form"] for r in seen.where((F.col("side") == side) & (F.col("n") >= least)).select("form").collect()))
    return out[0], out[1]


def assign(values: DataFrame, entries: DataFrame, key: str, text: str, entry_id: str = "id", name: str = "name", aliases: str = "aliases", around: tuple[Sequence[str], Sequence[str]] | None = None, most_entries: int = 100_000) -> DataFrame:
    """(text, looks, entry_id, how, score): one row a distinct text of values, entry_id null if it means no entry.

    how is mention, similar, empty (a null or blank text, or one without letters and digits) or unmatched. The reference
    list goes to every worker, so it must have at most most_entries rows, else ValueError. Repeated rows of an entry
    add their aliases; an entry without id or name takes no part; two entries of one wording: the smallest id has it.
    Only distinct texts are matched, so a text of a third of the rows costs one match. around gives the frames (heads, tails)
    in their folded form, # for digits; without it they are learned from the values (`frames`).
    """
    spark = values.sparkSession
    e = entries.where(F.col(entry_id).isNotNull()).select(F.col(entry_id).alias("id"), F.col(name).alias("name"), F.coalesce(F.col(aliases), F.array().cast("array<string>")).alias("aliases"))
    if (n := e.limit(most_entries + 1).count()) > most_entries:
        raise ValueError(f"the reference list has over {most_entries} rows")
    flat = e.select("id", F.posexplode(F.concat(F.array("name"), "aliases")).alias("pos", "word")).where("word IS NOT NULL").distinct()
    listed: dict[str, tuple[str, list[str]]] = {}
    for r in sorted(unify(flat, "word", "word").collect() if n else [], key=lambda r: (r["id"], r["pos"], r["word"])):
        if r["pos"] == 0 and r["id"] not in listed:
            listed[r["id"]] = (r["word"], [])
        elif r["id"] in listed:
            listed[r["id"]][1].append(r["word"])
    d = values.select(F.col(text).alias("text")).distinct()
    # a fixed number of parts: matching costs far more than the bytes that adaptive coalescing goes by. By a hash of its own, since
    # a repartition by the column of distinct would be taken for done
    d = unify(d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("text")), "text", "looks")
    table = simplified(spark)
    if around is None:
        d = cut(d)
        around = frames(d, listed, table)

    def run(batches):
        m = Matcher(listed, table, *around)
        memo: dict[str, tuple] = {}
        for b in batches:
            got = []
            for x in b.column(1).to_pylist():
                k = m.fold(x) if x else ""
                if k not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[k] = m.match(k)
                got.append(memo[k])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([float(g[2]) for g in got], pa.float64())], ["text", "looks", "entry_id", "how", "score"])

    return d.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), T.StructField("looks", T.StringType()), T.StructField("entry_id", T.StringType()), T.StructField("how", T.StringType()), T.StructField("score", T.DoubleType())]))
