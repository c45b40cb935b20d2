"""Pairs of similar names in blocks: common characters in order counted for many pairs at once, in words of bits."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np

#: Pairs whose common characters are counted at once, and numbers in a matrix of names.
PAIRS_AT_ONCE, CHARACTERS_AT_ONCE = 1 << 13, 1 << 22


def needed(n: int, least: float) -> int:
    """The fewest characters of n that make a share of at least `least`, by the division that the share itself is made by."""
    m = max(0, int(n * least) - 1)
    while m / n < least:
        m += 1
    return m


def occurrences(name: str) -> list[str]:
    """The characters of a name, each followed by its number among equal ones, so that what two names share is a multiset."""
    seen: Counter[str] = Counter()
    out = []
    for c in name:
        seen[c] += 1
        out.append(f"{c}{seen[c]}")
    return out


def _matching(a: str, b: str) -> int:
    """What difflib's matching blocks hold without its popular characters: the longest common part, of several the first in a
    and then in b, and so on left and right of it."""
    if not a or not b:
        return 0
    size = at = i = 0
    while i + size < len(a):
        if a[i : i + size + 1] in b:
            size, at = size + 1, i
        else:
            i += 1
    if not size:
        return 0
    j = b.find(a[at : at + size])
    return size + _matching(a[:at], b[:j]) + _matching(a[at + size :], b[j + size :])


def containment_of(a: str, b: str) -> float:
    """Characters in matching blocks over the shorter length; 0 if either is empty. The order of the two matters."""
    if not a or not b:
        return 0.0
    # difflib leaves popular characters out from 200 on
    n = _matching(a, b) if max(len(a), len(b)) < 200 else sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
    return n / min(len(a), len(b))


def _codes(names: list[str], known: dict[str, int]) -> np.ndarray:
    """Names as rows of numbers of characters; 0 for one that isn't known, and beyond a name's end. Folded names hold no \\0."""
    width = max(map(len, names))
    table = np.zeros(0x110000, np.int32)
    table[[ord(c) for c in known]] = list(known.values())
    points = np.frombuffer("".join(x.ljust(width, "\0") for x in names).encode("utf-32-le", "surrogatepass"), "<u4")
    return table[points].reshape(len(names), width)


def _known(names: list[str]) -> dict[str, int]:
    return {c: k for k, c in enumerate(sorted(set().union(*names)), 1)}


def common_in_order(short: list[str], long: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of short[i] and long[j] (never less than their matching blocks hold).

    A word of bits a short name (more words beyond 64 characters), one addition a character of the long one: Hyyrö's form.
    """
    known = _known(short)
    words = -(-max(map(len, short)) // 64)
    masks = np.zeros((words, len(short), len(known) + 1), np.uint64)
    for r, x in enumerate(short):
        for p, c in enumerate(x):
            masks[p >> 6, r, known[c]] |= np.uint64(1 << (p & 63))
    masks = masks.reshape(words, -1)
    codes = np.ascontiguousarray(_codes(long, known).T)
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        row, col = i[part] * (len(known) + 1), j[part]
        v = np.full((words, len(row)), ~np.uint64(0))
        for c in codes:
            cell = row + c[col]
            carry = None
            for w in range(words):
                u = v[w] & masks[w][cell]
                rest = v[w] ^ u
                total = v[w] + u
                if words > 1:
                    over = total < u
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                v[w] = total | rest
        out[part] = np.bitwise_count(~v).sum(0, dtype=np.int64)
    return out


def _times(names: list[str], known: dict[str, int]) -> np.ndarray:
    """(name, number of a character): how often the name holds it."""
    codes, n = _codes(names, known), len(known) + 1
    return np.bincount((codes + np.arange(len(names))[:, None] * n).ravel(), minlength=len(names) * n).reshape(-1, n)


def _ranges(widths: list[int], most: int) -> list[slice]:
    """Ranges in which the number of names by the greatest width stays within `most`; one name at least."""
    out, first, top = [], 0, 0
    for k, w in enumerate(widths):
        if k > first and (k + 1 - first) * max(top, w) > most:
            out.append(slice(first, k))
            first, top = k, 0
        top = max(top, w)
    return [*out, slice(first, len(widths))] if widths else []


def similar_pairs(short: list[str], earlier: list[list[str]], long: list[str], least: float) -> tuple[list[str], list[str], list[float]]:
    """Columns a, b and score, a < b, of the pairs of a name of `short` with a longer one (or an equally long, greater one) of
    `long` that has none of its `earlier` occurrences, of containment `least` or more.

    Two bounds from above before the matching blocks themselves: common occurrences, by a product of matrices, and common
    characters in order.
    """
    size = lambda x: (len(x), x)
    mine = sorted(zip(short, earlier, strict=True), key=lambda x: size(x[0]))
    short, earlier, long = [x for x, _ in mine], [x for _, x in mine], sorted(long, key=size)
    rank = {x: k for k, x in enumerate(sorted({*short, *long}, key=size))}
    need = {n: needed(n, least) for n in set(map(len, short))}
    out: tuple[list[str], list[str], list[float]] = ([], [], [])
    for sr in _ranges([len(x) + 64 for x in short], CHARACTERS_AT_ONCE // 64):
        ss, es = short[sr], earlier[sr]
        known = _known(ss)
        times = _times(ss, known)
        tokens = [(c, m) for c, k in known.items() for m in range(1, int(times[:, k].max()) + 1)]
        at = {f"{c}{m}": k for k, (c, m) in enumerate(tokens)}
        columns, least_times = [known[c] for c, _ in tokens], np.array([m for _, m in tokens])
        before = np.zeros((len(ss), len(tokens)), np.float32)
        for r, x in enumerate(es):
            before[r, [at[t] for t in x]] = 1
        theirs, least_common = (times[:, columns] >= least_times).astype(np.float32), np.array([need[len(x)] for x in ss])
        for lr in _ranges([len(x) + len(tokens) for x in long], CHARACTERS_AT_ONCE):
            ls = long[lr]
            ok = np.array([rank[x] for x in ss])[:, None] < np.array([rank[x] for x in ls])[None, :]
            if not ok.any():
                continue
            has = (_times(ls, known)[:, columns] >= least_times).astype(np.float32).T
            ok &= (theirs @ has >= least_common[:, None]) & (before @ has == 0)
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            enough = common_in_order(ss, ls, i, j) >= least_common[i]
            for r, c in zip(i[enough].tolist(), j[enough].tolist(), strict=True):
                a, b = (ss[r], ls[c]) if ss[r] < ls[c] else (ls[c], ss[r])
                if (score := containment_of(a, b)) >= least:
                    for to, v in zip(out, (a, b, score), strict=True):
                        to.append(v)
    return out
