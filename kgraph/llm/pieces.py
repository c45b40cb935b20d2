"""Long texts in pieces at natural boundaries (problem 9): content-defined chunking over tokens.

A gear hash over the last 32 tokens marks landmarks, about one in 1,024 positions, which depend on the
content alone. From the start of a piece, the first landmark past the minimum size is taken, and the cut snaps to the natural
boundary nearest to it between minimum and maximum size, of the strongest kind within reach (heading, then paragraph,
then sentence end). Without a landmark the last boundary before the maximum counts, without a boundary the landmark, without
both the maximum. After an edit, the cuts meet the old ones again at the next shared landmark, so only neighbouring
pieces change.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.llm.bpe import BYTE_BPE_50K, loaded
from kgraph.llm.tokens import may_exceed

LIMIT, OVERLAP, LEAST = 8192, 128, 4096
WINDOW, ONE_IN = 32, 1024
#: A boundary of a stronger kind is taken if it's at most so many tokens farther from the landmark than the next weaker one.
REACH = 1024
# What ends a sentence, closing marks that may follow, and how a heading line begins.
SENTENCE_END = re.compile("[。！？!?；;…][”’」』）)\"']*|[.](?=\\s)")
PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)(?:[ \t　]*(?:\r\n|\r|\n))+|(?:\r\n|\r|\n)")
HEADING = re.compile(r"(?m)^(?:#{1,6} |第[一二三四五六七八九十百零0-9]+[章节課课单元]|\d+(?:\.\d+)+[ 　]|【)")
KINDS = ("heading", "paragraph", "sentence")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets, strength 3 heading to 1 sentence) where a piece may start, ascending, neither end included."""
    at: dict[int, int] = {}
    for m in SENTENCE_END.finditer(text):
        at[m.end()] = 1
    for m in PARAGRAPH.finditer(text):
        at[m.end()] = 2
    for m in HEADING.finditer(text):
        at[m.start()] = 3
    chars = np.array(sorted(k for k in at if 0 < k < len(text)), dtype=np.int64)
    kinds = np.array([at[k] for k in chars.tolist()], dtype=np.int64)
    return _bytes_before(text)[chars], kinds


def _bytes_before(text: str) -> np.ndarray:
    """Byte offset of every character, and of the end."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])


def landmarks(ids: np.ndarray) -> np.ndarray:
    """Token positions (a cut before the position) whose last WINDOW tokens hash to a landmark."""
    x = ids.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = np.zeros(len(x) + 1, np.uint64)
    for k in range(WINDOW):
        h[k + 1 :] += x[: len(x) - k] << np.uint64(k)
    return np.flatnonzero((h[WINDOW:] >> np.uint64(20)) % np.uint64(ONE_IN) == 0) + WINDOW


class _Cutter:
    """Where a piece may end, over one text's tokens; ends are byte ends of tokens, chars of characters."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], chars: np.ndarray):
        self.whole = np.flatnonzero(np.isin(ends, chars)) + 1  # token positions that split no character
        at = np.searchsorted(ends, bounds[0]) + 1
        ok = (at <= len(ids)) & (ends[np.minimum(at, len(ids)) - 1] == bounds[0])
        self.at, self.kinds = at[ok], bounds[1][ok]
        marks = landmarks(ids)
        self.marks = marks[np.isin(marks, self.whole)]

    def end(self, start: int, size: int, least: int) -> tuple[int, str]:
        """(token after the last, kind of the cut) of the piece from start, between least and size tokens."""
        low, high = start + least, start + size
        m = self.marks[np.searchsorted(self.marks, low) : np.searchsorted(self.marks, high, "right")]
        a, b = np.searchsorted(self.at, low), np.searchsorted(self.at, high, "right")
        where, strong = self.at[a:b], self.kinds[a:b]
        aim = int(m[0]) if len(m) else high
        if len(where):
            far = np.abs(where - aim)
            best = None
            for k in (3, 2, 1):
                if (mine := np.flatnonzero(strong == k)).size:
                    i = mine[np.argmin(far[mine])]
                    if best is None or far[i] + REACH < far[best]:
                        best = i
            return int(where[best]), KINDS[3 - int(strong[best])]
        if len(m):
            return aim, "landmark"
        return self.back(high), "limit"

    def back(self, position: int) -> int:
        """The last token position up to this one that splits no character."""
        return int(self.whole[np.searchsorted(self.whole, position, "right") - 1])


def pieces_of(text: str, machine, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int, int, str]]:
    """(first character, character after the last, tokens, tokens shared with the piece before, kind of end) of each piece.

    Every piece has at most `limit` tokens when it's encoded on its own. The shared stretch is the fewest whole characters
    that make `overlap` tokens or more, at most 3 more. A text within the limit is one piece.
    """
    if not 0 <= 2 * (overlap + 4) < limit:
        raise ValueError("pieces must be over twice as long as their overlap")
    ids = np.frombuffer(machine.encode(text), dtype="<i4")
    n = len(ids)
    if n <= limit:
        return [(0, len(text), n, 0, "end")]
    ends = np.cumsum(machine.lengths()[ids])
    chars = _bytes_before(text)
    cutter = _Cutter(ids, ends, boundaries(text), chars)
    out, start, last, kind = [], 0, 0, ""
    while kind != "end":
        size = limit
        a = int(np.searchsorted(chars, ends[start - 1] if start else 0))
        while True:
            end, kind = (n, "end") if n - start <= size else cutter.end(start, size, min(least, size // 2))
            b = int(np.searchsorted(chars, ends[end - 1]))
            tokens = machine.count(text[a:b])
            if tokens <= limit:
                break
            # a piece that starts inside a run can have a few tokens more on its own than in the whole text: it alone is shortened
            size = min(size, end - start) - (tokens - limit)
        out.append((a, b, tokens, last - start if start else 0, kind))
        start, last = cutter.back(end - overlap), end
    return out


def split(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST, path: str = BYTE_BPE_50K) -> DataFrame:
    """(id, piece, first_char, next_char, n_tokens, shared_tokens, ends_at, text): the pieces of every text over the limit.

    Texts within it, empty and null texts have no rows here: they stay as they are, and texts of at most `limit` bytes aren't encoded,
    since they can't have more tokens. Each row of df counts for itself, so a repeated row comes out twice.
    """

    def run(batches):
        machine = loaded(path)
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                found = pieces_of(text, machine, limit, overlap, least)
                if len(found) < 2:
                    continue
                k = len(found)
                cols = [pa.array([b.column(0)[i].as_py()] * k, b.column(0).type), pa.array(range(k), pa.int32())]
                cols += [pa.array([f[j] for f in found], pa.int32()) for j in range(4)] + [pa.array([f[4] for f in found]), pa.array([text[f[0] : f[1]] for f in found])]
                yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "first_char", "next_char", "n_tokens", "shared_tokens", "ends_at", "text"])

    d = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(may_exceed(F.col("text"), limit))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(run, f"id {kind}, piece int, first_char int, next_char int, n_tokens int, shared_tokens int, ends_at string, text string").withColumnRenamed("id", id_col)
