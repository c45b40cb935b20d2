"""Byte-level BPE as a lazily determinised finite-state transducer, and an incremental decoder.

A state is (kind of run, window, held blank). The window is the part of the current run whose tokens may
still depend on what follows. On reading a character the transducer looks at every position j of the window from
which a vocabulary token could still be under way (the rest of the window is a proper prefix of a token); each such j
has one encoding of what lies before it. A token boundary shared by all those encodings holds whatever
follows, so everything before the last such boundary is emitted and leaves the window. Lookahead is thus bounded by the
longest token. Transitions are built when first taken and kept; a text is read in short stretches of like
characters, and the way a stretch leads through the states is kept too, as one composed transition. A table
that outgrows its bound is dropped and grown again, which changes no result.

Runs are those of the public pattern: an optional single space and letters, numbers or others; contractions; blanks,
of which the last is held back because it belongs to the next run if it is a space.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata

import numpy as np

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Unicode's White_Space, and the contractions of the public split pattern.
WHITE_SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
ONE_LETTER = frozenset("stmd")
TWO_LETTER = {"r": "e", "v": "e", "l": "l"}


#: How a text is cut into the symbols that are read; any cut gives the same ids. Between slices of so many characters the table may be dropped.
SLICE = 1 << 16
STRETCH = re.compile("[\u4e00-\u9fff]{1,24}|[A-Za-z]{1,24}|[^\u4e00-\u9fffA-Za-z]{1,24}")


def kind(ch: str) -> str:
    """L letter, N number, S blank, O other."""
    if ch in WHITE_SPACE:
        return "S"
    c = unicodedata.category(ch)[0]
    return c if c in "LN" else "O"


class _State(dict):
    """character or stretch of characters -> (packed ids emitted, next state)."""

    __slots__ = ("machine", "run", "window", "held", "tail")

    def __init__(self, machine, run, window, held):
        self.machine, self.run, self.window, self.held = machine, run, window, held
        self.tail = None

    def end(self) -> bytes:
        if self.tail is None:
            self.tail = self.machine.pack(self.machine.ending(self.run, self.window, self.held))
        return self.tail

    def __missing__(self, symbol):
        if len(symbol) == 1:
            ids, state = self.machine.step(self, symbol)
            out = (self.machine.pack(ids), state)
        else:
            state, parts = self, []
            for ch in symbol:
                e, state = state[ch]
                parts.append(e)
            out = (b"".join(parts), state)
        self[symbol] = out
        self.machine.built += 1
        return out


class Transducer:
    """encode(text) gives little-endian int32 ids as bytes."""

    def __init__(self, ranks: dict[bytes, int], most_transitions: int = 1_500_000):
        self.ranks = ranks
        self.most = most_transitions
        self._lengths = None
        self.open = {t[:n] for t in ranks for n in range(1, len(t))}
        self.reset()

    @classmethod
    def load(cls, path: str = BYTE_BPE_50K) -> Transducer:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def reset(self) -> None:
        self.states: dict = {}
        self.pieces: dict[bytes, tuple] = {}
        self.built = 0
        self.begin = self.state("B", b"", "")

    def state(self, run, window, held) -> _State:
        key = (run, window, held)
        if (s := self.states.get(key)) is None:
            s = self.states[key] = _State(self, run, window, held)
        return s

    @staticmethod
    def pack(ids) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids) if ids else b""

    def merged(self, piece: bytes) -> tuple:
        """The tokens of one run, by always merging the pair of lowest rank, the leftmost first."""
        if (out := self.pieces.get(piece)) is not None:
            return out
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            low, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if low == 1 << 60:
                break
            pair = parts[at] + parts[at + 1]
            joined, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] + parts[i + 1] == pair:
                    joined.append(pair)
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        out = tuple(parts)
        if len(self.pieces) > 400_000:
            self.pieces.clear()
        self.pieces[piece] = out
        return out

    def ids(self, piece: bytes) -> list[int]:
        return [self.ranks[p] for p in self.merged(piece)] if piece else []

    def advance(self, window: bytes, more: bytes) -> tuple[list[int], bytes]:
        """Ids that no continuation can change, and the window that stays."""
        w = window + more
        if w in self.open:
            return [], w
        common = None
        for j in range(1, len(w) + 1):
            if j < len(w) and w[j:] not in self.open:
                continue
            at, cuts = 0, {0}
            for part in self.merged(w[:j]):
                at += len(part)
                cuts.add(at)
            common = cuts if common is None else common & cuts
        sure = max(common)
        return self.ids(w[:sure]), w[sure:]

    def start(self, ch: str, lead: str = "") -> tuple[list[int], _State]:
        k = kind(ch)
        if k == "S":
            return [], self.state("S", b"", ch)
        if ch == "'" and not lead:
            return [], self.state("Q", b"", ch)
        ids, w = self.advance(b"", (lead + ch).encode())
        return ids, self.state(k, w, "")

    def step(self, s: _State, ch: str) -> tuple[list[int], _State]:
        k = kind(ch)
        if s.run == "B":
            return self.start(ch)
        if s.run == "S":
            if k == "S":
                ids, w = self.advance(s.window, s.held.encode())
                return ids, self.state("S", w, ch)
            ids = self.ids(s.window)
            if s.held == " ":
                more, nxt = self.start(ch, " ")
            else:
                ids = ids + self.ids(s.held.encode())
                more, nxt = self.start(ch)
            return ids + more, nxt
        if s.run == "Q":
            if len(s.held) == 1:
                if ch in ONE_LETTER:
                    return self.ids(("'" + ch).encode()), self.begin
                if ch in TWO_LETTER:
                    return [], self.state("Q", b"", "'" + ch)
                if k == "O":
                    ids, w = self.advance(b"", b"'")
                    more, w = self.advance(w, ch.encode())
                    return ids + more, self.state("O", w, "")
                more, nxt = self.start(ch)
                return self.ids(b"'") + more, nxt
            letter = s.held[1]
            if ch == TWO_LETTER[letter]:
                return self.ids((s.held + ch).encode()), self.begin
            first, run = self.start(letter)
            more, nxt = self.step(run, ch)
            return self.ids(b"'") + first + more, nxt
        if k == s.run:
            ids, w = self.advance(s.window, ch.encode())
            return ids, self.state(k, w, "")
        more, nxt = self.start(ch)
        return self.ids(s.window) + more, nxt

    def ending(self, run, window, held) -> list[int]:
        if run == "Q":
            return self.ids(b"'") + (self.ids(held[1:].encode()) if len(held) > 1 else [])
        return self.ids(window + held.encode())

    def encode(self, text: str) -> bytes:
        s, out = self.begin, []
        add = out.append
        for at in range(0, len(text), SLICE):
            if self.built > self.most:
                run, window, held = s.run, s.window, s.held
                self.reset()
                s = self.state(run, window, held)
            for symbol in STRETCH.findall(text[at : at + SLICE]):
                e, s = s[symbol]
                add(e)
        add(s.end())
        return b"".join(out)

    def lengths(self) -> np.ndarray:
        """Bytes of each token, by id."""
        if self._lengths is None:
            self._lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
            for t, i in self.ranks.items():
                self._lengths[i] = len(t)
        return self._lengths

    def count(self, text: str) -> int:
        return len(self.encode(text)) >> 2


class Decoder:
    """Ids to text, token by token. Its states are the unfinished UTF-8 sequences (at most three bytes); transitions are
    kept once taken. A byte that can't continue a sequence gives U+FFFD, as does an unfinished end."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.states: dict[bytes, dict] = {b"": {}}

    @staticmethod
    def _split(data: bytes) -> tuple[str, bytes]:
        """Complete characters, and the unfinished rest."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80:
                break
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if need > back:
                    return data[:-back].decode("utf-8", "replace"), data[-back:]
                break
        return data.decode("utf-8", "replace"), b""

    def decode(self, ids) -> str:
        rest, out = b"", []
        for i in ids:
            table = self.states[rest]
            if (hit := table.get(i)) is None:
                hit = table[i] = self._split(rest + self.tokens[i])
                self.states.setdefault(hit[1], {})
            out.append(hit[0])
            rest = hit[1]
        if rest:
            out.append("\ufffd")
        return "".join(out)


_LOADED: dict[str, Transducer] = {}


def loaded(path: str = BYTE_BPE_50K) -> Transducer:
    """One transducer a worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = Transducer.load(path)
    return _LOADED[path]
