"""Exact token counts of all prefixes, by dynamic programming over the last token.

The encoding of a prefix without its last token is the encoding of the shorter
prefix, and a token may follow another exactly if the two stay apart when merged
alone; so of the tokens that end at a place one fits, and the count there is one
more than the count where that token starts.  Tokens that end at a place come
from a trie of the vocabulary; which pairs stay apart is found by merging the
two once, and remembered.  Many units are counted together: all units advance by
one character at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import numpy as np

from .lookup import Lookup
from .pieces import MARK, Vocabulary

#: Units up to this length advance together; longer ones are counted one by one.
TOGETHER = 48
#: Pairs of tokens that a worker remembers at most.
PAIRS = 4_000_000


class Programme:
    """The dynamic programme of one vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        names = list(v.ids)
        cuts, _, _ = v.cut_units([p.replace(MARK, " ") for p in names])
        whole = {p for p, c in zip(names, cuts, strict=True) if c == v.packed[p]}  # a token that merging never makes is never a last token
        nodes: dict[str, int] = {"": 0}
        keys, values = [], []
        for p in names:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    keys.append(nodes[p[: k - 1]] << 21 | ord(p[k - 1]))
                    values.append(nodes[p[:k]])
        self.step = Lookup(np.array(keys), np.array(values))
        self.token = np.full(len(nodes), -1, dtype=np.int64)
        for p in whole:
            self.token[nodes[p]] = v.ids[p]
        self.apart = Lookup()
        if any(c not in v.ids for p in names for c in p):
            raise ValueError("a vocabulary is needed that has each character of its pieces as a piece")

    def _tokens(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, length, token) of every token inside a unit, and of characters that are no piece: token -1."""
        first, length, token = [], [], []
        start, node, n = np.arange(len(points)), np.zeros(len(points), dtype=np.int64), 0
        while len(start):
            node = self.step.get(node << 21 | points[start + n])
            n += 1
            if n == 1:
                odd = start[node < 0]
                first.append(odd)
                length.append(np.ones(len(odd), dtype=np.int64))
                token.append(np.full(len(odd), -1))
            start, node = start[node >= 0], node[node >= 0]
            got = self.token[node]
            known = got >= 0
            first.append(start[known])
            length.append(np.full(known.sum(), n))
            token.append(got[known])
            going = start + n < ends[start]
            start, node = start[going], node[going]
        return np.concatenate(first), np.concatenate(length), np.concatenate(token)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b next to each other remain two tokens."""
        key = a << 20 | b
        out = self.apart.get(key)
        new = np.unique(key[out < 0])
        if len(new):
            pieces = self.v.pieces
            left, right = [pieces[k] for k in (new >> 20).tolist()], [pieces[k] for k in (new & 0xFFFFF).tolist()]
            cuts, _, _ = self.v.cut_units([(x + y).replace(MARK, " ") for x, y in zip(left, right, strict=True)])
            good = [c == self.v.packed[x] + self.v.packed[y] for c, x, y in zip(cuts, left, right, strict=True)]
            if len(self.apart) > PAIRS:
                self.apart = Lookup()
                return self.stay_apart(a, b)
            self.apart.add(new, np.array(good, dtype=np.int64))
            out = self.apart.get(key)
        return out > 0

    def counts(self, units: Sequence[str]) -> list[bytes | array]:
        """For each unit the token counts after its first, second, ... character."""
        if not units:
            return []
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        points[points == 0x20] = ord(MARK)
        unit_end = np.cumsum(sizes)
        unit_start = np.repeat(unit_end - sizes, sizes)
        first, length, token = self._tokens(points, np.repeat(unit_end, sizes))
        end = first + length - 1
        spelled = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)  # byte pieces of a character that is no piece
        count, last, done = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=bool)
        together = np.repeat(sizes <= TOGETHER, sizes)[end]
        place = end - unit_start[end]
        order = np.lexsort((-length, place))
        order = order[together[order]]
        bounds = np.flatnonzero(np.diff(place[order] * (self.v.longest + 1) + length[order])) + 1
        for some in np.split(order, bounds):
            some = some[~done[end[some]]]
            if not len(some):
                continue
            n, at = length[some[0]], first[some]
            if place[some[0]] + 1 == n:
                before = np.zeros(len(some), dtype=np.int64)
            else:
                previous, own = last[at - 1], token[some]
                fits = (previous < 0) | (own < 0)
                ask = np.flatnonzero(~fits)
                if len(ask):
                    fits[ask] = self.stay_apart(previous[ask], own[ask])
                    some, at = some[fits], at[fits]
                before = count[at - 1]
            to, own = end[some], token[some]
            count[to], last[to], done[to] = before + np.where(own < 0, spelled[to], 1), own, True
        for u in np.flatnonzero(sizes > TOGETHER).tolist():
            a, b = int(unit_end[u] - sizes[u]), int(unit_end[u])
            mine = np.flatnonzero((end >= a) & (end < b))
            self._one(a, b, end[mine], length[mine], token[mine], spelled, count, last)
        flat, out, at = count.tolist(), [], 0
        for n in sizes.tolist():
            own = flat[at : at + n]
            out.append(bytes(own) if max(own, default=0) < 256 else array("I", own))
            at += n
        return out

    def _one(self, a: int, b: int, end: np.ndarray, length: np.ndarray, token: np.ndarray, spelled: np.ndarray, count: np.ndarray, last: np.ndarray) -> None:
        """The programme over one long unit."""
        order = np.lexsort((-length, end))
        known: dict[tuple[int, int], bool] = {}
        counts, lasts, at = [0], [-1], a
        for e, n, t in zip(end[order].tolist(), length[order].tolist(), token[order].tolist(), strict=True):
            if e < at:  # a longer token has been found to fit
                continue
            j = e + 1 - n - a
            if j and t >= 0 and lasts[j] >= 0:
                pair = lasts[j], t
                if pair not in known:
                    known[pair] = bool(self.stay_apart(np.array([pair[0]]), np.array([t]))[0])
                if not known[pair]:
                    continue
            counts.append(counts[j] + (1 if t >= 0 else int(spelled[e])))
            lasts.append(t)
            at = e + 1
        count[a:b], last[a:b] = counts[1:], lasts[1:]


def programme(v: Vocabulary) -> Programme:
    """The programme of a vocabulary, made once a process."""
    if ("programme",) not in v.caches:
        v.caches["programme",] = Programme(v)
    return v.caches["programme",]


class PrefixTable:
    """Token counts of all prefixes of one text: totals at the starts of units, and the counts inside each unit."""

    def __init__(self, v: Vocabulary, text: str, units: list[str] | None = None, counts: list[bytes | array] | None = None):
        self.units = v.units(text) if units is None else units
        self.inside = programme(v).counts(self.units) if counts is None else counts
        self.totals = np.concatenate([[0], np.cumsum([c[-1] for c in self.inside], dtype=np.int64)])
        # Characters of the text before each unit: the first unit has one mark that is not in the text.
        self.chars = np.concatenate([[0], np.cumsum([len(u) for u in self.units], dtype=np.int64) - 1]) if self.units else np.zeros(1, dtype=np.int64)

    def count(self, chars: int) -> int:
        """Tokens of the first `chars` characters."""
        if chars <= 0 or not self.units:
            return 0
        chars = min(chars, int(self.chars[-1]))
        u = int(np.searchsorted(self.chars, chars, side="left")) - 1
        return int(self.totals[u]) + self.inside[u][chars - int(self.chars[u]) + (u == 0) - 1]

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens."""
        u = int(np.searchsorted(self.totals, budget, side="right")) - 1
        if u >= len(self.units):
            return int(self.chars[-1])
        most = max((k for k, c in enumerate(self.inside[u], 1) if self.totals[u] + c <= budget), default=0)
        return max(0, int(self.chars[u]) + most - (u == 0))
