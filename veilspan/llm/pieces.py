"""A merge-type (BPE) piece vocabulary in its own right: units, merges, merge-dropout.

A unit is a run of space marks followed by other characters.  The vocabulary is
checked at load: no piece has a space mark after another character, so merges
never cross the start of a unit and units can be encoded one by one.
"""

from __future__ import annotations

import gc
import heapq
import re
import sys
from array import array
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
_SPACED = re.compile(" +[^ ]*")
_M64 = (1 << 64) - 1
#: Units up to the last of these lengths are merged in matrices of that many columns, so many rows at once.
WIDTHS = (4, 6, 8, 10, 12, 16, 24)
ROWS = 4_096


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def mixed(h: int, part: int) -> int:
    """A 64-bit hash with one more integer mixed in."""
    h = ((h ^ (part & _M64)) * 0xBF58476D1CE4E5B9) & _M64
    h ^= h >> 31
    h = (h * 0x94D049BB133111EB) & _M64
    return h ^ h >> 29


def mixed_all(h: int, parts: np.ndarray) -> np.ndarray:
    """mixed() of one hash with each of an array of unsigned integers."""
    out = (parts ^ np.uint64(h)) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ out >> np.uint64(29)


def keyed(*parts: int) -> int:
    """A 64-bit hash of integers, the same everywhere."""
    return reduce(mixed, parts, 0x9E3779B97F4A7C15)


@contextmanager
def rare_collections(young: int = 500_000):
    """Makes the cycle collector run seldom: merging makes many short lists and no cycles."""
    old = gc.get_threshold()
    gc.set_threshold(young, *old[1:])
    try:
        yield
    finally:
        gc.set_threshold(*old)


class Vocabulary:
    """Pieces, their ranks and byte pieces, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.path, self.library = path, sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        special = {i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        # Ranks of scores, the best first; pieces with one score share a rank.
        order = {x: r for r, x in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        # Agenda entries at place 0: rank and size; those of two characters apart.
        self.entries = {p: (order[sp.get_score(i)] << 52) | len(p) for p, i in self.ids.items()}
        self.pairs = {p: e for p, e in self.entries.items() if len(p) == 2}
        self.packed = {p: _packed([i]) for p, i in self.ids.items()}
        self._tables: tuple[np.ndarray, ...] | None = None
        #: Tables of remembered units, kept for the life of the process and bounded by those who fill them.
        self.caches: dict[tuple, dict] = {}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in special if sp.is_byte(i)}
        if len(self.byte_ids) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a vocabulary with byte pieces and without pieces across units is needed")
        probe = "  x ﬁ \n"
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("a vocabulary that leaves texts as they are is needed")
        # Bytes of each piece, for decoding.
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else (b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        sizes = np.array([len(b) for b in self.bytes])
        self._at, self._sizes, self._flat = np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.longest = max(map(len, self.ids))
        self._lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)

    # -- merging ---------------------------------------------------------

    def merge(self, text: Sequence[str], drop: int = 0, key: int = 0, trail: list[int] | None = None) -> list[str]:
        """Pieces of a run of characters after merging by an agenda, best score first, leftmost among equals.

        `drop` of 2**32 candidates are skipped: a candidate taken from the agenda is
        passed over when the hash of its place and size under `key` falls below `drop`.
        `trail` takes the merges made, in their order.
        An agenda entry is one integer: rank of the score, place, size.  A symbol is
        known by its place; `end` holds where it ends (0 once it is merged into
        another), `left` where the symbol before it starts.
        """
        s = text if isinstance(text, str) else "".join(text)
        n = len(s)
        if n < 2:
            return list(s)
        get, pop, push = self.entries.get, heapq.heappop, heapq.heappush
        agenda = [r | (i << 26) for i, r in enumerate(map(self.pairs.get, map(add, s, s[1:]))) if r is not None]
        if not agenda:
            return list(s)
        heapq.heapify(agenda)
        end, left = [*range(1, n + 1), 0], list(range(-1, n))
        key |= 1
        while agenda:
            entry = pop(agenda)
            i = (entry >> 26) & 0x3FFFFFF
            j = end[i]
            if not j or j == n or end[j] != i + (entry & 0x3FFFFFF):
                continue
            if drop and ((((entry & 0xFFFFFFFFFFFFF) + 0x9E3779B97F4A7C15) * key) >> 27 & 0xFFFFFFFF) < drop:
                continue
            if trail is not None:
                trail.append(entry & 0xFFFFFFFFFFFFF)
            end[i] = k = end[j]
            end[j] = 0
            if k < n:
                left[k] = i
                if (r := get(s[i : end[k]])) is not None:
                    push(agenda, r | (i << 26))
            if (h := left[i]) >= 0 and (r := get(s[h:k])) is not None:
                push(agenda, r | (h << 26))
        out, i = [], 0
        while i < n:
            out.append(s[i : end[i]])
            i = end[i]
        return out

    def _pair_tables(self) -> tuple[np.ndarray, ...]:
        """(symbol of each code point, sorted pairs of symbols, their merged symbols, ranks and sizes).

        A symbol is a piece's id, or -2 - c for a code point c that is no piece.
        """
        if self._tables is None:
            symbol = -2 - np.arange(0x110000, dtype=np.int64)
            merges = {}
            for p, i in self.ids.items():
                if len(p) == 1:
                    symbol[ord(p)] = i
                for k in range(1, len(p)):
                    a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                    if a is not None and b is not None:
                        merges[a << 32 | b] = (i, self.entries[p] >> 52, len(p))
            pairs = np.array(sorted(merges), dtype=np.int64)
            made = np.array([merges[x] for x in pairs.tolist()], dtype=np.int64).reshape(-1, 3)
            self._tables = symbol, pairs, *made.T.copy()
        return self._tables

    def encode_units(self, units: Sequence[str], drop: int, keys: np.ndarray) -> list[bytes]:
        """encode_unit() of many units: the agendas of units of like length are rows of one matrix, and each round takes the best entry of every row.

        A candidate is known by its place and size, so one that was passed over
        stays so, however often it would enter the agenda; rows then hold just
        the candidates that are not skipped.  Long units and units with space
        marks of the text itself are merged one by one.
        """
        out = self._in_matrices(units, drop, keys)
        return [self.encode_unit(units[i], drop, int(keys[i])) if got is None else got for i, got in enumerate(out)]

    def cut_units(self, units: Sequence[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(packed pieces, where the merges of each unit end, merges as place << 26 | size) of units without space marks, undropped."""
        made: list[tuple[np.ndarray, np.ndarray]] = []
        out = self._in_matrices(units, 0, np.zeros(len(units), dtype=np.uint64), made)
        for i in [i for i, got in enumerate(out) if got is None]:
            rest, trail = units[i].lstrip(" "), []
            pieces = self.merge(MARK * (len(units[i]) - len(rest)) + rest, trail=trail)
            out[i] = b"".join(map(self._packed_or_bytes, pieces))
            made.append((np.full(len(trail), i), np.array(trail, dtype=np.uint64)))
        owner = np.concatenate([np.empty(0, dtype=np.int64), *(a for a, _ in made)])
        merges = np.concatenate([np.empty(0, dtype=np.uint64), *(b for _, b in made)])
        order = np.argsort(owner, kind="stable")
        return out, np.cumsum(np.bincount(owner, minlength=len(units))), merges[order]

    def _in_matrices(self, units: Sequence[str], drop: int, keys: np.ndarray, made: list | None = None) -> list[bytes | None]:
        """Packed pieces of the units that matrices take, None for the others; `made` takes (unit, merge) of all merges."""
        out: list[bytes | None] = [None] * len(units)
        symbol = self._pair_tables()[0]
        widths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = symbol[np.where(points == 0x20, ord(MARK), points)]
        ends = np.cumsum(widths)
        plain = np.add.reduceat(points == ord(MARK), ends - widths) == 0 if len(units) else np.empty(0, dtype=bool)
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero(plain & (widths > low) & (widths <= width))
            low = width
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                place = np.arange(width)
                inside = place < widths[some, None]
                matrix = np.where(inside, symbols[np.minimum((ends - widths)[some, None] + place, len(symbols) - 1)], -1)
                trail: list | None = None if made is None else []
                for i, got in zip(some.tolist(), self._merge_rows(matrix, drop, keys[some], trail), strict=True):
                    out[i] = got
                if made is not None:
                    made += [(some[row], merge) for row, merge in trail]
        return out

    def _merge_rows(self, symbols: np.ndarray, drop: int, keys: np.ndarray, trail: list | None = None) -> list[bytes]:
        """Packed pieces of each row of symbols; rows are filled up with -1.  `trail` takes (rows, merges) of each round."""
        _, pairs, made, ranks, sizes = self._pair_tables()
        keys = (keys | np.uint64(1)).astype(np.uint64)
        none = np.int64(1 << 62)
        # Agenda entries by a pair's number: rank and merged symbol; the column stands between them.
        entries = (ranks << 40) | made
        draws = (sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) if drop else None

        def candidates(a: np.ndarray, b: np.ndarray, column: np.ndarray, key: np.ndarray) -> np.ndarray:
            """Agenda entries of neighbours a and b, a in `column`; `none` where they make no piece or are skipped."""
            wanted = (a << 32) | b
            k = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            good = np.flatnonzero((pairs[k] == wanted) & (a >= 0) & (b >= 0))
            k, column = k[good], column[good]
            out = np.full(len(a), none)
            out[good] = entries[k] | (column << 32)
            if drop:
                draw = (draws[k] + ((column - 1) << 26).astype(np.uint64)) * key[good]
                out[good[((draw >> np.uint64(27)) & np.uint64(0xFFFFFFFF)) < np.uint64(drop)]] = none
            return out

        # A symbol stays in the column where it starts, a bound of -1 at either side; `after` and `before` are the columns of its neighbours.
        n, width = symbols.shape[0], symbols.shape[1] + 2
        whole = np.full((n, width), -1, dtype=np.int64)
        whole[:, 1:-1] = symbols
        columns = np.arange(width, dtype=np.int64)
        result, alive = whole, np.arange(n)
        inner = np.broadcast_to(columns[1:-1], symbols.shape)
        agenda = np.full((n, width), none)
        agenda[:, 1:-1] = candidates(whole[:, 1:-1].ravel(), whole[:, 2:].ravel(), inner.ravel(), np.repeat(keys, width - 2)).reshape(n, width - 2)
        after, before = np.tile(np.minimum(columns + 1, width - 1), (n, 1)), np.tile(np.maximum(columns - 1, 0), (n, 1))
        while len(alive):
            best = agenda.argmin(axis=1)
            entry = agenda[np.arange(len(alive)), best]
            row = np.flatnonzero(entry < none)
            if 4 * len(row) < 3 * len(alive):
                result[alive] = whole
                alive, whole, agenda, after, before, keys, best, entry = alive[row], whole[row], agenda[row], after[row], before[row], keys[row], best[row], entry[row]
                row = np.arange(len(alive))
            if not len(row):
                break
            column, made_here, base = best[row], entry[row] & 0xFFFFFFFF, row * width
            if trail is not None:
                trail.append((alive[row], ((column - 1) << 26 | self._lengths[made_here]).astype(np.uint64)))
            at, flat, then, past, open_ = base + column, whole.reshape(-1), after.reshape(-1), before.reshape(-1), agenda.reshape(-1)
            gone = base + then[at]
            right, left = then[gone], past[at]
            flat[at], flat[gone], then[at], open_[gone] = made_here, -1, right, none
            past[base + right] = column
            new = candidates(np.concatenate([made_here, flat[base + left]]), np.concatenate([flat[base + right], made_here]), np.concatenate([column, left]), np.tile(keys[row], 2))
            open_[at], open_[base + left] = new[: len(row)], new[len(row) :]
        result[alive] = whole
        return self._packed_rows(result)

    def _packed_rows(self, rows: np.ndarray) -> list[bytes]:
        """Packed piece ids of rows of symbols, code points without a piece as byte pieces."""
        held = rows != -1
        flat, sizes = rows[held], np.ones(held.sum(), dtype=np.int64)
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            points, which = np.unique(-2 - flat[odd], return_inverse=True)
            spelled = [[self.byte_ids[b] for b in chr(c).encode()] for c in points.tolist()]
            table, lengths = np.array([(x * 4)[:4] for x in spelled]), np.array([len(x) for x in spelled])
            sizes[odd] = lengths[which]
            at = np.cumsum(sizes) - sizes
            out = np.repeat(flat, sizes)
            for j in range(4):
                some = lengths[which] > j
                out[at[odd[some]] + j] = table[which[some], j]
            flat = out
        data = flat.astype("<u4").tobytes()
        per_row = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(held.sum(axis=1))])]
        stops = (4 * per_row).tolist()
        return [data[a:b] for a, b in zip(stops, stops[1:])]  # noqa: B905

    def encode_unit(self, unit: str, drop: int = 0, key: int = 0) -> bytes:
        """Piece ids of a unit (its spaces written as blanks) as little-endian 32-bit values.

        A space mark that stands in the text itself goes to byte pieces, so that
        decoding gives it back.
        """
        if MARK not in unit and unit[1:2] != " ":
            pieces = self.merge(MARK + unit[1:], drop, key)
            out = list(map(self.packed.get, pieces))
            return b"".join(out) if None not in out else b"".join(map(self._packed_or_bytes, pieces))
        spaces = len(unit) - len(unit.lstrip(" "))
        out = []
        for k, part in enumerate(unit[spaces:].split(MARK)):
            if k:
                out.append(self._bytes_of(MARK))
            out += map(self._packed_or_bytes, self.merge(MARK * (spaces if k == 0 else 0) + part, drop, key + k))
        return b"".join(out)

    def _bytes_of(self, piece: str) -> bytes:
        return _packed([self.byte_ids[b] for b in piece.encode()])

    def _packed_or_bytes(self, piece: str) -> bytes:
        got = self.packed.get(piece)
        return self._bytes_of(piece) if got is None else got

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text, without the blank that stands before every text."""
        sizes = self._sizes[ids]
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        at = np.repeat(self._at[ids] - (ends - sizes), sizes) + np.arange(total)
        return self._flat[at].tobytes()[1:]

    # -- counting --------------------------------------------------------

    def units(self, text: str) -> list[str]:
        """Units as the library sees them: space marks are blanks; a blank stands before the text."""
        return _SPACED.findall(" " + text.replace(MARK, " ")) if text else []

    def unit_counts(self, units: list[str]) -> list[int]:
        # The library puts a mark before a text, but not before the empty text.
        return [max(1, len(x)) for x in self.library.encode([u[1:] for u in units], num_threads=1)] if units else []


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at `path`, loaded once a process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def spaced_units(text: str) -> list[str]:
    """Units of a text for lossless encoding; a blank stands before the text."""
    return _SPACED.findall(" " + text)


def text_runs(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about `most` bytes of text in their second column, or one row with more."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64))
    first = 0
    while first < len(batch):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
