"""Operator 13: byte-level BPE, encoding and decoding.

A text is cut into units by the vocabulary's pattern; each unit is encoded by
backtracking: from a place the longest token that starts there is taken, found
for all places of the unit by one pass of an Aho-Corasick automaton over its
bytes as Latin-1; if the token may not follow the one before it, the next
shorter token of the place is tried, and if none is left, the token before is
shortened and its place is never ended at again.  Each place is given up once at
most, so a unit takes time proportional to its length.  A sequence whose
neighbours all stay apart when merged alone is what the merges give for the
whole, so the result is exact.  Whether two tokens stay apart is read from their
merge trees: the last units of the left tree meet the first units of the right
tree in the order of ranks.  The answers, and the ids of units, are remembered
in bounded tables.

Narrow: no shuffle.  The path of the ranks is a parameter and is opened on the
executors.  Texts over `WINDOW` characters are cut into units window by window.

Defined results: a null or empty text has no tokens.  Repeated rows give
repeated results, null keys are kept, an empty table gives no rows.  Special
strings are ordinary text.  A unit that is a token is that token.  The pattern's
letters and numbers are those of the tiktoken library.  Other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import ahocorasick
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import text_runs

#: Units that each of a worker's two tables holds at most, the longest unit held, and pairs of tokens remembered at most.
REMEMBERED, LONGEST, PAIRS = 400_000, 64, 2_000_000
#: Bytes of text encoded together, and characters of a long text cut into units at a time.
RUN_BYTES, WINDOW = 4 << 20, 1 << 20
#: No letter or number is newer than the libraries before this character.
_LATE = re.compile("[԰-\U0010ffff]")


def _ranges(chars: Iterable[str]) -> str:
    """A character class body of the given characters."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Units:
    """Cuts texts by a pattern as the tiktoken library does, whose tables of letters and numbers may be older than those of `regex`."""

    def __init__(self, pattern: str):
        self.plain = self.exact = regex.compile(pattern)
        self.newer = None
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        single = {bytes([b]): b for b in range(256)}
        exact, newer = pattern, set()
        for name in (r"\p{L}", r"\p{N}"):
            library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
            extra = set(regex.findall(name, every)) - set(library.decode(library.encode_ordinary(every)))
            if extra:
                newer |= extra
                exact = self._without(exact, name, _ranges(extra))
        if newer:
            self.newer, self.exact = regex.compile(f"[{_ranges(newer)}]"), regex.compile(exact, regex.V1)

    @staticmethod
    def _without(pattern: str, name: str, body: str) -> str:
        """`pattern` with the class `name` less some characters, inside and outside of sets."""
        return pattern.replace(name, f"[{name}--[{body}]]")

    def pattern_for(self, text: str) -> regex.Pattern:
        if self.newer is None or text.isascii() or not _LATE.search(text) or not self.newer.search(text):
            return self.plain
        return self.exact

    def windows(self, text: str, size: int = WINDOW) -> Iterator[list[str]]:
        """Lists of units.  A unit that touches the end of a window may go on, so the next window starts with it."""
        pattern = self.pattern_for(text)
        if len(text) <= size:
            yield pattern.findall(text)
            return
        at, width = 0, size
        while at < len(text):
            end = min(len(text), at + width)
            found = [m.span() for m in pattern.finditer(text, at, end)]
            if end < len(text) and found and found[-1][1] == end:
                end = found.pop()[0]
            if not found and end == at:
                width *= 2
                continue
            yield [text[a:b] for a, b in found]
            at, width = end, size


class Ranks:
    """The merges of one vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {i: t for t, i in self.ids.items()}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("a vocabulary is needed that holds every byte")
        self.first, self.last = {}, {}
        automaton = ahocorasick.Automaton()
        made = set()
        for token, i in sorted(self.ids.items(), key=lambda x: x[1]):
            parts = self._parts(token, i)
            if len(parts) > 2:
                continue  # merging never makes this token, so only a unit equal to it becomes it
            made.add(token)
            left, right = (self.ids[parts[0]], self.ids[parts[-1]])
            self.first[i] = (*self.first[left], i) if len(parts) == 2 else (i,)
            self.last[i] = (*self.last[right], i) if len(parts) == 2 else (i,)
            automaton.add_word(token.decode("latin-1"), (i, len(token)))
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter = {}
        for token in made:
            cut = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in made), None)
            self.shorter[self.ids[token]] = self.ids[cut] if cut else -1
        self.sizes = {i: len(t) for i, t in self.tokens.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _parts(self, token: bytes, rank: int) -> list[bytes]:
        """What the merges of lower ranks leave of a token."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, k = min(((self.ids.get(a + b, rank), k) for k, (a, b) in enumerate(pairwise(parts))))
            if best >= rank:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b next to each other as they are.

        Along the boundary the ends of a grow by `last[a]` and the beginnings of b by
        `first[b]`, the lower rank first; the two stay apart if no pair that meets on the
        way would merge before one of its parts grows.  Of equal ranks the left one merges first.
        """
        ends, begins, i, j = self.last[a], self.first[b], 0, 0
        while True:
            left = ends[i + 1] if i + 1 < len(ends) else None
            right = begins[j + 1] if j + 1 < len(begins) else None
            met = self.ids.get(self.tokens[ends[i]] + self.tokens[begins[j]])
            if met is not None and (left is None or met < left) and (right is None or met <= right):
                return False
            if left is None and right is None:
                return True
            if right is None or (left is not None and left <= right):
                i += 1
            else:
                j += 1

    def may_follow(self, a: int, b: int) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[a, b] = self.stay_apart(a, b)
        return known

    def unit(self, data: bytes) -> list[int]:
        """The tokens of one unit."""
        if data in self.ids:
            return [self.ids[data]]
        longest = [0] * len(data)
        for end, (i, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size] = i  # of tokens that start at one place the longest ends last
        out: list[int] = []
        open_at = bytearray(b"\1") * (len(data) + 1)
        at, token = 0, longest[0]
        while at < len(data):
            while token >= 0 and not (open_at[at + self.sizes[token]] and (not out or self.may_follow(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.sizes[token]
                token = longest[at] if at < len(data) else -1
            else:
                open_at[at] = 0
                token = out.pop()
                at -= self.sizes[token]
        return out

    def encode(self, units: list[str]) -> list[int]:
        young, old = self.young, self.old
        if len(young) > REMEMBERED:
            self.young, self.old = young, old = {}, young
        long = {}
        for u in set(units).difference(young):
            ids = old.get(u) or tuple(self.unit(u.encode()))
            (young if len(u) <= LONGEST else long)[u] = ids
        look = young.__getitem__ if not long else lambda u: long[u] if len(u) > LONGEST else young[u]
        return list(chain.from_iterable(map(look, units)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[object, object] = {}


def ranks(path: str) -> Ranks:
    """The vocabulary at `path`, loaded once a worker."""
    if path not in _LOADED:
        _LOADED[path] = Ranks(path)
    return _LOADED[path]


def units(pattern: str) -> Units:
    if ("pattern", pattern) not in _LOADED:
        _LOADED["pattern", pattern] = Units(pattern)
    return _LOADED["pattern", pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, cutter = ranks(path), units(pattern)
        for batch in batches:
            for part in text_runs(batch, RUN_BYTES):
                rows = [[i for window in cutter.windows(t or "") for i in merges.encode(window)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32()))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data binary): the bytes of token ids, which need not be whole characters; null ids have none.  An unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = ranks(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([merges.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], ["key", "data"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(ids).cast("array<int>")).mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from them; a long text is held a window at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, cutter = ranks(path), units(pattern)
        written = {i: str(i).encode() for i in merges.tokens}.__getitem__
        for batch in batches:
            for part in text_runs(batch, RUN_BYTES):
                counts, of_ids, of_bytes = [], [], []
                for t in part.column(1).to_pylist():
                    n, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
                    for window in cutter.windows(t or ""):
                        ids = merges.encode(window)
                        if n and ids:
                            listed.update(b",")
                        n += len(ids)
                        listed.update(b",".join(map(written, ids)))
                        decoded.update(merges.decode(ids))
                    counts.append(n)
                    of_ids.append(listed.hexdigest())
                    of_bytes.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
