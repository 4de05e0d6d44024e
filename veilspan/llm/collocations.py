"""Operator 12: phrase collocation mining with depth-limited count tries.

Each task turns runs of texts into shards: the five words from every place
inside a piece, sorted, make a trie of depth five with counts.  A shard is
serialised in order, each row as what it does not share with the row before, and
cut into prefix ranges.  The blobs of a range meet in one group and are merged in
order; walking the merged trie gives each phrase its count and those of its
first parts.  Nodes at the margin of a range may go on in its neighbours and are
summed once more.  The right part of a cut is found by following suffix links,
each the phrase without its first words, as a join on keys.

A phrase met any number of times in a shard is one row there, so a frequent
phrase, word or text costs each shard one row.  Ranges are cut at tuples of a
bounded sample, wherever these are in depth; it balances groups and decides no
result.  There are at most `RANGES` ranges; above that the rows of each range are
dealt further by their first words, to groups of one size.

Words are compared by 64-bit hashes of their bytes (see `textcore`).  Products
are exact decimals.

Defined results: null or empty texts have no words; a null language is `und`.
Repeated rows count again.  A phrase does not cross a separator or the end of its
text.  Ties in score and count go by the phrase's UTF-8 bytes, of cuts by the
shorter first part.  An empty table gives no rows.  A text may be of any length:
long ones are read window by window, with the words that follow.  Other columns
do not matter.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import text_bytes
from .pieces import text_runs
from .tables import cut, if_small
from .textcore import _LOWER, byte_hashes, mix, raw_text

#: Words of a phrase at most.
DEPTH = 5
#: Bytes of text read together, words of a shard of one language at most; all shards of a task together hold twice as many.
RUN_BYTES, SHARD_WORDS = 4 << 20, 1_000_000
#: Bytes of text for a group of the merge; ranges at most; bytes of the sample that cuts ranges, and one of how many of its tuples is taken.
GROUP_BYTES, RANGES, SAMPLE_BYTES, SAMPLE_THIN = 8 << 20, 8192, 24 << 20, 8
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True


@dataclass
class Words:
    """Words of one language in order: hashes, pieces they stand in, and their bytes."""

    hashes: np.ndarray
    pieces: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def last(self, n: int) -> Words:
        return Words(self.hashes[-n:], self.pieces[-n:], self.data, self.starts[-n:], self.ends[-n:])


def read_words(data: np.ndarray, at: np.ndarray) -> Words:
    """The words of some texts; pieces are numbered upwards."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_GAP[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge], ends[edge - 1] = inside[1:-1][edge], inside[1:-1][edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    pieces = np.cumsum(_BREAK[data], dtype=np.int64)[starts] + np.searchsorted(at, starts, side="right")
    hashes = byte_hashes(data, starts, stops)
    hashes[hashes == 0] = 1
    return Words(hashes, pieces, data, starts.astype(np.int32), stops.astype(np.int32))


def windows(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[Words, bool]]:
    """The words of some texts, and whether their last text goes on; a single long text comes in windows that end between words."""
    if len(at) != 2 or len(data) <= size:
        yield read_words(data, at), False
        return
    first, pieces = 0, 0
    while first < len(data):
        last = min(len(data), first + size)
        while last < len(data) and not _GAP[data[last]]:
            gap = np.flatnonzero(_GAP[data[last : last + size]])
            last = last + int(gap[0]) if len(gap) else min(len(data), last + size)
        words = read_words(data[first:last], np.array([0, last - first]))
        words.pieces += pieces
        pieces += int(_BREAK[data[first:last]].sum())
        yield words, last < len(data)
        first = last


def tuples(ids: np.ndarray, pieces: np.ndarray, count: int) -> list[np.ndarray]:
    """Columns of the first `count` places: the word and those that follow in its piece, 0 after its end."""
    columns = []
    for k in range(DEPTH):
        column = np.zeros(count, dtype=ids.dtype)
        n = max(0, min(count, len(ids) - k))
        column[:n] = np.where(pieces[k : k + n] == pieces[:n], ids[k : k + n], 0)
        columns.append(column)
    return columns


def _bits(hashes: np.ndarray) -> int:
    """Bits for the numbers of words, and for one beyond them."""
    return (len(hashes) + 1).bit_length()


def packed(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Columns of small numbers as few sort keys, the first one first."""
    each = 64 // max(1, bits)
    keys = []
    for k in range(0, len(columns), each):
        key = np.zeros(len(columns[0]), dtype=np.uint64)
        for column in columns[k : k + each]:
            key = key << np.uint64(bits) | column.astype(np.uint64)
        keys.append(key)
    return keys


def in_order(columns: list[np.ndarray], bits: int, counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns, lcp, counts) of distinct rows in order; lcp: columns that a row shares with the one before."""
    order = np.lexsort(packed(columns, bits)[::-1])
    columns = [c[order] for c in columns]
    same, lcp = np.ones(len(order), dtype=bool), np.zeros(len(order), dtype=np.int8)
    same[:1] = False
    for c in columns:
        same[1:] &= c[1:] == c[:-1]
        lcp += same
    first = np.flatnonzero(lcp < DEPTH)
    counts = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return [c[first] for c in columns], lcp[first], counts.astype(np.int64)


def _planes(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").reshape(-1)


def write_blob(columns: list[np.ndarray], lcp: np.ndarray, counts: np.ndarray, hashes: np.ndarray, names: list[bytes]) -> bytes:
    """Rows of a trie in order; words are numbers from 1 into ascending `hashes`, and `names` are the bytes of all first words, in order."""
    lcp = lcp.copy()
    lcp[:1] = 0
    rest = np.stack(columns, axis=1)[np.arange(DEPTH) >= lcp[:, None]]
    parts = [lcp.astype(np.uint8).tobytes(), _planes(counts, 8), _planes(rest, 4), _planes(np.diff(hashes, prepend=np.uint64(0)), 8), b"\n".join(names)]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<5q", *map(len, parts)) + b"".join(parts))


def read_blob(blob: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[bytes]]:
    """(columns, counts, hashes, names)."""
    data, parts = zstandard.ZstdDecompressor().decompress(blob), []
    at = 40
    for size in struct.unpack("<5q", data[:40]):
        parts.append(data[at : at + size])
        at += size
    lcp = np.frombuffer(parts[0], dtype=np.uint8).astype(np.int64)
    rest, rows = _from_planes(parts[2], 4), np.arange(len(lcp))
    begin = np.cumsum(DEPTH - lcp) - (DEPTH - lcp)
    columns = []
    for k in range(DEPTH):
        from_row = np.maximum.accumulate(np.where(lcp <= k, rows, 0))
        columns.append(rest[begin[from_row] + k - lcp[from_row]].astype(np.int32))
    return columns, _from_planes(parts[1], 8).astype(np.int64), np.cumsum(_from_planes(parts[3], 8), dtype=np.uint64), parts[4].split(b"\n")


def cuts_in(columns: list[np.ndarray], hashes: np.ndarray, borders: np.ndarray, bits: int) -> np.ndarray:
    """For each border tuple of hashes the first row that is not before it."""
    exact, numbers = np.ones(len(borders), dtype=bool), []
    for k in range(DEPTH):
        h = borders[:, k]
        at = np.searchsorted(hashes, h)
        found = (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == h)
        numbers.append(np.where(exact & (h > 0), at + 1, 0))  # a word that the shard lacks: from the next one on
        exact &= found & (h > 0)
    keys, wanted = packed(columns, bits), packed(numbers, bits)
    low, high = np.zeros(len(borders), dtype=np.int64), np.full(len(borders), len(columns[0]), dtype=np.int64)
    for key, want in zip(keys, wanted, strict=True):
        for i in np.flatnonzero(low < high).tolist():
            a, b = low[i], high[i]
            low[i], high[i] = a + np.searchsorted(key[a:b], want[i]), a + np.searchsorted(key[a:b], want[i], side="right")
    return low


@dataclass
class Shard:
    """Words of one language that wait to become a trie."""

    parts: list[Words] = field(default_factory=list)
    size: int = 0
    pieces: int = 0

    def add(self, words: Words) -> None:
        if len(words.hashes):
            words.pieces += self.pieces
            self.parts.append(words)
            self.size += len(words.hashes)

    def text_ends(self) -> None:
        if self.parts:
            self.pieces = int(self.parts[-1].pieces[-1]) + 1

    def trie(self, more: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, dict[int, bytes]]:
        """(columns, lcp, counts, hashes, names by number); where the text goes on, the last words stay for the next shard."""
        h, p = (np.concatenate([getattr(w, name) for w in self.parts]) for name in ("hashes", "pieces"))
        hashes, first, numbers = np.unique(h, return_index=True, return_inverse=True)
        ends = np.cumsum([len(w.hashes) for w in self.parts])
        names = {}
        for i, place in enumerate(first.tolist()):
            k = int(np.searchsorted(ends, place, side="right"))
            w, j = self.parts[k], place - (int(ends[k - 1]) if k else 0)
            names[i + 1] = w.data[w.starts[j] : w.ends[j]].tobytes()
        kept = min(DEPTH - 1, len(h)) if more else 0
        columns = tuples(numbers.astype(np.int32) + np.int32(1), p, len(h) - kept)
        hold = Words(h[-kept:], p[-kept:], *_held(self.parts, kept)) if kept else None
        self.parts, self.size = ([hold], kept) if hold else ([], 0)
        return *in_order(columns, _bits(hashes)), hashes, names


def _held(parts: list[Words], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the last n words on their own."""
    spelled = [w.data[a:b] for w in parts[-n:] for a, b in zip(w.starts[-n:], w.ends[-n:], strict=True)][-n:]
    ends = np.cumsum([len(s) for s in spelled])
    return np.concatenate(spelled), ends - [len(s) for s in spelled], ends


def _records(lang: str, shard: Shard, more: bool, borders: np.ndarray, deal: np.ndarray, groups: int) -> Iterator[tuple[str, int, int, bytes]]:
    """(lang, range, group, blob) of one shard."""
    columns, lcp, counts, hashes, names = shard.trie(more)
    if not len(counts):
        return
    at = np.concatenate([[0], cuts_in(columns, hashes, borders, _bits(hashes)), [len(counts)]]).astype(np.int64)
    for r in np.flatnonzero(np.diff(at)).tolist():
        rows = np.arange(at[r], at[r + 1])
        of = _dealt(columns, hashes, rows, int(deal[r]), groups)
        for g in np.unique(of).tolist():
            mine = rows[of == g]
            own = [c[mine] for c in columns]
            shared = np.zeros(len(mine), dtype=np.int64)
            same = np.ones(max(0, len(mine) - 1), dtype=bool)
            for c in own:
                same &= c[1:] == c[:-1]
                shared[1:] += same
            used = np.unique(np.concatenate(own))
            used = used[used > 0]
            numbered = np.zeros(len(hashes) + 1, dtype=np.int64)
            numbered[used] = np.arange(1, len(used) + 1)
            yield lang, r, g, write_blob([numbered[c] for c in own], shared, counts[mine], hashes[used - 1], [names[i] for i in np.unique(own[0]).tolist()])


def _dealt(columns: list[np.ndarray], hashes: np.ndarray, rows: np.ndarray, depth: int, groups: int) -> np.ndarray:
    if groups == 1:
        return np.zeros(len(rows), dtype=np.int64)
    spelled, h = np.concatenate([np.zeros(1, dtype=np.uint64), hashes]), np.zeros(len(rows), dtype=np.uint64)
    for c in columns[:depth]:
        h = mix(h + spelled[c[rows]] + np.uint64(1))
    return (h % np.uint64(groups)).astype(np.int64)


def _sorted_texts(batch: pa.RecordBatch, run_bytes: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, bytes, offsets) for runs of rows of one language."""
    langs = batch.column(0).dictionary_encode()
    of = np.asarray(langs.indices)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        for part in text_runs(batch.take(pa.array(np.flatnonzero(of == k))), run_bytes):
            data, at = raw_text(part.column(1))
            yield lang, data, at


def shard_tries(texts: DataFrame, borders: dict[str, np.ndarray], groups: int, shard_words: int = SHARD_WORDS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(lang, range, group, blob): the tries of all shards, cut into ranges."""
    none = np.empty((0, DEPTH), dtype=np.uint64)
    deal = {lang: split_depths(b) for lang, b in borders.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}

        def written(lang: str, more: bool) -> Iterator[pa.RecordBatch]:
            shard = shards[lang]
            rows = _records(lang, shard, more, borders.get(lang, none), deal.get(lang, split_depths(none)), groups)
            for x in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(x, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["lang", "range", "group", "blob"])

        for batch in batches:
            for lang, data, at in _sorted_texts(batch, run_bytes):
                shard = shards.setdefault(lang, Shard())
                for words, more in windows(data, at, run_bytes):
                    if shard.size and shard.size + len(words.hashes) > shard_words:
                        yield from written(lang, bool(shard.parts) and shard.pieces <= int(shard.parts[-1].pieces[-1]))
                    shard.add(words)
                    if not more:
                        shard.text_ends()
                if sum(s.size for s in shards.values()) > 2 * shard_words:
                    for other in list(shards):
                        if shards[other].size:
                            yield from written(other, False)
        for lang in list(shards):
            if shards[lang].size:
                yield from written(lang, False)

    return texts.mapInArrow(run, "lang string, range int, group int, blob binary")


def split_depths(borders: np.ndarray) -> np.ndarray:
    """For each range the words by which its rows are dealt to groups: two more than its two ends share."""
    shared = np.zeros(len(borders) + 1, dtype=np.int64)
    if len(borders) > 1:
        shared[1:-1] = np.cumprod(borders[1:] == borders[:-1], axis=1).sum(axis=1)
    return np.minimum(DEPTH, shared + 2)


def sampled_borders(texts: DataFrame, total: int, ranges: int) -> dict[str, np.ndarray]:
    """Tuples that cut the order of languages and tuples into about `ranges` ranges of one size, from a bounded sample."""
    if ranges < 2:
        return {}
    rate, thin = min(1.0, SAMPLE_BYTES / max(1, total)), np.uint64(SAMPLE_THIN if total > 64 * ranges * SAMPLE_THIN * 6 else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data, at in _sorted_texts(batch, RUN_BYTES):
                words = read_words(data, at)
                rows = np.stack(tuples(words.hashes, words.pieces, len(words.hashes)), axis=1)
                h = np.zeros(len(rows), dtype=np.uint64)
                for k in range(DEPTH):
                    h = mix(h + rows[:, k] + np.uint64(1))
                taken = np.unique(rows[h % thin == 0].astype(">u8").view(f"S{8 * DEPTH}"))
                spelled = np.frombuffer(taken.tobytes(), dtype=np.uint8)
                keys = pa.Array.from_buffers(pa.binary(), len(taken), [None, pa.py_buffer(np.arange(len(taken) + 1, dtype=np.int32) * 8 * DEPTH), pa.py_buffer(spelled)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(taken), pa.string()), keys], ["lang", "key"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).withColumn("text", F.substring("text", 1, 1 << 20))
    got = some.mapInArrow(run, "lang string, key binary").distinct().toArrow().sort_by([("lang", "ascending"), ("key", "ascending")])
    picks = np.unique(np.linspace(0, len(got), ranges + 1).astype(np.int64)[1:-1])
    out: dict[str, list[bytes]] = {}
    for lang, key in zip(*(got.column(k).take(pa.array(picks)).to_pylist() for k in (0, 1)), strict=True) if len(got) else ():
        out.setdefault(lang, []).append(key)
    return {lang: np.frombuffer(b"".join(keys), dtype=">u8").reshape(-1, DEPTH).astype(np.uint64) for lang, keys in out.items()}


def _keys(columns: list[np.ndarray]) -> pa.Array:
    """Phrases as binary keys: the hashes of their words, eight bytes each."""
    n, size = len(columns[0]) if columns else 1, 8 * len(columns)
    spelled = np.stack(columns, axis=1).astype(">u8").tobytes() if columns else b""
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(spelled)])


def merged_nodes(blobs: list[bytes], least: int, open_depth: int) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray, list[bytes] | None]]:
    """(keys, size, counts, counts of first parts, words) of the nodes of merged tries.

    Nodes of at least `least` occurrences, and those that other groups may hold too:
    the first and the last of each depth, and all up to `open_depth`.  A first part
    that other groups may hold counts -1.
    """
    read = [read_blob(b) for b in blobs]
    hashes = np.unique(np.concatenate([r[2] for r in read]))
    columns, names = [[] for _ in range(DEPTH)], {}
    for own, _, have, words in read:
        number = np.concatenate([[0], np.searchsorted(hashes, have) + 1]).astype(np.int32)
        for k in range(DEPTH):
            columns[k].append(number[own[k]])
        names.update(zip(number[np.unique(own[0])].tolist(), words, strict=True))
    columns, lcp, counts = in_order([np.concatenate(c) for c in columns], _bits(hashes), np.concatenate([r[1] for r in read]))
    yield _keys([]), 0, np.array([counts.sum()]), np.empty((1, 0), dtype=np.int64), None
    spelled = np.concatenate([np.zeros(1, dtype=np.uint64), hashes])
    of_row: list[np.ndarray] = []  # counts of each row's nodes by depth, -1 where open
    for d in range(1, DEPTH + 1):
        start = np.flatnonzero(lcp < d)
        n = np.add.reduceat(counts, start)
        real = columns[d - 1][start] > 0
        open_ = np.full(len(start), d <= open_depth)
        open_[0] = open_[-1] = True
        take = np.flatnonzero(real & (open_ | (n >= least)))
        at = start[take]
        left = np.stack([c[at] for c in of_row], axis=1) if of_row else np.empty((len(take), 0), dtype=np.int64)
        yield _keys([spelled[c[at]] for c in columns[:d]]), d, n[take], left, [names[i] for i in columns[0][at].tolist()] if d == 1 else None
        of_row.append(np.repeat(np.where(open_, -1, n), np.diff(np.append(start, len(counts)))))


def phrase_counts(tries: DataFrame, least: int, borders: dict[str, np.ndarray], groups: int) -> DataFrame:
    """(lang, key, size, n, left, word): phrases of `least` occurrences or more, and of size 0 all words of each language."""
    deal = {lang: split_depths(b) for lang, b in borders.items()}

    def merge(table: pa.Table) -> pa.Table:
        lang, at = table["lang"][0].as_py(), table["range"][0].as_py()
        depth = 0 if groups == 1 else int(deal.get(lang, split_depths(np.empty((0, DEPTH))))[at]) - 1
        out = []
        for keys, size, n, left, words in merged_nodes(table["blob"].to_pylist(), least, depth):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * left.shape[1], pa.int32()), pa.array(left.reshape(-1), pa.int64()))
            spelled = pa.array(words, pa.binary()).cast(pa.string()) if words is not None else pa.nulls(len(n), pa.string())
            out.append(pa.table([pa.array([lang] * len(n), pa.string()), keys, pa.array(np.full(len(n), size), pa.int32()), pa.array(n, pa.int64()), lists, spelled], names=["lang", "key", "size", "n", "left", "word"]))
        return pa.concat_tables(out)

    nodes = tries.groupBy("lang", "range", "group").applyInArrow(merge, "lang string, key binary, size int, n long, left array<long>, word string")
    summed = nodes.groupBy("lang", "key", "size").agg(F.sum("n").alias("n"), F.max("left").alias("left"), F.max("word").alias("word"))
    return summed.where((F.col("n") >= least) | (F.col("size") == 0))


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)); 41 digits are never reached with counts below 10^17."""
    big = lambda x: x.cast("decimal(18,0)")
    return F.call_function("div", big(a) * F.lit(1000).cast("decimal(4,0)") * big(n), big(left) * big(right))


def mine(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS, group_bytes: int = GROUP_BYTES, ranges: int = RANGES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by their lowest-scoring cut."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = text_bytes(texts, "text")
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / group_bytes))
    groups = math.ceil(wanted / ranges)
    borders = sampled_borders(texts, total, min(wanted, ranges))
    frequent = cut(phrase_counts(shard_tries(texts, borders, groups, shard_words), least, borders, groups))

    phrases, sizes = frequent.where("size > 1").withColumnRenamed("n", "a"), frequent.where("size = 0").select("lang", F.col("n").alias("all"))
    links = phrases.select("lang", "key", F.explode(F.expr("sequence(1, size - 1)")).alias("k"), "left")
    suffixes = links.select("lang", "key", F.lit("r").alias("side"), "k", F.expr("substring(key, 8 * k + 1)").alias("part"))
    walked = links.where("left[k - 1] < 0").select("lang", "key", F.lit("l").alias("side"), "k", F.expr("substring(key, 1, 8 * k)").alias("part"))
    found = suffixes.unionByName(walked).join(frequent.select("lang", F.col("key").alias("part"), F.col("n").alias("of")), ["lang", "part"])
    by_key = found.groupBy("lang", "key").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("k", "of")))).alias(s) for s in "lr"))
    cuts = phrases.join(by_key, ["lang", "key"]).join(if_small(sizes), "lang")
    left = lambda k: F.when(F.element_at("left", k) < 0, F.element_at("l", k)).otherwise(F.element_at("left", k))
    each = F.transform(F.expr("sequence(1, size - 1)"), lambda k: F.struct(score(F.col("a"), F.col("all"), left(k), F.element_at("r", k)).alias("score"), k.alias("k"), left(k).alias("l"), F.element_at("r", k).alias("r")))
    scored = cut(cuts.select("lang", "key", "size", "a", F.col("all").alias("n"), F.array_min(each).alias("best"), left(F.col("size") - 1).alias("head"), F.element_at("r", F.lit(1)).alias("tail")))

    held = F.array(F.when(F.col("head") == F.col("a"), F.expr("substring(key, 1, 8 * (size - 1))")), F.when(F.col("tail") == F.col("a"), F.expr("substring(key, 9)")))
    within = scored.where("size > 2").select("lang", F.explode(held).alias("key")).where("key is not null").distinct()
    kept = scored.join(within, ["lang", "key"], "left_anti").select("lang", "key", "size", "a", "n", "best.*")
    first = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    words = frequent.where("size = 1").select("lang", F.col("key").alias("one"), "word")
    spelled = first.select("lang", "key", F.posexplode(F.expr("transform(sequence(0, size - 1), i -> substring(key, 8 * i + 1, 8))")).alias("at", "one")).join(words, ["lang", "one"])
    phrase = spelled.groupBy("lang", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first.join(phrase, ["lang", "key"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
