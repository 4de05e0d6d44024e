"""Operator 8: benchmark decontamination by greedy string tiling.

Documents and benchmark items become words (lower case A-Z, ASCII punctuation
as blanks).  Runs of `seed` words shared by a document and an item are the
seeds, found by rolling hashes (Karp-Rabin) against a sorted table of the
items.  Seeds on one diagonal join into maximal matches, of which only the two
ends are ever held; the longest match
whose words are all free is marked, overlapped matches are cut back to their
free parts, and so on until no match of the least length is left.  The share
of an item's words that is tiled is its coverage; an item at or over the
threshold contaminates the document.  As tiles may lie in any order, reordered
passages are caught.

The item table goes to the executors in blocks of at most `BLOCK_BYTES` of item
text (a checked size); more items make more blocks.  All blocks are looked up
in one pass over each batch of documents, one block in memory at a time.
Narrow over the documents.

Defined results: a null or empty text, or an item without words, is never
contaminated or covered.  Items shorter than the seed must occur as a whole.
Ties between items are resolved by the smaller id, ties between matches by the
earlier place in the document.  Repeated rows and rows with null ids give one
result each, however many blocks there are; rows of one item id are one item as
long as the longest of them.  An item without an id is an item of its own, comes
after all ids and is reported as null (`best_coverage` tells it from no item at
all).  Item ids of another type than an integer are refused.  Texts and words of
any length are compared whole, in one task, whose memory follows the text and the
number of maximal matches, not the number of shared seeds.  An empty table of
documents gives no rows, an empty benchmark contaminates nothing.  Columns of
`docs` named like those returned do not matter; `carry` must not name them.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import _LOWER, Slice, ngrams, raw_text, slices, word_bounds

SEED = 5
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
_PLAIN = _LOWER.copy()
_PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32
_BITS = 20
#: Shared seeds that are held at a time.
SEEDS = 1_000_000
_RETURNED = ("contaminated", "item_ids", "best_item", "best_coverage")


def plain_slices(batches, text: str, key: str) -> Iterator[Slice]:
    for part in slices(batches, text, key, lower=False):
        data = _PLAIN[part.data]
        starts, ends = word_bounds(data, part.text_at)
        yield Slice(part.ids, part.rows, data, part.text_at, starts, ends, np.searchsorted(starts, part.text_at))


def tile(matches: list[tuple[int, int, int]] | np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (document start, item start, length), greedily longest first, from maximal matches of the same form.

    Once no free run of `least` words is left in the item, the remaining matches are not looked at.
    """
    found = np.asarray(matches, dtype=np.int64).reshape(-1, 3)
    found = found[found[:, 2] >= least]
    if not len(found):
        return []
    found = found[np.lexsort((found[:, 1], found[:, 0], -found[:, 2]))]
    reached = np.zeros(int((found[:, 1] + found[:, 2]).max()) + 2, dtype=np.int64)
    np.add.at(reached, found[:, 1] + 1, 1)
    np.add.at(reached, found[:, 1] + found[:, 2] + 1, -1)
    edges = np.flatnonzero(np.diff((np.cumsum(reached) > 0).astype(np.int8)))
    free = [(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2], strict=True)]  # runs of the item that matches reach, ascending
    taken: list[tuple[int, int]] = []  # runs of the document, ascending
    parts: list[tuple[int, int, int]] = []  # what is left of matches that were overlapped
    out, at = [], 0
    while free and (at < len(found) or parts):
        head = (-int(found[at, 2]), int(found[at, 0]), int(found[at, 1])) if at < len(found) else None
        if head is None or parts and parts[0] < head:
            head = heapq.heappop(parts)
        else:
            at += 1
        n, i, j = -head[0], head[1], head[2]
        left = []
        k = bisect.bisect_right(free, (j, math.inf)) - 1
        for x, y in itertools.takewhile(lambda r: r[0] < j + n, itertools.islice(free, max(k, 0), None)):
            x, y = max(x, j) - j, min(y, j + n) - j
            d = max(bisect.bisect_right(taken, (i + x, math.inf)) - 1, 0)
            for u, v in itertools.takewhile(lambda r: r[0] < i + y, itertools.islice(taken, d, None)):
                left.append((x, u - i))
                x = max(x, v - i)
            left.append((x, y))
        left = [(x, y) for x, y in left if y - x >= least]
        if left == [(0, n)]:
            out.append((i, j, n))
            bisect.insort(taken, (i, i + n))
            k = bisect.bisect_right(free, (j, math.inf)) - 1
            x, y = free[k]
            free[k : k + 1] = [r for r in ((x, j), (j + n, y)) if r[1] - r[0] >= least]
        else:
            for x, y in left:
                heapq.heappush(parts, (x - y, i + x, j + x))
    return out


class Table:
    """The seeds of one length: hashes in the order of the items, and their sorted order."""

    def __init__(self, length: int, grams: list[np.ndarray], numbers: list[int]):
        self.length, self.gram = length, np.concatenate(grams)
        sizes = np.array([len(g) for g in grams])
        self.item = np.repeat(np.array(numbers, dtype=np.int32), sizes)
        first = np.cumsum(sizes) - sizes
        self.place = (np.arange(len(self.gram)) - np.repeat(first, sizes)).astype(np.int32)
        self.head = self.place == 0
        self.tail = np.append(self.head[1:], True)
        self.order = np.argsort(self.gram, kind="stable").astype(np.int32)
        self.sorted = self.gram[self.order]
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[self.gram & np.uint64((1 << _BITS) - 1)] = True


class Items:
    """Seeds of benchmark items (id, text), a table for each seed length; `names` are the ids, ascending, null ones last."""

    def __init__(self, items: list[tuple[int | None, str]], seed: int):
        items = sorted({(i, t) for i, t in items if t}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.tables: list[Table] = []
        self.names: list[int | None] = []
        sizes: list[int] = []
        found: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        if items:
            data, at = raw_text(pa.array([t for _, t in items], pa.string()))
            data = _PLAIN[data]
            starts, ends = word_bounds(data, at)
            part = Slice([i for i, _ in items], None, data, at, starts, ends, np.searchsorted(starts, at))
            words = part.word_hashes()
            for k, (i, _) in enumerate(items):
                w = words[part.docs[k] : part.docs[k + 1]]
                if len(w):
                    if i is None or not self.names or self.names[-1] != i:
                        self.names.append(i)
                        sizes.append(0)
                    sizes[-1] = max(len(w), sizes[-1])
                    grams, numbers = found[min(seed, len(w))]
                    grams.append(ngrams(w, min(seed, len(w))))
                    numbers.append(len(sizes) - 1)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.tables = [Table(m, *found[m]) for m in sorted(found)]


def _matches(part: Slice, table: Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (row, item, place in the document, place in the item, words) of maximal matches, some whole rows at a time.

    Of the seeds only those that begin or end a match are kept: the first of a match
    has no seed one word before it in both texts, the last none after it.  The k-th
    beginning and the k-th end on a diagonal belong together.  Seeds are made
    `SEEDS` at a time, also inside of one row.
    """
    m, h = table.length, ngrams(part.word_hashes(), table.length)
    at = np.flatnonzero(table.bitmap[h & np.uint64((1 << _BITS) - 1)])
    low = np.searchsorted(table.sorted, h[at])
    at = at[table.sorted[np.minimum(low, len(table.sorted) - 1)] == h[at]]
    rows = np.searchsorted(part.docs, at, side="right") - 1
    inside = at + m <= part.docs[rows + 1]
    at, rows = at[inside], rows[inside]
    low = np.searchsorted(table.sorted, h[at])
    n = np.searchsorted(table.sorted, h[at], side="right") - low
    total = np.cumsum(n)
    begins, ends = [], []
    first, held = 0, 0
    while first < len(at):
        before = int(total[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + SEEDS, side="right")))
        if last < len(at) and rows[last] == rows[last - 1] and rows[last] != rows[first]:
            last = int(np.searchsorted(rows, rows[last]))  # back to the end of a row
        size = n[first:last]
        k = np.arange(int(size.sum())) + np.repeat(low[first:last] - (np.cumsum(size) - size), size)
        gram, place, row = table.order[k], np.repeat(at[first:last], size), np.repeat(rows[first:last], size)
        begin = table.head[gram] | (place == part.docs[row])
        begin[~begin] = table.gram[gram[~begin] - 1] != h[place[~begin] - 1]
        end = table.tail[gram] | (place + m >= part.docs[row + 1])
        end[~end] = table.gram[gram[~end] + 1] != h[place[~end] + 1]
        begins.append((gram[begin], place[begin]))
        ends.append((gram[end], place[end]))
        held += int(begin.sum())
        del k, gram, place, row, begin, end
        whole = last == len(at) or rows[last] != rows[last - 1]
        if whole and (held >= SEEDS // 4 or last == len(at)):
            gram, place = (np.concatenate(x) for x in zip(*begins, strict=True))
            to_gram, to_place = (np.concatenate(x) for x in zip(*ends, strict=True))
            a, b = np.lexsort((place, gram - place)), np.lexsort((to_place, to_gram - to_place))
            gram, place, size = gram[a], place[a], to_place[b] - place[a] + m
            begins, ends, held = [], [], 0
            row = np.searchsorted(part.docs, place, side="right") - 1
            yield row, table.item[gram], place, table.place[gram], size
        first = last


def _covers(part: Slice, items: Items, enough: float) -> Iterator[tuple[int, int | None, float]]:
    """(row, item, coverage) of pairs that share a seed, but for those that can neither reach `enough` nor be the best of their row."""
    for table in items.tables:
        for row, item, i, j, n in _matches(part, table):
            order = np.lexsort((item, row))
            row, item, i, j, n = (x[order] for x in (row, item, i, j, n))
            changed = np.ones(len(row), dtype=bool)
            changed[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
            pairs = np.flatnonzero(changed)
            ends = np.append(pairs[1:], len(row))
            most = np.minimum(1.0, np.add.reduceat(n, pairs) / items.sizes[item[pairs]]) if len(pairs) else np.empty(0)
            best_row, best = -1, 0.0
            for k in np.lexsort((item[pairs], -most, row[pairs])).tolist():
                a, b = int(pairs[k]), int(ends[k])
                r, which = int(row[a]), int(item[a])
                if r != best_row:
                    best_row, best = r, 0.0
                if most[k] < best and most[k] < enough:
                    continue
                share = sum(size for *_, size in tile(np.stack([i[a:b], j[a:b], n[a:b]], axis=1), table.length)) / int(items.sizes[which])
                best = max(best, share)
                yield r, items.names[which], share


def _rank(item: int | None) -> float:
    return math.inf if item is None else item


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """(key, contaminated, item_ids, best_item, best_coverage) of every document; best_* are null where no seed is shared.

    `carry` names columns of `docs` to return instead of the key alone.
    """
    spark = docs.sparkSession
    if benchmark.schema[item_key].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise ValueError(f"{item_key} is not an integer column")
    if clash := [c for c in carry or [] if c in _RETURNED and c != key]:
        raise ValueError(f"carry names returned columns: {', '.join(clash)}")
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    kind = docs.schema[key].dataType.simpleString()
    carry = [c for c in carry or [] if c not in (key, text)] + ([text] if text in (carry or []) else [])
    names = {f"_{c}": docs.schema[c].dataType.simpleString() for c in carry}
    schema = f"key {kind}, contaminated boolean, item_ids array<long>, best_item long, best_coverage double" + "".join(f", {c} {t}" for c, t in names.items())
    held = []
    for b in range(blocks):
        rows = benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("length(t) > 0").distinct()
        rows = rows.where(F.pmod(F.coalesce(F.when(F.col("i").isNotNull(), F.xxhash64("i")), F.xxhash64("t")), F.lit(blocks)) == b) if blocks > 1 else rows
        held.append(spark.sparkContext.broadcast(Items([tuple(r) for r in rows.collect()], seed)))  # a block of a checked size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(plain_slices([batch], text, key))
            over = [[[] for _ in part.ids] for part in parts]
            best = [[(None, None)] * len(part.ids) for part in parts]
            for block in held:
                items = block.value
                for k, part in enumerate(parts):
                    for r, i, c in _covers(part, items, coverage):
                        b, so_far = best[k][r]
                        if so_far is None or c > so_far or c == so_far and _rank(i) < _rank(b):
                            best[k][r] = (i, c)
                        if c >= coverage:
                            over[k][r].append(i)
                del items
                if len(held) > 1 and getattr(block, "_path", None):
                    block.__dict__.pop("_value", None)  # read again from the local file when it is needed
            for k, part in enumerate(parts):
                found = [part.rows.column(0), pa.array([bool(x) for x in over[k]], pa.bool_()), pa.array([sorted(set(x), key=_rank) for x in over[k]], pa.list_(pa.int64())), pa.array([x for x, _ in best[k]], pa.int64()), pa.array([x for _, x in best[k]], pa.float64())]
                yield pa.RecordBatch.from_arrays(found + [part.rows.column(2 + j) for j in range(len(names))], ["key", "contaminated", "item_ids", "best_item", "best_coverage", *names])

    out = docs.select(key, F.col(text).cast("string").alias(text), *[F.col(c).alias(f"_{c}") for c in carry]).mapInArrow(run, schema)
    return out.withColumnsRenamed({"key": key} | {f"_{c}": c for c in carry})
