"""Operator 10: substring dedup by prefix-partitioned suffix trees.

A suffix starts at every word.  Suffixes are split by variable-length word
prefixes: a prefix held by more than a memory-sized share of all suffixes is
lengthened by a word, and again, and at last to the whole window.  All suffixes
of one prefix meet in one group, where the nodes at the depth of `window` words
are found: sorted by the label of that depth (a 64-bit hash of the path), each
run of two or more suffixes is a node with two or more leaves, that is, a
repeat.  The first suffix of a node, by (key, place), stays; each other one
marks its window as a repeat.  Overlapping marked windows join into maximal
repeats, whose words are removed.

Before anything is shuffled, a task keeps only the first suffix of each of its
own nodes, so a passage that a third of all texts share sends one record a
task.  Records travel as compressed blobs of hashes and places; texts are
shuffled once, by key, to meet their marks.

Defined results: a null or empty text has no words and yields the empty kept
text.  Rows with a null key are kept whole and remove nothing.  Rows repeated
with one key are one document: no window of theirs is earlier than its copy, a
window at an earlier place of any of them is.  Texts shorter than the window are
kept whole; a text of any length, or one word of any length, is handled in one
task.  Ties cannot be: suffixes with one label differ in key or place.  An empty
table gives no rows.  Columns named like those returned may stand in `docs`;
`carry` must not name them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import GROUP_BYTES, MANY_GROUPS, group_of, groups_for, pack, pack_sorted, text_bytes, unpack, unpack_sorted
from .tables import cut
from .textcore import ngrams, slices, xxhash64_of_longs

WINDOW = 20
#: Words of a prefix at most; where that does not split the suffixes enough, the whole window takes the prefix's place.
DEPTH = 3
#: Suffixes drawn for each group to find the prefixes that are too frequent, and about how many bytes a word and its blank have.
PER_GROUP, WORD_BYTES = 256, 6
#: Suffixes that a task gathers before it sends its blobs; the second figure where there are very many groups to send to.
FLUSH, FLUSH_MANY = 2_000_000, 16_000_000


def _suffixes(part, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, row, place in the document) of every suffix of at least `window` words whose key is not null."""
    sizes = np.diff(part.docs)
    n = np.where(np.array([i is not None for i in part.ids], dtype=bool), np.maximum(sizes - window + 1, 0), 0)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return part.docs[row] + place, row, place


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _prefixes(words: np.ndarray, at: np.ndarray, longer: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
    """The hash of the prefix of each suffix: one word, one more while the prefix is among the `longer` ones, and in the end the whole label."""
    key = ngrams(words, 1)[at]
    left = np.arange(len(at))
    for depth, table in enumerate(longer, 2):
        left = left[_member(key[left], table)]
        key[left] = ngrams(words, depth)[at[left]] if depth <= DEPTH else whole[left]
    return key


def long_prefixes(docs: DataFrame, groups: int, total: int, key: str, text: str, window: int) -> list[np.ndarray]:
    """For each length from 1 to DEPTH, the sorted hashes of prefixes that have about an eighth of a group's suffixes or more.

    Counted on suffixes drawn with equal chances, `PER_GROUP` for a group, from about
    total / WORD_BYTES altogether: it decides where suffixes meet, not which are found.  A
    length has at most 8 prefixes for a group, whatever `total` is.
    """
    most = min(DEPTH, window - 1)
    chance = min(1.0, PER_GROUP * groups / max(1, total / WORD_BYTES))
    limit = np.uint64(min(int(chance * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: list[list[np.ndarray]] = [[np.empty(0, dtype=np.uint64)] for _ in range(most)]
        for part in slices(batches, text, key, lower=False):
            at, row, place = _suffixes(part, window)
            if not len(at):
                continue
            words = part.word_hashes()
            # One suffix a node: repeats inside a slice do not travel either.
            _, first = np.unique(ngrams(words, window)[at], return_index=True)
            ids = np.array([0 if i is None else i for i in part.ids], dtype=np.int64)
            draw = xxhash64_of_longs(xxhash64_of_longs(ids)[row[first]] + place[first]).view(np.uint64)
            at = at[first[draw <= limit]]
            for depth in range(1, most + 1):
                drawn[depth - 1].append(ngrams(words, depth)[at])
        depths, hashes, numbers = [0], [0], [sum(map(len, drawn[0])) if drawn else 0]
        for depth, found in enumerate(drawn, 1):
            h, n = np.unique(np.concatenate(found), return_counts=True)
            depths += [depth] * len(h)
            hashes += h.view(np.int64).tolist()
            numbers += n.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(depths, pa.int32()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int64())], ["depth", "h", "n"])

    reports = cut(docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, "depth int, h long, n long"))
    seen = reports.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    found = reports.where("depth > 0").groupBy("depth", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, seen / (8 * groups))).select("depth", "h").toArrow()
    depth, h = (found.column(c).to_numpy() for c in ("depth", "h"))
    return [np.sort(h[depth == d].view(np.uint64)) for d in range(1, most + 1)]


def _by_home(ids: np.ndarray, places: np.ndarray, homes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(home, keys, marks): marked places of documents, by the group where their texts will be."""
    keys, inverse = np.unique(ids, return_inverse=True)
    home = (xxhash64_of_longs(keys) % homes).astype(np.int64)
    order = np.lexsort((places, inverse, home[inverse]))
    at_home = home[inverse][order]
    ends = np.append(np.flatnonzero(np.diff(at_home)) + 1, len(order)) if len(order) else []
    first = 0
    for last in ends:
        own = order[first:last]
        table, which = np.unique(inverse[own], return_inverse=True)
        yield int(at_home[first]), pack(keys[table].view(np.uint64)), pack_sorted((which.astype(np.uint64) << np.uint64(32)) | places[own].astype(np.uint64))
        first = last


def _nodes(label: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of the tree's leaves, and which of them are not the first of their node."""
    order = np.arange(len(ref)) if len(ref) < 2 or (ref[1:] >= ref[:-1]).all() else np.argsort(ref, kind="stable")
    order = order[np.argsort(label[order], kind="stable")]
    sorted_label, sorted_ref = label[order], ref[order]
    starts = np.ones(len(order), dtype=bool)
    starts[1:] = sorted_label[1:] != sorted_label[:-1]
    del sorted_label
    first = np.repeat(sorted_ref[starts], np.diff(np.append(np.flatnonzero(starts), len(order)))) if len(order) else sorted_ref
    return order, sorted_ref > first


def marks(docs: DataFrame, homes: int, total: int, key: str, text: str, window: int, groups: int, flush: int = FLUSH) -> DataFrame:
    """(home, docs, marks): blobs of the places at which repeated windows start."""
    longer = docs.sparkSession.sparkContext.broadcast(long_prefixes(docs, groups, total, key, text, window))  # 8 * DEPTH hashes a group at most
    blobs = "bucket int, home int, docs binary, labels binary, refs binary"  # home -1: suffixes for a tree

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Labels, buckets and places of suffixes; keys of texts and how many suffixes each has.
        held: tuple[list[np.ndarray], ...] = ([], [], [], [], [])

        def taken(k: int) -> np.ndarray:
            out = np.concatenate(held[k])
            held[k].clear()
            return out

        def out() -> Iterator[pa.RecordBatch]:
            keys, rank = np.unique(taken(3), return_inverse=True)
            ref = np.repeat(rank.astype(np.uint64) << np.uint64(32), taken(4))
            ref |= taken(2).astype(np.uint64)
            label, bucket = taken(0), taken(1)
            order, again = _nodes(label, ref)
            some = ref[order[again]]
            rows = [(home, home, d, None, m) for home, d, m in _by_home(keys[some >> np.uint64(32)], (some & np.uint64(0xFFFFFFFF)).astype(np.int64), homes)]
            del again, some
            ones = np.ones(len(order), dtype=bool)
            ones[1:] = label[order][1:] != label[order][:-1]
            first = order[ones]
            del order, ones
            first = first[np.argsort(bucket[first], kind="stable")]
            ends = np.append(np.flatnonzero(np.diff(bucket[first])) + 1, len(first)) if len(first) else []
            a = 0
            for b in ends:
                own = first[a:b]
                table, which = np.unique(ref[own] >> np.uint64(32), return_inverse=True)
                refs = (which.astype(np.uint64) << np.uint64(32)) | (ref[own] & np.uint64(0xFFFFFFFF))
                rows.append((int(bucket[own[0]]), -1, pack(keys[table].view(np.uint64)), pack_sorted(label[own]), pack(refs)))
                a = b
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "home", "docs", "labels", "refs"])

        n = 0
        for part in slices(batches, text, key, lower=False):
            at, row, place = _suffixes(part, window)
            if not len(at):
                continue
            words = part.word_hashes()
            label = ngrams(words, window)[at]
            prefix = _prefixes(words, at, longer.value, label)
            ids = np.array([0 if i is None else i for i in part.ids], dtype=np.int64)
            counts = np.bincount(row, minlength=len(ids))
            for column, values in zip(held, (label, (prefix % np.uint64(groups)).astype(np.int32), place.astype(np.int32), ids[counts > 0], counts[counts > 0]), strict=True):
                column.append(values)
            n += len(at)
            if n >= flush:
                yield from out()
                n = 0
        if n:
            yield from out()

    def tree(table: pa.Table) -> pa.Table:
        rows, labels, docs_, places = [], [], [], []
        for home, d, lab, refs in zip(*(table.column(c).to_pylist() for c in ("home", "docs", "labels", "refs")), strict=True):
            if home >= 0:  # marks that a task has found among its own suffixes
                rows.append((home, d, refs))
                continue
            ref = unpack(refs)
            labels.append(unpack_sorted(lab))
            docs_.append(unpack(d).view(np.int64)[(ref >> np.uint64(32)).astype(np.int64)])
            places.append((ref & np.uint64(0xFFFFFFFF)).astype(np.int64))
        if labels:
            label, doc, place = np.concatenate(labels), np.concatenate(docs_), np.concatenate(places)
            _, rank = np.unique(doc, return_inverse=True)
            order, again = _nodes(label, (rank.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64))
            own = order[again]
            rows += _by_home(doc[own], place[own], homes)
        return pa.table({"home": pa.array([r[0] for r in rows], pa.int32()), "docs": pa.array([r[1] for r in rows], pa.binary()), "marks": pa.array([r[2] for r in rows], pa.binary())})

    sent = docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(send, blobs)
    return sent.groupBy("bucket").applyInArrow(tree, "home int, docs binary, marks binary")


def dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", flush: int | None = None, carry: tuple[str, ...] = (), sizes: tuple[int, int] = GROUP_BYTES) -> DataFrame:
    """(key, n_words, n_removed, removed array<struct<start,end>>, kept): kept words joined by a blank; removed are ranges of words.

    The key is an integer column.  `carry` names further columns to return, the text too if wanted.
    """
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} is not an integer column")
    if clash := [c for c in carry if c in ("n_words", "n_removed", "removed", "kept") and c != key]:
        raise ValueError(f"carry names returned columns: {', '.join(clash)}")
    spark = docs.sparkSession
    names = {c: f"_{i}" for i, c in enumerate(carry) if c not in (key, text)}
    docs = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"), *[F.col(c).alias(n) for c, n in names.items()])
    total = text_bytes(docs, "_text")
    homes = groups_for(spark, total, sizes)
    marked = marks(docs, homes, total, "_key", "_text", window, 2 * homes, flush or (FLUSH if homes <= MANY_GROUPS else FLUSH_MANY))
    back = [(n, docs.schema[n].dataType) for n in names.values()] + ([("_text", docs.schema["_text"].dataType)] if text in carry else [])
    schema = "_key long, _n long, _gone long, _ranges array<struct<start:int,end:int>>, _kept string" + "".join(f", {n} {t.simpleString()}" for n, t in back)

    def strike(texts: pa.Table, found: pa.Table) -> pa.Table:
        doc, place = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for d, m in zip(found.column("docs").to_pylist(), found.column("marks").to_pylist(), strict=True):
            ref = unpack_sorted(m)
            doc.append(unpack(d).view(np.int64)[(ref >> np.uint64(32)).astype(np.int64)])
            place.append((ref & np.uint64(0xFFFFFFFF)).astype(np.int64))
        doc, place = np.concatenate(doc), np.concatenate(place)
        order = np.argsort(doc, kind="stable")
        doc, place = doc[order], place[order]
        n_words, n_removed, ranges, kept = [], [], [], []
        ids = texts.column("_key").to_pylist()
        bodies = texts.column("_text").cast(pa.binary()) if texts.num_rows else texts.column("_text")
        for i, body in zip(ids, (b.as_py() for b in bodies), strict=True):
            words = (body or b"").split()
            own = place[np.searchsorted(doc, i) : np.searchsorted(doc, i, side="right")] if i is not None else place[:0]
            n_words.append(len(words))
            if not len(own):
                n_removed.append(0)
                ranges.append([])
                kept.append(b" ".join(words))
                continue
            own = np.sort(own)
            gap = np.flatnonzero(own[1:] > own[:-1] + window)
            starts, ends = own[np.append(0, gap + 1)], own[np.append(gap, len(own) - 1)] + window
            n_removed.append(int((ends - starts).sum()))
            ranges.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
            rest, last = [], 0
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                rest += words[last:a]
                last = b
            kept.append(b" ".join(rest + words[last:]))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"_key": pa.array(ids, pa.int64()), "_n": pa.array(n_words, pa.int64()), "_gone": pa.array(n_removed, pa.int64()), "_ranges": pa.array(ranges, kind), "_kept": pa.array(kept, pa.binary()).cast(pa.string())} | {n: texts.column(n) for n, _ in back})

    dealt = docs.withColumn("_home", group_of("_key", "_text", homes))
    struck = dealt.groupBy("_home").cogroup(marked.groupBy("home")).applyInArrow(strike, schema)
    return struck.select(F.col("_key").alias(key), F.col("_n").alias("n_words"), F.col("_gone").alias("n_removed"), F.col("_ranges").alias("removed"), F.col("_kept").alias("kept"), *[F.col("_text" if c == text else names[c]).alias(c) for c in carry if c != key])
