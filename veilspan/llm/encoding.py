"""Operator 9: SentencePiece encoding and decoding with seeded merge-dropout.

Texts are encoded by merging with an agenda; each candidate merge is skipped
when the keyed hash of (seed, document id, place of the unit, place, size) falls
below the dropout rate, so each occurrence of a word is cut by its own draws, the
same everywhere for one seed, id and place.  Undropped cuts are remembered with
their merges in a bounded table; occurrences that skip none of these merges take
them, and the others are merged together, each under its own key.
Decoding concatenates the bytes of pieces; every segmentation decodes
to the text it came from, space marks of the text itself included.

Narrow: no shuffle.  Defined results: a null or empty text has no pieces and
decodes to the empty text.  Rows with null ids are cut as one id.  Repeated rows
give repeated results.  A text is cut whole, whatever its length; of candidates
with one score the leftmost is taken.  An empty table gives no rows.  Other columns
do not matter.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MARK, keyed, mixed_all, rare_collections, spaced_units, text_runs, vocabulary

#: Bytes of text whose units are cut together.
RUN_BYTES = 1 << 20
#: Cuts that a worker remembers at most: workers outlive the stage and share an executor with the next one.
REMEMBERED = 300_000


class Cuts:
    """Units cut without dropout, with the merges made: an occurrence whose draws skip none of them is cut alike."""

    def __init__(self, v):
        self.v, self.roots = v, {}
        self.at, self.path = array("q", [0]), array("Q")
        #: Pieces of all cuts, and where those of each end.
        self.pieces, self.ends = array("I"), array("q", [0])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def add(self, units: list[str]) -> None:
        """Cuts of new units; those with space marks of the text itself get the number -1."""
        plain = [u for u in units if MARK not in u]
        packed, ends, merges = self.v.cut_units(plain)
        self.roots.update((u, -1) for u in units if MARK in u)
        self.roots.update(zip(plain, range(len(self), len(self) + len(plain)), strict=True))
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        self.pieces.frombytes(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.uintc).tobytes())
        self.ends.frombytes((np.cumsum(sizes) + self.ends[-1]).tobytes())
        self.at.frombytes((ends.astype(np.int64) + self.at[-1]).tobytes())
        self.path.frombytes(merges.tobytes())

    def skipping(self, nodes: np.ndarray, keys: np.ndarray, drop: int) -> np.ndarray:
        """Places of the occurrences that skip one of the merges of their unit."""
        going = np.flatnonzero(nodes >= 0) if drop else np.empty(0, dtype=np.int64)
        if not len(going):
            return going
        at, path = np.array(self.at), np.array(self.path, dtype=np.uint64)
        first, counts = at[nodes[going]], np.diff(at)[nodes[going]]
        ends = np.cumsum(counts)
        step = np.arange(ends[-1]) + np.repeat(first - (ends - counts), counts)
        owner = np.repeat(np.arange(len(going)), counts)
        draws = (path[step] + np.uint64(0x9E3779B97F4A7C15)) * (keys[going] | np.uint64(1))[owner]
        return going[np.unique(owner[((draws >> np.uint64(27)) & np.uint64(0xFFFFFFFF)) < np.uint64(drop)])]


def encode_texts(v, texts: list[str], drop: int, seed: int, documents: list[int]) -> list[np.ndarray]:
    """Piece ids of each text; `documents` are hashes of the documents' ids."""
    cuts = v.caches.get(("cuts",))
    if cuts is None or len(cuts) > REMEMBERED:
        cuts = v.caches["cuts",] = Cuts(v)
    units = [spaced_units(t) if t else [] for t in texts]
    flat = [u for us in units for u in us]
    found = list(map(cuts.roots.get, flat))
    if None in found:
        cuts.add(list({u for u, k in zip(flat, found, strict=True) if k is None}))
        found = list(map(cuts.roots.get, flat))
    nodes = np.array(found, dtype=np.int64)
    keys = np.concatenate([mixed_all(keyed(seed, d), np.arange(len(us), dtype=np.uint64)) for us, d in zip(units, documents, strict=True)]) if units else np.empty(0, dtype=np.uint64)
    alone = np.union1d(np.flatnonzero(nodes < 0), cuts.skipping(nodes, keys, drop))
    own = v.encode_units([flat[i] for i in alone.tolist()], drop, keys[alone])
    # Pieces of remembered cuts, then those of the occurrences cut by themselves; each occurrence takes a run of them.
    table = np.concatenate([np.array(cuts.pieces, dtype="<u4"), np.frombuffer(b"".join(own), dtype="<u4")])
    ends = np.array(cuts.ends)
    first, sizes = ends[nodes], np.append(np.diff(ends), 0)[nodes]
    sizes[alone] = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
    first[alone] = ends[-1] + np.cumsum(sizes[alone]) - sizes[alone]
    stops = np.cumsum(sizes)
    ids = table[np.repeat(first - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
    return np.split(ids, np.append(0, stops)[np.cumsum([len(us) for us in units], dtype=np.int64)[:-1]]) if units else []


def encode_text(v, text: str, drop: int, seed: int, document: int) -> np.ndarray:
    """Piece ids of one text."""
    return encode_texts(v, [text], drop, seed, [document])[0]


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pieces array<int>, lossless): lossless says that decoding the pieces gave the text."""
    drop = round(dropout * (1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for part in text_runs(batch, RUN_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                chosen = [xxhash.xxh64_intdigest(str(k)) if k is not None else 0 for k in part.column(0).to_pylist()]
                with rare_collections():
                    ids = encode_texts(v, texts, drop, seed, chosen)
                    good = [v.decode(got) == t.encode() for got, t in zip(ids, texts, strict=True)]
                at = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=at[1:])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(good, pa.bool_())], ["key", "pieces", "lossless"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, pieces array<int>, lossless boolean").withColumnRenamed("key", key)


def decode(pieces: DataFrame, model: str, key: str = "doc_id", column: str = "pieces") -> DataFrame:
    """(key, text): texts of arrays of pieces; a null array gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = [None if p is None else v.decode(np.array(p, dtype=np.int64)).decode("utf-8", "replace") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = pieces.schema[key].dataType.simpleString()
    return pieces.select(F.col(key), F.col(column)).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
