"""Operator 7: token counts by prefix dynamic programming.

For each text the exact token count of every prefix is held: at the starts of
units as running totals, and inside units after every character, as the dynamic
programme over the last token gives them (`prefixes`).  The total, the count of
any prefix, the longest prefix within a budget and the truncated text are looked
up there; nothing is encoded again.  The counts of a unit are remembered in two
bounded tables, the younger taking what the older is asked for.

Narrow: no shuffle.  The vocabulary's path is a parameter and is opened on the
executors.  Defined results: a null or empty text has 0 bytes, 0 tokens and no
prefix.  Repeated rows give repeated results, null keys are kept, an empty table
gives no rows.  A unit may be as long as the text: its counts are made one by one
in time proportional to its length, and not remembered beyond `LONGEST`
characters.  The longest prefix within a limit is unique, so there are no ties.
Other columns do not matter.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Vocabulary, text_runs, vocabulary
from .prefixes import PrefixTable, programme

#: Units that each of a worker's two tables holds at most, and the longest unit that they hold.
REMEMBERED, LONGEST = 800_000, 64
#: Bytes of text whose units are counted together.
RUN_BYTES = 4 << 20


class Remembered:
    """Prefix counts of units, in two tables."""

    def __init__(self, v: Vocabulary):
        self.programme, self.young, self.old = programme(v), {}, {}

    def of(self, texts: list[list[str]]) -> list[list[bytes | array]]:
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        asked = {u for units in texts for u in units if u not in young}
        young.update((u, old[u]) for u in asked if u in old)
        new = [u for u in asked if u not in young]
        got = dict(zip(new, self.programme.counts(new), strict=True))
        long = {u: c for u, c in got.items() if len(u) > LONGEST}
        young.update((u, c) for u, c in got.items() if len(u) <= LONGEST)
        return [[young[u] if len(u) <= LONGEST else long[u] for u in units] for units in texts] if long else [list(map(young.__getitem__, units)) for units in texts]


def remembered(v: Vocabulary) -> Remembered:
    if ("counts",) not in v.caches:
        v.caches["counts",] = Remembered(v)
    return v.caches["counts",]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fit_chars): fit_chars characters are the longest prefix within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for part in text_runs(batch, RUN_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                units = [v.units(t) for t in texts]
                totals, fits = [], []
                for t, us, counts in zip(texts, units, remembered(v).of(units), strict=True):
                    totals.append(n := sum([c[-1] for c in counts]))
                    fits.append(len(t) if n <= limit else PrefixTable(v, t, us, counts).fit(limit))
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(fits, pa.int64())], ["key", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long").withColumnRenamed("key", key)


def prefix_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts array<int>): the token count of the first 1, 2, ... characters of each text; empty for a null or empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for part in text_runs(batch, RUN_BYTES):
                units = [v.units(t or "") for t in part.column(1).to_pylist()]
                counts = []
                for us, inside in zip(units, remembered(v).of(units), strict=True):
                    before, flat = 0, []
                    for c in inside:
                        flat.append(np.array(list(c), dtype=np.int32) + before)
                        before += c[-1]
                    counts.append(np.concatenate(flat)[1:] if flat else np.empty(0, dtype=np.int32))  # the first mark is not in the text
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.list_(pa.int32()))], ["key", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, counts array<int>").withColumnRenamed("key", key)


def truncate(docs: DataFrame, model: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_tokens): the longest prefix of each text with at most `limit` tokens, and its count; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for part in text_runs(batch, RUN_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                units = [v.units(t) for t in texts]
                tables = [PrefixTable(v, t, us, counts) for t, us, counts in zip(texts, units, remembered(v).of(units), strict=True)]
                sizes = [table.fit(limit) for table in tables]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t[:n] for t, n in zip(texts, sizes, strict=True)], pa.string()), pa.array([table.count(n) for table, n in zip(tables, sizes, strict=True)], pa.int64())], ["key", "text", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, text string, n_tokens long").withColumnRenamed("key", key)
