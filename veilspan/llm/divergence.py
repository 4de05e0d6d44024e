"""Operator 11: source divergence audit by wide term vectors.

Term counts of sources are pivoted into one array a term, indexed by the sources
of its language.  Higher-order functions turn an array into smoothed shares and
emit, source by source, what the term adds to each pair of sources; sums are
taken map-side first.  All arithmetic is on whole numbers; the shares are long
divisions by steps of a thousand, so that nothing passes 64 bits below nine
quadrillion occurrences.

A task counts the terms of a run of texts before Spark sums them, so a frequent
term, source or language costs each task one row.  A term's array is as long as
its language has sources, and is emitted one source at a time.  Sources and
languages are joined by broadcast only where their number and bytes are counted
to be small.

Defined results: null text, language and source are empty strings.  Rows count as
documents, repeated ones too.  A source without terms has the smoothed shares of
zero counts; a language without kept terms has pairs of value 0 and no terms.
Ties go by the item's UTF-8 bytes.  An empty table gives no rows.  A text may be
of any length: long ones are counted window by window.  Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pieces import text_runs
from .tables import cut, if_small
from .textcore import _LOWER, raw_text

#: Bytes of text whose terms are counted together, and of names and arrays up to which the table of languages is broadcast.
RUN_BYTES, SMALL_BYTES = 12 << 20, 32 << 20
#: Added to every count, and the whole to which shares are scaled in three steps of a thousand.
ADDED, SCALE = 5, 1_000_000_000
#: Bytes of terms: ASCII letters and all of characters beyond ASCII.
_TERM = np.zeros(256, dtype=bool)
_TERM[128:] = _TERM[65:91] = _TERM[97:123] = True


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some texts as a dictionary array, and the row of each."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _TERM[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = at[(at > 0) & (at < len(data))]  # a term does not go on in the next text
    begins[edge], ends[edge - 1] = inside[1:-1][edge], inside[1:-1][edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside[1:-1]]))])
    return words.dictionary_encode(), np.searchsorted(at, starts, side="right") - 1


def _long(data: np.ndarray, size: int) -> pa.Table:
    """(term, n) of one long text; windows end between terms."""
    parts, first = [], 0
    while first < len(data):
        last = min(len(data), first + size)
        while last < len(data) and _TERM[data[last]]:
            more = np.flatnonzero(~_TERM[data[last : last + size]])
            last = last + int(more[0]) if len(more) else min(len(data), last + size)
        words, _ = _terms(data[first:last], np.array([0, last - first]))
        found = pc.value_counts(words)
        parts.append(pa.table({"term": found.field(0).cast(pa.binary()), "n": found.field(1)}))
        first = last
    return pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])


def term_counts(docs: DataFrame, text: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """(lang, source, term, n, docs) for runs of rows: occurrences, and rows that hold the term; to be summed by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch.select([0, 2, 1]), run_bytes):
                data, at = raw_text(part.column(1))
                langs, sources = part.column(0), part.column(2)
                if len(part) == 1 and len(data) > run_bytes:
                    found = _long(data, run_bytes)
                    code, n, holds, of = np.arange(len(found)), found["n_sum"].to_numpy(), np.ones(len(found), dtype=np.int64), np.zeros(len(found), dtype=np.int64)
                    names = found["term"].combine_chunks()
                else:
                    groups = pa.StructArray.from_arrays([langs.dictionary_encode().indices, sources.dictionary_encode().indices], ["a", "b"])
                    a, b = (np.asarray(groups.field(k), dtype=np.int64) for k in (0, 1))
                    _, sample, group = np.unique(a << 32 | b, return_index=True, return_inverse=True)
                    words, row = _terms(data, at)
                    codes, names = np.asarray(words.indices, dtype=np.int64), words.dictionary
                    size = max(1, len(names))
                    pairs, times = np.unique(row * size + codes, return_counts=True)
                    keys = group[pairs // size] * size + pairs % size
                    order = np.argsort(keys, kind="stable")
                    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
                    n, holds = (np.add.reduceat(x[order], first) if len(first) else np.empty(0, dtype=np.int64) for x in (times, np.ones(len(keys), dtype=np.int64)))
                    code, of = keys[order][first] % size, sample[keys[order][first] // size]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(of)), sources.take(pa.array(of)), names.take(pa.array(code)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(holds, pa.int64())], ["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / whole) by long division; count + ADDED is at most `whole`."""
    quotient, rest = F.lit(0).cast("long"), count + F.lit(ADDED).cast("long")
    for _ in range(3):
        step = rest * F.lit(1000).cast("long")
        quotient, rest = quotient * 1000 + F.call_function("div", step, whole), step % whole
    return quotient + 1


def wide_vectors(counts: DataFrame, groups: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, v): occurrences in each source of the language, for terms in at least `min_docs` documents."""
    summed = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    listed = summed.join(if_small(groups), ["lang", "source"]).groupBy("lang", "term", "size").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("held")).where(F.col("docs") >= min_docs)
    # each held count after the zeros that stand before it, and the zeros after the last
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    before = lambda k: F.when(k > 0, F.col("held")[k - 1]["at"]).otherwise(-1)
    dense = F.flatten(F.transform("held", lambda x, k: F.concat(zeros(x["at"] - before(k) - 1), F.array(x["n"]))))
    return listed.select("lang", "term", F.concat(dense, zeros(F.col("size") - 1 - F.element_at("held", -1)["at"])).alias("v"))


def _with_languages(wide: DataFrame, langs: DataFrame) -> DataFrame:
    rows, size = langs.agg(F.count("*"), F.sum(F.size("wholes") * 8 + F.octet_length("lang"))).first()
    return wide.join(F.broadcast(langs) if (size or 0) <= SMALL_BYTES else langs, "lang")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` for all other sources, part `term` for the `top` terms over the language's share."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    by_lang = Window.partitionBy("lang")
    groups = cut(plain.select("lang", "source").distinct().select("lang", "source", (F.row_number().over(by_lang.orderBy("source")) - 1).alias("at"), F.count("*").over(by_lang).cast("int").alias("size")))
    wide = cut(wide_vectors(term_counts(plain), groups, min_docs))
    kept = wide.groupBy("lang").agg(F.count("*").alias("kept"))
    occurrences = wide.select("lang", F.posexplode("v").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    wholes = groups.join(if_small(kept), "lang", "left").join(occurrences, ["lang", "at"], "left").na.fill(0, ["kept", "n"])
    langs = cut(wholes.groupBy("lang").agg(F.first("kept").alias("kept"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "n", "source"))).alias("g")).select(
        "lang", "kept", (F.col("n") + ADDED * F.col("kept")).alias("whole"), F.transform("g", lambda x: x["n"] + ADDED * F.col("kept")).alias("wholes"), F.col("g.source").alias("sources")))
    shares = _with_languages(wide, langs.select("lang", "whole", "wholes")).select("lang", "term", "v", F.zip_with("v", "wholes", share).alias("p"), share(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x), F.col("whole")).alias("q"))

    one = shares.select("lang", "p", F.posexplode("p").alias("a", "own"))
    added = one.select("lang", "a", F.posexplode(F.transform(F.slice("p", F.col("a") + 2, F.size("p")), lambda x: F.abs(x - F.col("own")))).alias("k", "f"))
    sums = added.groupBy("lang", "a", (F.col("a") + F.col("k") + 1).alias("b")).agg(F.sum("f").alias("value"))
    own = langs.select("lang", "sources", F.posexplode("sources").alias("x", "source"))
    both = own.select("lang", "source", "x", F.posexplode("sources").alias("y", "item")).where("x <> y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    pairs = both.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    over = shares.select("lang", "term", F.posexplode(F.transform("p", lambda x, k: F.when((F.col("v")[k] > 0) & (x > F.col("q")), x - F.col("q")))).alias("at", "value")).where("value is not null")
    best = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    terms = best.join(if_small(groups), ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.unionByName(terms)
