"""Operator 3: LM scoring by prediction by partial matching (PPM).

A text is modelled as the bytes of its words (lower case A-Z) with one blank
between words and one end mark.  The model is a trie of byte contexts up to
`order` bytes: in a context, a byte seen c of n times with d distinct bytes
has probability c/(n+d), and the escape to the next shorter context d/(n+d).
On escape, bytes of the longer context are excluded; below the empty context
all bytes not excluded are equally likely.  Counts come from the rows that
`learn` selects; every row is scored with the finished trie.

Plan: texts are dealt into groups by key.  A group reports its distinct
(order+1)-byte strings and word hashes with training counts, as compressed
blobs by hash range; ranges sum them; the distinct strings, grouped by the bytes
that all their contexts end in (two, more where too many strings share them),
become subtries in which the code length of each string is computed once; the answers travel back to the groups
that asked.  No table that grows with the input is broadcast or collected.

Also returned is the base: word counts with add-one smoothing.

Defined results: a null or empty text is one end mark.  Rows with a null key are
dealt by their text, scored, and learned from as `learn` says (null: not).  With
nothing to learn, every byte has probability 1/256.  Repeated rows are learned
from as often as they occur, and scored alike.  A text or word of any length is
scored whole, in one task.  Scores are sums, so there are no ties to break.  An
empty table gives no rows.  Other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import group_of, groups_for, pack, pack_sorted, text_bytes, unpack, unpack_sorted
from .tables import cut
from .textcore import mix, slices

ORDER = 5
#: Bytes of text in a group; the second figure where there are very many groups.
GROUP_BYTES = 40 << 20, 256 << 20
#: Least share of all distinct strings from which on a suffix of contexts is lengthened.
LEAST_SHARE = 1 / 4096
END = 10  # the end mark; blanks never are in a word
STRINGS, WORDS = 0, 1


def byte_strings(part, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the last order+1 bytes at every byte of the modelled texts of a slice, and their rows."""
    data, pad = part.data.tobytes(), bytes([END]) * order
    at = part.text_at.tolist()
    bodies = [pad + b" ".join(data[a:b].split()) + b"\n" for a, b in zip(at[:-1], at[1:], strict=True)]
    flat = np.frombuffer(b"".join(bodies), dtype=np.uint8).astype(np.int64)
    code = np.zeros(len(flat), dtype=np.int64)
    for j in range(order, -1, -1):
        code <<= 8
        if j:
            code[j:] += flat[:-j]
        else:
            code += flat
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    row = np.repeat(np.arange(len(bodies)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    real = place >= order
    return code[real], row[real]


def word_codes(part) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words and the end marks (code 0) of a slice, and their rows."""
    n = len(part.ids)
    words = (part.word_hashes() >> np.uint64(1)).astype(np.int64)
    words[words == 0] = 1
    row = np.repeat(np.arange(n), np.diff(part.docs))
    return np.concatenate([words, np.zeros(n, dtype=np.int64)]), np.concatenate([row, np.arange(n)])


class _Tally:
    """Counts by code, merged from time to time."""

    def __init__(self):
        self.codes, self.counts, self.size = [], [], 0

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        label, distinct = pd.factorize(codes)
        self.codes.append(distinct)
        self.counts.append(np.bincount(label, weights=weights, minlength=len(distinct)).astype(np.int64))
        self.size += len(distinct)
        if self.size > 6_000_000 and len(self.codes) > 1:
            c, n = self.done()
            self.codes, self.counts, self.size = [c], [n], len(c)

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.codes:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return _totals(np.concatenate(self.codes), np.concatenate(self.counts))


def _totals(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label, distinct = pd.factorize(codes)
    order = np.argsort(distinct, kind="stable")
    return distinct[order], np.bincount(label, weights=counts, minlength=len(distinct)).astype(np.int64)[order]


def _range(codes: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(codes.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)


def trie_lengths(asked: np.ndarray, codes: np.ndarray, counts: np.ndarray, singles: np.ndarray, order: int, upper: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """log10 probability of the last byte of each asked string after the bytes before it.

    codes, counts: the trained strings whose contexts end in the same bytes as
    those asked; singles[a, b]: trained count of byte b after byte a; `upper` has, by
    order, sorted strings and counts where those bytes are more than the context.
    """
    tables = []  # for each order from the deepest: sorted keys, counts, and by context: keys, total, distinct
    for k in range(order, 1, -1):
        key = codes & ((1 << 8 * (k + 1)) - 1) if k < 7 else codes
        keys, n = upper[k] if upper and k in upper else _totals(key, counts)
        ctx, start = np.unique(keys >> 8, return_index=True)
        tables.append((k, keys, n, ctx, np.add.reduceat(n, start) if len(n) else n, np.diff(np.append(start, len(keys)))))
    zero = singles.sum(axis=0)

    def count(k: int, key: np.ndarray) -> np.ndarray:
        if k == 1:
            return singles[(key >> 8) & 255, key & 255]
        if k == 0:
            return zero[key & 255]
        _, keys, n, *_ = tables[order - k]
        if not len(keys):
            return np.zeros(len(key), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, n[at], 0)

    total1, distinct1 = singles.sum(axis=1), (singles > 0).sum(axis=1)
    m = len(asked)
    out, open_ = np.zeros(m), np.ones(m, dtype=bool)
    # Of the next longer context: number of distinct bytes, and how often they occur in this one.
    gone_d, gone_n = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    for k in range(order, -1, -1):
        key = asked & ((1 << 8 * (k + 1)) - 1) if k < 7 else asked
        if k >= 2:
            _, keys, n, ctx, total, distinct = tables[order - k]
            at = np.minimum(np.searchsorted(ctx, key >> 8), max(len(ctx) - 1, 0))
            seen = ctx[at] == key >> 8 if len(ctx) else np.zeros(m, dtype=bool)
            big_n, big_d = (np.where(seen, total[at], 0), np.where(seen, distinct[at], 0)) if len(ctx) else (np.zeros(m, dtype=np.int64),) * 2
        elif k == 1:
            big_n, big_d = total1[(key >> 8) & 255], distinct1[(key >> 8) & 255]
        else:
            big_n, big_d = np.full(m, zero.sum()), np.full(m, (zero > 0).sum())
        c, rest_n, rest_d = count(k, key), big_n - gone_n, big_d - gone_d
        hit = open_ & (c > 0)
        out[hit] += np.log10(c[hit] / (rest_n[hit] + rest_d[hit]))
        open_ &= ~hit
        escape = open_ & (rest_d > 0)
        out[escape] += np.log10(rest_d[escape] / (rest_n[escape] + rest_d[escape]))
        gone_d = big_d
        if k >= 2:
            # Counts, one order lower, of the bytes seen in each context.
            lower = count(k - 1, keys & ((1 << 8 * k) - 1))
            sums = np.add.reduceat(lower, np.cumsum(distinct) - distinct) if len(keys) else lower
            gone_n = np.where(seen, sums[at], 0) if len(ctx) else np.zeros(m, dtype=np.int64)
        elif k == 1:
            sums = ((singles > 0) * zero).sum(axis=1)
            gone_n = sums[(key >> 8) & 255]
    out[open_] -= np.log10(256 - gone_d[open_])
    return out


def _suffix(k: int) -> Column:
    """The last k bytes of the context of a string, with k."""
    return F.shiftright("code", 8).bitwiseAND((1 << 8 * k) - 1).bitwiseOR(F.lit(k << 40))


def frequent_suffixes(strings: DataFrame, order: int, share: float) -> tuple[dict[int, list[int]], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Suffixes of contexts, by length from 2, that have more than `share` of the rows of `strings`; and the trained counts of bytes after them."""
    hot: dict[int, list[int]] = {}
    upper: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows, most = strings, share * strings.count()
    for k in range(2, order):
        hot[k] = [r[0] for r in rows.groupBy(_suffix(k).alias("s")).agg(F.count("*").alias("c")).where(F.col("c") > most).select("s").collect()]
        if not hot[k]:
            del hot[k]
            break
        rows = rows.where(_suffix(k).isin(hot[k]))
        after = rows.where("n > 0").groupBy(F.col("code").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("s")).agg(F.sum("n")).collect()
        table = np.array(sorted((r[0], r[1]) for r in after), dtype=np.int64).reshape(-1, 2)
        upper[k] = table[:, 0].copy(), table[:, 1].copy()
    return hot, upper


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, sizes: tuple[int, int] = GROUP_BYTES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score)."""
    if not 2 <= order <= 6:
        raise ValueError("order is 2 to 6")
    spark = docs.sparkSession
    groups = groups_for(spark, text_bytes(docs, text), sizes)
    dealt = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    dealt = dealt.withColumn("grp", group_of("key", "text", groups))

    def report(group: tuple, table: pa.Table) -> pa.Table:
        tallies = {STRINGS: _Tally(), WORDS: _Tally()}
        for part in slices(table.to_batches(), "text", "key"):
            learned = np.array(part.rows.column(part.rows.schema.names.index("learn")).to_pylist(), dtype=np.int64)
            for kind, (codes, row) in ((STRINGS, byte_strings(part, order)), (WORDS, word_codes(part))):
                tallies[kind].add(codes, learned[row])
        rows = []
        for kind, tally in tallies.items():
            codes, counts = tally.done()
            home = _range(codes, groups)
            turn = np.argsort(home, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(home[turn])) + 1, len(turn)) if len(turn) else []
            a = 0
            for b in ends:
                own = turn[a:b]
                rows.append((int(home[own[0]]), group[0].as_py(), kind, pack_sorted(codes[own]), pack(counts[own].astype(np.uint64))))
                a = b
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("range", pa.int32()), ("grp", pa.int32()), ("kind", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())))})

    blobs = cut(dealt.groupBy("grp").applyInArrow(report, "range int, grp int, kind int, codes binary, counts binary"))

    def add_up(table: pa.Table) -> pa.Table:
        kinds, out = np.array(table.column("kind").to_pylist()), []
        for kind in (STRINGS, WORDS):
            own = np.flatnonzero(kinds == kind)
            codes = [unpack_sorted(table.column("codes")[int(i)].as_py()).astype(np.int64) for i in own]
            counts = [unpack(table.column("counts")[int(i)].as_py()).astype(np.int64) for i in own]
            if not codes:
                continue
            c, n = _totals(np.concatenate(codes), np.concatenate(counts))
            if kind == WORDS:  # only their number and sum are needed
                c, n = np.array([int((n > 0).sum())]), np.array([int(n.sum())])
            out.append((np.full(len(c), kind, dtype=np.int32), c, n))
        k, c, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"kind": pa.array(k), "code": pa.array(c), "n": pa.array(n)})

    counted = cut(blobs.groupBy("range").applyInArrow(add_up, "kind int, code long, n long"))
    vocabulary, tokens = counted.where(F.col("kind") == WORDS).agg(F.sum("code"), F.sum("n")).first()
    vocabulary, tokens = int(vocabulary or 0), int(tokens or 0)
    singles = np.zeros((256, 256), dtype=np.int64)
    strings = counted.where(F.col("kind") == STRINGS)
    for pair, n in strings.where("n > 0").groupBy(F.col("code").bitwiseAND(0xFFFF).alias("p")).agg(F.sum("n")).collect():  # 65,536 rows at most
        singles[pair >> 8, pair & 255] = n
    hot, upper = frequent_suffixes(strings, order, max(least_share, 1 / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    held = spark.sparkContext.broadcast((singles, upper))  # 1 / share contexts of each length with 256 bytes each, at most

    def subtrie(group: tuple, table: pa.Table) -> pa.Table:
        codes, n = table.column("code").to_numpy(), table.column("n").to_numpy()
        singles, upper = held.value
        above = {k: upper[k] for k in range(2, group[0].as_py() >> 40)}
        lengths = trie_lengths(codes, codes[n > 0], n[n > 0], singles, order, above)
        return pa.table({"range": pa.array(_range(codes, groups).astype(np.int32)), "code": pa.array(codes), "lp": pa.array(lengths)})

    suffix = _suffix(2)
    for k, values in sorted(hot.items()):
        suffix = F.when(_suffix(k).isin(values), _suffix(k + 1)).otherwise(suffix)
    lengths = strings.select("code", "n", suffix.alias("suffix")).groupBy("suffix").applyInArrow(subtrie, "range int, code long, lp double")

    def answer(asked: pa.Table, found: pa.Table) -> pa.Table:
        kinds = np.array(asked.column("kind").to_pylist(), dtype=np.int64)
        columns = [asked.column(c).to_pylist() for c in ("grp", "codes", "counts")]
        rows = []
        code, lp = found.column("code").to_numpy(), found.column("lp").to_numpy()
        turn = np.argsort(code, kind="stable")
        code, lp = code[turn], lp[turn]
        words = [(unpack_sorted(columns[1][i]).astype(np.int64), unpack(columns[2][i]).astype(np.int64)) for i in np.flatnonzero(kinds == WORDS)]
        word, count = _totals(np.concatenate([w for w, _ in words]), np.concatenate([n for _, n in words])) if words else (code[:0], code[:0])
        for i, kind in enumerate(kinds):
            codes = unpack_sorted(columns[1][i]).astype(np.int64)
            values = lp[np.searchsorted(code, codes)].view(np.uint64) if kind == STRINGS else count[np.searchsorted(word, codes)].astype(np.uint64)
            rows.append((columns[0][i], int(kind), columns[1][i], pack(values)))
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("grp", pa.int32()), ("kind", pa.int32()), ("codes", pa.binary()), ("found", pa.binary())))})

    answers = blobs.groupBy("range").cogroup(lengths.groupBy("range")).applyInArrow(answer, "grp int, kind int, codes binary, found binary")
    kind_of_key = docs.schema[key].dataType.simpleString()

    def total(table: pa.Table, found: pa.Table) -> pa.Table:
        tables = {}
        for kind in (STRINGS, WORDS):
            own = [(unpack_sorted(c).astype(np.int64), unpack(v)) for k, c, v in zip(*(found.column(n).to_pylist() for n in ("kind", "codes", "found")), strict=True) if k == kind]
            codes, values = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))
            turn = np.argsort(codes, kind="stable")
            tables[kind] = codes[turn], values[turn]

        def look_up(kind: int, codes: np.ndarray) -> np.ndarray:
            label, distinct = pd.factorize(codes)
            keys, values = tables[kind]
            return values[np.searchsorted(keys, distinct)][label]

        keys, cols = [], [[], [], [], []]
        for part in slices(table.to_batches(), "text", "key"):
            n = len(part.ids)
            codes, row = byte_strings(part, order)
            bits = np.bincount(row, weights=look_up(STRINGS, codes).view(np.float64), minlength=n)
            codes, row = word_codes(part)
            c = look_up(WORDS, codes).astype(np.int64)
            base = np.bincount(row, weights=np.log10((c + 1) / (tokens + vocabulary + 1)), minlength=n)
            keys.append(part.rows.column(0))
            for col, x in zip(cols, (np.bincount(row, minlength=n), np.bincount(row, weights=c > 0, minlength=n), base, bits), strict=True):
                col.append(x)
        n_tokens, n_known, base, bits = (np.concatenate(c) if c else np.empty(0) for c in cols)
        return pa.table({"key": pa.chunked_array(keys, type=table.schema.field("key").type), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)), "train_tokens": pa.array(np.full(len(base), tokens, dtype=np.int64)), "base_score": pa.array(base), "score": pa.array(bits)})

    scored = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(total, f"key {kind_of_key}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("key", key)
