"""Operator 2: n-gram Jaccard join by vertical partitioning.

A document's set holds its distinct n-gram hashes.  Two documents link when
den * |A & B| >= num * |A | B|.  Equal sets are one class, represented by its
smallest id; only representatives are joined.

The n-grams have one global order, that of their hashes; its beginning, a fixed
share of the range, is level 0.  Vertical partitioning cuts the order into
FRAGMENTS ranges of equal width, which hold equally many n-grams: each fragment
counts the partial overlap of every candidate pair from its own segments, and
the parts are summed per pair and verified.  Pairs inside hot groups are counted
so too.

Candidates come from prefixes.  For these the n-grams inside a level are ordered
by the number of documents that hold them, rare ones first.  A set reports its
level 0, or everything where level 0 does not hold its prefix; counts are counts
of reports, so the order is the same for all.  Two linked sets share an n-gram in
their prefixes, the first n - ceil(t*n) + 1 in that order.

Hot groups: n-grams held by the prefixes of many sets name a hub (the smallest
id).  Members of a hub are described by their difference to it.  A member near
enough to its hub is linked to it by arithmetic alone.  Two members of a hub
can be linked otherwise only if at least one is not near, and then they share a
minimum number of n-grams of their differences; these pairs are found by the
same prefix join over differences, in which far members that share a difference
with many others get a hub among themselves first.  So a large group of near copies never
becomes all its pairs, and no link that decides a component is lost.

Defined results: without words or text a document has the empty set, links
with nothing and is its own component.  Rows with a null key are returned with
a null component and link with nothing.  Repeated rows share their component.
Of equal sets the smallest key stands for all; ties in counts are ordered by
hash.  Where rows of one key have different sets, these rows link with equal
sets only.
A text, or a word, of any length is handled whole in one task.  An empty table
gives no rows.  Other columns do not matter.  A key that is no integer is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import components, cut, if_small
from .textcore import int_list, mix, ngrams, slices

#: Sets whose prefixes share an n-gram, from which on a hub is named.
HOT = 32
#: Members of a hub that share one copy of its set.
HUB_SHARE = 256
#: One in so many members of a hub must differ in an n-gram for it to count as common among them.
COMMON = 16
#: Far members of a hub that share a difference, from which on they get a hub of their own, and how often at most.
FAR, NESTED = 256, 3
#: Fragments of the global order.
FRAGMENTS = 4
_TOP = 1 << 63


def _sets(part, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes (63 bits) of each row of a slice."""
    words = part.word_hashes()
    grams = ngrams(words, n) >> np.uint64(1)
    for a, b in zip(part.docs[:-1].tolist(), part.docs[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngrams(words[a:b], b - a) >> np.uint64(1)
        else:
            yield grams[:0]


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def sketches(docs: DataFrame, n: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """(id, n, k1, k2, m0, grams): size and identity of each set, its reported n-grams, m0 of level 0."""
    level0 = np.uint64(min(1.0, 1.75 * (1 - num / den)) * _TOP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, key):
            size, k1, k2, m0, grams = [], [], [], [], []
            for s in _sets(part, n):
                size.append(len(s))
                k1.append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                low = int(np.searchsorted(s, level0))
                m0.append(low)
                grams.append(s[:low] if low >= _prefix(len(s), num, den) else s)
            yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(size, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(m0, pa.int32()), int_list(grams)], ["id", "n", "k1", "k2", "m0", "grams"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, "id long, n int, k1 long, k2 long, m0 int, grams array<long>")


def full_sets(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """(id, grams): the whole sorted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, key):
            yield pa.RecordBatch.from_arrays([part.rows.column(0), int_list(list(_sets(part, n)))], ["id", "grams"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, "id long, grams array<long>")


def _positions(rows: DataFrame, keep: str, by: list[str]) -> DataFrame:
    """Explodes `held`, a sorted array of (lvl, c, g) whose n-grams with one holder were left out, to (g, pos).

    `pos` is the place in the whole order: n-grams with one holder come first in
    their level.  Only rows for which `keep` holds stay.
    """
    return (
        rows.withColumn("r0", F.expr("size(filter(held, x -> x.lvl = 0))"))
        .withColumn("at", F.expr("transform(held, (x, i) -> struct(x.g as g, case when x.lvl = 0 then m0 - r0 + i else n_all - size(held) + i end as pos))"))
        .withColumn("at", F.expr(f"filter(at, x -> {keep})"))
        .select(*by, F.inline("at"))
    )


def _postings(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n, g, pos): n-grams of prefixes that another set reports too."""
    grams = reps.select("id", "n", "m0", F.size("grams").alias("n_all"), F.posexplode("grams").alias("i", "g"))
    grams = grams.withColumn("lvl", F.expr("if(i < m0, 0, 1)")).drop("i")
    counts = cut(grams.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"))  # read again, so that a skewed side of the join can be split
    held = grams.join(counts, "g").groupBy("id").agg(F.first("n").alias("n"), F.first("m0").alias("m0"), F.first("n_all").alias("n_all"), F.sort_array(F.collect_list(F.struct("lvl", "c", "g"))).alias("held"))
    return _positions(held, f"x.pos <= n - ceil({num} * n / {den}.0D)", ["id", "n"])


def overlaps(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """(a, b, i) of pairs (a, b) of `sets` (id, an array of n-grams): i is the size of the intersection.

    Vertical partitioning: each fragment of the order counts the partial overlap of
    its own segments, and the parts are summed per pair.
    """
    width = _TOP // FRAGMENTS
    above = [f" and x < {(f + 1) * width}L" for f in range(FRAGMENTS - 1)] + [""]  # the last fragment has no upper end
    cuts = ", ".join(f"struct({f} as f, filter({column}, x -> x >= {f * width}L{above[f]}) as seg)" for f in range(FRAGMENTS))
    segments = sets.selectExpr("id", f"inline(array({cuts}))").where("size(seg) > 0")
    both = pairs.join(segments.selectExpr("id a", "f", "seg sa"), "a").join(segments.selectExpr("id b", "f", "seg sb"), ["b", "f"])
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("part")).groupBy("a", "b").agg(F.sum("part").alias("i"))


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets (id, grams) that link."""
    sizes = sets.selectExpr("id", "size(grams) n")
    sums = overlaps(pairs, sets, "grams").join(sizes.selectExpr("id a", "n na"), "a").join(sizes.selectExpr("id b", "n nb"), "b")
    return sums.where(f"{den} * i >= {num} * (na + nb - i)").select("a", "b")


def _difference_rows(delta: DataFrame, counts: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, ..., m0, n_all, lvl, g): n-grams of the differences `d` up to where the prefix, places 0 to `last`, may end.

    n-grams that more than one in COMMON members of a hub differ in are level 1 and
    come last; there are fewer than COMMON times as many as a difference has on
    average.  Where the m0 others hold the prefix, these alone are returned.
    """
    common = counts.join(delta.groupBy("hub").agg(F.count("*").alias("members")), "hub").where(f"{COMMON} * c > members").groupBy("hub").agg(F.collect_list("g").alias("common"))
    common = common.join(copies, "hub").select("hub", "common", F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"))
    rows = delta.join(common, ["hub", "copy"], "left").withColumn("rest", F.expr("if(common is null, d, array_except(d, common))"))
    rows = rows.withColumn("m0", F.size("rest")).withColumn("n_all", F.size("d")).withColumn("some", F.expr("if(last < m0, rest, concat(rest, array_except(d, rest)))"))
    rows = rows.select("id", "hub", "p", "w", "near", "m0", "n_all", "last", "last_far", F.posexplode("some").alias("i", "g"))
    return rows.withColumn("lvl", F.expr("if(i < m0, 0, 1)")).drop("i")


def _hubs(postings: DataFrame, by: list[str], most: int) -> DataFrame:
    """(id, hub) of sets that share an n-gram of `postings` (id, *by), which more than `most` sets hold: the smallest id among these."""
    hot = cut(postings.groupBy(*by).agg(F.count("*").alias("c"), F.min("id").alias("up")).where(F.col("c") > most).select(*by, "up"))
    hubs = cut(postings.select("id", *by).join(hot, by).groupBy("id").agg(F.min("up").alias("hub")))
    for _ in range(2):  # a hub's own hub
        hubs = hubs.join(hubs.selectExpr("id as hub", "hub as up"), "hub", "left").selectExpr("id", "coalesce(up, hub) hub")
    return cut(hubs)


def _hub_links(members: DataFrame, sets: DataFrame, num: int, den: int, nested: int = NESTED) -> DataFrame:
    """Links that decide components among members (id, hub) of hubs.

    Members far from their hub that share a difference with more than FAR others
    get a hub among themselves, `nested` times at most; what is left is paired.
    """
    near = F.expr(f"w <= {den - num} * p")
    # A hub's set is held once for every HUB_SHARE members, each of which meets one of these copies.
    copies = members.groupBy("hub").agg(F.ceil(F.count("*") / HUB_SHARE).cast("int").alias("copies"))
    placed = members.where("id <> hub").join(copies, "hub").withColumn("copy", F.expr("cast(pmod(xxhash64(id), copies) as int)")).select("id", "hub", "copy")
    bases = sets.withColumnRenamed("id", "hub").join(copies, "hub").select("hub", F.col("grams").alias("base"), F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"))
    own = placed.join(sets, "id").join(bases, ["hub", "copy"])
    delta = own.selectExpr("id", "hub", "copy", "size(base) p", "array_except(base, grams) lost", "array_except(grams, base) more").selectExpr("id", "hub", "copy", "p", f"{den} * size(lost) + {num} * size(more) w", "concat(lost, more) d")
    delta = cut(delta.withColumn("near", near))
    star = delta.where("near").selectExpr("hub a", "id b")
    # The least overlap of differences that any pair looked for has: with a far set, and for a far set with any.
    both = f"ceil((w + 1) / {den + num}.0D)"
    far = f"greatest(1, ceil((w - {den - num} * p) / {den}.0D))"
    delta = delta.withColumn("last", F.expr(f"size(d) - if(near, {both}, {far})")).withColumn("last_far", F.expr(f"size(d) - if(near, {both}, greatest({both}, {far}))"))
    counts = cut(delta.select("hub", "near", F.explode("d").alias("g")).groupBy("hub", "g").agg(F.count("*").alias("c"), F.count_if(~F.col("near")).alias("nf")).where("c > 1 and nf > 0"))
    rows = _difference_rows(delta, counts, copies)
    held = rows.join(counts, ["hub", "g"]).groupBy("id").agg(
        *[F.first(c).alias(c) for c in ("hub", "p", "w", "near", "m0", "n_all", "last", "last_far")],
        F.sort_array(F.collect_list(F.struct("lvl", "c", "g"))).alias("held"),
    )
    held = held.withColumn("m", F.col("n_all"))
    at = _positions(held, "x.pos <= last", ["id", "hub", "p", "w", "near", "m", "last_far"]).withColumn("short", F.expr("pos <= last_far"))
    at, links, sub = cut(at), star, at.sparkSession.createDataFrame([], "id long, sub long")
    if nested and not at.where("not near").groupBy("hub", "g").count().where(f"count > {FAR}").isEmpty():
        deeper = _hubs(at.where("not near"), ["hub", "g"], FAR)
        links, sub = links.unionByName(_hub_links(deeper, sets, num, den, nested - 1)), deeper.withColumnRenamed("hub", "sub")
    at = at.join(sub, "id", "left").withColumn("sub", F.coalesce("sub", "id"))
    a, b = at.alias("a"), at.alias("b")
    on = F.expr(
        f"""a.hub = b.hub and a.g = b.g and a.id <> b.id and a.sub <> b.sub and not a.near and (b.near or (a.short and b.short and a.id < b.id))
            and {den + num} * (1 + least(a.m - a.pos - 1, b.m - b.pos - 1)) >= a.w + b.w - {den - num} * a.p"""
    )
    pairs = cut(a.join(b, on).selectExpr("a.id a", "b.id b").distinct())
    sums = overlaps(pairs, delta, "d").join(delta.selectExpr("id a", "w wa", "p"), "a").join(delta.selectExpr("id b", "w wb"), "b")
    more = sums.where(f"{den + num} * i >= wa + wb - {den - num} * p").select("a", "b")
    return links.unionByName(more)


def representatives(docs: DataFrame, n: int, num: int, den: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(sketch of every row, links between representatives)."""
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} is not an integer column")
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    sketch = cut(sketches(docs, n, num, den, key, text))
    several = sketch.where("n > 0").groupBy("id").agg(F.min(F.struct("k1", "k2", "n")).alias("lo"), F.max(F.struct("k1", "k2", "n")).alias("hi")).where("lo <> hi").select("id", F.lit(True).alias("odd"))
    sketch = sketch.join(if_small(cut(several)), "id", "left").withColumn("odd", F.expr("coalesce(odd, false)"))
    reps = sketch.where("n > 0 and id is not null and not odd").groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "m0", "grams")).alias("x")).select("n", "x.*")
    postings = cut(_postings(reps, num, den))
    hubs = _hubs(postings, ["g"], HOT)
    at = postings.join(hubs, "id", "left").selectExpr("id", "n", "g", "pos", "coalesce(hub, id) hub")
    mixed = at.groupBy("g").agg(F.min("hub").alias("lo"), F.max("hub").alias("hi")).where("lo <> hi").select("g")
    at = at.join(mixed, "g")
    a, b = at.alias("a"), at.alias("b")
    on = F.expr(
        f"""a.g = b.g and a.id < b.id and a.hub <> b.hub and {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
            and {den + num} * (1 + least(a.n - a.pos - 1, b.n - b.pos - 1)) >= {num} * (a.n + b.n)"""
    )
    pairs = cut(a.join(b, on).selectExpr("a.id a", "b.id b").distinct())
    wanted = pairs.selectExpr("a id").union(pairs.selectExpr("b")).union(hubs.select("id")).distinct()
    sets = cut(full_sets(docs.join(if_small(wanted.withColumnRenamed("id", key)), key, "left_semi"), n, key, text).dropDuplicates(["id"]))
    return sketch, _verify(pairs, sets, num, den).unionByName(_hub_links(hubs, sets, num, den))


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, class_id, component_id): class_id is the smallest id with the same set.

    The key is an integer column.  num/den is the similarity from which on documents link.
    """
    sketch, links = representatives(docs, n, num, den, key, text)
    labels = components(links)
    classes = sketch.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min(F.struct("odd", "id")).alias("x")).selectExpr("k1", "k2", "n", "x.id class_id")
    classes = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").selectExpr("k1", "k2", "n", "class_id", "coalesce(component, class_id) component_id")
    classes = cut(classes)  # read again, so that the rows of a class with very many copies can be split in the join
    rows = sketch.select("id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left")
    return rows.selectExpr(f"id as {key}", "cast(n as long) n_shingles", "if(id is null, null, coalesce(class_id, id)) class_id", "if(id is null, null, coalesce(component_id, id)) component_id")
