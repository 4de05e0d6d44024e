"""Operator 4: quality rules as a short-circuit cascade.

Each rule says when a document is rejected.  On a sample, each rule is timed
and its rejections are counted; rules are then ordered by rejections per
second.  They are evaluated in that order, each only where no earlier one has
rejected, so that a document which an early rule rejects never reaches the
later, dearer ones.  The order changes what is evaluated and which rule is
named as the first to reject, never the verdict.

Main path: built-in functions only, a chain of narrow projections.  Steps that
are used more than once are columns of their own, so each is evaluated once.

Defined results: a null text counts as empty; it has no words and is rejected
for having too few.  Repeated rows give repeated results, rows with null keys are
judged like others, an empty table gives no rows.  A text, or a word, of any length is judged whole.
Rules that reject equally fast keep their given order.  Columns beside the key
and the text do not matter; helper columns begin with `_q_`, and a column
`rejected_by` of the input is replaced by that of `cascade`, kept by `keep`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 400

T, W, N = "_q_text", "_q_words", "_q_n"
Step = tuple[str, Callable[[], Column]]


def _count(mark: str) -> Column:
    """Occurrences of a short literal in the text, without overlaps."""
    return (F.length(T) - F.length(F.replace(F.col(T), F.lit(mark), F.lit("")))) / len(mark)


def word_chars() -> Column:
    return F.length(F.array_join(W, "")).cast("long")


def n_symbols() -> Column:
    bare = F.col(T)
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    return (F.length(T) - F.length(bare)).cast("long")


def n_dup_lines() -> Column:
    lines = F.filter(F.split(T, "\n", -1), lambda u: F.btrim(u, F.lit(BLANK_CHARS)) != "")
    return F.aggregate(F.array(lines), F.lit(0), lambda _, x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeat_steps() -> list[Step]:
    """Steps to `_q_repeat`: words inside 3-word windows found twice or more, first occurrences included.

    Windows are hashes.  Where all are distinct the count is 0; else they are
    sorted with their places, equal neighbours give the places of repeated
    windows, and the gaps between places give the covered words.
    """
    n = F.col(N)
    hashes = F.slice(F.transform(W, lambda w, i: F.xxhash64(w, F.get(W, i + 1), F.get(W, i + 2))), 1, F.greatest(n - 2, F.lit(0)))
    same = lambda x, i, d: x["h"].eqNullSafe(F.get("_q_sorted", i + d)["h"])
    return [
        ("_q_hashes", lambda: F.when(n > 3, hashes)),
        ("_q_sorted", lambda: F.when(F.size("_q_hashes") > F.size(F.array_distinct("_q_hashes")), F.sort_array(F.transform("_q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))),
        ("_q_at", lambda: F.sort_array(F.transform(F.filter("_q_sorted", lambda x, i: same(x, i, 1) | same(x, i, -1)), lambda x: x["i"]))),
        ("_q_repeat", lambda: F.coalesce(F.aggregate(F.transform("_q_at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_q_at", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long")),
    ]


@dataclass(frozen=True)
class Rule:
    """Steps make helper columns; `rejects` gives a boolean column."""

    name: str
    rejects: Callable[[], Column] = field(compare=False)
    steps: Callable[[], list[Step]] = field(compare=False, default=list)


def default_rules() -> list[Rule]:
    """The production rules."""
    return [
        Rule("few_words", lambda: F.col(N) < 50),
        Rule("repeated_windows", lambda: 100 * F.col("_q_repeat") > 50 * F.col(N), repeat_steps),
        Rule("symbols", lambda: 10 * F.col("_q_symbols") > F.col(N), lambda: [("_q_symbols", n_symbols)]),
        Rule("repeated_lines", lambda: 10 * F.col("_q_dup_lines") > 3 * F.size(F.split(T, "\n", -1)), lambda: [("_q_dup_lines", n_dup_lines)]),
        Rule("word_length", lambda: ~F.col("_q_chars").between(2 * F.col(N), 15 * F.col(N)), lambda: [("_q_chars", word_chars)]),
        Rule("capitals", lambda: 10 * F.length(F.regexp_replace(T, "[^A-Z]+", "")) > 3 * F.length(T)),
        Rule("shouting", lambda: 10 * _count("!!") > F.col(N)),
    ]


def prepared(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with the text, its words and their number."""
    bare = F.btrim(F.col(T), F.lit(BLANK_CHARS))
    docs = docs.withColumn(T, F.coalesce(F.col(text).cast("string"), F.lit("")))
    docs = docs.withColumn(W, F.when(bare != "", F.split(bare, BLANKS, -1)).otherwise(F.array().cast("array<string>")))
    return docs.withColumn(N, F.size(W).cast("long"))


def _apply(docs: DataFrame, rules: list[Rule], ready: set[str]) -> DataFrame:
    docs = docs.withColumn("rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        alive = F.col("rejected_by").isNull()
        for name, step in rule.steps():
            if name not in ready:
                docs = docs.withColumn(name, F.when(alive, step()))
                ready.add(name)
        docs = docs.withColumn("rejected_by", F.coalesce("rejected_by", F.when(alive & rule.rejects(), F.lit(rule.name))))
    return docs


def order_rules(docs: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS, runs: int = 3) -> list[Rule]:
    """`rules` by rejections per second on a sample of about `rows` documents, the best first; ties keep the given order.

    The sample is drawn from all rows, each with the same chance, and holds twice `rows` at most.  Each rule runs once
    unmeasured, for its code to be compiled, then `runs` times; its cost is the
    shortest of these less that of a job that only reads the sample.
    """
    share = min(1.0, rows / max(1, docs.count()))
    held = [r[0] for r in docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).sample(share, 4).limit(2 * rows).collect()]
    if not held:
        return list(rules)
    sample = prepared(docs.sparkSession.createDataFrame([(t,) for t in held], "t string").coalesce(1), "t")

    def measured(job: DataFrame) -> tuple[float, int]:
        took, count = [], job.first()[0]
        for _ in range(runs):
            began = time.perf_counter()
            job.first()
            took.append(time.perf_counter() - began)
        return min(took), count

    empty, _ = measured(sample.agg(F.count(N)))
    scored = []
    for k, rule in enumerate(rules):
        took, rejected = measured(_apply(sample, [rule], set()).agg(F.count("rejected_by")))
        scored.append((-rejected / max(took - empty, 1e-3), k, rule))
    return [rule for *_, rule in sorted(scored, key=lambda s: s[:2])]


def cascade(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, ordered: bool = False) -> DataFrame:
    """`docs` with `rejected_by` (null: kept).  `ordered`: the rules are in cascade order already."""
    rules = default_rules() if rules is None else list(rules)
    rules = rules if ordered else order_rules(docs, rules, text)
    # The verdict passes through a generator: a filter on it would else be pushed down
    # through the projections, with all their expressions written out in it.
    own = [c for c in docs.columns if c != "rejected_by"]
    return _apply(prepared(docs, text), rules, set()).select(*own, F.explode_outer(F.array("rejected_by")).alias("rejected_by"))


def keep(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of `docs` that no rule rejects."""
    named = docs.withColumnRenamed("rejected_by", "_q_given") if "rejected_by" in docs.columns else docs
    return cascade(named, text, rules).where("rejected_by is null").select(*[F.col("_q_given").alias(c) if c == "rejected_by" else F.col(c) for c in docs.columns])


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    The base statistics are wanted for all rows, so they are made first and the
    rules read them; the rest of each rule runs as the cascade orders them.
    """
    rules = order_rules(docs, default_rules() if rules is None else list(rules), text)
    base = [("_q_chars", word_chars), ("_q_symbols", n_symbols), ("_q_dup_lines", n_dup_lines), *repeat_steps()]
    out = prepared(docs.select(F.col(key), F.col(text).alias("_q_in")), "_q_in")
    for name, step in base:
        out = out.withColumn(name, step())
    out = _apply(out, rules, {name for name, _ in base})
    failed = (F.col(N) < 50) | (100 * F.col("_q_repeat") > 50 * F.col(N))
    return out.select(key, F.col(N).alias("n_words"), F.col("_q_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"), F.col("_q_dup_lines").alias("n_dup_lines"), F.col("_q_repeat").alias("n_repeat_words"), failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"))
