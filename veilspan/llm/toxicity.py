"""Operator 5: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has the hashed features of its
distinct words (the word and its beginnings of 3 to 7 letters) and a logistic
probability p; the document's is the noisy-or 1 - prod(1 - p).  The prior of a
sentence falls with the number n of sentences of its document, by n to the power
of a learned `spread`, so a long clean document does not add up to a toxic one.
Weights, prior and spread are fitted to document labels only, by full-batch Adam
on the likelihood of the noisy-or, so blame falls on the sentences that raise
it; the same sentence probabilities then locate offending sentences.

Fitting uses at most `FIT_ROWS` labelled documents (those with the smallest hash
of their key) and, of these, as many in that order as have `FIT_BYTES` of text
together (and the one that goes beyond it; of several texts of a key the longest
counts), on the driver; scoring is a narrow
map over all rows with a weight vector of fixed size.

Defined results: a null or empty text has no sentence and gets the score of an
empty product, 0.  Words are lower-cased with punctuation at their ends removed.
Without rows of both labels all weights are zero and every sentence has the prior
probability.  Labels are joined by key; rows with a null key or label take no
part in fitting, but are scored.  A key that has several labels has the largest,
one that has several texts is fitted with the largest in byte order.  Repeated
rows are scored alike.  A sentence, however long, is one instance.  Of equally
offending sentences the first is reported.  An empty table gives no rows.  Other
columns do not matter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, if_small

#: The bounds on labelled documents used for fitting.
FIT_ROWS = 6000
FIT_BYTES = 32 << 20
BITS = 18
#: Lengths of the beginnings of a word that are features.
BEGINNINGS = range(3, 8)
#: Words that a worker remembers, at most, and the longest such word.
REMEMBERED, LONGEST = 500_000, 64
_SENTENCE = re.compile(r"[^.!?|\n]+[.!?|]*")
_STRIP = " \t\r\n\v\f.,;:!?\"'()[]{}<>|*#$%&-_/\\"


@dataclass(frozen=True)
class Model:
    """Weights by hashed feature; prior log-odds of a sentence; power of the number of sentences by which they fall."""

    weights: np.ndarray
    bias: float
    spread: float

    def priors(self, n: int) -> float:
        return self.bias - self.spread * np.log(max(n, 1))


def features(word: str, bits: int = BITS) -> list[int]:
    """The distinct hashed features of a word in lower case."""
    names = ["w" + word, *("^" + word[:k] for k in BEGINNINGS if k < len(word))]
    return sorted({xxhash.xxh32_intdigest(x.encode()) & ((1 << bits) - 1) for x in names})


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text that hold a word."""
    return [m.span() for m in _SENTENCE.finditer(text or "") if m.group().strip(_STRIP)]


def sentence_words(sentence: str) -> set[str]:
    return {w for x in sentence.lower().split() if (w := x.strip(_STRIP))}


class Bags:
    """Documents as index arrays: feature of word, word of sentence, sentence of document."""

    def __init__(self, texts: list[str], bits: int = BITS):
        words: dict[str, int] = {}
        of_word: list[list[int]] = []
        sentence, word, document = array("q"), array("q"), array("q")
        for d, text in enumerate(texts):
            for a, b in sentences(text):
                for w in sorted(sentence_words(text[a:b])):
                    if w not in words:
                        words[w] = len(words)
                        of_word.append(features(w, bits))
                    sentence.append(len(document))
                    word.append(words[w])
                document.append(d)
        self.sentence, self.word, self.document = (np.frombuffer(x, dtype=np.int64) if x else np.empty(0, dtype=np.int64) for x in (sentence, word, document))
        self.feature_word = np.repeat(np.arange(len(of_word)), [len(f) for f in of_word])
        self.feature = np.array([f for fs in of_word for f in fs], dtype=np.int64)
        self.sizes = len(texts), len(document), len(of_word), 1 << bits
        self.log_n = np.log(np.maximum(np.bincount(self.document, minlength=len(texts)), 1))[self.document]

    def likelihood(self, labels: np.ndarray, weights: np.ndarray, bias: float, spread: float) -> tuple[float, np.ndarray, float, float]:
        """Mean negative log-likelihood of the noisy-or, and its gradients by weights, bias and spread."""
        n_docs, n_sentences, n_words, n_features = self.sizes
        of_word = np.bincount(self.feature_word, weights=weights[self.feature], minlength=n_words)
        z = np.bincount(self.sentence, weights=of_word[self.word], minlength=n_sentences) + bias - spread * self.log_n
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.clip(np.exp(np.bincount(self.document, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs)), 1e-9, 1 - 1e-9)
        loss = -np.where(labels > 0, np.log1p(-none), np.log(none)).mean()
        # By z: p for a sentence of a clean document, -p*none/(1-none) for one of a toxic document.
        g = p * np.where(labels > 0, -none / (1 - none), 1.0)[self.document] / n_docs
        by_word = np.bincount(self.word, weights=g[self.sentence], minlength=n_words)
        return float(loss), np.bincount(self.feature, weights=by_word[self.feature_word], minlength=n_features), float(g.sum()), float(-(g * self.log_n).sum())


def fit(texts: list[str], labels: list[int], bits: int = BITS, rounds: int = 200, rate: float = 0.05, l2: float = 1e-4) -> Model:
    w, bias, spread = np.zeros(1 << bits), -5.0, 0.5
    bags, y = Bags(texts, bits), np.array(labels, dtype=float)
    if not len(bags.document) or len(set(labels)) < 2:
        return Model(w, bias, spread)
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for t in range(1, rounds + 1):
        _, by_weight, by_bias, by_spread = bags.likelihood(y, w, bias, spread)
        grad = np.append(by_weight + l2 * w, (by_bias, by_spread))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-2]
        bias, spread = bias - step[-2], max(0.0, spread - step[-1])
    return Model(w, float(bias), float(spread))


def noisy_or(p: np.ndarray) -> float:
    return float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    """A model fitted to labelled documents for which `learn` holds, within the bounds, chosen by the hash of their key."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.lit(True) if learn is None else learn)).groupBy(key).agg(F.max(label).alias("_y"))
    chosen = marked.orderBy(F.xxhash64(F.col(key)), key).limit(rows)
    own = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    sizes = own.select(key, F.octet_length("_t").cast("long").alias("_n")).join(if_small(chosen, rows), key).groupBy(key, "_y").agg(F.max("_n").alias("_n"))
    # The window runs over at most `rows` keys and lengths; only texts within the bound are fetched.
    before = F.sum("_n").over(Window.orderBy(F.xxhash64(F.col(key)), key).rowsBetween(Window.unboundedPreceding, -1))
    within = sizes.withColumn("_before", before).where(F.coalesce("_before", F.lit(0)) < most_bytes).select(key, "_y")
    taken = own.join(if_small(cut(within), rows), key).groupBy(key, "_y").agg(F.max("_t").alias("_t")).select(key, "_t", "_y").collect()
    taken.sort(key=lambda r: r[0])
    return fit([r[1] for r in taken], [int(r[2]) for r in taken])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, worst_start, worst_end, worst_score): the document's probability and its most offending sentence (null where there is none)."""
    held = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias, model.spread))  # 2**BITS values, whatever the input
    bits = int(len(model.weights)).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: Model = held.value
        known: dict[str, tuple[str, float]] = {}  # by token as written: the word, and the sum of its weights

        def look_up(token: str) -> tuple[str, float]:
            word = token.lower().strip(_STRIP)
            got = word, float(trained.weights[features(word, bits)].sum()) if word else 0.0
            if len(token) <= LONGEST:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[token] = got
            return got

        for batch in batches:
            scores, starts, ends, worst = [], [], [], []
            for value in batch.column(1).to_pylist():
                spans = sentences(value)
                sums = [sum(dict(known.get(token) or look_up(token) for token in value[a:b].split()).values()) for a, b in spans]
                p = 1 / (1 + np.exp(-np.clip(np.array(sums) + trained.priors(len(spans)), -30, 30)))
                scores.append(noisy_or(p))
                k = int(p.argmax()) if len(p) else None
                starts.append(spans[k][0] if k is not None else None)
                ends.append(spans[k][1] if k is not None else None)
                worst.append(float(p[k]) if k is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(worst, pa.float64())], ["key", "score", "worst_start", "worst_end", "worst_score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, score double, worst_start int, worst_end int, worst_score double").withColumnRenamed("key", key)
