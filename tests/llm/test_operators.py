"""Each operator against a brute-force version, and its edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import encoding, importance, jaccard, licenses, lm, pieces, quality_rules, substrings, tiling, token_counts, toxicity
from veilspan.llm.lookup import Lookup
from veilspan.llm.pieces import vocabulary
from veilspan.llm.prefixes import PrefixTable, programme
from veilspan.llm.queries import model_path, remainder
from veilspan.llm.tables import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, h long, key string"


def words(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = data.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    return WORD.findall(data)


def corpus():
    """Random texts with exact and near copies, shared passages, repeats, odd characters, nulls and a long text."""
    rng = random.Random(5)
    vocab = ["a", "the", "of", "Été", "naïve", "x y", "▁mark", "Ünder", "zoo,", "end."] + [f"w{i}" for i in range(150)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = make(60)
    texts = [None, "", "   \n\t ", "one", "one two", "the " * 90, "Released under the MIT License.\nrest"]
    base = make(200)
    texts += [base] * 4
    for _ in range(60):
        w = base.split(" ")
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(40)}"
        texts.append(" ".join(w))
    for _ in range(40):
        t = make(rng.randint(1, 120))
        texts.append(t)
        if rng.random() < 0.5:
            texts.append(t + " " + passage + "\n" + make(rng.randint(0, 30)))
        if rng.random() < 0.3:
            texts.append(t.upper() + " tail")
    texts.append(make(8000))
    texts.append(make(30) + "\n" + make(30) + "\n" + passage + "  " + passage)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    """Documents with further columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "k") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard(docs, rows, n, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, n, num, 100).collect()}
    assert got == brute_components(rows, n, num, 100)


def test_jaccard_edges(spark, docs, none):
    assert jaccard.join(none).count() == 0
    twice = frame(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, None), (8, "")])
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard.join(twice).collect())
    assert got == [(-1, None), (3, 3), (3, 3), (5, 3), (8, 8), (9, 9)]


def test_jaccard_odd_keys(spark):
    """Rows of one key with different texts link with equal sets only; other keys are not disturbed."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base + " more"
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, [(1, base), (1, "quite other words stand in this one"), (2, near), (3, base), (4, base + " tail")])).collect())
    assert got == [(1, 3, 1), (1, 56, 2), (2, 57, 2), (3, 56, 2), (4, 57, 2)]
    with pytest.raises(ValueError):
        jaccard.join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def marker(n):
    """The first n letters of the Thue-Morse word over a and b, and its complement: alike under sums of powers modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 1024, 4096])
def test_words_that_differ_have_different_hashes(spark, n):
    """Texts that share no word but marker words that collide under weak hashes: nothing links, repeats or is known."""
    from veilspan.llm.textcore import byte_hashes

    a, b = marker(n)
    data = np.frombuffer((a + b).encode(), dtype=np.uint8)
    assert len(set(byte_hashes(data, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    left, right = ("\n".join([f"{w}{i % 2}" if i % 2 else w for i in range(40)]) for w in (a, b))
    docs = frame(spark, [(1, left), (2, right)])
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 2}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup(docs).collect()} == {i: x[:2] for i, x in brute_dedup([(1, left), (2, right)]).items()}
    assert {r.doc_id: r.n_known for r in lm.score(docs, F.col("doc_id") == 1).collect()} == {1: 41, 2: 1}
    items = spark.createDataFrame([(1, left)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in tiling.decontaminate(docs, items).collect()} == {1: True, 2: False}


def test_hashes_of_all_lengths():
    """Equal bytes have equal hashes wherever they stand; words of up to 70 bytes that differ in one byte differ."""
    from veilspan.llm.textcore import byte_hashes

    rng = random.Random(7)
    words_ = [bytes(rng.choice(b"ab\x00\xff") for _ in range(n)) for n in range(1, 71) for _ in range(20)]
    words_ = sorted(set(words_ + [w + b"\x00" for w in words_]))
    order = rng.sample(range(len(words_)), len(words_)) * 2
    data = np.frombuffer(b" ".join(words_[i] for i in order), dtype=np.uint8)
    ends = np.cumsum([len(words_[i]) + 1 for i in order]) - 1
    h = byte_hashes(data, ends - np.array([len(words_[i]) for i in order]), ends)
    assert (h[: len(words_)] == h[len(words_) :]).all() and len(set(h.tolist())) == len(words_)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {100: 90, 95: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_dedup(rows, window=20):
    first, tokens = {}, {i: words(t) for i, t in rows}
    for i in sorted(tokens):
        w = tokens[i]
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    out = {}
    for i, w in tokens.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("sizes", "flush"), [((24 << 20, 24 << 20), 2_000_000), ((9_000, 9_000), 500)])
def test_dedup(docs, rows, sizes, flush):
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.dedup(docs, sizes=sizes, flush=flush).collect()}
    assert got == brute_dedup(rows)


def test_dedup_edges(spark, none):
    assert substrings.dedup(none).count() == 0
    text = " ".join(f"t{i}" for i in range(30))
    got = sorted((r.doc_id or -1, r.n_removed) for r in substrings.dedup(frame(spark, [(2, text), (2, text), (4, text), (None, text), (1, None)])).collect())
    assert got == [(-1, 0), (1, 0), (2, 0), (2, 0), (4, 30)]


def brute_ppm(train, text, order):
    """log10 probability by plain dictionaries."""
    counts = defaultdict(Counter)
    stream = lambda t: b"\n" * order + b" ".join(words(t, True)) + b"\n"
    for t in train:
        s = stream(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    s, total = stream(text), 0.0
    for i in range(order, len(s)):
        gone = set()
        for k in range(order, -1, -1):
            seen = {b: c for b, c in counts[s[i - k : i]].items() if b not in gone} if s[i - k : i] in counts else {}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if s[i] in seen:
                total += math.log10(seen[s[i]] / (n + d))
                break
            total += math.log10(d / (n + d))
            gone |= set(seen)
        else:
            total -= math.log10(256 - len(gone))
    return total


@pytest.mark.parametrize(("order", "share", "size"), [(3, 1, 1 << 25), (5, 1, 1 << 25), (5, 0.0005, 4_000)])
def test_lm(docs, rows, order, share, size):
    few = [r for r in rows if len(r[1] or "") < 3000][:60]
    part = docs.where(F.col("doc_id").isin([i for i, _ in few]))
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in few}
    train = [t for i, t in few if not held[i]]
    counts = Counter(w for t in train for w in [*words(t, True), None])
    total, distinct = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm.score(part, remainder(7) != 2, order=order, least_share=share, sizes=(size, size)).collect()}
    assert len(got) == len(few)
    for i, t in few:
        tokens = [*words(t, True), None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, brute_ppm(train, t, order), rel_tol=1e-9, abs_tol=1e-9)


def test_lm_edges(spark, none):
    assert lm.score(none, F.lit(True)).count() == 0
    got = {r.doc_id: r for r in lm.score(frame(spark, [(1, None), (2, "")]), F.lit(False)).collect()}
    assert got[1].n_tokens == 1 and math.isclose(got[2].score, -math.log10(256)) and got[1].train_tokens == 0


def brute_stats(text):
    w = words(text)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [u for u in (text or "").split("\n") if words(u)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, rows, none):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality_rules.keep(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    for order in (list(reversed(quality_rules.default_rules())), quality_rules.default_rules()):
        assert {r.doc_id for r in quality_rules.cascade(docs, rules=order, ordered=True).where("rejected_by is null").collect()} == kept
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep(none).count() == 0


def test_licenses(spark, none):
    texts = {1: "x y\nReleased under the MIT license!", 2: "released under the license", 3: None, 4: "", 5: "This work is licensed under the GNU General Public License, version 2", 6: licenses.TEMPLATES["MIT-text"].replace("deal", "trade")}
    got = {r.doc_id: [(m.unit, m.license) for m in r.matches] for r in licenses.scan(frame(spark, list(texts.items()))).collect()}
    assert got == {1: [(2, "MIT")], 2: [], 3: [], 4: [], 5: [(1, "GPL-2.0")], 6: [(1, "MIT-text")]}
    assert licenses.scan(none).count() == 0
    assert licenses.scan(frame(spark, [(1, "a")]), templates={}).first().matches == []


def test_token_counts(docs, rows, none):
    v = vocabulary(model_path())
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, model_path(), limit=50).collect()}
    for i, t in rows:
        t = t or ""
        assert (got[i].n_bytes, got[i].n_tokens) == (len(t.encode()), len(v.library.encode(t)))
        assert got[i].over_limit == (got[i].n_tokens > 50)
        assert len(v.library.encode(t[: got[i].fit_chars])) <= 50
    assert token_counts.count_tokens(none, model_path()).count() == 0


@pytest.mark.parametrize("text", ["hello there  world\n\tthe end", "Été naïve ▁mark x y 你好", " leading", "a", "aaaaaaabbb  ", "  ", "▁", "unbroken" * 30 + "😀"])
def test_prefix_counts(text):
    v = vocabulary(model_path())
    table = PrefixTable(v, text)
    want = [len(v.library.encode(text[:k])) for k in range(len(text) + 1)]
    assert [table.count(k) for k in range(len(text) + 1)] == want
    for budget in range(len(want)):
        assert table.fit(budget) == max(k for k, c in enumerate(want) if c <= budget)


def test_prefix_programme(rows, monkeypatch):
    """Totals of all units and counts of their prefixes equal the library's, together and one by one."""
    v, rng = vocabulary(model_path()), random.Random(2)
    letters = ["a", "e", "n", "s", "t", "th", "ing", "\n", "é", "世", "😀", "0", "\t", "-"]
    units = {u for _, t in rows for u in v.units(t or "")} | {" " * rng.randint(1, 4) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(1500)}
    units = sorted(units)
    got = programme(v).counts(units)
    assert [c[-1] for c in got] == v.unit_counts(units)
    some = rng.sample(range(len(units)), 120)
    for i in some:
        assert list(got[i])[1:] == [len(v.library.encode(units[i][1:k])) for k in range(2, len(units[i]) + 1)], units[i]
    monkeypatch.setattr("veilspan.llm.prefixes.TOGETHER", 0)
    assert programme(v).counts([units[i] for i in some]) == [got[i] for i in some]
    assert programme(v).counts([]) == []


def test_token_count_edges(spark, monkeypatch):
    """Null and repeated keys, a long unbroken text, truncation, counts of all prefixes; tables that overflow change nothing."""
    v = vocabulary(model_path())
    texts = [(None, "one two"), (None, None), (5, "same words"), (5, "same words"), (6, ""), (7, "x" * 1_000_000), (8, "Été ▁ naïve 你好 " * 40)]
    docs = frame(spark, texts)
    want = sorted((str(i), len((t or "").encode()), len(v.library.encode(t or ""))) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, model_path()).collect()) == want
    for r in token_counts.truncate(docs, model_path(), 9).collect():
        whole = [t or "" for i, t in texts if i == r.doc_id and (t or "").startswith(r.text)]
        assert whole and r.n_tokens == len(v.library.encode(r.text)) <= 9
        assert any(r.text == t or len(v.library.encode(t[: len(r.text) + 1])) > 9 for t in whole)
    counts = {r.doc_id: r.counts for r in token_counts.prefix_counts(docs.where("doc_id in (5, 6, 8)"), model_path()).collect()}
    assert counts[6] == [] and counts[5] == [len(v.library.encode("same words"[:k])) for k in range(1, 11)]
    assert counts[8][100:110] == [len(v.library.encode(texts[6][1][:k])) for k in range(101, 111)]
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    held, lines = token_counts.Remembered(v), [f"word{i % 7} other{i}" for i in range(60)]
    for line in lines:
        assert [c[-1] for c in held.of([v.units(line)])[0]] == v.unit_counts(v.units(line))


def test_lookup():
    rng = np.random.default_rng(8)
    keys = rng.choice(1 << 62, 5000, replace=False)
    table = Lookup(keys[:10], np.arange(10))
    for a in range(10, 5000, 499):
        table.add(keys[a : a + 499], np.arange(a, a + len(keys[a : a + 499])))
    assert len(table) == 5000 and (table.get(keys) == np.arange(5000)).all()
    assert (table.get(keys + 1)[~np.isin(keys + 1, keys)] == -1).all() and len(table.get(keys[:0])) == 0


@pytest.mark.parametrize("drop", [0, 1 << 29, 1 << 31, (1 << 32) - 1])
def test_matrix_of_agendas_equals_one_agenda(rows, drop):
    v, rng = vocabulary(model_path()), random.Random(9)
    letters = ["a", "e", "n", "s", "t", "th", "ing", "\n", "é", "世", "😀", "▁", "0", "\t"]
    units = [u for _, t in rows[:40] if t for u in pieces.spaced_units(t)]
    units += [" " * rng.randint(1, 4) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    units = list(dict.fromkeys(units))
    keys = np.array([pieces.mixed(11, k) for k in range(len(units))], dtype=np.uint64)
    assert (keys == pieces.mixed_all(11, np.arange(len(units), dtype=np.uint64))).all()
    assert v.encode_units(units, drop, keys) == [v.encode_unit(u, drop, k) for u, k in zip(units, keys.tolist(), strict=True)]
    assert v.encode_units([], drop, keys[:0]) == []


def test_encoding(docs, rows, none):
    v = vocabulary(model_path())
    texts = dict(rows)
    plain = {r.doc_id: r for r in encoding.encode(docs, model_path(), dropout=0.0).collect()}
    for i, t in rows:
        if "▁" not in (t or ""):
            assert plain[i].pieces == v.library.encode(t or "")
        assert plain[i].lossless
    varied = encoding.encode(docs, model_path(), dropout=0.3, seed=4)
    got = {r.doc_id: r.pieces for r in varied.collect()}
    assert got == {r.doc_id: r.pieces for r in encoding.encode(docs.repartition(5), model_path(), dropout=0.3, seed=4).collect()}
    assert sum(got[i] != plain[i].pieces for i in got) > len(got) / 2
    assert got != {r.doc_id: r.pieces for r in encoding.encode(docs, model_path(), dropout=0.3, seed=5).collect()}
    assert {r.doc_id: r.text for r in encoding.decode(varied, model_path()).collect()} == {i: t or "" for i, t in texts.items()}
    assert encoding.encode(none, model_path()).count() == 0


def test_toxicity(spark, none):
    rng = random.Random(3)
    clean = [f"c{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(clean) for _ in range(8)) + "." for _ in range(rng.randint(1, 8))]
        bad = rng.random() < 0.3
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] = sentences[k].replace(" ", f" {rng.choice(['vile', 'nasty', 'foul'])} ", 1)
        rows.append((i, " ".join(sentences)))
        marks.append((i, int(bad)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, learn=remainder(5) != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum((got[i].score >= 0.5) == bool(y) for i, y in marks) >= 590
    for i, y in marks:
        if y:
            assert re.search("vile|nasty|foul", rows[i][1][got[i].worst_start : got[i].worst_end])
    for i, t in rows[:50]:
        assert math.isclose(got[i].score, brute_noisy_or(model, t), rel_tol=1e-4, abs_tol=1e-6)
    long = ("x " * 30 + ". ") * 4000
    odd = {r.doc_id: r for r in toxicity.score(frame(spark, [(1, None), (2, ""), (3, "x " * 5000), (4, "y" * 2_000_000), (5, long), (None, "vile c1."), (6, "... !!! |")]), model).collect()}
    assert odd[1].score == odd[2].score == odd[6].score == 0 and 0 <= odd[3].score <= 1 and odd[6].worst_start is None
    assert odd[5].score < 0.5 and 0 <= odd[4].score < 0.5 and odd[None].score > odd[3].score
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def brute_noisy_or(model, text):
    """The probability of a document by plain loops."""
    bags = [toxicity.sentence_words(s) for s in re.findall(r"[^.!?|\n]+", text)]
    bags = [b for b in bags if b]
    none = 1.0
    for bag in bags:
        z = model.bias - model.spread * math.log(len(bags)) + sum(model.weights[f] for w in bag for f in toxicity.features(w))
        none *= 1 - 1 / (1 + math.exp(-z))
    return 1 - none


def test_toxicity_gradient():
    """Gradients of the likelihood against differences; the likelihood against plain loops."""
    texts, y = ["a bb. ccc dddd", "eeee! a a", "", "bb | ffff gggg. a. ccc"], np.array([1.0, 0, 0, 1])
    rng = np.random.default_rng(4)
    bags, w = toxicity.Bags(texts, 12), rng.normal(size=1 << 12)
    loss, by_weight, by_bias, by_spread = bags.likelihood(y, w, -1.0, 0.4)
    none = [1 - brute_noisy_or(toxicity.Model(_Wide(w), -1.0, 0.4), t) for t in texts]
    want = -np.mean([math.log(1 - n) if k else math.log(min(n, 1 - 1e-9)) for n, k in zip(none, y, strict=True)])
    assert math.isclose(loss, want, rel_tol=1e-6)
    step = 1e-6
    assert math.isclose((bags.likelihood(y, w, -1.0 + step, 0.4)[0] - loss) / step, by_bias, rel_tol=1e-3)
    assert math.isclose((bags.likelihood(y, w, -1.0, 0.4 + step)[0] - loss) / step, by_spread, rel_tol=1e-3)
    for k in np.flatnonzero(by_weight)[:8]:
        moved = w.copy()
        moved[k] += step
        assert math.isclose((bags.likelihood(y, moved, -1.0, 0.4)[0] - loss) / step, by_weight[k], rel_tol=1e-3, abs_tol=1e-9)


class _Wide:
    """Weights of fewer bits, looked up by features of all bits."""

    def __init__(self, w):
        self.w = w

    def __getitem__(self, k):
        return self.w[k & (len(self.w) - 1)]


def test_toxicity_bounds(spark):
    """Repeated rows and clashing names change nothing; the bounds on rows and bytes hold."""
    rows = [(i, ("vile thing. " if i % 2 else "nice thing. ") + f"w{i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    once, twice = frame(spark, rows), frame(spark, rows + rows)
    a, b = toxicity.train(once, labels), toxicity.train(twice, labels)
    assert (a.weights == b.weights).all() and a.bias == b.bias
    few = toxicity.train(once, labels, most_bytes=1)
    assert not few.weights.any()


def test_importance(spark, docs, rows, none):
    good = docs.where("doc_id % 3 = 0").select("doc_id")
    out = importance.resample(docs, good, share=0.4).collect()
    assert sum(r.selected for r in out) == round(0.4 * len(rows))
    worst = min(r.sort_key for r in out if r.selected)
    assert all(r.sort_key < worst for r in out if not r.selected)
    by = {r.doc_id: r for r in out}
    assert by[rows[0][0]].log_weight == 0 and by[rows[0][0]].n_grams == 0
    assert importance.resample(none, good).count() == 0
    values = spark.createDataFrame([(x,) for x in [1.0, 2.0, 2.0, 5.0, -3.0]], "v double")
    assert [importance.kth_largest(values, "v", k) for k in (1, 2, 3, 4, 5, 6)] == [5.0, 2.0, 2.0, 1.0, -3.0, None]


def test_tiling(spark, docs, rows, none):
    rng = random.Random(9)
    item = [f"q{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "tiny item"), (3, None), (4, ""), (5, " ".join(rng.choice("abc") for _ in range(40)))], "item_id long, text string")
    moved = " ".join(item[15:]) + " filler words here " + " ".join(item[:15]).upper() + "!"
    extra = [(5001, "pre " + " ".join(item) + " post"), (5002, moved), (5003, " ".join(item[:9])), (5004, "a tiny, item b")]
    got = {r.doc_id: r for r in tiling.decontaminate(docs.unionByName(frame(spark, extra)), items).collect()}
    assert got[5001].item_ids == [1] and got[5002].item_ids == [1] and got[5004].item_ids == [2]
    assert not got[5003].contaminated and got[5003].best_coverage == pytest.approx(9 / 30)
    assert not any(got[i].contaminated for i, _ in rows)
    small = {r.doc_id: r.item_ids for r in tiling.decontaminate(docs.unionByName(frame(spark, extra)), items, block_bytes=40).collect()}
    assert small == {i: r.item_ids for i, r in got.items()}
    assert tiling.decontaminate(none, items).count() == 0
    assert not tiling.decontaminate(frame(spark, extra), items.limit(0)).where("contaminated").count()
    assert sorted(tiling.tile([(0, 0, 8), (4, 4, 9), (20, 0, 4)], 3)) == [(0, 0, 4), (4, 4, 9)]


def test_textcore():
    from veilspan.llm.packing import pack, pack_sorted, unpack, unpack_sorted

    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(x)) == x).all() and (unpack(pack(x[::-1])) == x[::-1]).all() and len(unpack(pack(x[:0]))) == 0


def test_spark_hash(spark):
    from veilspan.llm.textcore import xxhash64_of_longs

    ids = [0, 1, -5, 123456789012345]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.xxhash64("i")).collect()]
    assert xxhash64_of_longs(np.array(ids)).tolist() == want


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_license_template_is_found(name):
    """The best template of each wording is its own, and no other has the same bigrams."""
    table = {k: set(licenses._template_bigrams(t)) for k, t in licenses.TEMPLATES.items()}
    assert table[name] and [k for k, b in table.items() if b == table[name]] == [name]


def test_license_families_and_bodies(spark):
    short = [f"Licensed under CC {c} {v}." for c in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("4.0", "3.0")]
    bodies = {k: t for k, t in licenses.TEMPLATES.items() if k.endswith("-body")}
    assert {"MIT-body", "BSD-2-Clause-body", "BSD-3-Clause-body", "Apache-2.0-body", "GPL-2.0-body", "GPL-3.0-body", "MPL-2.0-body", "ISC-body", "Zlib-body", "Unlicense-body"} <= set(bodies)
    texts = dict(enumerate([*short, *bodies.values(), "Released under the ISC License.", "Licensed under the Eclipse Public License 2.0."]))
    want = [f"CC-{t.split()[3]}-{t.split()[4][:3]}-short" for t in short] + [*bodies, "ISC", "EPL-2.0-short"]
    got = {r.doc_id: [m.license for m in r.matches if m.unit == 0 or m.unit == 1 and texts[r.doc_id].count("\n") == 0] for r in licenses.scan(frame(spark, list(texts.items()))).collect()}
    assert got == {i: [w] for i, w in enumerate(want)}


def test_license_windows(spark):
    """Notices over several lines, beside other sentences and inside long lines; each is reported once."""
    mit, prose = licenses.TEMPLATES["MIT-body"], " ".join(f"prose of the w{i} author" for i in range(150))
    texts = {
        1: "See below. Released under the MIT License.",
        2: "Released under the MIT License. All rights reserved.",
        3: "x\nThis file is\nLicensed under the Apache\nLicense, Version 2.0.\ny",
        4: f"{prose} Released under the MIT License. {prose}",
        5: f"{prose}\n{mit}\n{prose}",
        6: f"{prose}\n" + licenses.TEMPLATES["Apache-2.0-body"].strip() + f"\n{prose}",
        7: "Released under the MIT License.\nmore text",
        8: prose,
        9: 'Licensed under the Apache License, Version 2.0 (the "License");',
    }
    got = {r.doc_id: [(m.unit, m.license) for m in r.matches] for r in licenses.scan(frame(spark, list(texts.items()))).collect()}
    assert got == {1: [(1, "MIT")], 2: [(1, "MIT"), (1, "Proprietary")], 3: [(3, "Apache-2.0")], 4: [(1, "MIT")], 5: [(2, "MIT-body")], 6: [(2, "Apache-2.0-body")], 7: [(1, "MIT")], 8: [], 9: [(1, "Apache-2.0")]}


def test_tiling_blocks_keep_rows(spark):
    """Null and repeated ids give one row each, with one block and with several, alone and with carried columns."""
    items = spark.createDataFrame([(k, " ".join(f"q{k}x{j}" for j in range(12))) for k in range(1, 9)] + [(20, " ".join(f"q3x{j}" for j in range(12)))], "item_id long, text string")
    hit = lambda *ks: " and then ".join(" ".join(f"q{k}x{j}" for j in range(12)) for k in ks)
    docs = frame(spark, [(None, "clean one"), (None, "clean two"), (None, hit(2)), (7, hit(1, 5)), (7, "clean seven"), (7, "clean seven"), (8, None), (9, hit(3))])
    rows = lambda **more: sorted(tuple(map(str, r)) for r in tiling.decontaminate(docs, items, **more).collect())
    one = rows()
    assert len(one) == 8 and rows(block_bytes=60) == one
    carried = rows(carry=["doc_id", "text", "lang"])
    assert len(carried) == 8 and rows(carry=["doc_id", "text", "lang"], block_bytes=60) == carried
    assert ("9", "True", "[3, 20]", "3", "1.0") in one


@pytest.mark.parametrize("drop", [0, 1 << 29, 1 << 31, (1 << 32) - 1])
def test_dropout_by_occurrence(rows, drop):
    """Remembered cuts equal merging each occurrence alone; one word gets many cuts, within a document too."""
    v, word = vocabulary(model_path()), "international "
    texts = [t or "" for _, t in rows[:40]] + [word * 200, "a  b ▁mark 世界 " * 20]
    documents = list(range(len(texts)))
    got = encoding.encode_texts(v, texts, drop, 3, documents)
    for t, d, ids in zip(texts, documents, got, strict=True):
        want = [v.encode_unit(u, drop, pieces.mixed(pieces.keyed(3, d), k)) for k, u in enumerate(pieces.spaced_units(t) if t else [])]
        assert ids.tobytes() == b"".join(want)
    if drop == 1 << 31:
        assert len({v.encode_unit(" international", drop, pieces.mixed(pieces.keyed(3, 40), k)) for k in range(200)}) > 4
