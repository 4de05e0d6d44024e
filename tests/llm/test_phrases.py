"""Operators 11 to 13 against brute force and the library, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import byte_bpe, collocations, divergence
from veilspan.llm.queries import RANKS

SCHEMA = "doc_id long, text string, lang string, source string, at int, n long, key string, size int, term string"


def rows():
    """Texts of three languages, hot source and phrases, nulls, odd separators, long words and texts."""
    rng = random.Random(3)
    vocab = ["the", "Of", "Été", "naïve", "x", "don't", "漢字", "a-b"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    out = [(None, None, None, None), (1, "", "en", "s1"), (2, " \t\n.,", "en", "s9"), (3, "x" * 3000, "de", None), (4, "one", None, "s1")]
    for i in range(160):
        words = [rng.choice(vocab[: rng.choice([6, 20, 68])]) for _ in range(rng.randint(1, 90))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "! "]) for w in words)
        if rng.random() < 0.4:
            text += "; quick brown Fox jumps over"
        out.append((10 + i // 2, text, rng.choice(["en", "en", "de", "fr"]), rng.choice(["s1", "s1", "s2", "s3", "été", None])))
    out += [out[-1]] * 3
    out.append((999, "ab ab ab cd " * 1500 + "quick brown fox jumps over " * 300, "en", "s2"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, "t") for r in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_audit(data, least, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for _, text, lang, source in data]
    out = set()
    for lang in {x[0] for x in terms}:
        holds = Counter(t for x in terms if x[0] == lang for t in set(x[2]))
        kept = {t for t, n in holds.items() if n >= least}
        counts = defaultdict(Counter)
        for x in terms:
            if x[0] == lang:
                counts[x[1]].update(t for t in x[2] if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in p:
            for part, items in (("pair", [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]), ("term", [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]])):
                ranked = sorted(items)[: top if part == "term" else None]
                out |= {(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("run_bytes", [divergence.RUN_BYTES, 700])
def test_divergence(docs, run_bytes, monkeypatch):
    monkeypatch.setattr(divergence.term_counts, "__defaults__", ("text", run_bytes))
    for least, top in ((3, 50), (20, 4), (10_000, 5)):
        got = [tuple(r) for r in divergence.audit(docs, least, top).collect()]
        assert set(got) == brute_audit(rows(), least, top) and len(got) == len(set(got))


def test_divergence_without_broadcast(docs, monkeypatch):
    want = {tuple(r) for r in divergence.audit(docs, 3).collect()}
    monkeypatch.setattr(divergence, "SMALL_BYTES", 0)
    monkeypatch.setattr(divergence, "if_small", lambda df: df)
    assert {tuple(r) for r in divergence.audit(docs, 3).collect()} == want


def test_shares_of_large_counts(spark):
    c, n = 8_999_999_999_999_990, 8_999_999_999_999_999
    got = spark.range(1).select(divergence.share(F.lit(c), F.lit(n)), divergence.share(F.lit(0).cast("long"), F.lit(n))).first()
    assert tuple(got) == (1 + 1000000000 * (c + 5) // n, 1 + 1000000000 * 5 // n)


def brute_phrases(data, least, top):
    counts, whole = defaultdict(Counter), Counter()
    for _, text, lang, _ in data:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            whole[lang or "und"] += len(words)
            for m in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, f in counts.items():
        cands = {g: n for g, n in f.items() if n >= least and len(g) > 1}
        inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        found = []
        for g, a in cands.items():
            if not any(len(h) > len(g) and b >= a and inside(g, h) for h, b in cands.items()):
                s, _, l, r = min((1000 * a * whole[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                found.append((-s, -a, " ".join(g).encode(), " ".join(g), a, l, r, whole[lang], s))
        out |= {(lang, k + 1, *x[3:]) for k, x in enumerate(sorted(found)[:top])}
    return out


@pytest.mark.parametrize("settings", [{}, {"shard_words": 300, "group_bytes": 400}, {"shard_words": 2000, "group_bytes": 300, "ranges": 5}, {"shard_words": 5, "group_bytes": 10**9, "ranges": 1}])
def test_phrases(docs, settings, monkeypatch):
    if settings:
        monkeypatch.setattr(collocations.shard_tries, "__defaults__", (settings["shard_words"], 500))
    want = brute_phrases(rows(), 5, 40)
    got = [tuple(r) for r in collocations.mine(docs, 5, 40, **settings).collect()]
    assert set(got) == want and len(got) == len(want) > 60


def test_blobs_round_trip():
    rng = np.random.default_rng(1)
    columns, lcp, counts = collocations.in_order([rng.integers(0, 4, 500) for _ in range(5)], 3)
    hashes = np.array([3, 2**63, 2**64 - 1], dtype=np.uint64)
    own, n, have, names = collocations.read_blob(collocations.write_blob(columns, lcp, counts, hashes, [b"a", b"b"]))
    assert all((a == b).all() for a, b in zip(own, columns, strict=True)) and (n == counts).all() and (have == hashes).all() and names == [b"a", b"b"]


def test_cuts_of_words_that_the_shard_lacks():
    rng = random.Random(2)
    hashes = np.array(sorted(rng.sample(range(1, 60), 20)), dtype=np.uint64)
    ended = lambda t: tuple(0 if 0 in t[:k] else x for k, x in enumerate(t))
    some = sorted({ended(tuple(rng.choice([0, *range(1, 21)]) for _ in range(5))) for _ in range(300)})
    spelled = [tuple(int(hashes[i - 1]) if i else 0 for i in t) for t in some]
    borders = sorted({ended(tuple(rng.randrange(62) for _ in range(5))) for _ in range(60)} | set(spelled[::9]))
    got = collocations.cuts_in([np.array(c) for c in zip(*some, strict=True)], hashes, np.array(borders, dtype=np.uint64), 5)
    assert got.tolist() == [sum(s < b for s in spelled) for b in borders]


def test_scores_beyond_64_bits(spark):
    a, n = 10**13, 9 * 10**16
    assert spark.range(1).select(collocations.score(F.lit(a), F.lit(n), F.lit(a + 1), F.lit(a + 7))).first()[0] == 1000 * a * n // ((a + 1) * (a + 7))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(RANKS)
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path).ids, special_tokens={})


def strings():
    rng = random.Random(9)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x3000), rng.randrange(0x1F000, 0x1FA00), 32, 10])) for _ in range(300)) for _ in range(60)]
    return odd + ["a" * 4000, "ab" * 3000, " " * 3000, "é" * 999, "<|endoftext|> it's I'LL", "՘ab֋ ₝9 𑷠1", " \n\n  x\x1c\x85 ", "".join(rng.choice("aeitnosr") for _ in range(6000))]


def test_byte_bpe_equals_the_library(spark, library):
    path, pattern, encoding = library
    texts = [None, "", *strings()]
    docs = spark.createDataFrame([(i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int").repartition(2)
    pairs = docs.select(F.col("text").alias("doc_id"), "text")
    for t, ids in byte_bpe.encode(pairs, path, pattern).collect():
        assert ids == encoding.encode_ordinary(t or "")
    for t, data in byte_bpe.decode(byte_bpe.encode(pairs, path, pattern), path).collect():
        assert bytes(data).decode() == (t or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i // 2, len(ids := encoding.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in enumerate(texts)]
    assert sorted(map(tuple, byte_bpe.round_trip(docs, path, pattern).collect())) == sorted(want)


def test_byte_bpe_by_windows(library):
    path, pattern, encoding = library
    for t in strings():
        for size in (7, 50, 1000):
            windows = list(byte_bpe.units(pattern).windows(t, size))
            assert [u for w in windows for u in w] == next(byte_bpe.units(pattern).windows(t))
            assert [i for w in windows for i in byte_bpe.ranks(path).encode(w)] == encoding.encode_ordinary(t)


def test_pairs_stay_apart_as_merged(library):
    merges, rng = byte_bpe.ranks(library[0]), random.Random(4)

    def merged(data):
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, k = min((merges.ids.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [merges.ids[p] for p in parts]

    short = [i for i in merges.first if len(merges.tokens[i]) < 4]
    pairs = [(rng.choice(short), rng.choice(short)) for _ in range(3000)] + [(rng.choice(list(merges.first)), rng.choice(list(merges.first))) for _ in range(500)]
    for a, b in pairs:
        assert merges.stay_apart(a, b) == (merged(merges.tokens[a] + merges.tokens[b]) == [a, b])


def test_small_tables_of_remembered_units(library, monkeypatch):
    path, pattern, encoding = library
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(byte_bpe, "PAIRS", 2)
    for t in strings()[:9]:
        assert byte_bpe.Ranks.encode(byte_bpe.ranks(path), next(byte_bpe.units(pattern).windows(t))) == encoding.encode_ordinary(t)


def test_empty_tables(none, library):
    path, pattern, _ = library
    assert not divergence.audit(none).collect() and not collocations.mine(none).collect()
    assert not byte_bpe.round_trip(none, path, pattern).collect() and not byte_bpe.encode(none, path, pattern).collect()
