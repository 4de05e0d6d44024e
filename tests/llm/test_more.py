"""Brute-force versions of weights, tiling and dropout, the pipeline as a whole, and edge cases of several operators."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspan.llm import encoding, importance, jaccard, licenses, lm, pieces, quality_rules, substrings, tables, textcore, tiling, toxicity
from veilspan.llm.pieces import vocabulary
from veilspan.llm.queries import model_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = data.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    return WORD.findall(data)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def word_hash(word):
    data = np.frombuffer(word, dtype=np.uint8)
    return int(textcore.byte_hashes(data, np.array([0]), np.array([len(word)]))[0])


def test_importance_numbers(spark):
    """Counts, log weights and noise against plain loops; null and repeated ids."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(None, "a b"), (5, "extra a"), (6, None)]
    good = {i for i, _ in rows if i is not None and i % 3 == 0}

    def grams(text):
        w = np.array([word_hash(x) for x in words(text, True)], dtype=np.uint64)
        return [int(x) % importance.BUCKETS for x in [*w, *textcore.ngrams(w, 2)]]

    counts = np.zeros((2, importance.BUCKETS))
    for i, t in rows:
        for g in grams(t):
            counts[1, g] += 1
            counts[0, g] += i in good
    p = (counts + 1) / (counts.sum(axis=1, keepdims=True) + importance.BUCKETS)
    target = spark.createDataFrame([(i,) for i in [*good, 0, None]], "doc_id long")
    out = importance.resample(documents(spark, rows), target, share=0.3, seed=11).collect()
    assert len(out) == len(rows) and sum(r.selected for r in out) == round(0.3 * len(rows))
    want = sorted((str(i), len(grams(t)), round(sum(math.log(p[0, g]) - math.log(p[1, g]) for g in grams(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_grams, round(r.log_weight, 6)) for r in out) == want
    noise = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i, _ in rows], "i long").select("i", F.pmod(F.xxhash64(F.lit(11), "i"), F.lit(1 << 52))).collect()}
    for r in out:
        assert math.isclose(r.sort_key, r.log_weight - math.log(-math.log((noise[r.doc_id] + 0.5) / 2**52)), rel_tol=1e-9)
    cutoff = min(r.sort_key for r in out if r.selected)
    assert all((r.sort_key >= cutoff) == r.selected for r in out)
    alike = importance.resample(documents(spark, [(1, "x y"), (1, "x y"), (1, "x y"), (2, "z")]), target, share=0.5).collect()
    assert len({r.selected for r in alike if r.doc_id == 1}) == 1  # rows that tie are kept or left together


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition: again and again the longest match of unmarked words."""
    used_d, used_i, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_d and j + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        used_d.update(range(i, i + n))
        used_i.update(range(j, j + n))
        total += n


def test_tiling_against_definition(spark):
    rng = random.Random(4)
    items = {k: [f"t{rng.randrange(400)}" for _ in range(rng.randint(6, 30))] for k in range(12)}
    docs = {}
    for d in range(40):
        own = [f"d{rng.randrange(50)}" for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            item = items[rng.randrange(12)]
            a = rng.randrange(len(item) - 4)
            own += item[a : a + rng.randint(4, 20)] + [f"d{rng.randrange(50)}"]
        docs[d] = own
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {r.doc_id: r for r in tiling.decontaminate(documents(spark, [(d, " ".join(w)) for d, w in docs.items()]), bench).collect()}
    for d, own in docs.items():
        cover = {k: brute_tiles(own, v, 5) / len(v) for k, v in items.items()}
        best = max(cover.values())
        assert got[d].item_ids == sorted(k for k, c in cover.items() if c >= 0.5)
        assert got[d].contaminated == (best >= 0.5)
        if best > 0:
            assert got[d].best_coverage == pytest.approx(best) and got[d].best_item == min(k for k, c in cover.items() if c == best)
        else:
            assert got[d].best_item is None


def test_tiling_of_repetitive_texts(spark, monkeypatch):
    """Few words over and over: many seeds a pair, items that share all words; also with few seeds held at a time."""
    rng = random.Random(3)
    items = {k: [rng.choice("ab") for _ in range(12)] for k in range(6)}
    docs = {d: [rng.choice("ab") for _ in range(rng.randint(0, 40))] for d in range(12)}
    part = next(tiling.plain_slices(iter([pa.RecordBatch.from_arrays([pa.array(list(docs)), pa.array([" ".join(w) for w in docs.values()])], ["doc_id", "text"])]), "text", "doc_id"))
    table = tiling.Items([(k, " ".join(w)) for k, w in items.items()], 5)
    want = {(d, k): brute_tiles(docs[d], items[k], 5) / 12 for d in docs for k in items}
    for held in (2_000_000, 7):
        monkeypatch.setattr(tiling, "SEEDS", held)
        got = {(r, k): c for r, k, c in tiling._covers(part, table, 0.5)}
        for d in docs:
            best = max(want[d, k] for k in items)
            assert {k for k in items if got.get((d, k), 0) >= 0.5} == {k for k in items if want[d, k] >= 0.5}
            assert max((c for (r, _), c in got.items() if r == d), default=0) == pytest.approx(best)


def test_tiling_of_one_long_repetitive_text():
    """200,000 equal words against 40: memory follows the matches, not the seven million shared seeds."""
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["ab " * 200_000])], ["doc_id", "text"])
    part = next(tiling.plain_slices(iter([batch]), "text", "doc_id"))
    table = tiling.Items([(1, "ab " * 40), (2, "ab " * 10 + "cd " * 30)], 5)
    tracemalloc.start()
    got = {k: c for _, k, c in tiling._covers(part, table, 0.5)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.get(1) == 1.0 and got.get(2, 0.25) == 0.25 and peak < 256 << 20


def test_tiling_stops_when_the_item_is_used_up():
    rng = random.Random(8)
    for _ in range(60):
        doc, item = ([rng.choice("abc") for _ in range(rng.randint(3, 30))] for _ in range(2))
        part = next(tiling.plain_slices(iter([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([" ".join(doc)])], ["doc_id", "text"])]), "text", "doc_id"))
        got = {k: c for _, k, c in tiling._covers(part, tiling.Items([(4, " ".join(item))], 3), 0.0)}
        assert got.get(4, 0) == pytest.approx(brute_tiles(doc, item, 3) / len(item))


def test_tiling_item_ids(spark):
    """Items without an id are reported as null, after the others; several of them and repeated rows are no trouble, in one block or many."""
    passage = lambda c: " ".join(f"{c}{j}" for j in range(12))
    bench = spark.createDataFrame([(None, passage("n")), (None, passage("m")), (None, passage("m")), (3, passage("p")), (3, passage("p")), (4, passage("m"))], "item_id int, text string")
    docs = documents(spark, [(1, "x " + passage("n")), (2, passage("m") + " y"), (3, passage("p") + " " + passage("n")), (4, "clean text of its own")])
    for size in (tiling.BLOCK_BYTES, 50):
        got = {r.doc_id: (r.contaminated, r.item_ids, r.best_item, r.best_coverage) for r in tiling.decontaminate(docs, bench, block_bytes=size).collect()}
        assert got == {1: (True, [None], None, 1.0), 2: (True, [4, None], 4, 1.0), 3: (True, [3, None], 3, 1.0), 4: (False, [], None, None)}
    with pytest.raises(ValueError, match="integer"):
        tiling.decontaminate(docs, bench.selectExpr("'q' item_id", "text"))
    with pytest.raises(ValueError, match="contaminated"):
        tiling.decontaminate(docs.selectExpr("*", "true contaminated"), bench, carry=["contaminated"])


def plain_dropout(v, unit, drop, key):
    """Merges of one unit by their definition: of the candidates not skipped, always the best, the leftmost among equals."""
    text = [pieces.MARK if c == " " else c for c in unit]
    at = list(range(len(text)))
    while True:
        found = []
        for k in range(len(text) - 1):
            p = text[k] + text[k + 1]
            entry = v.entries.get(p)
            if entry is None:
                continue
            drawn = ((((at[k] << 26) | len(p)) + 0x9E3779B97F4A7C15) * (key | 1) >> 27) & 0xFFFFFFFF
            if drawn >= drop:
                heapq.heappush(found, (entry >> 52, at[k], k))
        if not found:
            return text
        k = found[0][2]
        text[k : k + 2] = [text[k] + text[k + 1]]
        del at[k + 1]


@pytest.mark.parametrize("drop", [0, 1 << 28, 1 << 31, 1 << 32])
def test_dropout_by_definition(drop):
    v, rng = vocabulary(model_path()), random.Random(6)
    units = [" " + "".join(rng.choice(["th", "e", "ing", "tion", "a", "st", "é", "n", "o"]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    keys = np.array([pieces.mixed(3, k) for k in range(len(units))], dtype=np.uint64)
    for unit, key, got in zip(units, keys.tolist(), v.encode_units(units, drop, keys), strict=True):
        assert b"".join(map(v._packed_or_bytes, plain_dropout(v, unit, drop, key))) == got


def test_encoding_edges(spark):
    """Null and repeated ids, a long unbroken text; decoding of null arrays."""
    rows = [(None, "a word"), (None, "a word"), (4, "twice said"), (4, "twice said"), (5, None), (6, "x" * 300_000), (7, "  ▁ \t")]
    out = encoding.encode(documents(spark, rows), model_path()).collect()
    assert len(out) == 7 and all(r.lossless for r in out)
    by = [(r.doc_id, tuple(r.pieces)) for r in out if r.doc_id in (None, 4)]
    assert len(set(by)) == 2
    arrays = spark.createDataFrame([(1, None), (2, [])], "doc_id long, pieces array<int>")
    assert {r.doc_id: r.text for r in encoding.decode(arrays, model_path()).collect()} == {1: None, 2: ""}


def test_repeats_and_nulls(spark):
    """Repeated rows, rows with null keys and one long word give one result each."""
    rows = [(None, "some text here"), (None, "some text here"), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, "w" * 2_000_000), (5, None)]
    docs = documents(spark, rows)
    assert [r.n for r in licenses.scan(docs).selectExpr("size(matches) n").orderBy("n").collect()] == [0, 0, 0, 0, 1, 1]
    assert quality_rules.judge(docs).count() == 6
    scored = lm.score(docs, F.col("doc_id") != 5, order=3).collect()
    assert len(scored) == 6 and len({(r.n_tokens, r.score) for r in scored if r.doc_id == 3}) == 1 and len({r.score for r in scored if r.doc_id is None}) == 1
    model = toxicity.fit([], [])
    assert toxicity.score(docs, model).count() == 6
    items = spark.createDataFrame([(1, "some text here")], "item_id long, text string")
    assert tiling.decontaminate(docs, items).where("contaminated").count() == 2


def test_rule_order_and_names(spark):
    """A column of the cascade's own name in the input; ties of useless rules keep their order."""
    docs = documents(spark, [(i, "word " * 3) for i in range(10)]).withColumn("rejected_by", F.lit("before"))
    assert quality_rules.cascade(docs).select("rejected_by").distinct().collect()[0][0] == "few_words"
    assert quality_rules.keep(docs).count() == 0 and quality_rules.keep(docs).columns == docs.columns
    rules = [quality_rules.Rule(f"r{k}", lambda: F.lit(False)) for k in range(3)]
    assert [r.name for r in quality_rules.order_rules(docs, rules)] == ["r0", "r1", "r2"]


def test_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        tables.shared_folder(Session())


def brute_quality(text):
    w = words(text)
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(3)}
    lines = [u for u in (text or "").split("\n") if words(u)]
    chars, text = sum(len(x.decode()) for x in w), text or ""
    bad = [len(w) < 50, 100 * len(covered) > 50 * len(w), 10 * sum(c in "#*$%&|<>" for c in text) > len(w), 10 * (len(lines) - len(set(lines))) > 3 * len(text.split("\n")), not 2 * len(w) <= chars <= 15 * len(w)]
    bad += [10 * len(re.findall("[A-Z]", text)) > 3 * len(text), 10 * text.count("!!") > len(w)]
    return not any(bad)


def brute_pipeline(rows, items, v):
    rows = [(i, t) for i, t in rows if brute_quality(t)]
    sets = {}
    for i, t in rows:
        w = words(t, True)
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if group[a] < group[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    group[b] = group[a]
                    changed = True
    rows = sorted({(i, t) for i, t in rows if i is not None and group[i] == i}) + [(i, t) for i, t in rows if i is None]
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - 19):
                first.setdefault(tuple(w[k : k + 20]), (i, k))
    struck = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 19):
            if i is not None and first[tuple(w[k : k + 20])] < (i, k):
                gone.update(range(k, k + 20))
        struck.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t))
    plain = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()).split()
    clean = [(i, t) for i, t in struck if not any(brute_tiles(plain(t), plain(x), 5) >= 0.5 * len(plain(x)) for x in items)]
    return clean


def test_pipeline(spark, tmp_path):
    """run() on copies, passages, benchmark items, junk, null and repeated ids, against a plain version."""
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in ("ba", "de", "ki", "lo", "mu", "na") for b in ("r", "st", "n", "lt", "x", "ve", "sh", "p", "ck", "mb")]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    passage, items = make(60), [make(14), make(20)]
    texts = [make(rng.randint(55, 130)) for _ in range(16)]
    base = make(120)
    near = base.split(" ")
    near[60] = "changed"
    texts += [base, base, " ".join(near), make(40) + " " + passage + " " + make(30), make(35) + " " + passage, make(70) + "\n" + items[0].upper() + "\n" + make(20)]
    texts += [make(30) + " " + items[1] + " " + make(40), "short one", None, "", "HEY!! " * 80, "same words again " * 40]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[2], (None, make(80)), (None, base), (None, None)]
    documents(spark, rows).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    v = vocabulary(model_path())
    want = brute_pipeline(rows, items, v)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.lossless for r in out)
    got = sorted((str(r.doc_id), v.decode(np.array(r.pieces, dtype=np.int64)).decode()) for r in out)
    assert got == sorted((str(i), t) for i, t in want)
    assert 15 < len(got) < len(rows) - 8 and sum(passage in t for _, t in got) == 1
    for r in out:
        alone = encoding.encode_text(v, dict((str(i), t) for i, t in want)[str(r.doc_id)], round(0.1 * 2**32), 1, encoding.xxhash.xxh64_intdigest(str(r.doc_id)) if r.doc_id is not None else 0)
        if r.doc_id is not None:
            assert r.pieces == alone.tolist()


def test_pipeline_stages_on_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [(1, "x")]).limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS


def test_slices_hold_bytes():
    """Rows are cut into slices by bytes, a long row is a slice of its own."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a " * 10, "b " * (2 << 20), None])], ["doc_id", "text"])
    assert [i for p in textcore.slices(iter([batch])) for i in p.ids] == [1, 2, 3]
    assert hashlib.sha256(b"".join(p.word(i) for p in textcore.slices(iter([batch])) for i in range(len(p.starts)))).hexdigest() == hashlib.sha256(b"a" * 10 + b"b" * (2 << 20)).hexdigest()


def test_last_fragment_holds_the_largest_hash(spark):
    top = (1 << 63) - 1
    sets = spark.createDataFrame([(1, [0, 5, top - 1, top]), (2, [0, 7, top])], "id long, grams array<long>")
    got = jaccard.overlaps(spark.createDataFrame([(1, 2)], "a long, b long"), sets, "grams").collect()
    assert [tuple(r) for r in got] == [(1, 2, 2)]


def test_fit_takes_keys_in_order_of_their_hash_until_the_bound(spark, monkeypatch):
    """Lengths alone are cumulated; of two texts of a key the longest counts and the largest is fitted."""
    rows = [(i, "word " * (i % 7 + 1) + str(i)) for i in range(30)] + [(3, "zz"), (4, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append((texts, y)))
    toxicity.train(documents(spark, rows), labels, rows=20, most_bytes=200)
    order = [r[0] for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()]
    texts = {i: sorted((t or "").encode() for k, t in rows if k == i) for i in order}
    taken, total = [], 0
    for i in order:
        if total < 200:
            taken.append(i)
        total += max(map(len, texts[i]))
    assert 3 < len(taken) < 20
    assert seen == [([texts[i][-1].decode() for i in sorted(taken)], [i % 2 for i in sorted(taken)])]


def test_substring_dedup_refuses_clashing_columns(spark):
    docs = documents(spark, [(1, "a b c")]).withColumn("kept", F.lit(1))
    with pytest.raises(ValueError, match="kept"):
        substrings.dedup(docs, carry=("kept",))
    assert substrings.dedup(docs, carry=("lang",)).columns == ["doc_id", "n_words", "n_removed", "removed", "kept", "lang"]


@pytest.mark.parametrize("total", [0, 6 * 60_000])
def test_frequent_prefixes_are_found_by_a_draw(spark, total):
    """A word before every other one is lengthened, rare words are not; with all suffixes counted and with some two thirds of them drawn."""
    texts = [(d, " ".join(f"hot w{d}x{i}" for i in range(500))) for d in range(20)]
    first, second, third = substrings.long_prefixes(documents(spark, texts), 160, total, "doc_id", "text", 20)
    assert first.tolist() == [int(textcore.ngrams(np.array([word_hash(b"hot")], dtype=np.uint64), 1)[0])]
    assert not len(second) and not len(third)


def test_far_members_of_a_hub_get_hubs_of_their_own(spark, monkeypatch):
    """Near copies that are all far from their hub become links to one of them, not all pairs."""
    monkeypatch.setattr(jaccard, "FAR", 32)
    n = 120
    other = list(range(1000, 1200))
    sets = [(0, list(range(100)))] + [(i, sorted({*other} - {1000 + i} | {5000 + i})) for i in range(1, n + 1)]
    links = jaccard._hub_links(spark.createDataFrame([(i, 0) for i, _ in sets], "id long, hub long"), spark.createDataFrame(sets, "id long, grams array<long>"), 90, 100).collect()
    assert {tuple(sorted(x)) for x in links} >= {(1, i) for i in range(2, n + 1)} and len(links) < 4 * n
    assert not any(0 in x for x in links)


@pytest.mark.parametrize("common", [1, 16, 10**6])
def test_small_hubs_and_nested_hubs_lose_no_link(spark, monkeypatch, common):
    """With hubs from three holders on, the components are those of all pairs."""
    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "FAR", 2)
    monkeypatch.setattr(jaccard, "COMMON", common)
    draw = random.Random(7)
    rows = []
    for i in range(240):
        words = [f"c{i % 3}w{j}" for j in range(40)]
        for _ in range(draw.randrange(7)):
            words[draw.randrange(40)] = f"x{draw.randrange(30)}"
        rows.append((i, " ".join(words[: draw.choice((40, 40, 36))])))
    got = {r.doc_id: r.component_id for r in jaccard.join(documents(spark, rows), 1, 85, 100).collect()}
    held = {i: set(t.split()) for i, t in rows}
    lowest = dict.fromkeys(held)
    for i in held:
        if lowest[i] is None:
            todo = [i]
            while todo:
                a = todo.pop()
                if lowest[a] is None:
                    lowest[a] = i
                    todo += [b for b in held if 100 * len(held[a] & held[b]) >= 85 * len(held[a] | held[b])]
    assert got == lowest and 1 < len(set(got.values())) < 240


def test_common_differences_are_left_out_of_prefixes(spark):
    """Level 1 is exploded only for members whose prefix reaches it."""
    common = list(range(100, 105))
    delta = [(i, 0, 0, 50, 900, False, [i, 1000 + i // 2, *common], 1 if i % 2 else 4, 1) for i in range(1, 41)]
    delta = spark.createDataFrame(delta, "id long, hub long, copy int, p int, w int, near boolean, d array<long>, last int, last_far int")
    counts = spark.createDataFrame([(0, g, 40, 40) for g in common] + [(0, 1000 + k, 2, 2) for k in range(21)], "hub long, g long, c long, nf long")
    rows = jaccard._difference_rows(delta, counts, spark.createDataFrame([(0, 1)], "hub long, copies int")).collect()
    assert {r.id for r in rows if r.lvl == 1} == {i for i in range(1, 41) if i % 2 == 0} and {r.g for r in rows if r.lvl == 1} == {*common}
    assert len([r for r in rows if r.lvl == 0]) == 80 and {(r.m0, r.n_all) for r in rows} == {(2, 7)}


def test_suffixes_gathered_by_a_task_take_less_memory(spark, monkeypatch):
    """At its peak a task holds fewer than 80 bytes for each suffix gathered."""
    got = {}
    monkeypatch.setattr(substrings, "long_prefixes", lambda *a: [np.empty(0, dtype=np.uint64)] * 3)
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: got.update(send=f) or self.selectExpr("1 bucket"))
    substrings.marks(documents(spark, []), 4, 1, "doc_id", "text", 20, 8)
    rows = 60
    body = " ".join(map(str, range(20_000)))
    batches = [pa.RecordBatch.from_arrays([pa.array([d]), pa.array([f"d{d} ".join(["", body, ""]).replace(" ", f" {d}x")])], ["doc_id", "text"]) for d in range(rows)]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for _ in got["send"](iter(batches)):
        pass
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 80 * rows * 20_000, peak / (rows * 20_000)
