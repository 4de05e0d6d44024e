"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, divergence, encoding, importance, jaccard, licenses, lm, quality_rules, substrings, tiling, token_counts, toxicity

#: Name of the vocabulary file for operators 7 and 9.
MODEL = "piece_bpe_32k.model"
#: Name of the rank file for operator 13.
RANKS = "byte_bpe_multi_50k.tiktoken"


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").cast("long").alias("n_units"), F.size("matches").cast("long").alias("n_matches"), F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["unit"].cast("string"), m["license"])), ",").alias("found"), F.round(F.array_max(F.transform("matches", lambda m: m["dice"])), 6).alias("best_dice"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return scored.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=remainder(5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return importance.resample(table(spark, sf_dir, "documents"), good)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model_path())


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sentencepiece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoding.encode(table(spark, sf_dir, "documents"), model_path())
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("pieces").cast("array<string>"), " "), 256).alias("pieces_sha256"), "lossless")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = {c: F.col(c).cast("long") for c in ("rank", "a", "l", "r", "n", "score")}
    return collocations.mine(table(spark, sf_dir, "documents")).withColumns(long)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), str(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_license_scans, op2_ngram_jaccard_join, op3_lm_scoring, op4_quality_rules, op5_toxicity, op6_quality_classifier, op7_token_counts, op8_benchmark_decontamination, op9_sentencepiece_encoding, op10_substring_dedup, op11_source_divergence, op12_collocations, op13_byte_bpe)}


def _licenses_sql() -> str:
    rows = ", ".join("('{}', [{}])".format(k.replace("'", "''"), ", ".join("'" + g.replace("'", "''") + "'" for g in licenses._template_bigrams(v))) for k, v in sorted(licenses.TEMPLATES.items()))
    return f"""
    WITH t(license, g) AS (VALUES {rows}),
    lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls, coalesce(text, '') body FROM documents),
    units AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS unit, unnest(ls) AS u FROM lines
              UNION ALL SELECT doc_id, 0, body FROM lines WHERE len(ls) > 1),
    words AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(lower(u), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda w: w <> '') w FROM units),
    grams AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) b FROM words WHERE len(w) > 1),
    dice AS (SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(b, g)) / (len(b) + len(g)) d FROM grams, t
             WHERE len(b) BETWEEN len(g) * 0.9 / 1.1 AND len(g) * 1.1 / 0.9),
    best AS (SELECT doc_id, unit, license, d FROM dice WHERE d >= 0.9 QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY d DESC, license) = 1),
    found AS (SELECT doc_id, count(*) n, string_agg(unit || ':' || license, ',' ORDER BY CASE WHEN unit = 0 THEN 0 ELSE unit END) f, max(d) d FROM best GROUP BY 1)
    SELECT l.doc_id, len(ls)::BIGINT AS n_units, coalesce(n, 0)::BIGINT AS n_matches, coalesce(f, '') AS found, round(d, 6) AS best_dice
    FROM lines l LEFT JOIN found USING (doc_id)"""


_QUALITY_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
                 list_filter(string_split(text, chr(10)), lambda u: regexp_matches(u, '[^\x20\x09-\x0D]')) ls FROM d),
    g AS (SELECT doc_id, i, w[i] a, w[i + 1] b, w[i + 2] c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM w)),
    r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
    c AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) nxt FROM r) GROUP BY 1),
    s AS (SELECT doc_id, text, w, len(w) n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines,
                 coalesce(n, 0)::BIGINT n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) large, (length(text) - length(replace(text, '!!', ''))) / 2 marks,
                 len(string_split(text, chr(10))) n_lines FROM w LEFT JOIN c USING (doc_id))
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
                OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words OR 10 * large > 3 * length(text) OR 10 * marks > n_words) AS kept
    FROM s"""

_DIVERGENCE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
    c AS (SELECT lang, source, term, count(*)::HUGEINT n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*) v FROM kept GROUP BY 1),
    gn AS (SELECT lang, source, coalesce(sum(n), 0) + 5 * coalesce(any_value(v), 0) whole FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
    ln AS (SELECT lang, sum(n) + 5 * any_value(v) whole FROM c JOIN v USING (lang) GROUP BY 1),
    p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // whole AS p
          FROM gn JOIN kept k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
    q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // any_value(whole) AS q FROM c JOIN ln USING (lang) GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
             FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
             UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
    FROM rows QUALIFY part = 'pair' OR rank <= 50"""

_COLLOCATION_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
    p AS (SELECT lang, unnest(ps) AS piece FROM d),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, k.k AS m, unnest(list_transform(range(1, len(w) - k.k + 2), lambda i: array_to_string(w[i:i + k.k - 1], ' '))) AS g
          FROM w, (VALUES (1), (2), (3), (4), (5)) k(k) WHERE len(w) >= k.k),
    f AS (SELECT lang, m, g, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY 1),
    c AS (SELECT f.lang, m, g, f AS a, string_split(g, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
    s AS (SELECT c.lang, c.m, c.g, c.a, k, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score
          FROM c JOIN t USING (lang) JOIN f x ON x.lang = c.lang AND x.m = k AND x.g = array_to_string(ws[1:k], ' ')
          JOIN f y ON y.lang = c.lang AND y.m = c.m - k AND y.g = array_to_string(ws[k + 1:c.m], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    o AS (SELECT DISTINCT b.lang, b.g FROM b JOIN b x ON x.lang = b.lang AND x.m > b.m AND 100 * x.a >= 100 * b.a AND contains(' ' || x.g || ' ', ' ' || b.g || ' '))
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank, b.g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE o.g IS NULL QUALIFY rank <= 2000"""

ORACLES = {"op12_collocations": _COLLOCATION_SQL, "op11_source_divergence": _DIVERGENCE_SQL, "op1_license_scans": _licenses_sql(), "op4_quality_rules": _QUALITY_SQL}
