"""Model families with stand-in models, the vault, audit folders."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilspan.functions.adapters import analyzer, available, chunks, classifier, zero_shot
from veilspan.functions.detect import Settings, scan, spans
from veilspan.sources import stores

KEYS = ["A" * 43 + "=", "B" * 43 + "="]


def names():
    """A model that finds the word Ann, and repeats a label."""
    return lambda text, labels, threshold: [{"label": "Person", "start": i, "end": i + 3, "score": 0.9} for i in range(len(text)) if text[i : i + 3] == "Ann"] + [{"label": "person", "start": i, "end": i + 6, "score": 0.9} for i in range(len(text)) if text[i : i + 6] == "person"]


def pieces():
    return lambda text: [{"category": "B-private_person", "start": 0, "end": 3, "score": 0.9}, {"category": "I-private_person", "start": 4, "end": 7, "score": 0.95}, {"category": "secret", "start": 0, "end": 2, "score": 0.2}, {"category": "other", "start": 0, "end": 2, "score": 1}]


def places():
    return lambda text: [{"entity_type": "LOCATION", "start": 0, "end": 4, "score": 0.6}, {"entity_type": "X", "start": 0, "end": 4, "score": 1}, {"entity_type": "PERSON", "start": 3, "end": 99, "score": 1}]


def test_chunks():
    text = " ".join(f"word{i}" for i in range(900))
    got = list(chunks(text))
    assert got[0][0] == 0 and all(text[a : a + len(p)] == p and len(p) <= 1400 for a, p in got) and got[-1][0] + len(got[-1][1]) == len(text)
    assert all(a < b <= a + 1400 - 350 for (a, _), (b, _) in zip(got, got[1:], strict=False)) and all(text[a - 1] == " " for a, _ in got[1:])
    assert list(chunks("")) == [(0, "")] and len(list(chunks("x" * 5000))) == 5


def test_model_families(spark):
    families = (zero_shot(names), classifier(pieces), analyzer(places, 0.5))
    s = Settings(custom=families)
    text = "Ann " + "x " * 1000 + "Ann and a person"
    found = [x for x in scan(text, ("gliner",), resolved=False, settings=s)]
    assert [(x["start"], x["entity"], x["specificity"], x["detector_id"]) for x in found] == [(0, "PERSON", 77, "gliner.person"), (2004, "PERSON", 77, "gliner.person")]
    assert [(x["start"], x["end"], x["confidence"]) for x in scan("Ann Lee", ("openai_privacy_filter",), resolved=False, settings=s)] == [(0, 7, 0.95)]
    assert [(x["entity"], x["detector_id"]) for x in scan("Oslo", ("presidio",), resolved=False, settings=s)] == [("ADDRESS", "presidio.location")]

    def here():  # a function of this module would not be found by the workers
        return lambda text, labels, threshold: [{"label": "person", "start": 0, "end": 3, "score": 0.9}]

    rows = spark.createDataFrame([("Ann Lee",)], "t string").select(F.inline(spans(F.col("t"), ("regex", "gliner"), settings=Settings(custom=(zero_shot(here),))))).collect()
    assert [(r.entity, r.family, r.registry_order) for r in rows] == [("PERSON", "gliner", 1)]
    assert available(("regex", "gliner", "presidio"), Settings(), {"gliner": {"required": False}, "presidio": {"required": False}}) == ("regex",)
    with pytest.raises(ValueError):
        available(("gliner",), Settings(), {})


def test_vault(spark, tmp_path):
    path = f"{tmp_path}/vault"
    found = spark.createDataFrame([("EMAIL", "ann@x.org"), ("EMAIL", "ann@x.org"), ("PHONE", "212-555-0199"), (None, "x"), ("EMAIL", None)], "entity string, value string")
    assert stores.status(spark, path).count() == 0
    tokens = stores.insert(found, path, b"k", KEYS[0], {"from": "a test"}).collect()
    stores.insert(found.limit(2), path, b"k", KEYS[0])
    assert {r.entity: r.n for r in stores.status(spark, path).collect()} == {"EMAIL": 1, "PHONE": 1} and len(tokens) == 2
    asked = spark.createDataFrame([(r.token,) for r in tokens] + [("nothing",)], "token string")
    assert {(r.entity, r.value) for r in stores.resolve(asked, path, KEYS[0]).collect()} == {("EMAIL", "ann@x.org"), ("PHONE", "212-555-0199")}
    assert {r.value for r in stores.resolve(asked, path, KEYS[1]).collect()} == {None}
    assert {r.metadata["from"] for r in stores.records(spark, path).collect()} == {"[REDACTED len=6]"}
    stores.backup(spark, path, f"{tmp_path}/copy")
    with pytest.raises(Exception, match="(?i)exist"):
        stores.backup(spark, path, f"{tmp_path}/copy")
    with pytest.raises(ValueError):
        stores.rotate(spark, path, f"{tmp_path}/new", KEYS[1], KEYS[0])
    stores.rotate(spark, path, f"{tmp_path}/new", *KEYS)
    assert {r.value for r in stores.resolve(asked, f"{tmp_path}/new", KEYS[1]).collect()} == {"ann@x.org", "212-555-0199"}
    spark.range(1).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="no vault"):
        stores.vault(spark, f"{tmp_path}/other")


def test_audits_by_date(spark, tmp_path):
    path = f"{tmp_path}/audits"
    stores.append_audits(spark.createDataFrame([(1, True), (2, False)], "id int, blocked boolean"), path, "request_preflight", rows_a_file=1)
    (tmp_path / "audits" / "date=2020-01-01").mkdir()
    (tmp_path / "audits" / "date=soon").mkdir()
    assert spark.read.json(path).where("stage = 'request_preflight'").count() == 2
    day = dt.date(2020, 1, 2)
    assert [(r.date, r.removed) for r in stores.purge_audits(spark, path, day).collect()] == [(dt.date(2020, 1, 1), False)]
    assert [(r.date, r.removed) for r in stores.purge_audits(spark, path, day, dry_run=False).collect()] == [(dt.date(2020, 1, 1), True)]
    assert stores.purge_audits(spark, path, day).count() == 0 and (tmp_path / "audits" / "date=soon").exists()


def test_catalog(spark):
    from veilspan.plans import catalog

    found = {(r.family, r.entity) for r in catalog.detectors(spark).collect()}
    assert {("regex", "TAX_ID"), ("gliner", "MRN"), ("contextual-anchored", "PASSPORT"), ("xpia", "PROMPT_INJECTION")} <= found
    assert {r.category for r in catalog.entities(spark).collect()} == {None, "PHI", "SECRET", "STRONG_ID", "INTERNAL_ID"}
    assert catalog.profiles(spark).count() == 11
    assert catalog.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")) == "| k | v |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"


def test_arguments_in_streams():
    """Arguments are withheld to the end; all fields are judged before any is released; a changed id ends the stream."""
    from collections import namedtuple

    from veilspan.streaming.holdback import _one_stream

    Row = namedtuple("Row", "seq field delta terminal response_id")
    act = lambda s: {"AWS_KEY": "block", "EMAIL": "redact"}.get(s["entity"], "allow")
    run = lambda *rows: _one_stream([Row(k, *r) for k, r in enumerate(rows)], act, 512, {})
    out, ended = run(("arguments:0", '{"to":"ann@', False, "r"), ("content", "hi", False, "r"), ("arguments:0", 'x.org","n":1}', False, None), ("content", "", True, "r"))
    assert ended and out == [("arguments", '{"to":"<EMAIL:REDACTED>","n":1}'), ("chunk", "hi"), ("terminal", "")]
    assert run(("arguments:0", '{"ann@x.org":1}', False, None), ("content", "hi", True, None)) == ([("blocked", "")], True)
    assert run(("arguments:0", '{"to":', False, None), ("content", "hi", True, None)) == ([("error", "malformed_tool_call_arguments")], True)
    assert run(("content", "a", False, "r1"), ("content", "b", True, "r2")) == ([("error", "response_id_mismatch")], True)
    assert run(("arguments:0", "", False, None), ("content", "x", False, None)) == ([], False)


def test_two_writers_give_one_record_a_token(spark, tmp_path):
    """Both look before either appends; readers see the first record, and a backup holds no other."""

    path, key, seal = f"{tmp_path}/v", b"k", "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="
    found = spark.createDataFrame([("EMAIL", "ann@x.org"), ("PHONE", "212-555-0199")], "entity string, value string")
    stores.insert(found, f"{tmp_path}/one", key, seal, {"who": "one"})
    stores.insert(found.union(spark.createDataFrame([("EMAIL", "bob@y.org")], "entity string, value string")), f"{tmp_path}/two", key, seal, {"who": "two"})
    for part in ("two", "one"):  # appended in the other order
        stores.appended(spark, f"{tmp_path}/{part}").write.mode("append").parquet(path)
    assert stores.appended(spark, path).count() == 5 and stores.vault(spark, path).count() == 3
    assert {r.entity: r.n for r in stores.status(spark, path).collect()} == {"EMAIL": 2, "PHONE": 1}
    assert sorted(r.metadata["who"] for r in stores.vault(spark, path).collect()) == ["one", "one", "two"]
    tokens = stores.insert(found, path, key, seal)
    assert stores.appended(spark, path).count() == 5 and {r.value for r in stores.resolve(tokens, path, seal).collect()} == {"ann@x.org", "212-555-0199"}
    stores.backup(spark, path, f"{tmp_path}/copy")
    assert stores.appended(spark, f"{tmp_path}/copy").count() == 3


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """A failure between two outputs, and a batch replayed after all went well."""

    split = lambda batch: {"audits": batch.where("k >= 0"), "metrics": batch.groupBy().count()}
    write, broken = stores.batch_sinks(str(tmp_path), split), stores.batch_sinks(str(tmp_path), lambda b: {"audits": b, "metrics": b.selectExpr("raise_error('down') AS x")})
    first, second = spark.range(5).selectExpr("id AS k"), spark.range(5, 8).selectExpr("id AS k")
    write(first, 0)
    with pytest.raises(Exception, match="down"):
        broken(second, 1)
    for batch, number in ((second, 1), (first, 0), (second, 1)):
        write(batch, number)
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/audits").collect()) == list(range(8))
    assert {(r.batch, r["count"]) for r in spark.read.parquet(f"{tmp_path}/metrics").collect()} == {(0, 5), (1, 3)}
