"""Evaluation from one inspection, by entity and family; fixtures and matchers; two policies on one set of spans; datasets from files."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veilspan.functions.detect import Settings, scan
from veilspan.operators import evaluation, reports
from veilspan.operators.payloads import inspect_payloads
from veilspan.plans.policy import Policy, Rule
from veilspan.plans.profiles import PROFILES
from veilspan.sources import datasets

CARD = "4111 1111 1111 1111"
TEXTS = ["mail ann@x.org, ssn 123-45-6789", f"card {CARD} and call 212-555-0199", "MRN: 12345678 patient has hypertension", "First Name: Élodie Durand, employee id: E-12345", "passphrase = " + "zx81" * 4, "nothing at all", ""]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(f"c{i}", json.dumps({"messages": [{"role": "user", "content": t}]}), [t.split()[1].strip(",")] if " " in t else None, ["EMAIL"] if "@" in t else ["CREDIT_CARD", "PHONE"] if "card" in t else None) for i, t in enumerate(TEXTS)] + [("bad", "{no", None, None), ("null", None, None, None)]
    return spark.createDataFrame(rows, "id string, payload string, expected_absent array<string>, expected_entities array<string>")


def totals(df):
    return [tuple(r) for r in df.collect()]


def test_one_inspection_gives_what_many_give(spark, cases):
    policy = PROFILES["strict"]
    policy = replace(policy, detectors=tuple(f for f in policy.detectors if f in evaluation.DETECTORS))
    thresholds = [0.0, 0.8, 0.81, 0.95]
    swept = evaluation.threshold_sweep(cases, policy, thresholds)
    for t in thresholds:
        raised = replace(policy, rules=tuple(replace(r, min_confidence=max(r.min_confidence, t)) for r in policy.rules))
        assert totals(swept.where(F.col("threshold") == t).drop("threshold")) == totals(evaluation.summary(evaluation.evaluate(cases, raised)))
    sets = {"one": ("regex",), "two": ("contextual-anchored", "entropy", "regex"),  "gone": ("gliner",), "none": ()}
    got = evaluation.compare(cases, policy, sets)
    for name, families in sets.items():
        if name != "gone":
            assert totals(got.where(F.col("detectors") == name).drop("detectors", "unavailable")) == totals(evaluation.summary(evaluation.evaluate(cases, replace(policy, detectors=families))))
    gone = got.where("detectors = 'gone'").first()
    assert gone.unavailable == "gliner" and gone.cases is None


def test_each_family_looks_once(spark, cases):
    looked = spark.sparkContext.accumulator(0)

    def own(text, order):
        looked.add(1)
        return [{"entity": "EMAIL", "start": 0, "end": min(4, len(text)), "registry_order": order}]

    settings = Settings(custom=(("own", 9, own),))
    policy = Policy("p", (Rule("r", "redact", ("EMAIL",)),), detectors=("own",))
    evaluation.threshold_sweep(cases, policy, [0.0, 0.3, 0.6, 0.9], settings).collect()
    surfaces = sum(map(bool, TEXTS)) + len(TEXTS)  # the texts that are not empty, and each role
    assert looked.value == surfaces
    evaluation.compare(cases, policy, {"a": ("own",), "b": ("regex", "own"), "c": ("own", "entropy")}, settings).collect()
    assert looked.value == surfaces * 2


def test_empty_tables(spark, cases):
    none = cases.limit(0)
    policy = PROFILES["balanced"]
    assert evaluation.threshold_sweep(none, policy, [0.5]).collect() == []
    assert [r.cases for r in evaluation.compare(none, policy, {"a": ("regex",)}).collect()] == [None]
    assert evaluation.by_entity(evaluation.evaluate(none, policy, carry=["expected_entities"])).collect() == []


def test_entities_and_families(spark, cases):
    policy = Policy("p", (Rule("m", "redact", ("EMAIL",), priority=1), Rule("c", "block", ("CREDIT_CARD",))), detectors=("regex",))
    results = evaluation.evaluate(cases, policy, carry=["expected_entities"])
    got = {r.entity: tuple(r)[1:] for r in evaluation.by_entity(results).collect()}
    assert got == {"EMAIL": (1, 1, 1.0, 1, 1.0), "CREDIT_CARD": (1, 1, 1.0, 1, 1.0), "PHONE": (1, 1, 1.0, 0, 0.0)}  # a blocked case holds all of its values
    by_family = {r.family: tuple(r)[1:] for r in evaluation.by_family(results, F.col("id") == "c1").collect()}
    assert by_family == {"regex": (1, 1, 1.0)}


def test_two_policies_on_one_set_of_spans(spark, cases):
    old = Policy("o", (Rule("m", "redact", ("EMAIL", "US_SSN")),), detectors=("regex",))
    new = Policy("n", (Rule("m", "mask", ("EMAIL",)), Rule("c", "block", ("CREDIT_CARD",)), Rule("x", "redact", ("MEDICAL_CONDITION",))), detectors=("regex", "medical-regex"))
    got = {(r.entity, r.old_action, r.new_action): (r.n_findings, r.newly_blocked, r.no_longer_blocked) for r in evaluation.simulate(cases, "payload", old, new).where("level = 0").collect()}
    assert got == {("EMAIL", "redact", "mask"): (1, 0, 0), ("US_SSN", "redact", "allow"): (1, 0, 0), ("CREDIT_CARD", "allow", "block"): (1, 1, 0), ("MEDICAL_CONDITION", "allow", "redact"): (1, 0, 0)}
    total = evaluation.simulate(cases, "payload", new, old).where("level = 7").first()
    assert (total.n_findings, total.newly_blocked, total.no_longer_blocked) == (4, 0, 1)


def test_blake2b_in_payloads(spark, cases):
    import hashlib

    policy = Policy("p", (Rule("m", "hash", ("EMAIL",), hash_algo="blake2b"),), detectors=("regex",))
    out = inspect_payloads(cases.where("id = 'c0'"), "payload", policy).first().transformed
    assert f"<EMAIL:HASH:blake2b={hashlib.blake2b(b'ann@x.org').hexdigest()[:16]}>" in out


def test_fixtures(spark, tmp_path):
    """Files by glob, places, defaults, fields that are missing; prefixes and sets of detector ids; families that share ids."""
    (tmp_path / "a").mkdir()
    one = {"detector": "regex.phone_family", "entity": "PHONE", "description": "d", "cases": [{"role": "positive", "text": "call 212-555-0199"}, {"role": "positive", "text": "call (11) 98765-4321", "surface": "logs.traces"}, {"role": "positive", "text": "call"}, {"role": "negative", "text": "212-555-0199"}, {"role": "negative", "text": None}]}
    two = {"detector": "regex.email", "entity": "EMAIL", "description": "d", "cases": [{"role": "positive", "text": "ann@x.org"}, {"role": "negative", "text": "123-45-6789"}]}
    (tmp_path / "a" / "one.json").write_text(json.dumps(one))
    (tmp_path / "a" / "two.json").write_text(json.dumps(two))
    read = datasets.read_fixtures(spark, f"{tmp_path}/*/*.json")
    assert [(r.path.rsplit("/", 1)[1], r.place, r.surface) for r in read.orderBy("path", "place").collect()][:2] == [("one.json", 0, "output.content"), ("one.json", 1, "logs.traces")]
    matchers = spark.createDataFrame([("regex.phone_family", "regex.pho", True), ("regex.phone_family", "regex.brazil_phone", False)], "detector string, id string, is_prefix boolean")
    got = {r.detector: tuple(r)[2:] for r in reports.foundation(evaluation.fixture_hits(read, matchers)).collect()}
    assert got == {"regex.phone_family": (2, 1, 1, 1, 0.666667, 0.5), "regex.email": (1, 0, 0, 1, 1.0, 1.0)}
    (tmp_path / "a" / "three.json").write_text(json.dumps({"detector": "x", "cases": []}))
    with pytest.raises(Exception, match="lacks entity, description"):
        datasets.read_fixtures(spark, f"{tmp_path}/a/three.json").collect()


def test_datasets(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"name": "mails", "cases": [{"id": "x", "payload": {"messages": [{"role": "user", "content": "to ann@x.org"}]}, "expected_absent": ["ann@x.org"], "expected_blocked": False}, {"id": "y", "payload": "plain", "known_gap": True}]}))
    rows = datasets.read_cases(spark, f"{tmp_path}/*.json")
    got = {r.id: (r.dataset, r.place, json.loads(r.payload), r.expected_absent, r.known_gap) for r in rows.collect()}
    assert got == {"x": ("mails", 0, {"messages": [{"role": "user", "content": "to ann@x.org"}]}, ["ann@x.org"], None), "y": ("mails", 1, "plain", None, True)}
    results = {r.id: r.passed for r in evaluation.evaluate(rows, Policy("p", (Rule("m", "redact", ("EMAIL",)),), detectors=("regex",))).collect()}
    assert results == {"x": True, "y": True}


def test_scan_is_the_same_apart(spark):
    from veilspan.functions.detect import DETECTORS, PLAIN, family_spans, resolved_spans

    families = tuple(DETECTORS)
    for text in TEXTS[:-1]:
        found = [s for order, f in enumerate(families) for s in family_spans(f, text, order, PLAIN, "output.content", frozenset())]
        assert resolved_spans(text, found) == scan(text, families)


def test_one_file_of_customers_is_dealt_to_all_cores(spark, tmp_path):
    from veilspan import queries

    spark.range(400).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert queries._cases(spark, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = {r.detectors: (r.cases, r.passed) for r in queries.compare_families(spark, str(tmp_path)).collect()}
    assert got == {"both": (400, 400), "regex": (400, 400), "medical": (400, 0), "gone": (0, 0)}


def test_sets_that_find_the_same_share_a_scan(spark, cases):
    from veilspan.operators.payloads import scanned_by_sets

    policy = Policy("p", (Rule("r", "redact"),), detectors=("regex",))
    sets = {"both": ("regex", "medical-regex"), "one": ("regex",), "other": ("medical-regex",)}
    rows = cases.where("id in ('c0', 'c2', 'bad')").select("id", F.explode(scanned_by_sets(F.col("payload"), policy, sets)).alias("s")).select("id", "s.names", "s.scan.fault").collect()
    got = {k: [r.names for r in rows if r.id == k] for k in ("c0", "c2", "bad")}
    assert got == {"c0": [["both", "one"], ["other"]], "c2": [["both"], ["one"], ["other"]], "bad": [["both", "one", "other"]]}
