"""Evaluation of policies on cases: leaks, failed expectations, summaries, comparisons of detector sets and thresholds.

A case is a row: id, category, surface, payload (JSON text), and what is expected
of it; columns that are missing, or null, ask nothing.  Cases are inspected where
they lie; only summaries shuffle.
"""

from __future__ import annotations

import json
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detect import DETECTORS, PLAIN, Settings, spans
from ..plans.policy import Policy, blocks, decide
from .payloads import decide_payloads, inspect_payloads, scanned, scanned_by_sets

#: Columns of cases and their types.
CASE = {
    "category": "string", "surface": "string", "sensitive_values": "array<string>", "expected_absent": "array<string>", "expected_audit_absent": "array<string>", "allow_sensitive_values_in_audit": "boolean",
    "expected_blocked": "boolean", "expected_unchanged": "boolean", "expected_no_findings": "boolean", "expected_no_decisions": "boolean", "expected_entities": "array<string>", "expected_surfaces": "array<string>",
    "expected_actions": "array<string>", "expected_detector_ids": "array<string>", "expected_detector_families": "array<string>", "expected_valid_json_pointers": "array<string>",
    "expected_json_semantics": "array<struct<pointer:string,values:string>>", "known_gap": "boolean",
}
SUBSETS = {"entities": "span.entity", "surfaces": "surface", "actions": "decision.action", "detector_ids": "span.detector_id", "detector_families": "span.family"}


def _at(root, pointer: list):
    for p in pointer:
        root = root[p]
    return root


def _json_faults(root, places, expected) -> list[str]:
    """Places of the written payload that hold no JSON text, and keys of such texts that changed."""
    out = []
    for place in places if places is not None else []:
        try:
            json.loads(_at(root, json.loads(place)))
        except (TypeError, KeyError, IndexError, ValueError, RecursionError):
            out.append("invalid_json")
    for e in expected if expected is not None else []:
        try:
            value = json.loads(_at(root, json.loads(e["pointer"])))
        except (TypeError, KeyError, IndexError, ValueError, RecursionError):
            out.append("invalid_json")
            continue
        out += ["json_changed" for k, v in json.loads(e["values"]).items() if not isinstance(value, dict) or value.get(k) != v]
    return out


def _compared(payload: Column, written: Column, pointers: Column, meanings: Column) -> Column:
    """A struct (before, after, same, faults): both payloads as Python writes a value, since leaks are looked for in this form;
    whether they hold the same value; and what is wrong with JSON texts inside the written one.  Each payload is read once."""

    def run_one(old, new, places, expected) -> tuple[str, str, bool, list[str]]:
        was = None if old is None else json.loads(old)
        now = None if new is None else was if new == old else json.loads(new)
        said = "None" if old is None else str(was)
        return said, "None" if new is None else said if new == old else str(now), old is not None and new is not None and was == now, _json_faults(now, places, expected)

    @F.pandas_udf("before string, after string, same boolean, faults array<string>")
    def run(p: pd.Series, w: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([run_one(*x) for x in zip(p, w, a, b, strict=True)], columns=["before", "after", "same", "faults"])

    return run.asNondeterministic()(payload, written, pointers, meanings)


def asked(cases: DataFrame) -> DataFrame:
    """Cases with every column of `CASE`."""
    for name, kind in CASE.items():
        cases = cases.withColumn(name, F.col(name).cast(kind) if name in cases.columns else F.lit(None).cast(kind))
    return cases


def evaluate(cases: DataFrame, policy: Policy, settings: Settings = PLAIN, mode: str = "chat", carry: list[str] = ()) -> DataFrame:
    """One row a case: passed, failures, blocked, finding_count, finding_entities, leaks_before, leaks_after (numbers of values), leaked, audit_violations, miss, mutated, unwanted_mutation, unwanted_block, known_gap, error, and columns to carry.

    A case that cannot be inspected fails with an error, also if it is a known gap;
    other failures of known gaps are told (`would_fail`) but do not count.
    """
    return judged(inspect_payloads(asked(cases), "payload", policy, mode, settings=settings), carry)


def judged(seen: DataFrame, carry: list[str] = ()) -> DataFrame:
    """What evaluate() gives, from inspected cases."""
    none = F.array().cast("array<string>")
    error = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("halted"), "policy_exception")
    seen = seen.withColumn("error", error).withColumn("known_gap", F.coalesce("known_gap", F.lit(False)))
    ok = F.col("error").isNull()
    seen = seen.withColumn("_compared", _compared(F.when(ok, F.col("payload")), F.when(ok, F.col("transformed")), F.col("expected_valid_json_pointers"), F.col("expected_json_semantics")))
    seen = seen.withColumn("_before", F.col("_compared.before")).withColumn("_after", F.col("_compared.after")).withColumn("_same", F.col("_compared.same")).withColumn("_json", F.col("_compared.faults"))
    audit = F.to_json(F.transform("findings", lambda f: F.struct(f["decision"].alias("d"), f["surface"].alias("s"), f["span"]["entity"].alias("e"), f["span"]["detector_id"].alias("i"), F.length(f["span"]["value"]).alias("n"))))
    held = lambda values, text: F.filter(F.coalesce(values, none), lambda v: F.contains(text, v))
    sensitive = F.coalesce("sensitive_values", "expected_absent")
    forbidden = F.when(F.coalesce("allow_sensitive_values_in_audit", F.lit(False)), F.coalesce("expected_audit_absent", none)).otherwise(F.array_union(F.coalesce("sensitive_values", none), F.coalesce("expected_audit_absent", none)))
    seen = seen.withColumn("_leaked", held(F.col("expected_absent"), F.col("_after"))).withColumn("_audit", held(forbidden, audit)).withColumn("mutated", ok & ~F.col("_same"))
    true = lambda c: F.coalesce(c, F.lit(False))
    checks = [
        ("leaks", F.size("_leaked") > 0),
        ("blocked", F.col("blocked") != F.col("expected_blocked")),
        ("changed", true(F.col("expected_unchanged")) & F.col("mutated")),
        ("findings", true(F.col("expected_no_findings")) & (F.size("findings") > 0)),
        ("decisions", true(F.col("expected_no_decisions")) & (F.size("findings") > 0)),
        *[(f"missing_{name}", F.size(F.array_except(F.col(f"expected_{name}"), F.coalesce(F.col(f"findings.{path}"), none))) > 0) for name, path in SUBSETS.items()],
        ("audit", F.size("_audit") > 0),
    ]
    told = F.array_compact(F.array(*[F.when(true(bad), F.lit(name)) for name, bad in checks]))
    told = F.concat(told, F.array_distinct("_json"))
    seen = seen.withColumn("_failures", F.when(ok, told).otherwise(F.array(F.concat(F.lit("error_"), F.col("error")))))
    counts = ~F.col("known_gap") | ~ok
    miss = ok & ((F.size("_leaked") > 0) | true(F.col("expected_blocked")) & ~F.col("blocked"))
    return seen.select(
        *carry, "id", F.coalesce("category", F.lit("uncategorized")).alias("category"), F.coalesce("surface", F.try_element_at("expected_surfaces", F.lit(1)), F.lit("unspecified")).alias("surface"), "known_gap", "error",
        (~counts | (F.size("_failures") == 0)).alias("passed"), F.when(counts, F.col("_failures")).otherwise(none).alias("failures"), F.when(F.col("known_gap"), F.col("_failures")).otherwise(none).alias("would_fail"),
        (ok & F.col("blocked")).alias("blocked"), F.when(ok, F.size("findings")).otherwise(0).alias("finding_count"), F.when(ok, F.array_sort(F.array_distinct("findings.span.entity"))).otherwise(none).alias("finding_entities"),
        F.array_sort(F.array_distinct("findings.decision.action")).alias("actions"), F.array_sort(F.array_distinct("findings.span.family")).alias("families"),
        F.size(held(sensitive, F.col("_before"))).alias("leaks_before"), F.size(held(sensitive, F.col("_after"))).alias("leaks_after"), F.col("_leaked").alias("leaked"), F.size("_audit").alias("audit_violations"),
        (miss & ~F.col("known_gap")).alias("miss"), (miss & F.col("known_gap")).alias("known_gap_miss"), "mutated",
        (true(F.col("expected_unchanged")) & F.col("mutated") & ~F.col("known_gap")).alias("unwanted_mutation"), (ok & true(~F.col("expected_blocked")) & F.col("blocked") & ~F.col("known_gap")).alias("unwanted_block"),
    )


def summary(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Totals of evaluated cases, in all or along columns (category, surface, error)."""
    flags = ("passed", "blocked", "miss", "known_gap_miss", "mutated", "unwanted_mutation", "unwanted_block", "known_gap")
    return results.groupBy(*by).agg(F.count("*").alias("cases"), *[F.count_if(c).alias(c) for c in flags], F.count("error").alias("errors"), F.sum("leaks_before").alias("leaks_before"), F.sum("leaks_after").alias("leaks_after"), F.sum("audit_violations").alias("audit_violations"))


def summary_of_sets(results: DataFrame) -> DataFrame:
    """(dimension, value, cases, passed): along entities, actions and families, a case counted under each that it has."""
    named = lambda c: F.transform(c, lambda v: F.struct(F.lit(c).alias("dimension"), v.alias("value")))
    pairs = F.concat(*[named(c) for c in ("finding_entities", "actions", "families")])
    return results.select("passed", F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))


def misses(results: DataFrame) -> DataFrame:
    """(id, category, surface, leaked): values that are still there, by case."""
    return results.where("miss").select("id", "category", "surface", F.explode_outer("leaked").alias("leaked"))


def compare(cases: DataFrame, policy: Policy, sets: dict[str, tuple[str, ...]], settings: Settings = PLAIN) -> DataFrame:
    """Totals for each set of detector families; a set with a family that is not to be had is told, not raised.

    Each family looks at each case once; overlaps are resolved by set, and sets that find
    the same in a case share its decisions.
    """
    known = {*DETECTORS, *(name for name, _, _ in settings.custom)}
    missing = {name: ",".join(sorted({*families} - known)) for name, families in sets.items()}
    told = cases.sparkSession.createDataFrame([(name, m) for name, m in missing.items()], "detectors string, unavailable string")
    had = {name: families for name, families in sets.items() if not missing[name]}
    if not had:
        return told
    seen = asked(cases).withColumn("_sets", scanned_by_sets(F.col("payload"), policy, had, settings=settings)).withColumn("_set", F.explode("_sets"))
    seen = seen.withColumn("_names", F.col("_set.names")).withColumn("_scan", F.col("_set.scan")).drop("_sets", "_set")
    results = judged(decide_payloads(seen, "payload", policy), ["_names"])
    totals = summary(results.withColumn("detectors", F.explode("_names")), ["detectors"])
    return told.join(F.broadcast(totals), "detectors", "left")  # a row a set


def threshold_sweep(cases: DataFrame, policy: Policy, thresholds: list[float], settings: Settings = PLAIN) -> DataFrame:
    """Totals for each least confidence laid on all rules of a policy.

    A case is scanned once.  Thresholds between two confidences of its spans decide
    alike, so it is decided and written once for each such range, not for each threshold.
    """
    seen = asked(cases).withColumn("_scan", scanned(F.col("payload"), policy, settings=settings))
    confidences = F.flatten(F.transform("_scan.rows", lambda s: s["spans"]["confidence"]))
    over = F.transform(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.struct(F.size(F.filter(confidences, lambda c: c >= t)).alias("n"), t.alias("t")))
    ranges = F.transform(F.array_distinct(F.transform("_over", lambda x: x["n"])), lambda n: F.transform(F.filter("_over", lambda x: x["n"] == n), lambda x: x["t"]))
    seen = seen.withColumn("_over", over).withColumn("thresholds", F.explode(ranges)).drop("_over")
    results = judged(decide_payloads(seen, "payload", policy, least=F.col("thresholds")[0]), ["thresholds"])
    return summary(results.withColumn("threshold", F.explode("thresholds")), ["threshold"])


def by_entity(results: DataFrame) -> DataFrame:
    """(entity, expected_cases, contained_cases, containment_recall, exact_tag_cases, exact_tag_recall) from evaluate(..., carry=["expected_entities"]).

    A case counts under each entity expected of it.  It is contained if it is blocked,
    or had sensitive values and has none left; tagged if a finding has that very entity.
    """
    contained = F.col("blocked") | (F.col("leaks_before") > 0) & (F.col("leaks_after") == 0)
    rows = results.where("id is not null").select(F.explode(F.array_distinct("expected_entities")).alias("entity"), contained.alias("contained"), "finding_entities")
    out = rows.groupBy("entity").agg(F.count("*").alias("expected_cases"), F.count_if("contained").alias("contained_cases"), F.count_if(F.array_contains("finding_entities", F.col("entity"))).alias("exact_tag_cases"))
    share = lambda c: F.round(F.col(c) / F.col("expected_cases"), 6)
    return out.select("entity", "expected_cases", "contained_cases", share("contained_cases").alias("containment_recall"), "exact_tag_cases", share("exact_tag_cases").alias("exact_tag_recall"))


def by_family(results: DataFrame, benign: Column) -> DataFrame:
    """(family, threat_cases, benign_cases, signal_to_noise): cases in which a family found something; no ratio without noise."""
    rows = results.select(F.explode("families").alias("family"), benign.alias("benign"))
    out = rows.groupBy("family").agg(F.count_if(~F.col("benign")).alias("threat_cases"), F.count_if("benign").alias("benign_cases"))
    return out.withColumn("signal_to_noise", F.when(F.col("benign_cases") > 0, F.round(F.col("threat_cases") / F.col("benign_cases"), 6)))


def simulate(rows: DataFrame, payload: str, old: Policy, new: Policy, by: list[str] = (), settings: Settings = PLAIN, mode: str = "chat") -> DataFrame:
    """(*by, entity, old_action, new_action, level, n_findings, newly_blocked, no_longer_blocked): what two policies decide on the same spans, with subtotals.

    Payloads are scanned once, with the families of both.  A span that one policy allows
    has `allow` there.  Subtotals along `by` and entity have nulls there, told by `level`.
    """
    both = Policy(new.name, (*old.rules, *(replace(r, id=f"new:{r.id}") for r in new.rules)), detectors=tuple(dict.fromkeys((*old.detectors, *new.detectors))))
    seen = rows.withColumn("_scan", scanned(F.col(payload), both, mode, settings))

    def side(policy: Policy, s: Column, x: Column) -> Column:
        decision = decide(policy, x["entity"], s["name"], x["confidence"])
        own = x["family"].isin(*policy.detectors)
        return F.struct(F.when(own, decision["action"]).otherwise("allow").alias("action"), (own & blocks(policy.mode, decision["action"], decision["on_fail"])).alias("blocks"))

    found = F.flatten(F.transform("_scan.rows", lambda s: F.transform(s["spans"], lambda x: F.struct(x["entity"].alias("entity"), side(old, s, x).alias("old"), side(new, s, x).alias("new")))))
    seen = seen.withColumn("_spans", F.filter(found, lambda f: (f["old"]["action"] != "allow") | (f["new"]["action"] != "allow")))
    stops = lambda part: F.exists("_spans", lambda f: f[part]["blocks"])
    each = seen.select(*by, stops("old").alias("was"), stops("new").alias("now"), F.posexplode("_spans").alias("k", "f")).select(*by, "f.entity", F.col("f.old.action").alias("old_action"), F.col("f.new.action").alias("new_action"), (F.col("k") == 0).alias("first"), "was", "now")
    newly = F.count_if(F.col("first") & F.col("now") & ~F.col("was")).alias("newly_blocked")
    freed = F.count_if(F.col("first") & F.col("was") & ~F.col("now")).alias("no_longer_blocked")
    return each.rollup(*by, "entity", "old_action", "new_action").agg(F.grouping_id().alias("level"), F.count("*").alias("n_findings"), newly, freed)


#: Families whose spans a fixture's detector is asked of, by the beginning of its name; the longest beginning counts.
FIXTURE_FAMILIES = {"regex.": "regex", "entropy.": "entropy", "medical-regex.": "medical-regex", "contextual-broad.": "contextual-broad", "contextual.": "contextual-anchored", "xpia.": "xpia"}


def fixture_hits(cases: DataFrame, matchers: DataFrame, settings: Settings = PLAIN) -> DataFrame:
    """Cases (detector, entity, role, text, surface) with `hit`: whether a span of that entity comes from one of the detector's own.

    `matchers` (detector, id, is_prefix) says which detector ids count for a fixture's
    detector: exact ones, or all with a beginning.  A detector without a matcher stands for its own id.  Spans are
    taken as each family finds them, before overlaps are resolved.
    """
    listed = matchers.groupBy("detector").agg(F.collect_list(F.struct("id", "is_prefix")).alias("ids"))
    families = F.array(*[F.struct(F.lit(b).alias("begin"), F.lit(f).alias("family")) for b, f in sorted(FIXTURE_FAMILIES.items(), key=lambda x: -len(x[0]))])
    own = F.array(F.struct(F.col("detector").alias("id"), F.lit(False).alias("is_prefix")))
    rows = cases.join(listed, "detector", "left").withColumn("ids", F.coalesce("ids", own)).withColumn("_family", F.filter(families, lambda f: F.startswith(F.col("detector"), f["begin"]))[0]["family"])
    rows = rows.withColumn("_spans", spans(F.col("text"), tuple(dict.fromkeys(FIXTURE_FAMILIES.values())), False, surface=F.col("surface"), settings=settings))
    counts = lambda s: F.exists("ids", lambda m: F.when(m["is_prefix"], F.startswith(s["detector_id"], m["id"])).otherwise(s["detector_id"] == m["id"]))
    hit = F.exists("_spans", lambda s: (s["entity"] == F.col("entity")) & (s["family"] == F.col("_family")) & counts(s))
    return rows.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_spans", "_family", "ids")


def distinct_sets(inspected: DataFrame, key: str) -> DataFrame:
    """(key, actions, entities, families): sorted and distinct, of each row's decisions."""
    of = lambda path: F.array_sort(F.array_distinct(F.col(f"findings.{path}")))
    return inspected.select(key, of("decision.action").alias("actions"), of("span.entity").alias("entities"), of("span.family").alias("families"))
