"""Inspection of flat tables: text in, findings, decisions and the changed text out; no shuffle."""

from __future__ import annotations

import os
import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import transforms as T
from ..functions.detect import PLAIN, Settings, spans
from ..plans.policy import Policy, applies, blocks, decide

# Which of two spans with one start is written, the higher first; others have 50.
PRIORITY = {
    "AWS_KEY": 100, "API_KEY": 100, "AZURE_KEY": 100, "DATADOG_KEY": 100, "JWT": 100, "BEARER_TOKEN": 100, "DATABASE_URL": 100, "PEM_BLOCK": 100, "PRIVATE_KEY": 100,
    "PASSWORD": 95, "OTHER_SECRET": 90,
    "US_SSN": 80, "PASSPORT": 80, "DRIVER_LICENSE": 80, "NATIONAL_ID": 80, "TAX_ID": 80, "BR_CPF": 80, "OTHER_STRONG_ID": 80, "CREDIT_CARD": 80, "MRN": 80, "HEALTH_INSURANCE_ID": 80,
    "ICD_CODE": 75, "LAB_VALUE": 75, "MEDICATION": 75, "MEDICAL_CONDITION": 75, "DIAGNOSIS_TEXT": 75, "OTHER_PHI": 70,
}
USUAL_PRIORITY = 50


def wanted_entities(policy: Policy) -> tuple[str, ...] | None:
    """Entities that some rule may decide on; None where a rule is open to all."""
    named = {e for r in policy.rules for e in r.members()}
    if any(not (r.entities or r.categories) for r in policy.rules):
        return None
    scope = policy.scoped()
    return tuple(sorted(named & {*scope} if scope else named))


def findings(docs: DataFrame, text: str, policy: Policy, surface: str | Column = "output.content", settings: Settings = PLAIN, flags: Column | None = None) -> DataFrame:
    """`docs` with `findings`: spans with decisions, allowed ones left out.  Only entities that the policy decides on are returned by the detectors."""
    where = F.lit(surface) if isinstance(surface, str) else surface
    found = docs.withColumn("_spans", spans(F.col(text), policy.detectors, surface=where, settings=settings, wanted=wanted_entities(policy), flags=flags))
    decided = F.transform("_spans", lambda s: F.struct(s.alias("span"), decide(policy, s["entity"], where, s["confidence"]).alias("decision")))
    return found.withColumn("findings", F.filter(decided, lambda x: x["decision"]["action"] != "allow")).drop("_spans")


def replacement(policy: Policy, x: Column, key: bytes | None, environment: Mapping[str, str], at: int) -> Column:
    s, d = x["span"], x["decision"]
    token = T.vault_token(key, s["entity"], s["value"]) if key else T.tokenized(s["entity"])
    out = F.when(d["action"] == "mask", T.masked(s["value"])).when(d["action"] == "tokenize", token)
    for r in policy.rules:
        if r.action == "replace":
            out = out.when(d["rule_id"] == r.id, T.replaced(s["entity"], r.replacement))
        if r.action == "hash":
            out = out.when(d["rule_id"] == r.id, T.hashed(s["entity"], s["value"], r.hash_algo or "sha256", x["digest"]))
        if r.action == "encrypt":
            if not environment.get(r.encrypt_key_env or ""):
                raise ValueError(f"{r.id}: no key in {r.encrypt_key_env}")
            out = out.when(d["rule_id"] == r.id, T.encrypted(s["entity"], s["value"], environment[r.encrypt_key_env], at))
    return out.otherwise(T.redacted(s["entity"]))


def priority(entity: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in PRIORITY.items() for v in pair])
    return F.coalesce(F.try_element_at(table, entity), F.lit(USUAL_PRIORITY))


def inspect(docs: DataFrame, text: str, policy: Policy, surface: str | Column = "output.content", key: bytes | None = None, settings: Settings = PLAIN, flags: Column | None = None, reject: Column | None = None, environment: Mapping[str, str] | None = None) -> DataFrame:
    """`docs` with findings, halted, rejected, blocked and transformed.

    `reject` says of a row that its text may not be rewritten (a key of tool arguments,
    metadata): a finding that applies then rejects it.  A halted or rejected row has no
    transformed text; halted rows are those that a rule with `exception` meets.
    `key` makes tokens that can be resolved; keys of `encrypt` rules are read from `environment`.
    """
    found = findings(docs, text, policy, surface, settings, flags)
    decision = lambda x: (x["decision"]["action"], x["decision"]["on_fail"])
    environment, at = os.environ if environment is None else environment, int(time.time())
    needs_digest = any(r.action == "hash" and r.hash_algo == "blake2b" for r in policy.rules)
    # An Arrow function cannot stand inside transform(), so digests are made beside the findings.
    digests = T.blake2b(F.transform("findings", lambda x: x["span"]["value"])) if needs_digest else F.transform("findings", lambda x: F.lit(""))
    found = found.withColumn("_digests", digests)
    act = F.filter(F.zip_with("findings", "_digests", lambda x, d: F.struct(x["span"].alias("span"), x["decision"].alias("decision"), d.alias("digest"))), lambda x: applies(policy.mode, *decision(x)))
    edits = F.transform(
        act,
        lambda x, i: F.struct(
            x["span"]["start"].alias("start"), (-priority(x["span"]["entity"])).alias("p"), (x["span"]["start"] - x["span"]["end"]).alias("n"), i.alias("i"),
            x["span"]["end"].alias("end"), F.when(x["decision"]["action"] == "block", 0).otherwise(1).alias("rank"), x["decision"]["scope"].alias("scope"), replacement(policy, x, key, environment, at).alias("replacement"),
        ),
    )
    found = found.withColumn("_edits", F.sort_array(edits))
    found = found.withColumn("_kept", T.without_overlaps(F.col("_edits")))
    whole = F.transform(F.filter("_edits", lambda e: e["scope"] == "surface"), lambda e: F.struct(e["p"], e["rank"], e["start"], e["n"], e["i"], e["replacement"].alias("replacement")))
    found = found.withColumn("_whole", F.try_element_at(F.sort_array(whole), F.lit(1))["replacement"])
    halted = F.coalesce(F.exists("findings", lambda x: F.coalesce(x["decision"]["on_fail"] == "exception", F.lit(False))), F.lit(False))
    rejected = F.coalesce(F.lit(False) if reject is None else reject & (F.size("_edits") > 0), F.lit(False))
    blocked = F.exists("findings", lambda x: blocks(policy.mode, *decision(x)))
    found = found.withColumn("halted", halted).withColumn("rejected", rejected).withColumn("blocked", blocked | F.col("rejected"))
    changed = F.when(~F.col("halted") & ~F.col("rejected"), F.coalesce("_whole", T.splice(F.col(text), F.col("_kept"))))
    return found.withColumn("transformed", changed).drop("_edits", "_kept", "_whole", "_digests")


def halt(inspected: DataFrame) -> DataFrame:
    """The same rows; the query fails at the first that a rule with `exception` meets."""
    said = F.raise_error(F.concat(F.lit("a rule halts the inspection: "), F.filter("findings", lambda x: x["decision"]["on_fail"] == "exception")[0]["decision"]["rule_id"]))
    return inspected.withColumn("halted", F.when(F.col("halted"), said.cast("boolean")).otherwise(F.lit(False)))


def counts(inspected: DataFrame, key: str = "doc_id") -> DataFrame:
    """(entity, action, n_findings, n_docs)."""
    rows = inspected.select(key, F.explode("findings").alias("f")).select(key, "f.span.entity", "f.decision.action")
    return rows.groupBy("entity", "action").agg(F.count("*").alias("n_findings"), F.countDistinct(key).alias("n_docs"))


def decisions(inspected: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each decision: (key, entity, start, end, detector_id, family, action, rule_id, severity, on_fail, blocked)."""
    rows = inspected.select(key, "blocked", F.explode("findings").alias("f"))
    return rows.select(key, "f.span.entity", "f.span.start", "f.span.end", "f.span.detector_id", "f.span.family", "f.decision.action", "f.decision.rule_id", "f.decision.severity", "f.decision.on_fail", "blocked")
