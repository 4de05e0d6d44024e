"""Inspection of JSON payloads: surfaces, spans, decisions and the payload written anew; no shuffle, a row a payload."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import transforms as T
from ..functions.detect import PLAIN, SPAN, Settings, family_spans, resolved_spans, scan
from ..plans.policy import Policy, applies, blocks, decide
from ..sources.payloads import SURFACE, rewritten, surfaces
from .inspect import priority, replacement, wanted_entities

SCANNED = SURFACE[:-1] + f",spans:array<{SPAN}>,digests:array<string>>"
#: What became of a payload that could not be inspected.
FAULTS = {"json": "invalid_json", "depth": "too_deep"}


def _digests(found: list[dict], policy: Policy) -> list[str]:
    """BLAKE2b digests of spans where a rule may ask for them: Spark has no function for these."""
    if not any(r.action == "hash" and r.hash_algo == "blake2b" for r in policy.rules):
        return []
    return [hashlib.blake2b(s["value"].encode()).hexdigest() for s in found]


def scanned(payload: Column, policy: Policy, mode: str = "chat", settings: Settings = PLAIN) -> Column:
    """A struct of surfaces with their spans, and a fault where the payload is no JSON or nested too deeply."""
    families, wanted = policy.detectors, wanted_entities(policy)
    only = None if wanted is None else frozenset(wanted)

    def walk(text: str | None) -> dict:
        if text is None:
            return {"rows": [], "fault": None}
        try:
            rows = surfaces(text, mode)
            found = [scan(r["value"], families, True, r["name"], settings, only, frozenset(filter(None, r["flags"].split(",")))) for r in rows]
            return {"rows": [r | {"spans": f, "digests": _digests(f, policy)} for r, f in zip(rows, found, strict=True)], "fault": None}
        except ValueError:
            return {"rows": [], "fault": FAULTS["json"]}
        except RecursionError:
            return {"rows": [], "fault": FAULTS["depth"]}

    @F.pandas_udf(f"rows array<{SCANNED}>, fault string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([walk(t) for t in batch], columns=["rows", "fault"])

    return run.asNondeterministic()(payload)


def inspect_payloads(rows: DataFrame, payload: str, policy: Policy, mode: str = "chat", key: bytes | None = None, settings: Settings = PLAIN, environment: Mapping[str, str] | None = None) -> DataFrame:
    """`rows` with findings, halted, rejected, blocked, fault and transformed.

    A finding on a key of tool arguments, or on metadata, that applies rejects the
    payload: it is blocked and not written.  So is one that cannot be read (`fault`).
    """
    return decide_payloads(rows.withColumn("_scan", scanned(F.col(payload), policy, mode, settings)), payload, policy, mode, key, environment)


def scanned_by_sets(payload: Column, policy: Policy, sets: dict[str, tuple[str, ...]], mode: str = "chat", settings: Settings = PLAIN) -> Column:
    """An array of structs (names, scan): what `scanned` gives for sets of detector families, with the names of all sets for which it is the same.  Every family looks at a text once."""
    every = tuple(dict.fromkeys(f for families in sets.values() for f in families))
    wanted = wanted_entities(policy)
    only = None if wanted is None else frozenset(wanted)

    def walk(text: str | None) -> list[dict]:
        fault, rows = None, []
        try:
            rows = surfaces(text, mode) if text is not None else []
        except ValueError:
            fault = FAULTS["json"]
        except RecursionError:
            fault = FAULTS["depth"]
        seen = []
        for r in rows:
            flags = frozenset(filter(None, r["flags"].split(",")))
            seen.append({f: list(family_spans(f, r["value"], 0, settings, r["name"], flags)) if r["value"] else [] for f in every})
        out: list[tuple[list, list[str]]] = []
        for name, families in sets.items():
            kept = [resolved_spans(r["value"], [s | {"registry_order": k} for k, f in enumerate(families) for s in found[f]], settings, only) for r, found in zip(rows, seen, strict=True)]
            same = next((names for k, names in out if k == kept), None)
            if same is None:
                out.append((kept, [name]))
            else:
                same.append(name)
        return [{"names": names, "scan": {"rows": [r | {"spans": f, "digests": _digests(f, policy)} for r, f in zip(rows, kept, strict=True)], "fault": fault}} for kept, names in out]

    @F.pandas_udf(f"array<struct<names:array<string>,scan:struct<rows:array<{SCANNED}>,fault:string>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([walk(t) for t in batch], dtype=object)

    return run.asNondeterministic()(payload)


def decide_payloads(rows: DataFrame, payload: str, policy: Policy, mode: str = "chat", key: bytes | None = None, environment: Mapping[str, str] | None = None, least: Column | None = None) -> DataFrame:
    """What inspect_payloads gives, for rows whose column `_scan` has the spans already; `least` raises the least confidence of every rule."""
    environment, at = os.environ if environment is None else environment, int(time.time())
    acts = lambda f: applies(policy.mode, f["decision"]["action"], f["decision"]["on_fail"])

    def decided(s: Column) -> Column:
        every = F.zip_with(s["spans"], s["digests"], lambda x, d: F.struct(x.alias("span"), decide(policy, x["entity"], s["name"], x["confidence"], least).alias("decision"), d.alias("digest")))
        return F.struct(*[s[c].alias(c) for c in ("name", "pointer", "value", "json_pointer", "is_key", "safe_pointer", "flags")], F.filter(every, lambda f: f["decision"]["action"] != "allow").alias("found"))

    def edit(s: Column) -> Column:
        edits = F.sort_array(
            F.transform(
                F.filter(s["found"], acts),
                lambda f, i: F.struct(
                    f["span"]["start"].alias("start"), (-priority(f["span"]["entity"])).alias("p"), (f["span"]["start"] - f["span"]["end"]).alias("n"), i.alias("i"),
                    f["span"]["end"].alias("end"), F.when(f["decision"]["action"] == "block", 0).otherwise(1).alias("rank"), f["decision"]["scope"].alias("scope"), replacement(policy, f, key, environment, at).alias("replacement"),
                ),
            )
        )
        whole = F.transform(F.filter(edits, lambda e: e["scope"] == "surface"), lambda e: F.struct(e["p"], e["rank"], e["start"], e["n"], e["i"], e["replacement"].alias("replacement")))
        value = F.coalesce(F.try_element_at(F.sort_array(whole), F.lit(1))["replacement"], T.splice(s["value"], T.without_overlaps(edits)))
        return F.struct(s["pointer"].alias("pointer"), s["json_pointer"].alias("json_pointer"), value.alias("value"))

    fixed = mode in ("metadata", "stream_metadata", "sse")
    out = rows.withColumn("_rows", F.transform(F.filter("_scan.rows", lambda s: F.size(s["spans"]) > 0), decided))
    flat = F.flatten(F.transform("_rows", lambda s: F.transform(s["found"], lambda f: F.struct(f["span"].alias("span"), f["decision"].alias("decision"), s["name"].alias("surface"), F.coalesce(s["safe_pointer"], s["pointer"]).alias("pointer"), F.when(~s["is_key"], s["json_pointer"]).alias("json_pointer"), s["is_key"].alias("is_key")))))
    out = out.withColumn("findings", flat)
    rejected = F.exists("findings", lambda f: (F.lit(fixed) | f["is_key"]) & acts(f))
    out = out.withColumn("fault", F.col("_scan.fault")).withColumn("halted", F.exists("findings", lambda f: F.coalesce(f["decision"]["on_fail"] == "exception", F.lit(False)))).withColumn("rejected", rejected)
    out = out.withColumn("blocked", F.exists("findings", lambda f: blocks(policy.mode, f["decision"]["action"], f["decision"]["on_fail"])) | F.col("rejected") | F.col("fault").isNotNull())
    edits = F.transform(F.filter("_rows", lambda s: F.exists(s["found"], acts)), edit)
    # A drawn column that is read twice is not written out inside the Python function's arguments, where Spark does not find lambdas again.
    out = out.withColumn("_edits", F.when(F.rand(0) >= 0, edits)).withColumn("_new", rewritten(F.col(payload), F.col("_edits")))
    return out.withColumn("transformed", F.when(F.col("_edits").isNotNull() & ~F.col("halted") & ~F.col("rejected") & F.col("fault").isNull(), F.col("_new"))).drop("_scan", "_rows", "_edits", "_new")


def outcomes(inspected: DataFrame, direction: str = "request") -> DataFrame:
    """`inspected` with `status` and `error`, as a gateway would answer: 200, 400 for what cannot be read, 403 or 502 where something blocks."""
    refused = 403 if direction == "request" else 502
    status = F.when(F.col("fault").isNotNull(), 400 if direction == "request" else 502).when(F.col("halted") | F.col("rejected") | F.col("blocked"), refused).otherwise(200)
    error = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("halted"), "policy_exception").when(F.col("rejected"), "metadata_rejected").when(F.col("blocked"), "policy_block")
    return inspected.withColumn("status", status).withColumn("error", error)


def unsupported(payload: Column) -> Column:
    """Why a request cannot be inspected (null: it can): no object, no list of messages, a part of a message that is no text, several answers streamed at once."""

    def fault(text: str | None) -> str | None:
        try:
            root = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            return "invalid_json"
        if not isinstance(root, dict):
            return "not_an_object"
        if not isinstance(root.get("messages"), list):
            return "no_messages"
        for m in root["messages"]:
            if not isinstance(m, dict):
                return "invalid_message"
            for part in m.get("content") if isinstance(m.get("content"), list) else []:
                if not isinstance(part, dict) or part.get("type") not in ("text", "input_text", "output_text"):
                    return "unsupported_content"
        return None

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(fault)

    return run(payload)
