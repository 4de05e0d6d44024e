"""Policies written as YAML, and digests of such files."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from ..plans.policy import BASE_FAMILIES, Policy, Promise, Rule, validate

#: Other names of detector families.
ALIASES = {"prompt-injection": "xpia"}


class Wrong(ValueError):
    """A policy that cannot be used; each of `faults` says why."""

    def __init__(self, faults: Sequence[str]):
        super().__init__("; ".join(faults))
        self.faults = list(faults)


def _mapping(value: object, what: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise Wrong([f"{what} is no mapping"])
    return value


def _names(value: object, what: str) -> tuple[str, ...]:
    if value is None:
        return ()
    if isinstance(value, str):
        return (value,)
    if not isinstance(value, list):
        raise Wrong([f"{what} is no list"])
    return tuple(map(str, value))


def _several(match: Mapping, one: str, many: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys((*_names(match.get(one), one), *_names(match.get(many), many))))


def rule(raw: Mapping, pack: bool = False) -> Rule:
    """A rule; a surface `any` stands for all, whatever else is named."""
    missing = [k for k in ("id", "action") if k not in raw]
    if missing:
        raise Wrong([f"a rule lacks {', '.join(missing)}"])
    match = _mapping(raw.get("match"), f"{raw['id']}: match")
    surfaces = _several(match, "surface", "surface_any_of")
    return Rule(
        str(raw["id"]),
        str(raw["action"]),
        _several(match, "entity", "entity_any_of"),
        _several(match, "entity_in_category", "entity_in_category_any_of"),
        _names(match.get("entity_except"), "entity_except"),
        () if "any" in surfaces else surfaces,
        float(match.get("min_confidence", 0)),
        str(raw.get("severity", "medium")),
        int(raw.get("priority", 0)),
        None if raw.get("on_fail") is None else str(raw["on_fail"]),
        str(raw.get("scope", "span")),
        pack,
        raw.get("replacement"),
        None if raw.get("hash_algo") is None else str(raw["hash_algo"]),
        raw.get("encrypt_key_env"),
    )


def promise(raw: object) -> Promise | None:
    """The promise of a profile: exactly the corpora and two floors between 0 and 1."""
    if raw is None:
        return None
    given = _mapping(raw, "gate_promise")
    if given.keys() != {"corpora", "recall_floor", "specificity_floor"}:
        raise Wrong(["gate_promise takes exactly corpora, recall_floor and specificity_floor"])
    if not isinstance(given["corpora"], list) or not given["corpora"]:
        raise Wrong(["gate_promise.corpora is no list, or empty"])
    floors = []
    for name in ("recall_floor", "specificity_floor"):
        try:
            floors.append(float(given[name]))
        except (TypeError, ValueError):
            raise Wrong([f"gate_promise.{name} is no number"]) from None
        if not 0 <= floors[-1] <= 1:
            raise Wrong([f"gate_promise.{name} is not between 0 and 1"])
    return Promise(tuple(map(str, given["corpora"])), *floors)


def parse(text: str, custom: tuple[str, ...] = ()) -> Policy:
    """A checked policy from YAML; `custom` are detector families of one's own."""
    import yaml

    raw = _mapping(yaml.safe_load(text), "the policy")
    missing = [k for k in ("version", "name", "action") if k not in raw]
    action = _mapping(raw.get("action"), "action")
    missing += [f"action.{k}" for k in ("mode", "rules") if "action" in raw and k not in action]
    if missing:
        raise Wrong([f"the policy lacks {', '.join(missing)}"])
    audit, detection = _mapping(raw.get("audit"), "audit"), _mapping(raw.get("detection"), "detection")
    if audit.get("store_raw_values"):
        raise Wrong(["audits never store raw values"])
    left_out = _names(detection.get("exclude_engines"), "detection.exclude_engines")
    added = tuple(ALIASES.get(a, a) for a in _names(detection.get("adapters"), "detection.adapters"))
    made = Policy(
        str(raw["name"]),
        tuple(rule(_mapping(r, "a rule")) for r in action["rules"] or ()),
        _names(detection.get("entities"), "detection.entities"),
        str(action["mode"]),
        (*(f for f in BASE_FAMILIES if f not in left_out), *added),
        str(raw["version"]),
        {str(k): _mapping(v, f"detection.settings.{k}") for k, v in _mapping(detection.get("settings"), "detection.settings").items()},
        promise(raw.get("gate_promise")),
        bool(audit.get("store_redacted_evidence", True)),
        bool(audit.get("include_policy_decision", True)),
    )
    faults = validate(made, custom=custom)
    if faults:
        raise Wrong(faults)
    return made


def parse_pack(text: str) -> Policy:
    """A domain pack from YAML: a name, rules, and entities that it adds to the scope."""
    import yaml

    raw = _mapping(yaml.safe_load(text), "the pack")
    missing = [k for k in ("name", "rules") if k not in raw]
    if missing:
        raise Wrong([f"the pack lacks {', '.join(missing)}"])
    made = Policy(str(raw["name"]), tuple(rule(_mapping(r, "a rule"), True) for r in raw["rules"] or ()), _names(raw.get("entities"), "entities"))
    faults = validate(made)
    if faults:
        raise Wrong(faults)
    return made


def read(spark: SparkSession, path: str, custom: tuple[str, ...] = ()) -> Policy:
    """A policy from a file in any store that Spark reads."""
    return parse(spark.read.text(path, wholetext=True).first()[0], custom)


def as_yaml(policy: Policy) -> str:
    """The policy written out, so that parse() gives it back."""
    import yaml

    def match(r: Rule) -> dict:
        parts = {"entity_any_of": list(r.entities), "entity_in_category_any_of": list(r.categories), "entity_except": list(r.excepted), "surface_any_of": list(r.surfaces), "min_confidence": r.min_confidence}
        return {k: v for k, v in parts.items() if v}

    def one(r: Rule) -> dict:
        rest = {"on_fail": r.on_fail, "replacement": r.replacement, "hash_algo": r.hash_algo, "encrypt_key_env": r.encrypt_key_env}
        return {"id": r.id, "match": match(r), "action": r.action, "severity": r.severity, "priority": r.priority, "scope": r.scope} | {k: v for k, v in rest.items() if v is not None}

    detection = {"entities": list(policy.scope), "exclude_engines": [f for f in BASE_FAMILIES if f not in policy.detectors], "adapters": [f for f in policy.detectors if f not in BASE_FAMILIES], "settings": policy.settings}
    out = {"version": policy.version, "name": policy.name, "detection": detection, "action": {"mode": policy.mode, "rules": [one(r) for r in policy.rules]}, "audit": {"store_redacted_evidence": policy.evidence, "include_policy_decision": policy.named_rules}}
    if policy.promise:
        out["gate_promise"] = {"corpora": list(policy.promise.corpora), "recall_floor": policy.promise.recall_floor, "specificity_floor": policy.promise.specificity_floor}
    return yaml.safe_dump(out, sort_keys=False, allow_unicode=True)


def without_origin(policy: Policy) -> Policy:
    """The policy with rules of packs taken as its own, as a file has them."""
    return replace(policy, rules=tuple(replace(r, pack=False) for r in policy.rules))


def digest(text: str) -> str:
    """What is published beside a policy file to know it by."""
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def verified(text: str, published: str) -> bool:
    return digest(text) == published.strip()
