"""Policies: rules ranked on the driver, compiled to one CASE expression or joined as a table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORIES, SURFACES

# Names that policies may use.
ACTION_CLASS = {"block": 3, "redact": 2, "mask": 2, "tokenize": 2, "replace": 2, "hash": 2, "encrypt": 2, "allow": 1}
MODES = ("monitor", "redact", "block")
ON_FAIL = ("mask", "reask", "block", "observe", "exception")
HASHES = ("sha256", "sha512", "blake2b")
STANDALONE = ("EMAIL", "PHONE", "PERSON", "ADDRESS", "DATE_OF_BIRTH", "BANK_ACCOUNT", "IBAN", "CREDIT_CARD", "SWIFT", "CUSTOMER_CONFIDENTIAL", "EMPLOYEE_COMPENSATION", "PROMPT_INJECTION")
#: Entities without a detector of their own, and the detector that finds them under another name.
RESERVED = {"OAUTH_TOKEN": "regex.gcp_oauth", "WEBHOOK_URL": "regex.stripe_key", "HEALTH_INSURANCE_ID": "gliner.pii_phi", "EMPLOYEE_COMPENSATION": None}
BASE_FAMILIES = ("regex", "entropy", "medical-regex", "contextual-anchored")
FAMILIES = (*BASE_FAMILIES, "xpia", "contextual-broad", "presidio", "gliner", "openai_privacy_filter")
STREAMED = ("output.stream_chunk",)


@dataclass(frozen=True)
class Rule:
    id: str
    action: str
    entities: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    excepted: tuple[str, ...] = ()
    surfaces: tuple[str, ...] = ()  # none: all
    min_confidence: float = 0.0
    severity: str = "medium"
    priority: int = 0
    on_fail: str | None = None
    scope: str = "span"
    pack: bool = False
    replacement: str | None = None
    hash_algo: str | None = None
    encrypt_key_env: str | None = None

    def members(self) -> list[str]:
        """Entities of the rule: named ones or members of named categories; none named: all but the excepted."""
        return sorted({*self.entities, *(e for c in self.categories for e in CATEGORIES[c])} - {*self.excepted})


@dataclass(frozen=True)
class Promise:
    """What a profile promises of the corpora named: least recall and specificity."""

    corpora: tuple[str, ...]
    recall_floor: float
    specificity_floor: float


@dataclass(frozen=True)
class Policy:
    name: str
    rules: tuple[Rule, ...]
    scope: tuple[str, ...] = ()
    mode: str = "redact"
    detectors: tuple[str, ...] = BASE_FAMILIES
    version: str = "0.2"
    settings: dict[str, dict] = field(default_factory=dict, hash=False, compare=False)
    promise: Promise | None = None
    evidence: bool = True
    named_rules: bool = True

    def scoped(self) -> list[str]:
        return sorted({m for e in self.scope for m in CATEGORIES.get(e, [e])})

    def ranked(self) -> list[Rule]:
        """Highest first: priority, class of action, surface scope, own before pack, number of conditions; ties as written."""
        conditions = lambda r: bool(r.entities or r.categories) + bool(r.surfaces) + bool(r.excepted) + (r.min_confidence > 0)
        return sorted(self.rules, key=lambda r: (r.priority, ACTION_CLASS[r.action], r.scope == "surface", not r.pack, conditions(r)), reverse=True)

    def combined(self, *packs: Policy) -> Policy:
        names = [self.name, *(p.name for p in packs)]
        if len(set(names)) < len(names):
            raise ValueError("a policy cannot be combined with a pack of its own name")
        twice = {r.id for r in self.rules} & {r.id for p in packs for r in p.rules}
        if twice:
            raise ValueError(f"rules stand in the policy and in a pack: {', '.join(sorted(twice))}")
        rules = (*self.rules, *(replace(r, pack=True) for p in packs for r in p.rules))
        return replace(self, name="+".join(names), rules=rules, scope=tuple(dict.fromkeys([*self.scope, *(s for p in packs for s in p.scope)])))


def known_entities() -> set[str]:
    return {e for members in CATEGORIES.values() for e in members} | {*STANDALONE}


def suggestion(entity: str) -> str:
    """A hint at the category that an unknown or too narrow entity may stand for; empty if there is none."""
    near = next((c for c, members in CATEGORIES.items() if entity == c or entity in members), None) or next((c for c in CATEGORIES if c in entity), None)
    return f", did you mean the category {near}?" if near and near != entity else f", {entity} is a category" if near else ""


def _of_rule(r: Rule, surfaces: list[str]) -> list[str]:
    known = known_entities()
    wrong = [
        (r.action not in ACTION_CLASS, f"unknown action {r.action}"),
        (bool(r.excepted) and not r.categories, "exceptions without a category"),
        (r.on_fail not in (None, *ON_FAIL), f"unknown on_fail {r.on_fail}"),
        (r.scope not in ("span", "surface"), f"unknown scope {r.scope}"),
        (r.scope == "surface" and (not r.surfaces or any(s in STREAMED for s in r.surfaces)), "surface scope where texts are streamed"),
        (r.action == "replace" and not isinstance(r.replacement, str), "replace needs a replacement"),
        (r.action != "replace" and r.replacement is not None, f"{r.action} takes no replacement"),
        (r.action == "hash" and r.hash_algo not in (None, *HASHES), f"unknown hash {r.hash_algo}"),
        (r.action != "hash" and r.hash_algo is not None, f"{r.action} takes no hash"),
        (r.action == "encrypt" and not (r.encrypt_key_env or "").strip(), "encrypt needs the name of a variable with the key"),
        (r.action != "encrypt" and r.encrypt_key_env is not None, f"{r.action} takes no key"),
    ]
    out = [f"{r.id}: {what}" for bad, what in wrong if bad]
    out += [f"{r.id}: unknown entity {e}{suggestion(e)}" for e in (*r.entities, *r.excepted) if e not in known]
    out += [f"{r.id}: unknown category {c}" for c in r.categories if c not in CATEGORIES]
    return out + [f"{r.id}: unknown surface {s}" for s in r.surfaces if s not in surfaces]


def validate(policy: Policy, surfaces: list[str] = SURFACES, custom: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with a policy; empty if nothing is.  `custom` are families of one's own."""
    out = [] if policy.mode in MODES else [f"unknown mode {policy.mode}"]
    out += [f"unknown detector family {f}" for f in policy.detectors if f not in (*FAMILIES, *custom)]
    out += [f"unknown entity {e}{suggestion(e)}" for e in policy.scope if e not in known_entities() and e not in CATEGORIES]
    out += [line for r in policy.rules for line in _of_rule(r, surfaces)]
    return out + [f"rule id {i} occurs twice" for i in sorted({r.id for r in policy.rules if sum(r.id == o.id for o in policy.rules) > 1})]


def warnings(policy: Policy) -> list[str]:
    """Entities that a policy names though nothing finds them under that name."""
    named = sorted({*policy.scope, *(e for r in policy.rules for e in (*r.entities, *r.excepted))})
    return [f"{e} is reserved; found by {RESERVED[e] or 'nothing'}" for e in named if e in RESERVED]


def changes(old: Policy, new: Policy) -> dict[str, list[str]]:
    """Rules added, removed and changed, and entities added, from one policy to another."""
    a, b = ({r.id: r for r in p.rules} for p in (old, new))
    return {
        "added_rules": sorted(b.keys() - a.keys()),
        "removed_rules": sorted(a.keys() - b.keys()),
        "changed_rules": sorted(i for i in a.keys() & b.keys() if a[i] != b[i]),
        "added_entities": sorted({*new.scope} - {*old.scope}),
    }


def explained(spark, policy: Policy) -> DataFrame:
    """One row for each rule, in the order in which rules are tried."""
    rows = [(k, r.id, r.action, r.on_fail, r.scope, r.severity, r.priority, r.min_confidence, r.members(), list(r.surfaces), r.pack) for k, r in enumerate(policy.ranked())]
    return spark.createDataFrame(rows, "rank int, rule_id string, action string, on_fail string, scope string, severity string, priority int, min_confidence double, entities array<string>, surfaces array<string>, from_pack boolean")


def _matches(rule: Rule, entity: Column, surface: Column, confidence: Column, least: Column | None) -> Column:
    out = confidence >= rule.min_confidence
    out = out if least is None else out & (confidence >= least)
    if rule.entities or rule.categories:
        out = out & entity.isin(rule.members())
    elif rule.excepted:
        out = out & ~entity.isin(*rule.excepted)
    return out & surface.isin(*rule.surfaces) if rule.surfaces else out


def decide(policy: Policy, entity: Column, surface: Column, confidence: Column, least: Column | None = None) -> Column:
    """A struct (action, rule_id, severity, on_fail, scope) for a span: first match by rank, else allow.  `least` raises the least confidence of every rule."""
    make = lambda a, i, s, o, c: F.struct(F.lit(a).alias("action"), F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(o).cast("string").alias("on_fail"), F.lit(c).alias("scope"))
    none = make("allow", "default-allow", "info", None, "span")
    out = F.when(~entity.isin(policy.scoped()), none) if policy.scope else None
    for r in policy.ranked():
        out = (F if out is None else out).when(_matches(r, entity, surface, confidence, least), make(r.action, r.id, r.severity, r.on_fail, r.scope))
    return out.otherwise(none) if out is not None else none


def rule_table(spark, policy: Policy) -> DataFrame:
    """(entity, surface, rank, rule_id, action, min_confidence): the rules spelled out for every known entity and surface that they match."""
    everything = sorted(known_entities())
    rows = [(e, s, k, r.id, r.action, r.min_confidence) for k, r in enumerate(policy.ranked()) for e in (r.members() if r.entities or r.categories else [e for e in everything if e not in r.excepted]) for s in (r.surfaces or SURFACES)]
    return spark.createDataFrame(rows, "entity string, surface string, rank int, rule_id string, action string, min_confidence double")


def decide_by_join(policy: Policy, findings: DataFrame, keys: list[str]) -> DataFrame:
    """The same decision as an equi-join with the rule table and the lowest rank for each key."""
    rules = F.broadcast(rule_table(findings.sparkSession, policy))  # rules x entities x surfaces of one policy
    scoped = F.col("entity").isin(policy.scoped()) if policy.scope else F.lit(True)
    met = findings.join(rules, ["entity", "surface"], "left").withColumn("fits", scoped & (F.col("confidence") >= F.col("min_confidence")))
    best = F.min_by(F.when(F.col("fits"), F.struct("action", "rule_id")), F.when(F.col("fits"), F.col("rank")).otherwise(F.lit(1 << 30)))
    return met.groupBy(*keys).agg(best.alias("d")).select(*keys, F.coalesce("d.action", F.lit("allow")).alias("action"), F.coalesce("d.rule_id", F.lit("default-allow")).alias("rule_id"))


def applies(mode: str, action: Column, on_fail: Column) -> Column:
    """Whether a decision changes the payload."""
    return F.when(action == "allow", False).when(on_fail == "observe", False).when(on_fail.isin("mask", "reask", "block"), True).otherwise(F.lit(mode in ("redact", "block")))


def blocks(mode: str, action: Column, on_fail: Column) -> Column:
    """Whether a decision blocks the payload."""
    out = F.when(on_fail == "observe", False).when(action == "allow", False).when(on_fail.isin("block", "exception"), True)
    return out.when(F.lit(mode == "block"), True).when((action == "block") & F.lit(mode in ("redact", "block")), True).otherwise(False)
