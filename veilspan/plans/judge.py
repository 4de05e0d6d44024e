"""A policy for single texts: decisions and replacements in Python, for keyed state that Spark's expressions cannot reach.

`decide`, `applies` and `blocks` of `policy`, and the replacements of `transforms`,
say the same as columns; tests hold the two against each other.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Mapping
from dataclasses import dataclass

from ..functions.detect import PLAIN, Settings, scan
from ..operators.inspect import wanted_entities
from .policy import Policy, Rule


class Halted(Exception):
    """A rule with `exception` was met."""


@dataclass(frozen=True)
class Decision:
    start: int
    end: int
    entity: str
    value: str
    detector: str
    confidence: float
    rule: Rule
    applies: bool
    blocks: bool

    def signature(self, surface: str, pointer: str = "") -> str:
        """What tells one decision from another, without the value."""
        return "|".join(map(str, (surface, pointer, self.start, self.end, self.entity, self.detector, self.rule.action, self.rule.id)))


def _applies(mode: str, rule: Rule) -> bool:
    return rule.on_fail != "observe" and (rule.on_fail in ("mask", "reask", "block") or mode in ("redact", "block"))


def _blocks(mode: str, rule: Rule) -> bool:
    if rule.on_fail == "observe":
        return False
    return rule.on_fail in ("block", "exception") or mode == "block" or rule.action == "block" and mode == "redact"


class Judge:
    """Finds spans and decides on them by a policy; `key` makes tokens that can be resolved."""

    def __init__(self, policy: Policy, settings: Settings = PLAIN, key: bytes | None = None):
        if any(r.action == "encrypt" for r in policy.rules):
            raise ValueError("streams are not encrypted: a rule with `encrypt` needs Spark's own functions")
        self.policy, self.settings, self.key = policy, settings, key
        self.ranked = [(r, frozenset(r.members()) if r.entities or r.categories else None) for r in policy.ranked()]
        self.scope = frozenset(policy.scoped()) if policy.scope else None
        wanted = wanted_entities(policy)
        self.wanted = None if wanted is None else frozenset(wanted)

    def rule_for(self, entity: str, surface: str, confidence: float) -> Rule | None:
        """The first rule by rank that meets a span; None: allowed."""
        if self.scope is not None and entity not in self.scope:
            return None
        for rule, members in self.ranked:
            named = entity in members if members is not None else entity not in rule.excepted
            if named and confidence >= rule.min_confidence and (not rule.surfaces or surface in rule.surfaces):
                return rule if rule.action != "allow" else None
        return None

    def decisions(self, text: str, surface: str) -> list[Decision]:
        """What is not allowed in a text, in order of detection; raises Halted."""
        out = []
        for s in scan(text, self.policy.detectors, surface=surface, settings=self.settings, wanted=self.wanted):
            rule = self.rule_for(s["entity"], surface, s["confidence"])
            if rule is not None:
                out.append(Decision(s["start"], s["end"], s["entity"], s["value"], s["detector_id"], s["confidence"], rule, _applies(self.policy.mode, rule), _blocks(self.policy.mode, rule)))
        if any(d.rule.on_fail == "exception" for d in out):
            raise Halted
        return out

    def replacement(self, d: Decision) -> str:
        action, value = d.rule.action, d.value
        if action == "mask":
            return "*" * len(value) if len(value) <= 4 else value[:2] + "*" * (len(value) - 4) + value[-2:]
        if action == "tokenize":
            if self.key is None:
                return f"<{d.entity}:TOKEN>"
            digest = hmac.new(self.key, d.entity.encode() + b"\0" + value.encode(), hashlib.sha256).hexdigest()
            return f"vault_tok_{d.entity.lower()}_{digest[:20]}"
        if action == "replace":
            return d.rule.replacement or f"<{d.entity}:REPLACED>"
        if action == "hash":
            name = d.rule.hash_algo or "sha256"
            return f"<{d.entity}:HASH:{name}={hashlib.new(name, value.encode()).hexdigest()[:16]}>"
        return f"<{d.entity}:REDACTED>"

    def written(self, text: str, found: list[Decision], priority: Mapping[str, int], usual: int) -> str:
        """`text` with what applies written in; of overlapping spans the earlier, then the more urgent, then the longer one."""
        order = sorted((d for d in found if d.applies), key=lambda d: (d.start, -priority.get(d.entity, usual), d.start - d.end))
        out, at = [], 0
        for d in order:
            if d.start >= at:
                out += [text[at : d.start], self.replacement(d)]
                at = d.end
        return "".join(out) + text[at:]
