"""The shipped profiles and domain packs: data only."""

from __future__ import annotations

from .policy import BASE_FAMILIES, Policy, Promise, Rule

# Surfaces, entities, rules, floors and settings of the shipped profiles and packs.
MESSAGES = ("input.messages", "input.system", "input.developer", "input.rag_context", "input.tool_results")
RETRIEVED = ("input.messages", "input.rag_context", "input.tool_results")
CONTENT = ("output.content", "output.stream_chunk")
DISPATCH = ("output.tool_calls.arguments", "output.reasoning", "logs.traces")
OUTBOUND = (*CONTENT, *DISPATCH)
ARGUMENTS = ("output.tool_calls.arguments",)
NUMBERS = ("CREDIT_CARD", "BANK_ACCOUNT", "IBAN", "SWIFT")
IDS = ("PHI", "STRONG_ID", "INTERNAL_ID")
PEOPLE = ("EMAIL", "PHONE", "PERSON")
IDENTITY = (*PEOPLE, "DATE_OF_BIRTH", "ADDRESS")
SCOPE = ("SECRET", "STRONG_ID", "INTERNAL_ID", *NUMBERS, *IDENTITY, "PHI", "EMPLOYEE_COMPENSATION", "CUSTOMER_CONFIDENTIAL")

SECRETS_BEFORE = Rule("block-secrets-before-model", "block", categories=("SECRET",), surfaces=MESSAGES, severity="critical", priority=90)
SECRETS_CONTENT = Rule("redact-secrets-final-content", "redact", categories=("SECRET",), surfaces=CONTENT, severity="high", priority=90)
SECRETS_DISPATCH = Rule("block-secrets-dispatch-surfaces", "block", categories=("SECRET",), surfaces=DISPATCH, severity="critical", priority=100)
IDS_BEFORE = Rule("tokenize-sensitive-identifiers-before-model", "tokenize", NUMBERS, IDS, surfaces=RETRIEVED, severity="high", priority=50)
IDS_OUTPUT = Rule("redact-sensitive-identifiers-output", "redact", NUMBERS, IDS, surfaces=(*CONTENT, "output.reasoning", "logs.traces"), severity="high", priority=50)
IDS_ARGUMENTS = Rule("redact-sensitive-tool-args", "block", NUMBERS, ("SECRET", *IDS), surfaces=ARGUMENTS, severity="critical", priority=100)
COMMON = (SECRETS_BEFORE, SECRETS_CONTENT, SECRETS_DISPATCH, IDS_BEFORE, IDS_OUTPUT, IDS_ARGUMENTS)
LOG_PEOPLE = Rule("log-generic-identity-low-noise", "redact", PEOPLE, on_fail="observe", severity="info", priority=10)
LOG_IDENTITY = Rule("log-generic-identity-low-noise", "redact", IDENTITY, on_fail="observe", severity="info", priority=10)

PHI_RULES = (
    Rule("healthcare.block-phi-dispatch", "block", categories=("PHI",), surfaces=DISPATCH, severity="critical", priority=110),
    Rule("healthcare.phi-output-containment", "redact", categories=("PHI",), surfaces=("output.content",), scope="surface", severity="high", priority=90),
    Rule("healthcare.redact-phi-content", "redact", categories=("PHI",), surfaces=CONTENT, severity="high", priority=90),
    Rule("healthcare.redact-identity-outbound", "redact", PEOPLE, surfaces=OUTBOUND, priority=60),
)
MODEL_SETTINGS = {
    "gliner": {
        "threshold": 0.45,
        "entity_thresholds": {"PERSON": 0.52, "ADDRESS": 0.42, "DATE_OF_BIRTH": 0.40, "BLOOD_TYPE": 0.38, "HEALTH_INSURANCE_ID": 0.38, "MEDICAL_CONDITION": 0.38, "MEDICATION": 0.38, "MRN": 0.38},
    }
}
FILTER_SETTINGS = {"openai_privacy_filter": {"required": False}}
BROAD_PROMISE = Promise(("piece_b_replay", "medical_phi_replay", "br_agentic_pii"), 0.90, 0.95)
CARE_PROMISE = Promise(("piece_b_replay", "medical_phi_replay", "nemotron_pii", "ai4privacy_multilingual", "br_agentic_pii"), 0.90, 0.95)


def _broad(infix: str) -> tuple[Rule, ...]:
    """Rules of the broad profiles; their ids differ by a part."""
    return (
        Rule(f"block-{infix}secrets-everywhere", "block", categories=("SECRET",), min_confidence=0.70, severity="critical", priority=100),
        Rule(f"redact-{infix}generic-identity-before-model", "redact", IDENTITY, ("PHI",), ("MRN",), MESSAGES, 0.38, priority=65),
        Rule(f"tokenize-{infix}hard-identifiers-before-model", "tokenize", NUMBERS, IDS, surfaces=MESSAGES, min_confidence=0.70, severity="high", priority=60),
        Rule(f"block-{infix}hard-identifiers-dispatch-surfaces", "block", NUMBERS, IDS, surfaces=DISPATCH, min_confidence=0.70, severity="critical", priority=90),
        Rule(f"redact-{infix}hard-identifiers-final-content", "redact", NUMBERS, IDS, surfaces=CONTENT, min_confidence=0.70, severity="high", priority=70),
        Rule(f"redact-{infix}generic-identity-outbound", "redact", IDENTITY, ("PHI",), ("MRN",), OUTBOUND, 0.38, priority=60),
    )


_ALL = (
    Policy("default", (*COMMON, LOG_PEOPLE), SCOPE),
    Policy("balanced", (*COMMON, Rule("redact-generic-identity-outbound", "redact", IDENTITY, surfaces=OUTBOUND, priority=60), LOG_IDENTITY), SCOPE),
    Policy(
        "strict",
        (
            Rule("block-secrets-everywhere", "block", categories=("SECRET",), severity="critical", priority=100),
            Rule("tokenize-hard-identifiers-before-model", "tokenize", NUMBERS, IDS, surfaces=RETRIEVED, severity="high", priority=60),
            Rule("block-hard-identifiers-dispatch-surfaces", "block", NUMBERS, IDS, surfaces=DISPATCH, severity="critical", priority=90),
            Rule("redact-hard-identifiers-final-content", "redact", NUMBERS, IDS, surfaces=CONTENT, severity="high", priority=70),
            Rule("redact-generic-identity-outbound", "redact", PEOPLE, surfaces=OUTBOUND, priority=60),
            Rule("block-prompt-injection-retrieved-surfaces", "block", ("PROMPT_INJECTION",), surfaces=("input.rag_context", "input.tool_results"), severity="critical", priority=95),
            Rule("log-prompt-injection-user-messages", "redact", ("PROMPT_INJECTION",), surfaces=("input.messages",), on_fail="observe", priority=50),
        ),
        (*SCOPE, "PROMPT_INJECTION"),
        detectors=(*BASE_FAMILIES, "xpia"),
    ),
    Policy("broad-pii", _broad(""), SCOPE, detectors=(*BASE_FAMILIES, "contextual-broad", "gliner"), settings=MODEL_SETTINGS, promise=BROAD_PROMISE),
    Policy("broad-pii-ml", _broad("ml-"), SCOPE, detectors=(*BASE_FAMILIES, "contextual-broad", "gliner", "openai_privacy_filter"), settings=MODEL_SETTINGS | FILTER_SETTINGS, promise=BROAD_PROMISE),
    Policy(
        "dev",
        (
            Rule("redact-secrets-everywhere", "redact", categories=("SECRET",), severity="high", priority=90),
            Rule("tokenize-sensitive-identifiers-before-model", "tokenize", NUMBERS, IDS, surfaces=RETRIEVED, priority=50),
            Rule("redact-sensitive-identifiers-outbound", "redact", NUMBERS, IDS, surfaces=OUTBOUND, severity="high", priority=60),
            LOG_PEOPLE,
        ),
        SCOPE,
    ),
    Policy(
        "monitor",
        (
            Rule("monitor-secrets-everywhere", "block", categories=("SECRET",), severity="critical", priority=100),
            Rule("monitor-hard-identifiers-dispatch-surfaces", "block", NUMBERS, IDS, surfaces=DISPATCH, severity="critical", priority=90),
            Rule("monitor-hard-identifiers-content", "redact", NUMBERS, IDS, surfaces=(*RETRIEVED, *CONTENT), severity="high", priority=70),
            Rule("monitor-generic-identity-outbound", "redact", PEOPLE, surfaces=OUTBOUND, priority=60),
        ),
        SCOPE,
        mode="monitor",
    ),
    Policy(
        "healthcare",
        (
            SECRETS_BEFORE, SECRETS_CONTENT, SECRETS_DISPATCH, IDS_BEFORE, *PHI_RULES[:3],
            Rule("block-sensitive-tool-args", "block", NUMBERS, ("STRONG_ID", "INTERNAL_ID"), surfaces=ARGUMENTS, severity="critical", priority=100),
            Rule("redact-sensitive-identifiers-output", "redact", NUMBERS, ("STRONG_ID", "INTERNAL_ID"), surfaces=(*CONTENT, "output.reasoning", "logs.traces"), severity="high", priority=50),
            PHI_RULES[3],
        ),
        SCOPE,
        promise=CARE_PROMISE,
    ),
)
PROFILES = {p.name: p for p in _ALL}
PACKS = {
    p.name: p
    for p in (
        Policy("healthcare", PHI_RULES),
        Policy(
            "financial",
            (
                Rule("domain-financial-block-payment-dispatch", "block", (*NUMBERS, "EMPLOYEE_COMPENSATION"), ("STRONG_ID", "INTERNAL_ID"), surfaces=DISPATCH, severity="critical", priority=115),
                Rule("domain-financial-tokenize-before-model", "tokenize", NUMBERS, ("STRONG_ID", "INTERNAL_ID"), surfaces=RETRIEVED, severity="high", priority=75),
                Rule("domain-financial-redact-output", "redact", (*NUMBERS, "EMPLOYEE_COMPENSATION"), ("STRONG_ID", "INTERNAL_ID"), surfaces=CONTENT, severity="high", priority=75),
            ),
        ),
        Policy(
            "enterprise-dlp",
            (
                Rule("domain-enterprise-block-secrets-dispatch", "block", ("CUSTOMER_CONFIDENTIAL",), ("SECRET",), surfaces=DISPATCH, severity="critical", priority=120),
                Rule("domain-enterprise-block-secrets-input", "block", categories=("SECRET",), surfaces=MESSAGES, severity="critical", priority=100),
                Rule("domain-enterprise-redact-confidential-output", "redact", ("CUSTOMER_CONFIDENTIAL",), ("SECRET",), surfaces=CONTENT, severity="high", priority=80),
            ),
        ),
    )
}


def effective(profile: str, packs: tuple[str, ...] = ()) -> Policy:
    """A profile with domain packs laid over it."""
    unknown = [x for x, known in ((profile, PROFILES), *((p, PACKS) for p in packs)) if x not in known]
    if unknown:
        raise ValueError(f"unknown profile or pack: {', '.join(unknown)}")
    return PROFILES[profile].combined(*(PACKS[p] for p in packs)) if packs else PROFILES[profile]
