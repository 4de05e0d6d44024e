"""What there is: detectors, entities and profiles as small tables, and a table as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import adapters
from ..functions import context as C
from ..functions import patterns as P
from ..functions.detect import LABELS
from .policy import RESERVED, known_entities
from .profiles import PACKS, PROFILES


def detectors(spark: SparkSession) -> DataFrame:
    """(family, detector_id, entity, confidence): every entity that a detector can give; the confidence is null where a model tells it."""
    rows = [("regex", d, e, c) for d, e, c, *_ in P.REGEX]
    rows += [("regex", d, e, c) for d, _, c, *_ in P.REGEX for name, _, e in LABELS if name == d]
    rows += [("entropy", "entropy.secret", "OTHER_SECRET", 0.78)]
    rows += [("medical-regex", "medical-regex.phi_pattern", e, c) for _, e, c, *_ in P.MEDICAL]
    rows += [("xpia", f"xpia.{n}", "PROMPT_INJECTION", c) for n, c, _ in P.INJECTION]
    rows += [("contextual-anchored", d, e, c) for e, d, _, _, c in P.FIELDS] + [("contextual-anchored", f"contextual.xml_{t}", e, 0.82) for t, e in C.TAGS.items()]
    rows += [("contextual-broad", d, e, c) for e, d, _, _, c in C.BROAD_FIELDS] + [("contextual-broad", d, e, c) for e, d, _, c in C.SHAPES]
    rows += [("gliner", "gliner", e, None) for e in dict.fromkeys(adapters.ZERO_SHOT_LABELS.values())] + [("presidio", f"presidio.{k.lower()}", e, None) for k, e in adapters.ANALYZER_LABELS.items()]
    rows += [("openai_privacy_filter", f"openai_privacy_filter.{k}", e, None) for k, e in adapters.CLASSIFIER_LABELS.items()]
    return spark.createDataFrame(sorted(set(rows), key=str), "family string, detector_id string, entity string, confidence double")


def entities(spark: SparkSession) -> DataFrame:
    """(entity, category, reserved): all entities; a category is null for those that stand alone."""
    category = {e: c for c, members in P.CATEGORIES.items() for e in members}
    return spark.createDataFrame([(e, category.get(e), e in RESERVED) for e in sorted(known_entities())], "entity string, category string, reserved boolean")


def profiles(spark: SparkSession) -> DataFrame:
    """(kind, name, mode, n_rules, detectors): shipped profiles and packs."""
    rows = [(kind, p.name, p.mode, len(p.rules), ",".join(p.detectors)) for kind, table in (("profile", PROFILES), ("pack", PACKS)) for p in table.values()]
    return spark.createDataFrame(rows, "kind string, name string, mode string, n_rules int, detectors string")


def markdown(table: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown, for reports; more than `most` rows are refused."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    said = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [table.columns, ["---"] * len(table.columns), *([said(v) for v in r] for r in rows)]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)
