"""Spans of recognizers from built-in functions only: no Python crosses the JVM's border.

A match is set between marks by regexp_replace, the text is split at the marks and
places are summed up from the lengths of the parts.  Patterns are those of the
recognizer table, in Java's dialect; only recognizers whose check has a built-in
form are taken.  Texts with combining marks, which detection first composes, go
through the Arrow function; for all others both forms give the same spans.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .detect import spans

MARK = "\u0001"
SPAN = "struct<entity:string,start:int,end:int,value:string,confidence:double,detector_id:string>"
#: Entities whose recognizers all have built-in forms.
ENTITIES = ("EMAIL", "PHONE", "CREDIT_CARD", "US_SSN", "MRN", "IBAN")


def places(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches of a pattern; marks in the text itself count as any other control character."""
    plain = F.translate(text, MARK, "\u0002")
    parts = F.split(F.regexp_replace(plain, f"(?U){pattern}", f"{MARK}$0{MARK}"), MARK, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x)).alias("at"),
        (~a["inside"]).alias("inside"),
        F.when(a["inside"], F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"), x.alias("value"))))).otherwise(a["out"]).alias("out"),
    )
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out")), step)["out"]
    return F.when(F.size(parts) > 1, found).otherwise(none)


def _checked(found: Column, check: str | None) -> Column:
    if check == "luhn":
        return F.filter(found, lambda x: F.length(F.regexp_replace(x["value"], r"(?U)\D", "")).between(13, 19) & F.call_function("luhn_check", F.regexp_replace(x["value"], r"(?U)\D", "")))
    if check == "email":
        return F.filter(found, lambda x: ~F.lower(F.substring_index(x["value"], "@", 1)).isin(*P.ROLE_ACCOUNTS))
    return found


def _named(entity: str, confidence: float, detector: str, x: Column) -> Column:
    return F.struct(F.lit(entity).alias("entity"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lit(confidence).alias("confidence"), F.lit(detector).alias("detector_id"))


def native_spans(text: Column, entities: tuple[str, ...]) -> Column:
    """Unresolved spans of the regex family for some of ENTITIES, in the order of the recognizer table."""
    if not set(entities) <= set(ENTITIES):
        raise ValueError(f"no built-in form of {', '.join(sorted(set(entities) - set(ENTITIES)))}")
    parts = []
    for detector, entity, confidence, _, pattern, check, needs in P.REGEX:
        if entity in entities:
            found = _checked(places(text, pattern), check)
            made = F.transform(found, partial(_named, entity, confidence, detector))
            signs = [n for n in needs if n in ("@", "(")]
            parts.append(F.when(F.contains(text, F.lit(signs[0])), made).otherwise(F.array().cast(f"array<{SPAN}>")) if signs else made)
    odd = F.rlike(text, F.lit(r"\p{M}"))
    slow = F.transform(spans(F.when(odd, text), ("regex",), resolved=False, wanted=entities), lambda s: F.struct(*[s[c].alias(c) for c in ("entity", "start", "end", "value", "confidence", "detector_id")]))
    return F.when(odd, slow).otherwise(reduce(F.concat, parts))
