"""Operator 1: licence scans.

Every line of a text, and the whole text, is normalised (lower case; every run
of characters other than letters and digits becomes one blank) and compared
with licence templates by the Dice coefficient over sets of word bigrams.  A
unit with b bigrams can reach the threshold t against a template with c
bigrams only if t/(2-t) <= b/c <= (2-t)/t, so templates whose size lies outside
are pruned.  Windows of words, over the ends of lines too, are compared in the
same way; one is reported, under the line where it starts, if no matched line
holds half of its words and the whole text does not match.  Of windows that
overlap, the one that shares most bigrams with its template stays.  Texts without any of the bigrams that a match needs are set aside
before that.

Everything is one narrow projection of built-in functions: no shuffle, no
Python.  Templates are literals in the plan; their number is fixed.

Defined results: a null or empty text, or a unit with fewer than two words,
has no bigrams and matches nothing.  Among templates with equal coefficients
the first name in alphabetical order wins.  Repeated rows yield repeated
results, null keys are kept, an empty table gives no rows.  A text, a line or a
word of any length is compared whole; columns other than the key and the text are
ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wordings of licence notices, in natural order.
NOTICES = {
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "This software is released under the BSD 2-Clause License.",
    "BSD-3-Clause": "This software is released under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "EPL-2.0-short": "Licensed under the Eclipse Public License 2.0.",
    "GPL-2.0-short": "Licensed under the GNU General Public License, version 2.",
    "GPL-3.0-short": "Licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT-short": "Licensed under the MIT License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-short": "Released under the Unlicense.",
    "Zlib": "Released under the zlib License.",
}

#: The Creative Commons family: code and name of each licence.
_COMMONS = {
    "BY": "Attribution",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-SA": "Attribution-ShareAlike",
}
for _code, _name in _COMMONS.items():
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        NOTICES[f"CC-{_code}-{_version}"] = f"This work is licensed under a Creative Commons {_name} {_version} {_port} License."
        NOTICES[f"CC-{_code}-{_version}-short"] = f"Licensed under CC {_code} {_version}."
NOTICES["CC0-1.0-short"] = "Licensed under CC0 1.0."


def _bodies() -> dict[str, str]:
    """Complete licence texts, by the name of their file."""
    folder = files(__package__) / "license_texts"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}


TEMPLATES = NOTICES | _bodies()
#: Templates of more bigrams than this have windows that start and end at runs of three shared bigrams.
LONG = 120
FOUND = "array<struct<shared:int,dice:double,rank:int,i:int,j:int,license:string>>"


def words_of(text: Column) -> Column:
    """The normalised words of `text` as an array."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "), " "), lambda w: w != "")


def all_bigrams_of(words: Column) -> Column:
    """The bigrams of an array of words in their order."""
    left, right = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))


def bigrams_of(words: Column) -> Column:
    """The set of bigrams of an array of words."""
    left, right = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    return F.array_distinct(F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b)))


def _template_words(text: str) -> list[str]:
    import re

    return [x for x in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if x]


def _n_bigrams(text: str) -> int:
    return len(_template_words(text)) - 1


def _template_bigrams(text: str) -> list[str]:
    w = _template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def necessary_bigrams(grams: list[str], threshold: float, chosen: set[str] = frozenset()) -> list[str]:
    """Bigrams of which a unit must hold at least one to reach the threshold with a template.

    With bounded sizes, the two sets share threshold/(2-threshold) of a template's
    bigrams at least, so one more than may be missed cannot all be missing.  Long
    ones, and those that other templates chose, are preferred: prose has few of them.
    """
    may_miss = int(len(grams) * (1 - threshold / (2 - threshold)) + 1e-9)
    return sorted(grams, key=lambda g: (g not in chosen, -len(g), g))[: may_miss + 1]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """(key, n_units, matches): matches is an array of (unit, license, dice), unit 0 the whole text, else the line's number; those of windows come last."""
    wordings = TEMPLATES if templates is None else templates
    table = {k: b for k, v in sorted(wordings.items()) if (b := _template_bigrams(v))}
    kind = "array<struct<unit:int,license:string,dice:double>>"
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.split(body, "\n", -1)
    if not table:
        return docs.select(F.col(key), F.size(lines).alias("n_units"), F.array().cast(kind).alias("matches"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    must: dict[str, list[str]] = {}
    for k, b in sorted(table.items(), key=lambda x: len(x[1])):
        must[k] = necessary_bigrams(b, threshold, set().union(*must.values()))
    # One string in the plan, folded to an array of structs.
    rows = [{"rank": i, "license": k, "grams": b, "must": must[k], "low": len(b) * low, "high": len(b) * high, "size": len(b), "most": int(_n_bigrams(wordings[k]) * high)} for i, (k, b) in enumerate(table.items())]
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<rank:int,license:string,grams:array<string>,must:array<string>,low:double,high:double,size:int,most:int>>")
    needed_words = F.split(F.lit(" ".join(sorted({max(g.split(" "), key=len) for b in must.values() for g in b}))), " ")
    needed = F.split(F.lit("\n".join(sorted(set().union(*must.values())))), "\n")

    def best(unit: Column, grams: Column, near: Column) -> Column:
        """(unit, best) of a unit against the templates in `near`."""
        n = F.size(grams)
        fits = F.filter(near, lambda t: n.between(t["low"], t["high"]))
        scored = F.transform(fits, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (n + F.size(t["grams"]))).alias("dice"), (-t["rank"]).alias("rank"), t["license"].alias("license")))
        return F.struct(unit.alias("unit"), F.array_max(scored).alias("best"))

    def units(words: Column, grams: Column, near: Column) -> Column:
        """Matches of the whole text and of its lines."""
        all_units = F.concat(F.when(F.size(words) > 1, F.array(best(F.lit(0), grams, near))).otherwise(F.array().cast("array<struct<unit:int,best:struct<dice:double,rank:int,license:string>>>")), F.transform(words, lambda w, i: let(bigrams_of(w), lambda b: best(i + 1, b, near))))
        found = F.filter(all_units, lambda m: m["best"]["dice"] >= threshold)
        return F.transform(found, lambda m: F.struct(m["unit"].alias("unit"), m["best"]["license"].alias("license"), m["best"]["dice"].alias("dice")))

    def windows(grams: Column, line_of: Column, known_units: Column, near: Column) -> Column:
        """Matches of windows of words that no line and not the whole text stands for; the unit is the line where one starts.

        Giving up bigrams at an end that the template lacks, or taking in more that
        it holds, never lowers the coefficient; so the best windows start and end
        where runs of the template's bigrams do.
        """
        def of(t: Column) -> Column:
            size, least = t["size"], t["low"]
            # Texts of many bigrams: only runs of three and more are taken as ends, single shared bigrams lie everywhere.
            run = F.when(size > LONG, 3).otherwise(1)

            def search(hit: Column) -> Column:
                at = lambda i: F.coalesce(F.get(hit, i), F.lit(False))
                places = F.filter(F.transform(hit, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
                whole = lambda i, step: (run == 1) | (at(i + step) & at(i + 2 * step))
                starts = F.filter(places, lambda i: ~at(i - 1) & whole(i, 1))
                ends = F.filter(places, lambda i: ~at(i + 1) & whole(i, -1))

                def score(i: Column, j: Column) -> Column:
                    return let(F.array_distinct(F.slice(grams, i + 1, j - i + 1)), lambda b: let(F.size(F.array_intersect(b, t["grams"])), lambda n: F.struct((-n).alias("shared"), (F.lit(-2.0) * n / (F.size(b) + F.size(t["grams"]))).alias("dice"), t["rank"].alias("rank"), i.alias("i"), j.alias("j"), t["license"].alias("license"))))

                pairs = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(ends, lambda j: (j >= i) & (j - i + 1 >= least) & (j - i + 1 <= t["most"])), lambda j: score(i, j))))
                return F.filter(pairs, lambda m: -m["dice"] >= threshold)

            enough = F.size(F.array_intersect(t["grams"], grams)) >= least
            return F.when(enough, let(F.transform(grams, lambda g: F.array_contains(t["grams"], g)), search)).otherwise(F.array().cast(FOUND))

        def seen(m: Column) -> Column:
            """Whether a matched line holds half of the window's words, or the whole text matched."""
            inside = lambda u: F.size(F.filter(F.slice(line_of, m["i"] + 1, m["j"] - m["i"] + 2), lambda k: k == u))
            return F.exists(known_units, lambda u: (u["unit"] == 0) | (2 * inside(u["unit"]) >= m["j"] - m["i"] + 2))

        found = F.array_sort(F.filter(F.flatten(F.transform(near, of)), lambda m: ~seen(m)))
        # Most shared bigrams first; what overlaps a window taken before goes.
        taken = F.aggregate(found, F.array().cast(FOUND), lambda kept, m: F.when(F.exists(kept, lambda k: (k["i"] <= m["j"]) & (m["i"] <= k["j"])), kept).otherwise(F.concat(kept, F.array(m))))
        return F.transform(F.array_sort(F.transform(taken, lambda m: F.struct(m["i"].alias("i"), m["license"].alias("license"), (-m["dice"]).alias("dice")))), lambda m: F.struct(F.get(line_of, m["i"]).alias("unit"), m["license"].alias("license"), m["dice"].alias("dice")))

    def matches(words: Column) -> Column:
        """Most texts hold none of the words, or none of the bigrams, that a match needs; they are done there."""
        none = F.array().cast(kind)

        def both(parts: Column, grams: Column, near: Column) -> Column:
            line_of = F.flatten(F.transform(parts, lambda w, i: F.array_repeat(i + 1, F.size(w))))
            return let(units(parts, grams, near).cast(kind), lambda found: let(line_of, lambda k: let(all_bigrams_of(words), lambda g: F.concat(found, windows(g, k, found, near).cast(kind)))))

        def of(grams: Column) -> Column:
            return let(F.array_intersect(grams, needed), lambda hits: F.when(F.size(hits) == 0, none).otherwise(let(F.filter(known, lambda t: F.arrays_overlap(t["must"], hits)), lambda near: let(F.transform(lines, words_of), lambda parts: both(parts, grams, near)))))

        return F.when(F.arrays_overlap(words, needed_words), let(bigrams_of(words), of)).otherwise(none)

    n_units = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return docs.select(F.col(key), n_units.alias("n_units"), let(words_of(body), matches).alias("matches"))
