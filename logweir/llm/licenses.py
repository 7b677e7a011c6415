"""Licence notices by the Dice coefficient over word bigrams.

Every line and every paragraph of a text is a unit.  Units and templates are
normalised alike and become sets of word bigrams; two sets of sizes a and b can only
reach a Dice coefficient t if b lies between a t / (2 - t) and a (2 - t) / t, so most
units leave by their length, before bigrams are made.  The templates are a fixed
list, so comparing is a projection.  Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICE = 0.8
#: Between paragraphs: lines that are blank, or hold nothing but the marks of a comment.
BREAK = r"\\n[ \\t\\r#*/;%-]*\\n"

#: Notices of common licences.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


#: Words that tell little, so that no search should rest on them.
COMMON = {"this", "is", "the", "of", "a", "under", "in", "by", "be", "with", "and", "or", "to", "for", "that", "at", "can", "you", "it", "not", "any",
          "are", "free", "use", "work", "source", "following", "form", "found", "file", "version", "may", "subject", "terms", "either", "later", "into"}


def normal_words(text: str) -> list[str]:
    """Words of a template: ASCII lower case, runs of letters and digits."""
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def bigrams(w: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def size_bounds(sizes: list[int], dice: float) -> list[tuple[int, int]]:
    """Set sizes that can reach the coefficient with sets of these sizes, as ranges."""
    spans = sorted((int(-(-n * dice // (2 - dice))), int(n * (2 - dice) / dice + 1e-9)) for n in set(sizes))
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def probe_words(sets: list[list[str]], dice: float) -> list[str]:
    """Words of which every set that reaches the coefficient with a template holds one.

    Such a set has more than a share of dice / (2 - dice) of the template's bigrams, so
    it can't miss all of a choice that leaves fewer; the choice is made greedily."""
    needs = [len(s) - math.ceil(len(s) * dice / (2 - dice) - 1e-9) + 1 for s in sets]
    chosen: list[str] = []
    left = [set(s) for s in sets]
    while any(n > 0 for n in needs):
        words_ = sorted({w for s, n in zip(left, needs) if n > 0 for b in s for w in b.split(" ")})
        won = lambda w: sum(min(n, sum(w in b.split(" ") for b in s)) for s, n in zip(left, needs) if n > 0)
        best = max(words_, key=lambda w: (w not in COMMON, len(w) > 1, won(w), len(w), w))
        chosen.append(best)
        for k, s in enumerate(left):
            hit = {b for b in s if best in b.split(" ")}
            needs[k] -= len(hit)
            left[k] = s - hit
    return chosen


def license_notices(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """(doc_id, unit, number, license, dice): the best template of every line and
    every paragraph (lines between those that are blank or hold comment marks alone, if
    more than one) that reaches ``dice``.

    Ties go to the template that is first by name.  Null and empty texts and units of
    one word match nothing.  Repeated rows and null ids stay; other columns go.
    """
    sets = [(name, sorted(bigrams(normal_words(t)))) for name, t in templates]
    sets = [(n, s) for n, s in sorted(sets) if s]
    if not sets:
        return docs.sparkSession.createDataFrame([], "doc_id long, unit string, number int, license string, dice double")
    ranges = size_bounds([len(s) for _, s in sets], dice)
    shortest = ranges[0][0]
    probes = "(?i)(?<![a-z0-9])(?:" + "|".join(probe_words([s for _, s in sets], dice)) + ")(?![a-z0-9])"
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).where(F.col("t").rlike(probes))
    lines = "transform(split(t, '\\n'), (x, i) -> named_struct('unit', 'line', 'number', i, 'x', x))"
    paragraphs = f"transform(split(t, '{BREAK}'), (x, i) -> named_struct('unit', 'paragraph', 'number', i, 'x', x))"
    both = F.expr(f"concat({lines}, filter({paragraphs}, p -> contains(trim('\\n' from p.x), '\\n')))")
    # explode keeps the filters that follow from being moved below, where they would make the bigrams again
    w = F.transform(F.filter(both, lambda u: u["x"].rlike(probes)), lambda u: F.struct(u["unit"].alias("unit"), u["number"].alias("number"), F.array_remove(
        F.split(F.regexp_replace(F.lower(u["x"]), "[^a-z0-9]+", " "), " "), "").alias("w")))
    w = F.filter(w, lambda u: F.size(u["w"]) > shortest)
    g = F.transform(w, lambda u: F.struct(u["unit"].alias("unit"), u["number"].alias("number"), F.array_distinct(F.transform(
        F.slice(u["w"], F.lit(1), F.size(u["w"]) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(u["w"], i + 1)))).alias("g")))

    def fits(u):
        ok = F.lit(False)
        for lo, hi in ranges:
            ok = ok | F.size(u["g"]).between(lo, hi)
        return ok

    def within(size: int):
        (low, high), = size_bounds([size], dice)
        return F.size("g").between(low, high)

    g = d.select("doc_id", F.explode(F.filter(g, fits)).alias("u")).select("doc_id", "u.*")
    every = F.array(*[F.lit(x) for x in sorted({b for _, s in sets for b in s})])
    g = g.where(F.arrays_overlap("g", every))
    scores = [
        # only within the template's own size bounds is the intersection made
        F.struct(F.when(within(len(s)), 2.0 * F.size(F.array_intersect("g", F.array(*[F.lit(x) for x in s]))) / (F.size("g") + len(s))).otherwise(0.0).alias("dice"),
                 F.lit(-i).alias("first"), F.lit(n).alias("license")) for i, (n, s) in enumerate(sets)]
    best = F.filter(F.array(F.array_max(F.array(*scores))), lambda x: x["dice"] >= dice - 1e-12)
    return g.select("doc_id", "unit", "number", F.explode(best).alias("best")).select("doc_id", "unit", "number", "best.license", "best.dice")
