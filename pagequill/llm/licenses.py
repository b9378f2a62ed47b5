"""License scan: MinHash bands over overlapping windows retrieve templates, containment is verified at every place.

A template of s shingles is looked for in windows of s + STEP s - 1 shingles (STEP
is a quarter, rounded up), which start at every STEP s: any s shingles in a row lie
within one of them. A window that holds CONTAINMENT, 0.8, of the template's
shingles has a Jaccard similarity J of 0.8 s / (1.25 s + 0.2 s) = 0.55 or more with
it. With BANDS = 64 bands of ROWS = 2 minima, the window and the template agree in
no band with a probability of (1 - J^2)^64, 8e-11 at most; a template of one
shingle has J = 1. So a notice in ten thousand million is missed by chance.

A window that shares no shingle with any template agrees with none in a band, so
minima are computed for windows that hold a shingle of a template of their size.
DataFrame functions only.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequill.llm.common import materialize

# Notices of common licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "All rights reserved."),
]
SHINGLE = 5
CONTAINMENT = 0.8
_WORD = r"[^a-z0-9.+-]+"
MAX_TEMPLATES = 10_000
BANDS, ROWS = 64, 2
#: Windows of a template start at so many of its shingles, as a divisor.
STEPS = 4


def _words(text: Column) -> Column:
    """Lower-cased words of letters, digits, dots and dashes; other characters divide them, final dots go."""
    cut = F.filter(F.split(F.lower(text), _WORD), lambda w: w != "")
    return F.filter(F.transform(cut, lambda w: F.regexp_replace(w, r"^[.+-]+|[.+-]+$", "")), lambda w: w != "")


def _shingles(words: str, n: int = SHINGLE) -> Column:
    """Hashes of n-word shingles, none of fewer words."""
    return F.expr(f"if(size({words}) < {n}, cast(array() as array<bigint>), transform(sequence(0, greatest(size({words}) - {n}, 0)), i -> xxhash64(array_join(slice({words}, i + 1, {n}), ' '))))")


def _places(words: str, n: int) -> Column:
    """array<struct<n, h, at>>: the n-word shingles with their first words' numbers."""
    return F.transform(_shingles(words, n), lambda h, i: F.struct(F.lit(n).alias("n"), h.alias("h"), i.alias("at")))


def anchors(templates: list[tuple[str, str]], containment: float = CONTAINMENT, n: int = SHINGLE) -> list[str]:
    """Words such that any text which contains `containment` of a template's shingles has one of them.

    Words are added, those of most templates first, common short ones last, until
    more than 1 - containment of the shingles of each template hold one.
    """
    sets = []
    for _, text in templates:
        w = [x.strip(".+-") for x in re.split(_WORD, text.lower()) if x.strip(".+-")]
        sets.append([frozenset(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)])
    spread = Counter(w for s in sets for w in frozenset().union(*s))
    chosen: list[str] = []
    for s in sets:
        while not sum(any(c in g for c in chosen) for g in s) > (1 - containment) * len(s):
            left = {w for g in s if not any(c in g for c in chosen) for w in g}
            chosen.append(max(left, key=lambda w: (len(w) >= 5, spread[w], len(w), w)))
    return chosen


def _bands(shingles: str) -> str:
    """array<bigint>: a key for each band, of the minima of ROWS hash functions over an array of shingle hashes."""
    minima = ", ".join(f"array_min(transform({shingles}, h -> xxhash64(h, {ROWS} * b + {r})))" for r in range(ROWS))
    return f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, {minima}))"


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template, license, size (words), n (words of a shingle: SHINGLE, or all of fewer), shingles, s (shingle places), step and width of its windows, bands."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError("the template table is broadcast and must stay small")
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(templates)], "template int, license string, text string")
    rows = rows.select("template", "license", _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    by_n = F.coalesce(*[F.when(F.size("w") == n, _shingles("w", n)) for n in range(1, SHINGLE)], _shingles("w"))
    rows = rows.select("template", "license", F.size("w").alias("size"), F.least(F.size("w"), F.lit(SHINGLE)).alias("n"), F.array_distinct(by_n).alias("shingles"))
    rows = rows.withColumn("s", F.col("size") - F.col("n") + 1).withColumn("step", F.ceil(F.col("s") / STEPS).cast("int"))
    return rows.withColumns({"width": F.col("s") + F.col("step") - 1, "bands": F.expr(_bands("shingles"))})


def _retrieved(held: DataFrame, hits: DataFrame, table: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, k, template): templates that agree with a window of the document in some band. held: id, k, w; hits: places of templates' shingles."""
    first = F.greatest(F.ceil((F.col("at") - F.col("width") + 1) / F.col("step")), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(first, F.floor(F.col("at") / F.col("step")).cast("int")), lambda i: i * F.col("step"))
    windows = hits.select("id", "k", F.explode(starts).alias("start"), "n", "s", "width").groupBy("id", "k", "n", "s", "width", "start").agg(F.count("*").alias("shared"))
    windows = windows.groupBy("id", "k").agg(F.collect_list(F.struct("n", "s", "width", "start")).alias("windows"))
    same = F.col("h.id").eqNullSafe(F.col("v.id")) & (F.col("h.k") == F.col("v.k"))
    rows = held.alias("h").join(windows.alias("v"), same).select("h.id", "h.k", "w", "windows")
    rows = rows.select("id", "k", "windows", *[_shingles("w", n).alias(f"h{n}") for n in sizes])
    of_size = f"case {' '.join(f'when x.n = {n} then h{n}' for n in sizes)} end"
    keys = F.expr(f"transform(windows, x -> struct(x.n as n, x.s as s, transform(array(slice({of_size}, x.start + 1, x.width)), a -> {_bands('a')})[0] as bands))")
    keys = rows.select("id", "k", F.explode(keys).alias("x")).select("id", "k", "x.n", "x.s", F.explode("x.bands").alias("band"))
    index = F.broadcast(table.select("n", "s", "template", F.explode("bands").alias("band")))
    return keys.join(index, ["n", "s", "band"]).groupBy("id", "k", "template").agg(F.count("*").alias("agree")).select("id", "k", "template")


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Matches: <id_col>, license, template, containment, start_word, n_words.

    One row for each document and template that a window of the text contains to
    `containment` or more of its 5-word shingles (its whole word sequence if it is
    shorter); the best window is named, of equals the first. Windows have a
    template's length and start at every word; the bands (see above) say which
    templates are verified so. Documents are told apart by id and text, so
    repeated rows match once, and null ids are kept apart by their texts. Null
    and empty texts match nothing; other columns are ignored. Documents without
    any anchor word (see anchors) can match nothing and are left out first.
    """
    spark, text = docs.sparkSession, F.col(f"`{text_col}`")
    table = template_table(spark, templates)
    words = anchors(templates, containment)
    near = F.lower(text).rlike("|".join(re.escape(w) for w in words))
    rows = docs.where(near).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{id_col}`", text).alias("k"), _words(text).alias("w"))
    held = materialize(rows.where(F.arrays_overlap("w", F.array(*map(F.lit, words)))).groupBy("id", "k").agg(F.first("w").alias("w")), "license-words")
    sizes = sorted(r["n"] for r in table.select("n").distinct().collect())
    places = held.select("id", "k", F.explode(F.concat(*[_places("w", n) for n in sizes])).alias("p"))
    index = F.broadcast(table.select("template", "license", "size", "n", "s", "step", "width", F.size("shingles").alias("of"), F.explode("shingles").alias("h")))
    hits = materialize(places.select("id", "k", "p.n", "p.h", "p.at").join(index, ["n", "h"]), "license-hits")
    found = _retrieved(held, hits, table, sizes)
    same = F.col("a.id").eqNullSafe(F.col("f.id")) & (F.col("a.k") == F.col("f.k")) & (F.col("a.template") == F.col("f.template"))
    hits = hits.alias("a").join(found.alias("f"), same, "left_semi")
    lists = hits.groupBy("id", "k", "license", "template").agg(F.first("of").alias("of"), F.first("size").alias("m"), (F.first("size") - F.first("n")).alias("r"), F.sort_array(F.collect_set(F.struct("at", "h"))).alias("l"))
    lists = lists.where(F.size(F.array_distinct("l.h")) / F.col("of") >= containment - 1e-9)
    # The first of the best windows starts the text or has a hit as its last shingle. A window has r + 1 shingles, so its hits are near in l.
    inside = "filter(slice(l, greatest(j - r, 0) + 1, r + 1), y -> y.at between greatest(x.at - r, 0) and greatest(x.at - r, 0) + r)"
    best = lists.withColumn("b", F.expr(f"array_max(transform(l, (x, j) -> struct(size(array_distinct(transform({inside}, y -> y.h))) / of as containment, - greatest(x.at - r, 0) as s)))"))
    best = best.where(F.col("b.containment") >= containment - 1e-9)
    return best.select(F.col("id").alias(id_col), "license", "template", F.col("b.containment").alias("containment"), (-F.col("b.s")).alias("start_word"), F.col("m").alias("n_words"))
