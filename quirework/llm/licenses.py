"""Operator 1: license scans by MinHash bands over overlapping windows, in DataFrame functions only.

Words are runs of letters and digits in lower case; shingles are five words. A template with m shingles is
looked for in windows of 1.5 c shingles that begin every c / 2, where c is 8, 16, 32 ... and not less than m, so
some window holds every passage of m shingles whole. A window's MinHash sketch is the ``BANDS`` least of its distinct
shingle hashes, each a band of one row; a template is retrieved where one band of a window is among the
template's own sketch. A passage with 0.8 of a template's shingles has a Jaccard similarity to its window of 0.25 or
more, so one of 24 bands collides with a probability above 0.998; windows of up to 24 shingles keep all
of them and miss nothing. Bands are looked up in a map from (class, band) to templates, which is one literal however many templates there are.
Retrieved templates are verified by the share of their shingles, as strings, in one window: ``CONTAINED`` or more.
Where passages of several templates overlap, the one with most shingles there is reported, so a notice is told
from its other versions and from the line that it begins with.

Defined results: a null text counts as empty and matches nothing; texts or templates under five words match
nothing; rows that repeat are each reported; an empty table gives an empty table. Of equally good windows the
first is reported. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import let

SHINGLE = 5
CONTAINED = 0.8
BANDS = 24
SMALLEST = 8
#: ASCII characters that part words; all others belong to them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices by which public licenses are declared, as their publishers word them.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Zlib-text": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
        "to whom the Software is furnished to do so, all subject to the following:"
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "CC0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    ),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "EPL-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _each_shingle(words: Column, make) -> Column:
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.when(F.size(words) >= SHINGLE, F.transform(places, make)).otherwise(F.array())


def hashes_of(words: Column) -> Column:
    return _each_shingle(words, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])).cast("array<bigint>")


def strings_of(words: Column) -> Column:
    return _each_shingle(words, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(SHINGLE)])).cast("array<string>")


def _starts(size: Column, c: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(c // 2))


def sketch(hashes: Column, c: int) -> Column:
    """The bands of all windows for templates of up to c shingles."""
    if 3 * c // 2 <= BANDS:  # such a window is its own sketch, and the windows together are the text
        return hashes
    least = lambda s: F.slice(F.sort_array(F.array_distinct(F.slice(hashes, s, 3 * c // 2))), 1, BANDS)
    return F.flatten(F.transform(_starts(F.size(hashes), c), least))


def _class_of(shingles: int) -> int:
    c = SMALLEST
    while c < shingles:
        c *= 2
    return c


def template_rows(spark: SparkSession, templates: dict[str, str]) -> list:
    """Each template's distinct shingles, their hashes and its class; one row per template, for the driver."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    words = words_of(F.col("text"))
    rows = rows.select(
        "license",
        F.array_distinct(let(words, hashes_of)).alias("hashes"),
        F.array_distinct(let(words, strings_of)).alias("shingles"),
    )
    return [(r["license"], _class_of(len(r["hashes"])), sorted(r["hashes"]), r["shingles"]) for r in rows.collect() if r["hashes"]]


def literal(value, type_: str) -> Column:
    """A constant of any size as one expression."""
    return F.from_json(F.lit(json.dumps(value)), type_)


RESULT = "doc_id long, license string, containment double, first_word long, last_word long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document and license found in it: doc_id, license, containment, first_word, last_word.

    containment is that of the best window; the words are those of its matching shingles, counted from 0.
    """
    known = template_rows(docs.sparkSession, TEMPLATES if templates is None else templates)
    if not known:
        return docs.sparkSession.createDataFrame([], RESULT)
    classes = sorted({c for _, c, _, _ in known})
    named: dict[str, list[str]] = {}
    for name, c, hashes, _ in known:
        for band in hashes if 3 * c // 2 <= BANDS else hashes[:BANDS]:
            named.setdefault(f"{c}:{band}", []).append(name)
    bands = {c: sorted(int(key.split(":")[1]) for key in named if key.startswith(f"{c}:")) for c in classes}
    by_band = literal(named, "map<string,array<string>>")
    wanted = literal({name: shingles for name, _, _, shingles in known}, "map<string,array<string>>")
    width = literal({name: c for name, c, _, _ in known}, "map<string,int>")

    def retrieved(hashes: Column) -> Column:
        """Keys of the bands that the text and some template have."""
        def of(c: int) -> Column:
            found = F.array_intersect(sketch(hashes, c), literal(bands[c], "array<bigint>"))
            return F.transform(found, lambda b: F.concat(F.lit(f"{c}:"), b.cast("string")))

        return F.concat(*map(of, classes))

    def verified(s: Column, name: Column, t: Column, c: Column) -> Column:
        """The best window's share of the template, its first and its last matching word."""
        span = (c * 3 / 2).cast("int")
        starts = F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)), (c / 2).cast("int"))
        share = lambda i: F.size(F.array_intersect(F.slice(s, i, span), t)) / F.size(t)
        best = F.array_max(F.transform(starts, lambda i: F.struct(share(i).alias("share"), (-i).alias("minus"))))

        def placed(b: Column) -> Column:
            hit = F.transform(F.slice(s, -b["minus"], span), lambda x, i: F.when(F.array_contains(t, x), i - b["minus"] - 1))
            return let(
                F.array_compact(hit),
                lambda h: F.struct(
                    name.alias("license"),
                    b["share"].alias("containment"),
                    F.array_min(h).cast("long").alias("first_word"),
                    (F.array_max(h) + SHINGLE - 1).cast("long").alias("last_word"),
                    (b["share"] * F.size(t)).alias("shingles"),
                ),
            )

        return let(best, placed)

    def each(s: Column, names: Column) -> Column:
        told = F.transform(names, lambda n: let(F.element_at(wanted, n), lambda t: let(F.element_at(width, n), lambda c: verified(s, n, t, c))))
        return F.filter(told, lambda x: x["containment"] >= CONTAINED)

    def unrivalled(all_: Column) -> Column:
        def beats(y: Column, x: Column) -> Column:
            meet = (y["first_word"] <= x["last_word"]) & (x["first_word"] <= y["last_word"])
            rank = lambda v, name: F.struct(-v["shingles"], -v["containment"], name)
            return meet & (rank(y, y["license"]) < rank(x, x["license"]))

        return F.filter(all_, lambda x: ~F.exists(all_, lambda y: beats(y, x)))

    words = words_of(docs["text"])
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"], let(words, lambda w: let(hashes_of(w), retrieved)).alias("_bands")
    ).where(F.size("_bands") > 0)
    names = F.array_distinct(F.flatten(F.transform("_bands", lambda b: F.element_at(by_band, b))))
    found = let(let(words_of(F.col("text")), strings_of), lambda s: let(names, lambda n: each(s, n)))
    rows = rows.select("doc_id", F.explode(let(found, unrivalled)).alias("_found"))
    return rows.select("doc_id", *[f"_found.{c}" for c in ("license", "containment", "first_word", "last_word")])
