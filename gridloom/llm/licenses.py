"""License scans: sentences and windows of a text against notices and whole license texts, by the Dice coefficient of
their word bigrams.

Only Spark SQL expressions. Letters and digits in lower case, with single spaces between, are a text's words. Its
sentences are compared with the notices; and windows of as many words as a notice or license text has, at every word and
across line and sentence ends, with that. With threshold t, 2 * common / (a + b) >= t needs t / (2 - t) * b <= a <=
(2 - t) / t * b bigrams, of which t / (2 - t) * b are common. A text is read at all if it holds one of the words without
which no template can reach the threshold (``anchors``, ``own_anchors``), which loses nothing.
"""

from __future__ import annotations

import json
import math
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Whole license texts and their published headers: files named by the identifier and, for headers, a suffix.
TEXTS = [(re.sub(r"\.(header|disclaimer)\d?$", "", f.stem), f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


#: Where a window reaches the threshold with a whole text, the bigrams by which it is told from relatives of that
#: text, most of which have no text here. The first line whose bigrams all stand in the window names it.
RELATIVES = {
    "Apache-2.0": [("ECL-2.0", ["educational community"]), ("Apache-2.0", [])],
    "BSD-3-Clause": [("BSD-4-Clause", ["all advertising"]), ("BSD-3-Clause", [])],
    "CC-BY-SA-4.0": [
        ("CC-BY-NC-SA-4.0", ["noncommercial sharealike"]), ("CC-BY-NC-ND-4.0", ["noncommercial noderivatives"]), ("CC-BY-NC-4.0", ["attribution noncommercial"]),
        ("CC-BY-ND-4.0", ["attribution noderivatives"]), ("CC-BY-SA-4.0", ["by sa", "sharealike in"]), ("CC-BY-4.0", []),
    ],
    "EPL-1.0": [("EPL-2.0", ["secondary licenses"]), ("CPL-1.0", ["common public"]), ("EPL-1.0", [])],
    "GFDL-1.2": [("GFDL-1.1", ["march 2000"]), ("GFDL-1.2", [])],
    "GPL-2.0": [("AGPL-1.0", ["affero general"]), ("GPL-2.0", [])],
    "GPL-3.0": [("AGPL-3.0", ["remote network"]), ("GPL-3.0", [])],
}


def normalised(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words such that a sentence within the threshold of a template holds one of them.

    At least t / (2 - t) of a template's bigrams must be found, so any set of more than the other bigrams has one of
    them. Taken are the bigrams whose rarer word (over the templates, then the longer) makes the fewest anchors.
    """
    found: set[str] = set()
    for _, text in sorted(templates, key=lambda t: len(t[1])):
        pairs = sorted(bigrams(normalised(text)))
        spare = len(pairs) - math.ceil(threshold / (2 - threshold) * len(pairs) - 1e-9)
        have = sum(bool(set(p.split()) & found) for p in pairs)
        for pair in sorted(pairs, key=lambda p: (-max(len(w) for w in p.split()), p)):
            if have > spare:
                break
            if not set(pair.split()) & found:
                found.add(max(pair.split(), key=len))
                have = sum(bool(set(p.split()) & found) for p in pairs)
    return sorted(found)


def own_anchors(pairs: list[str], threshold: float, known: set[str]) -> list[str]:
    """Words such that a window within the threshold of a template of these bigrams holds one of them (see ``anchors``).

    Taken are the words that stand in the most bigrams, longer ones and those of ``known`` before others.
    """
    left = [set(p.split()) for p in pairs]
    needed = len(pairs) - math.ceil(threshold / (2 - threshold) * len(pairs) - 1e-9)
    found: list[str] = []
    while len(pairs) - len(left) <= needed:
        held: dict[str, int] = {}
        for words in left:
            for w in words:
                held[w] = held.get(w, 0) + 1
        best = min(held, key=lambda w: (len(w) < 6, -held[w] * len(w) * (1 + (w in known)), w))
        found.append(best)
        left = [words for words in left if best not in words]
    return found


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prepared(templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    """Of every template: its identifier, words, bigrams, least common bigrams, and anchors."""
    rows, known = [], set()
    for name, words in sorted({(name, tuple(normalised(text))) for name, text in templates}, key=lambda t: (len(t[1]), t)):
        pairs = sorted(bigrams(list(words)))
        if pairs:
            own = own_anchors(pairs, threshold, known)
            known |= set(own)
            names = RELATIVES.get(name, []) if len(words) > 100 else []
            rows.append({"name": name, "names": [{"name": n, "has": h} for n, h in names] or [{"name": name, "has": []}], "words": len(words), "pairs": pairs, "least": math.ceil(threshold / (2 - threshold) * len(pairs) - 1e-9), "anchors": own})
    return rows


def _windows(threshold: float) -> str:
    """SQL of the windows of a text's bigrams ``g`` that reach the threshold with template ``t`` and are better than those
    beside them, as (fewer, less, name, start, stop).

    Looked at are the windows with ``t.least`` bigrams of the template or more: those that begin between the last place
    from which such a run of places ``m`` fits, and its first; each one once.
    """
    last = "greatest(0, size(g) - t.words + 1)"
    fits = f"m[j + t.least - 1] - m[j] <= t.words - 2 AND IF(j = 0, true, m[j - 1] < {last})"
    starts = f"sequence(greatest(0, m[j + t.least - 1] - t.words + 2, IF(j = 0, 0, m[j - 1] + 1)), least(m[j], {last}))"
    starts = f"flatten(transform(filter(sequence(0, size(m) - t.least), j -> {fits}), j -> {starts}))"
    places = "filter(sequence(0, size(g) - 1), i -> array_contains(t.pairs, g[i]))"
    counted = "transform(array(slice(g, i + 1, t.words - 1)), v -> named_struct('a', size(array_distinct(v)), 'c', size(array_intersect(v, t.pairs)), 'start', i))[0]"
    hit = "named_struct('fewer', -x.c, 'less', -2D * x.c / (x.a + size(t.pairs)), 'name', t.name, 'start', x.start, 'stop', least(x.start + t.words, size(g) + 1))"
    hits = f"transform(transform({starts}, i -> {counted}), x -> {hit})"
    best = f"h.less <= {-threshold + 1e-9} AND IF(k = 0, true, h.less < hs[k - 1].less) AND IF(k = size(hs) - 1, true, h.less <= hs[k + 1].less)"
    near = f"transform(array({places}), m -> transform(array({hits}), hs -> filter(hs, (h, k) -> {best}))[0])[0]"
    named = "get(filter(t.names, n -> size(array_intersect(n.has, slice(g, h.start + 1, t.words - 1))) = size(n.has)), 0).name"
    return f"transform({near}, h -> named_struct('fewer', h.fewer, 'less', h.less, 'name', {named}, 'start', h.start, 'stop', h.stop))"


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, texts: list[tuple[str, str]] | None = None
) -> DataFrame:
    """One row per document: (id_col, licenses, n_notices, best_dice).

    ``templates`` are notices, compared with sentences and with windows; ``texts`` are whole texts and headers, compared
    with windows (where only ``templates`` is given, there are none). Each sentence counts for the notice of its largest
    coefficient, ties to the identifier that comes first. Of sentences and windows that overlap, the one with the most
    common bigrams counts, so a license text is not counted again for the notices in it. A text shorter than a window
    is one window. A window near a whole text that has relatives is named by the bigrams that tell them apart (RELATIVES). ``licenses`` are the distinct identifiers found, sorted. ``best_dice`` is null where nothing is found.

    Null and empty texts have no sentences and an empty list. Null ids and repeated rows are rows like any other.
    Other columns are not read. An empty table gives an empty one. Texts are scanned whole.
    """
    texts = (TEXTS if templates is None else []) if texts is None else texts
    templates = TEMPLATES if templates is None else templates
    known = sorted({(name, tuple(sorted(bigrams(normalised(text))))) for name, text in templates})
    known = [(name, pairs) for name, pairs in known if pairs]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = math.ceil(low * min(len(p) for _, p in known) - 1e-9), math.floor(high * max(len(p) for _, p in known) + 1e-9)
    wanted = " OR ".join(f"contains(lower(text), {_sql(w)})" for w in anchors(templates, threshold))
    listed = "array(" + ", ".join(f"named_struct('name', {_sql(n)}, 'pairs', array({', '.join(map(_sql, p))}))" for n, p in known) + ")"
    sentences = r"split(text, '[\n\r]+|(?<=[.!?:;])\s+')".replace(r"[\n\r]", r"[\\n\\r]")
    words = f"transform({sentences}, s -> split(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ')), ' '))"
    grams = "transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))"
    near = f"size(p) BETWEEN {low - 1e-9} * size(t.pairs) AND {high + 1e-9} * size(t.pairs)"
    fewer = "-size(array_intersect(p, t.pairs))"
    dice = f"transform(filter({listed}, t -> {near}), t -> named_struct('less', 2D * ({fewer}) / (size(p) + size(t.pairs)), 'name', t.name, 'fewer', {fewer}))"
    pairs = f"IF(size(w) > {least}, array_distinct({grams}), null)"
    best = f"transform({words}, w -> named_struct('size', IF(w[0] = '', 0, size(w)), 'hit', get(transform(filter(array({pairs}), p -> size(p) BETWEEN {least} AND {most}), p -> array_min({dice})), 0)))"
    found = f"filter(transform(b, (x, k) -> named_struct('x', x, 'k', k)), y -> y.x.hit.less <= {-threshold + 1e-9})"
    start = "aggregate(slice(b, 1, y.k), 0, (n, x) -> n + x.size)"
    hits = f"transform({found}, y -> named_struct('fewer', y.x.hit.fewer, 'less', y.x.hit.less, 'name', y.x.hit.name, 'start', {start}, 'stop', {start} + y.x.size))"

    rows = _prepared([*templates, *texts], threshold)
    kind = "array<struct<name: string, names: array<struct<name: string, has: array<string>>>, words: int, pairs: array<string>, least: int, anchors: array<string>>>"
    every = docs.sparkSession.range(1, numPartitions=1).select(F.from_json(F.lit(json.dumps(rows)), kind).alias("every"))
    marks = sorted({w for r in rows for w in r["anchors"]})
    held = f"array_intersect(array({', '.join(map(_sql, marks))}), w)"
    by_anchor = "filter(every, t -> size(w) > t.least AND arrays_overlap(a, t.anchors))"
    by_pairs = "filter(some, t -> size(array_intersect(g, t.pairs)) >= t.least)"
    close = f"transform(array({held}), a -> IF(size(a) = 0, null, {by_anchor}))[0]"
    close = f"transform(array({close}), some -> IF(coalesce(size(some), 0) < 1, null, transform(array({grams}), g -> flatten(transform({by_pairs}, t -> {_windows(threshold)})))[0]))[0]"
    close = f"transform(array(split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ')), ' ')), w -> {close})[0]"
    none = "cast(array() AS array<struct<fewer: int, less: double, name: string, start: int, stop: int>>)"
    hits = f"CASE WHEN {wanted} THEN transform(array({best}), b -> {hits})[0] END"
    overlaps = "exists(taken, o -> o.start < h.stop AND h.start < o.stop)"
    chosen = f"aggregate(array_sort(concat(coalesce({hits}, {none}), coalesce({close}, {none}))), {none}, (taken, h) -> IF({overlaps}, taken, concat(taken, array(h))))"
    both = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).crossJoin(F.broadcast(every)).select("id", F.expr(chosen).alias("found"))
    return both.select(
        F.col("id").alias(id_col),
        F.expr("array_sort(array_distinct(transform(found, b -> b.name)))").alias("licenses"),
        F.size("found").alias("n_notices"),
        F.expr("-array_min(transform(found, b -> b.less))").alias("best_dice"),
    )
