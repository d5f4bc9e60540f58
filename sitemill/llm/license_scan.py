"""Licence notices in texts, by patience alignment with templates.

A template is a sequence of words. If a text holds a share ``least`` of a template's words in
order, it holds one of any floor((1 - least) * n) + 1 of them; the scan looks for that many of the
template's longest words and aligns the template with the stretch around each place where one
occurs. Alignment, from that match on: equal words next to a match match; then words that occur
once in the gap and once in the template's gap are anchors, the longest increasing subsequence of
them matches, and the gaps between them are aligned alike. Coverage is the share of the template's words that match;
besides, the words that name the licence and its version must match all, each phrase of them without
words between. A version 2.0 is a version 2. Of findings that overlap, the one with the larger coverage (then more words, then the closer, then
the first) stays.

Whole texts are scanned, whatever their length, each within its task; nothing is shuffled.
Defined results: a null or empty text has no findings and no row; repeated rows have their
findings each; a null doc_id is kept; an empty table gives an empty result.
"""
from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm.slices import prepare_workers

WORD = re.compile(r"[a-z0-9]+(?:[.\-'][a-z0-9]+)*")
NUMBER = re.compile(r"(\d+)\.0")
LEAST = 0.8

_GNU = "GNU {}General Public License"
_GNU_HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by "
               "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")

# The wording of public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                         "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                         "See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
                "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
                "this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later header": _GNU_HEADER.format("", "3"),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-or-later header": _GNU_HEADER.format("", "2"),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-or-later header": _GNU_HEADER.format("Lesser ", "2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-or-later header": _GNU_HEADER.format("Lesser ", "3"),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-or-later header": _GNU_HEADER.format("Affero ", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Released under the ISC License.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                "provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Released under the BSD License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                      "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
}

#: The phrases that tell which licence it is; texts of a licence that don't name it have none.
IDENTITY = {
    "Apache-2.0": ("Apache License", "2.0"), "Apache-2.0 header": ("Apache License", "2.0"), "MIT": ("MIT",), "ISC": ("ISC",), "BSD": ("BSD",),
    "MPL-2.0": ("Mozilla Public License", "2.0"),
    **{f"{x}GPL-{v}{end}": (_GNU.format(kind), n, *more) for x, kind, v, n in (("", "", "2.0", "2"), ("", "", "3.0", "3"), ("L", "Lesser ", "2.1", "2.1"), ("L", "Lesser ", "3.0", "3"), ("A", "Affero ", "3.0", "3"))
       for end, more in (("", ()), ("-or-later header", ("any later version",)))},
    **{f"CC-{k}-4.0": (f"CC {k} 4.0",) for k in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
}


def words_of(text: str) -> list[str]:
    """The words of a lower-cased text; a version 2.0 is a 2."""
    return [NUMBER.fullmatch(w)[1] if w.endswith(".0") and NUMBER.fullmatch(w) else w for w in WORD.findall(text)]


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        p = bisect.bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[p], piles[p] = v, k
        before[k] = piles[p - 1] if p else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(text: list[str], template: list[str], at: tuple[int, int]) -> list[tuple[int, int]]:
    """Matching (position in the text, position in the template), both ascending, around the match ``at``.

    A gap is aligned from the sides where a match bounds it: the outer ends of the text are open.
    """
    found = [at]
    todo = [(0, at[0], 0, at[1], False, True), (at[0] + 1, len(text), at[1] + 1, len(template), True, False)]
    while todo:
        a, b, c, d, left, right = todo.pop()
        while left and a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while right and a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if in_template[w] == 1}
        once = [(k, place[w]) for k, w in enumerate(text[a:b], a) if in_text[w] == 1 and w in place]
        anchors = [once[k] for k in increasing([y for _, y in once])]
        if anchors:
            found += anchors
            for k, ((x, y), (x2, y2)) in enumerate(zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)])):
                todo.append((x + 1, x2, y + 1, y2, left or k > 0, right or k < len(anchors)))
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST):
        self.least = least
        self.words = {name: words_of(t.lower()) for name, t in templates.items()}
        #: For each template the places (first, behind the last) of its identifying phrases.
        self.identity: dict[str, list[tuple[int, int]]] = {}
        for name, words in self.words.items():
            phrases = [words_of(x.lower()) for x in IDENTITY.get(name, ())]
            places = [(next((k for k in range(len(words)) if words[k:k + len(x)] == x), -1), len(x)) for x in phrases]
            self.identity[name] = [(k, k + n) for k, n in places if k >= 0]
        self.keys: dict[str, list[tuple[str, int]]] = {}
        for name, words in self.words.items():
            need = math.floor((1 - least) * len(words) + 1e-9) + 1
            # the longest words; all occurrences of a word count, as any of them may be the one that matches
            order = sorted(range(len(words)), key=lambda k: (-len(words[k]), k))[:need]
            for w in {words[k] for k in order}:
                for k in [k for k, x in enumerate(words) if x == w]:
                    self.keys.setdefault(w, []).append((name, k))
        self.any = re.compile("|".join(sorted(map(re.escape, self.keys), key=len, reverse=True)) or r"(?!)")

    def identified(self, name: str, pairs: list[tuple[int, int]]) -> bool:
        """Whether each identifying phrase matches whole and without words between."""
        place = {y: x for x, y in pairs}
        return all(c in place and all(place.get(k) == place[c] + k - c for k in range(c, d)) for c, d in self.identity[name])

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) of each notice, in text order; positions in code points."""
        lower = text.lower()
        if not self.any.search(lower) or len(lower) != len(text) and not self.any.search(lower := "".join(c.lower() if len(c.lower()) == 1 else c for c in text)):
            return []
        if len(lower) != len(text):
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spans = [m.span() for m in WORD.finditer(lower)]
        words = words_of(lower)
        covered, found = set(), []
        for p, w in enumerate(words):
            for name, k in self.keys.get(w, ()):
                template = self.words[name]
                slack = len(template) // 4 + 2
                lo, hi = max(0, p - k - slack), min(len(words), p + len(template) - k + slack)
                if (name, p, k) in covered:
                    continue  # it was matched in an alignment around another place
                pairs = align(words[lo:hi], template, (p - lo, k))
                if len(pairs) >= self.least * len(template) and self.identified(name, pairs):
                    covered.update((name, lo + x, y) for x, y in pairs)
                    a, b = lo + pairs[0][0], lo + pairs[-1][0] + 1
                    found.append((-len(pairs) / len(template), -len(pairs), b - a, a, b, name))
        kept: list[tuple[int, int, str, float]] = []
        for coverage, _, _, a, b, name in sorted(found):
            if all(b <= x or y <= a for x, y, *_ in kept):
                kept.append((a, b, name, -coverage))
        return [(name, coverage, spans[a][0], spans[b - 1][1]) for a, b, name, coverage in sorted(kept)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row per notice: doc_id, license, coverage, start, end (code points from 0, end exclusive)."""
    prepare_workers(docs)
    scanner = Scanner(templates or TEMPLATES, least)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *f) for d, t in zip(b["doc_id"].tolist(), b["text"].tolist()) if t for f in scanner.scan(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "start", "end"]).astype({"doc_id": object, "license": object, "coverage": float, "start": "int64", "end": "int64"})

    # ids pass through Python as text: pandas would make a nullable long a double
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, "doc_id string, license string, coverage double, start long, end long").withColumn("doc_id", F.col("doc_id").cast("long"))
