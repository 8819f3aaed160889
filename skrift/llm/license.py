"""License scans by patience alignment.

A window of a text is aligned with a template: common ends are stripped, words
that are unique in both are matched, a longest increasing subsequence of them
are the anchors, and the gaps between anchors are aligned in the same way, so
that words need only be unique within their gap. Coverage is the share of the
template's words that are aligned.

Windows are twice as long as the template, so up to as many words as it has may
be inserted, and start at every word that the template has. A window is skipped
only if it cannot reach `least`: if it holds too few of the template's words,
repeats counted. A find needs `least` coverage and more aligned words than
inserted and missing ones together. In a short template (under SHORT words) the
words that tell licenses apart (MARKS and numbers) must all be aligned, and none
may be inserted. Finds that overlap, of whatever templates, are the same place:
the one with the most aligned words less inserted and missing ones stays.

Words are lower-cased runs of letters, digits and underscores.

Defined results: null and empty texts have no finds; a null id is kept; repeated
rows give repeated finds; ties go to more aligned words, then to the earlier
window, then to the template's name. Other columns are not read; an empty table
gives no rows.
"""

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"\w+")
LEAST, SHORT = 0.8, 20

#: Fixed texts: public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Fixed list: words too common to point at a license.
COMMON = frozenset("a above all an and any are as at by can either file for free in is it may met no not of on or public that the this to under use used with without work you".split())

#: Fixed list: words that tell one license from another.
MARKS = frozenset("affero agpl apache bsd by cc gnu gpl isc lesser lgpl library mit mpl nc nd public sa unlicense zero".split())


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience piles."""
    tops, piles, before = [], [], [-1] * len(values)
    for at, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            piles.append(at)
        else:
            tops[pile], piles[pile] = v, at
        before[at] = piles[pile - 1] if pile else -1
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def aligned(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """(place in text, place in template) of the aligned words, increasing in both."""
    out, work = [], [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(template[c:d], c) if right[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(text[a:b], a) if left[w] == 1 and w in where]
        pairs = [pairs[i] for i in increasing([j for _, j in pairs])]
        ends = [(a - 1, c - 1), *pairs, (b, d)]
        out += pairs
        if pairs:
            work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, [w.lower() for w in WORDS.findall(text)]
        self.need = Counter(self.words)
        self.telling = {w for w in self.words if w not in COMMON} or set(self.words)
        self.short = len(self.words) < SHORT
        self.marks = [i for i, w in enumerate(self.words) if _mark(w)] if self.short else []

    def found(self, words: list[str], start: int, least: float):
        """(score, aligned, start, end) of the window from start, if it is a find; offsets in words."""
        n = len(self.words)
        part = words[start : start + 2 * n]
        pairs = aligned(part, self.words)
        if len(pairs) < least * n:
            return None
        first, last = pairs[0][0], pairs[-1][0]
        inserted, missing = last - first + 1 - len(pairs), n - len(pairs)
        score = len(pairs) - inserted - missing
        if score <= 0:
            return None
        if self.short:
            own = {j for _, j in pairs}
            there = {i for i, _ in pairs}
            if any(j not in own for j in self.marks) or any(_mark(part[i]) for i in range(first, last + 1) if i not in there):
                return None
        return score, len(pairs), start + first, start + last + 1


def _mark(word: str) -> bool:
    return word in MARKS or word.isdigit()


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST):
        self.least = least
        self.templates = [t for name, text in templates.items() if (t := Template(name, text)).words]
        self.vocabulary = {w for t in self.templates for w in t.telling}

    def _windows(self, words: list[str], t: Template):
        """Starts of windows that hold enough of the template's words, by a count that slides over their places."""
        n, need = len(t.words), t.need
        places = [i for i, w in enumerate(words) if w in need]
        held, common, end = Counter(), 0, 0
        for start in places:
            while end < len(places) and places[end] < start + 2 * n:
                w = words[places[end]]
                common += held[w] < need[w]
                held[w] += 1
                end += 1
            if common >= self.least * n:
                yield start
            w = words[start]
            held[w] -= 1
            common -= held[w] < need[w]

    def finds(self, text: str):
        """(template, coverage, start, end) with offsets in code points, in the order of the text."""
        # by word, as lower() may change a text's length and its words
        words = [w.lower() for w in WORDS.findall(text)]
        there = self.vocabulary.intersection(words)
        good = []
        for t in self.templates if there else ():
            n = len(t.words)
            if sum(w not in there for w in t.telling) <= (1 - self.least) * n:
                found = {f for start in self._windows(words, t) if (f := t.found(words, start, self.least))}
                good += [(-score, -n_aligned, a, t.name, b, n_aligned / n) for score, n_aligned, a, b in found]
        taken = []
        for _, _, a, name, b, coverage in sorted(good):
            if all(b <= x or y <= a for x, y, _, _ in taken):
                taken.append((a, b, name, coverage))
        if taken:
            offsets = [m.span() for m in WORDS.finditer(text)]
            for a, b, name, coverage in sorted(taken):
                yield name, coverage, offsets[a][0], offsets[b - 1][1]


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, license, coverage, start, end): a row for each find."""

    def run(batches):
        scanner = Scanner(templates, least)
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for f in scanner.finds(t.as_py() or "")]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["id", "license", "coverage", "start", "end"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, license string, coverage double, start long, end long").withColumnRenamed("id", id_col)
