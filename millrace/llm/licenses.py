"""Licence scans: Dice coefficient of word bigrams against licence templates (operator 1).

Texts are lower-cased words without punctuation. A passage of a text matches a template if 2 * shared / (bigrams of
both) is at least ``LEAST_DICE``, shared bigrams counted with repeats. That bounds a passage's size from both sides by
the template's, and the shared bigrams from below: templates whose bigrams are too few within the largest allowed
passage are pruned before any coefficient is computed. Passages begin and end with a shared bigram. Of passages that
overlap, of one template the one with the highest coefficient stays, then of several templates the one with the most
shared bigrams, so that a licence isn't taken for one that it contains (ties: the higher coefficient, the longer passage,
the earlier one, then by name).

``TEMPLATES`` are the notices and the short licences that are named there; the bodies of long licences (GPL, LGPL, AGPL,
MPL, EPL, Apache) are not among them. ``scan`` takes other templates, whatever their length.

A null text is an empty text and matches nothing; a text of any length is scanned whole; repeated rows are answered
once each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_slices, gram_hashes, lowered, text_buffer, whole_grams, word_hashes

LEAST_DICE = 0.8

#: Public licence notices, as they are put into works, and short licences in full.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not "
        "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. This notice may not be removed or altered from any source distribution.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


@dataclass(frozen=True)
class Template:
    name: str
    counts: dict[int, int]
    size: int
    least_shared: int
    longest: int


class Templates:
    """Templates by their bigrams, with the bounds that a coefficient sets."""

    def __init__(self, texts: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_DICE) -> None:
        self.least, self.all = least, []
        for name, text in texts:
            data, offsets = text_buffer(lowered(pa.array([text], pa.large_string())))
            grams = gram_hashes(word_hashes(data, offsets)[0], 2).tolist()
            n = len(grams)
            if n:
                # 2s / (a + n) >= least with a >= s bounds s from below, with s <= n bounds a from above
                self.all.append(Template(name, dict(Counter(grams)), n, int(np.ceil(least * n / (2 - least) - 1e-9)), int((2 - least) / least * n + 1e-9)))
        self.grams = np.array(sorted({g for t in self.all for g in t.counts}), np.uint64)
        self.member = np.array([[g in t.counts for g in self.grams.tolist()] for t in self.all], bool).reshape(len(self.all), len(self.grams))


def best_passages(grams: list[int], template: Template, places: np.ndarray, least: float) -> list[tuple[float, int, int]]:
    """(coefficient, first bigram, bigrams) of the best passage from each place where one can begin.

    grams: a text's bigrams; places: those that the template has, in order."""
    s, out = template.least_shared, []
    if len(places) < s:
        return out
    starts = np.flatnonzero(places[s - 1 :] - places[: len(places) - s + 1] < template.longest)
    positions = places.tolist()
    for i in starts.tolist():
        left, shared, best = dict(template.counts), 0, None
        for j in range(i, len(positions)):
            size = positions[j] - positions[i] + 1
            if size > template.longest:
                break
            g = grams[positions[j]]
            if left[g] > 0:
                left[g] -= 1
                shared += 1
                dice = 2 * shared / (size + template.size)
                if dice >= least and (best is None or dice > best[0]):
                    best = (dice, positions[i], size)
        if best is not None:
            out.append(best)
    return out


def matches(column: pa.Array, templates: Templates) -> list[tuple[int, str, float, int, int]]:
    """(row, licence, coefficient, first word, words) of the licence passages in a column of texts."""
    data, offsets = text_buffer(lowered(column))
    words, _, _, first = word_hashes(data, offsets)
    grams = gram_hashes(words, 2)
    if not len(grams):
        return []
    at = np.minimum(np.searchsorted(templates.grams, grams), len(templates.grams) - 1)
    hit = np.flatnonzero((templates.grams[at] == grams) & whole_grams(first, 2, len(words)))
    row, gram = np.searchsorted(first, hit, "right") - 1, at[hit]
    found: dict[int, list] = {}
    for number, t in enumerate(templates.all):
        mine = np.flatnonzero(templates.member[number][gram])
        s = t.least_shared
        if len(mine) < s:
            continue
        # prune by size: so many shared bigrams must be in one text, within the largest passage
        a, b = mine[: len(mine) - s + 1], mine[s - 1 :]
        for r in np.unique(row[a][(row[a] == row[b]) & (hit[b] - hit[a] < t.longest)]).tolist():
            base, end = int(first[r]), int(first[r + 1])
            places = hit[mine[row[mine] == r]] - base
            own = [(-dice, -size, start, t.name) for dice, start, size in best_passages(grams[base : end - 1].tolist(), t, places, templates.least)]
            for dice, size, start, name in _apart(own, lambda p: (p[2], p[2] - p[1])):
                shared = round(-dice * (t.size - size) / 2)
                found.setdefault(r, []).append((-shared, dice, size, start, name))
    out = []
    for r in sorted(found):
        out += [(r, name, -dice, start, 1 - size) for _, dice, size, start, name in _apart(found[r], lambda p: (p[3], p[3] - p[2]))]
    return out


def _apart(passages: list, span) -> list:
    """The passages in order, without those that overlap an earlier one. span: first bigram, and one past the last."""
    kept, taken = [], []
    for p in sorted(passages):
        a, b = span(p)
        if all(b < x or a > y for x, y in taken):
            taken.append((a, b))
            kept.append(p)
    return kept


_OUT = "doc_id long, license string, dice double, first_word long, n_words long"


def scan(docs: DataFrame, least: float = LEAST_DICE, templates: Iterable[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, first_word, n_words) of every licence passage in ``docs`` (doc_id, text).

    templates: (name, text); a name may have several texts. They are broadcast: some hundred bytes for each word."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(tuple(templates), least))

    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, "text"):
                found = matches(part.column(1), shared.value)
                r, name, dice, start, size = (list(x) for x in zip(*found, strict=True)) if found else ([],) * 5
                yield pa.record_batch([part.column(0).take(pa.array(r, pa.int64())), pa.array(name, pa.string()), pa.array(dice, pa.float64()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], names=[c.split()[0] for c in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)
