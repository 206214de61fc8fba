from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from millrace.llm import licenses


def grams(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return list(zip(w, w[1:], strict=False))


def slow_best(text, template, least):
    """The highest coefficient of any passage of a text, by trying all."""
    g, t, best = grams(text), Counter(grams(template)), 0.0
    for i in range(len(g)):
        for j in range(i, len(g)):
            part = Counter(g[i : j + 1])
            best = max(best, 2 * sum((part & t).values()) / (j - i + 1 + sum(t.values())))
    return best if best >= least else None


@pytest.mark.parametrize("seed", range(10))
def test_against_all_passages(seed):
    rng = random.Random(seed)
    template = "Licensed under the Apache License, Version 2.0 of the large license and of the small license"
    found = template.split()
    for _ in range(rng.randrange(4)):
        found[rng.randrange(len(found))] = rng.choice(["the", "of", "word"])
    text = " ".join([*(rng.choice(["of", "the", "license", "x"]) for _ in range(12)), *found, *(rng.choice(["and", "of", "y"]) for _ in range(9))])
    got = licenses.matches(pa.array([text]), licenses.Templates((("A", template),)))
    expected = slow_best(text, template, licenses.LEAST_DICE)
    assert (max((m[2] for m in got), default=None) or 0) == pytest.approx(expected or 0)


def test_notices(spark, odd_documents, no_documents):
    text = "Some prose.\nLICENSED*** under the Apache### License, Version 2.0!! More prose. Released under the MIT License."
    docs = spark.createDataFrame([(1, text), (1, text), (2, "This work is licensed under the GNU General Public License, version 3."), (3, None), (4, "no license at all")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.license, r.dice, r.first_word, r.n_words) for r in licenses.scan(docs).collect())
    assert rows == [(1, "Apache-2.0", 1.0, 2, 8), (1, "Apache-2.0", 1.0, 2, 8), (1, "MIT", 1.0, 12, 5), (1, "MIT", 1.0, 12, 5), (2, "GPL-3.0", 1.0, 0, 12)]
    assert licenses.scan(odd_documents).count() == 0 and licenses.scan(no_documents).count() == 0


def test_documents(documents):
    got = {r.doc_id for r in licenses.scan(documents).collect()}
    assert got == {r.doc_id for r in documents.collect() if re.search("licen[sc]e", r.text, re.IGNORECASE)}


def test_larger_licence_wins_and_templates_are_given(spark):
    three = dict(licenses.TEMPLATES)["BSD-3-Clause"].replace("Redistributions", "* Redistributions").replace("Neither", "3. Neither")
    docs = spark.createDataFrame([(1, f"x {three} y"), (2, dict(licenses.TEMPLATES)["BSD-2-Clause"]), (3, "Use it as you like, for all that I care.")], "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in licenses.scan(docs).collect()) == [(1, "BSD-3-Clause"), (2, "BSD-2-Clause")]
    assert [(r.doc_id, r.license) for r in licenses.scan(docs, templates=[("Own", "use it as you like for all I care")]).collect()] == [(3, "Own")]
