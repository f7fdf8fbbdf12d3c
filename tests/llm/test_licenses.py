import re

import pytest

from featshare.llm import licenses as L
from featshare.llm.common import table


def brute(text, threshold=L.THRESHOLD):
    """Every window of every template, compared as sets of word pairs."""
    words = re.findall("[0-9a-z]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    pairs, vocab = list(zip(words, words[1:])), {w for _, t in L.TEMPLATES for w in re.findall("[0-9a-z]+", t.lower())}
    pairs = [p if set(p) <= vocab else (i, p) for i, p in enumerate(pairs)]
    found = []
    for t, (_, text_) in enumerate(L.TEMPLATES):
        tw = re.findall("[0-9a-z]+", text_.lower())
        own = set(zip(tw, tw[1:]))
        n = len(tw) - 1
        for a in range(max(1, len(pairs) - n + 1)):
            win = set(pairs[a:a + n])
            d = 2 * len(win & own) / (len(win) + len(own))
            if d >= threshold - 1e-12 and pairs[a:a + n]:
                found.append((t, a, len(pairs[a:a + n]) + 1, d, n))
    kept = []
    for m in sorted(found, key=lambda m: (-m[3], -m[4], m[0], m[1])):
        if all(m[1] + m[2] <= k[1] or k[1] + k[2] <= m[1] for k in kept):
            kept.append(m)
    return sorted((m[:4] for m in kept), key=lambda m: (m[1], m[0]))


TEXTS = ["", None, "Released", "Released under the MIT License.", "released, UNDER (the) mit license",
         "x y z Licensed under the Apache License, Version 2.0. q r", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.",
         "Licensed under CC-BY-SA 4.0 licensed under cc by nc 4 0 licensed under cc by 4.0",
         " ".join(t for _, t in L.TEMPLATES), L.TEMPLATES[3][1].replace("hereby", "now").replace("merge, ", ""),
         "This work is licensed under the GNU General Public License, version 3. " * 3, "the the the the", "É MIT é"]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_against_every_window(i):
    got = L.Templates(L.TEMPLATES, L.THRESHOLD).scan([(t or "").encode() for t in TEXTS])[i]
    want = brute(TEXTS[i])
    # windows that begin between shared bigrams tie with the next that begins at one
    assert [(m[0], round(m[3], 9)) for m in got] == [(m[0], round(m[3], 9)) for m in want]


def test_documents(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in L.scan_licenses(docs).collect():
        want = {n for n, t in L.TEMPLATES if t in (text[r.doc_id] or "")}
        got = {m.license for m in r.matches if m.dice == 1}
        assert want <= got | {"MIT"} and (not r.matches) == (not brute(text[r.doc_id]))


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, TEXTS[3], 0), (None, TEXTS[3], 0), (1, TEXTS[3], 0)],
                                 "doc_id long, text string, matches int")
    rows = L.scan_licenses(docs).collect()
    assert sorted((r.doc_id or 0, len(r.matches)) for r in rows) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert L.scan_licenses(docs.limit(0)).count() == 0


GNU_HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License "
              "as published by the Free Software Foundation, either version {1} of the License, or (at your option) any "
              "later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
              "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} "
              "License for more details.")
LOOK_ALIKE = [
    ("GPL-3.0", GNU_HEADER.format("General Public", 3)), ("GPL-2.0", GNU_HEADER.format("General Public", 2)),
    ("LGPL-3.0", GNU_HEADER.format("Lesser General Public", 3)), ("AGPL-3.0", GNU_HEADER.format("Affero General Public", 3)),
    ("LGPL-2.1", GNU_HEADER.format("Lesser General Public", "2.1").replace("program", "library")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.0", "This work is licensed under the GNU Lesser General Public License, version 2."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]


@pytest.fixture(scope="module")
def every_template():
    return L.Templates(L.catalogue(), L.THRESHOLD)


@pytest.mark.parametrize("i", range(len(LOOK_ALIKE)))
def test_look_alike_notices(every_template, i):
    name, text = LOOK_ALIKE[i]
    (found,) = every_template.scan([f"Some words before it. {text} And others follow here.".encode()])
    assert {every_template.names[m[0]] for m in found} == {name}


def test_whole_texts(every_template):
    """Every whole text, some of its words changed, is its own licence and no other."""
    texts = {t: text for t, (_, text) in enumerate(L.catalogue()) if len(text.split()) > 60 and "\n" in text}
    for t, text in texts.items():
        words = text.split()
        words[::40] = ["changed"] * len(words[::40])
        (found,) = every_template.scan([f"Copyright 2024 X. {' '.join(words)} int main".encode()])
        assert [every_template.names[m[0]] for m in found] == [every_template.names[t]]
    assert {"AGPL-3.0", "LGPL-2.1", "BSD-2-Clause", "BSD-3-Clause", "MIT", "MIT-0"} <= {L.catalogue()[t][0] for t in texts}


def test_registered_scan_has_look_alikes(spark):
    docs = spark.createDataFrame([(str(i), t) for i, (_, t) in enumerate(LOOK_ALIKE)], "doc_id string, text string")
    got = {r.doc_id: {m.license for m in r.matches} for r in L.scan_licenses(docs).collect()}
    assert got == {str(i): {n} for i, (n, _) in enumerate(LOOK_ALIKE)}
