"""License scan: windows of normalised text against licence templates by the Dice coefficient
over word bigrams, with size bounds that prune templates.

A text is normalised to lower-case words of ASCII letters and digits (other letters part
words, as punctuation does). Templates are notices and whole licence texts. A template of n bigrams is compared with windows of n bigrams,
and with the whole text where that is shorter. The coefficient 2|A n B| / (|A| + |B|) can
reach the threshold t only if the smaller set has t / (2 - t) of the larger: a text with fewer
bigrams than that, or a window that shares too few bigrams of the template, is never compared.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, binary_text, ragged, received, send, text_slices
from .license_catalog import more_templates

THRESHOLD = 0.8
SLICE = 4 << 20

#: (licence, template): short public notices and permission texts; :func:`catalogue` has all templates
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def catalogue() -> list[tuple[str, str]]:
    """``TEMPLATES``, then the notices and whole texts of :mod:`license_catalog`."""
    return list(dict.fromkeys([*TEMPLATES, *more_templates()]))


WORD_TABLE = bytes(c if re.fullmatch(rb"[0-9a-z]", bytes([c])) else 32 for c in ASCII_LOWER)


def normalise(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Templates:
    """Templates as sets of bigram numbers (word * size + next word)."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.names = [n for n, _ in templates]
        words = [normalise(t.encode()) for _, t in templates]
        if any(len(w) < 2 for w in words):
            raise ValueError("a template needs two words at least")
        self.vocabulary = {w: i for i, w in enumerate(sorted(set(chain.from_iterable(words))), 1)}
        self.size = len(self.vocabulary) + 1
        ids = [[self.vocabulary[w] for w in t] for t in words]
        self.bigrams = [{a * self.size + b for a, b in zip(t, t[1:])} for t in ids]
        self.length = [len(t) - 1 for t in ids]
        # the templates of each bigram, one bigram after the other
        owned = np.array(sorted((g, t) for t, own in enumerate(self.bigrams) for g in own), np.int64)
        self.code, self.begin, self.count = np.unique(owned[:, 0], return_index=True, return_counts=True)
        self.owners = owned[:, 1]
        #: least number of bigrams a text or window must share
        self.least = [max(1, int(np.ceil(threshold / (2 - threshold) * len(b) - 1e-9))) for b in self.bigrams]
        # passages of another licence's template that alone cannot match it: they count only
        # where no whole template matches
        joined = [b" %b " % b" ".join(t) for t in words]
        self.fragment = [any(name != other and len(grams) < least and own in text
                             for other, text, least in zip(self.names, joined, self.least))
                         for name, own, grams in zip(self.names, joined, self.bigrams)]

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int, float]]]:
        """Per text: (template, first word, words, coefficient) of its matches. Overlapping
        matches: the larger coefficient, then the longer template, then the earlier one stays,
        and fragments of other licences come last."""
        words = [normalise(t) for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(self.vocabulary.get, chain.from_iterable(words), repeat(0)), np.int64, int(lengths.sum()))
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        if len(ids) < 2:
            return found
        start = np.cumsum(lengths) - lengths
        pair = ids[:-1] * self.size + ids[1:]
        known = (ids[:-1] > 0) & (ids[1:] > 0)
        inner = start[(start > 0) & (start < len(ids))]
        known[inner - 1] = False  # no bigram crosses texts
        place = np.flatnonzero(known)
        value = pair[place]
        owner = np.searchsorted(start, place, side="right") - 1
        while len(start) and (lengths[owner] == 0).any():  # empty texts share their start with the next
            owner = np.where(lengths[owner] == 0, owner - 1, owner)
        index = np.minimum(np.searchsorted(self.code, value), len(self.code) - 1)
        hit = self.code[index] == value
        place, owner, index = place[hit], owner[hit], index[hit]
        count = self.count[index]
        template = self.owners[ragged(self.begin[index], count)]
        order = np.argsort(template, kind="stable")
        at_all = np.repeat(place, count)[order]
        who_all = np.repeat(owner, count)[order]
        met, begin = np.unique(template[order], return_index=True)
        for t, i, j in zip(met.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
            at, who = at_all[i:j], who_all[i:j]
            n, first, last = self.length[t], start[who], start[who] + lengths[who] - 1
            lo = np.clip(np.minimum(at, last - n), first, None)  # windows end inside the text
            until = np.minimum(lo + n, last)
            shared = np.searchsorted(at, until) - np.searchsorted(at, lo)
            some = np.flatnonzero(shared >= self.least[t])
            spans = zip(lo[some].tolist(), until[some].tolist())
            for k, a, b, d in zip(some.tolist(), lo[some].tolist(), until[some].tolist(),
                                  self._coefficients(pair, known, spans, self.bigrams[t])):
                if d >= self.threshold - 1e-12:
                    found[int(who[k])].append((t, a - int(first[k]), b - a + 1, d))
        return [self._resolve(f) for f in found]

    @staticmethod
    def _coefficients(pair, known, spans, own: set):
        """Dice coefficient of each window with a template's bigrams. Windows come in order, so
        one slides to the next; bigrams with unknown words count by their place."""
        count: dict[int, int] = {}
        shared = low = high = 0
        for a, b in spans:
            if a >= high:
                count.clear()
                shared, low, high = 0, a, a
            for i in range(high, b):
                g = int(pair[i]) if known[i] else -i - 1
                had = count.get(g, 0)
                count[g] = had + 1
                shared += not had and g in own
            for i in range(low, a):
                g = int(pair[i]) if known[i] else -i - 1
                if count[g] == 1:
                    del count[g]
                    shared -= g in own
                else:
                    count[g] -= 1
            low, high = a, b
            yield 2 * shared / (len(count) + len(own))

    def _resolve(self, matches):
        kept = []
        for m in sorted(set(matches), key=lambda m: (self.fragment[m[0]], -m[3], -self.length[m[0]], m[0], m[1])):
            if all(m[1] + m[2] <= k[1] or k[1] + k[2] <= m[1] for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: (m[1], m[0]))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  templates: Sequence[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``matches``, an array of (license, template,
    first_word, n_words, dice) over the words of the normalised whole text.

    Bigrams with a word that no template has are distinct from each other. Null and short texts
    have no matches. Repeated rows are scanned each; empty input gives no rows; other columns
    are ignored. The templates (:func:`catalogue` if none are given) are a small fixed list that
    is broadcast.
    """
    sent = send(docs.sparkSession, Templates(catalogue() if templates is None else templates, threshold))

    def run(batches):
        catalog = received(sent)
        for b in batches:
            for lo, texts in text_slices(b.column(1), SLICE):
                found = catalog.scan(texts)
                cut = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = list(chain.from_iterable(found))
                matches = pa.StructArray.from_arrays(
                    [pa.array([catalog.names[m[0]] for m in flat], pa.string()), pa.array([m[0] for m in flat], pa.int32()),
                     pa.array([m[1] for m in flat], pa.int64()), pa.array([m[2] for m in flat], pa.int64()),
                     pa.array([m[3] for m in flat], pa.float64())],
                    names=["license", "template", "first_word", "n_words", "dice"])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)),
                                                  pa.ListArray.from_arrays(pa.array(cut), matches)],
                                                 names=["doc_id", "matches"])

    rows = docs.select(F.col(key).alias("doc_id"), binary_text(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, matches array<struct<license:string,template:int,first_word:long,"
                                "n_words:long,dice:double>>")
