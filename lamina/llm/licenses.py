"""License scans by a trained paragraph classifier.

A multinomial logistic regression on hashed word 1-, 2- and 3-grams tells licence families from an unknown licence
and from ordinary text. It is trained on phrases built from the families' names and texts and on a bounded sample of
the corpus's own lines; its temperature is calibrated on held-out phrases. A prediction counts as confirmed if
the paragraph holds most word pairs of a family's template, or a one-word name such as MIT next to a cue; several
families may be confirmed. A likely licence without a confirmed family is of the unknown class.
"""

from __future__ import annotations

import bisect
import collections
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import materialize, table
from . import textvec as V
from .linear import minimum
from .sampling import sample_keys

#: Documents whose lines serve as ordinary text in training at most: those of the smallest hashes of doc_id.
FIT_DOCUMENTS = 1000
#: Pieces of those lines that the model is fitted on at most, those of the smallest hashes; a line is cut into pieces
#: of PIECE_CHARS, so that the driver holds a bounded number of characters.
FIT_LINES = 8000
PIECE_CHARS = 2000
#: Texts up to this length share one look at their families.
CACHED_CHARS = 500
HASH_BITS = 20
GRAMS = (1, 2, 3)
#: Share of a template's word pairs that a paragraph must hold.
CONFIRM = 0.7
#: Word pairs of a template from which it is looked for in whole paragraphs; shorter ones are names.
LONG = 8
#: Lines with this share of a template are not taken for ordinary text in training.
RESEMBLE = 0.4
#: Calibrated probability of "some licence" from which a paragraph is reported.
REPORT = 0.5
_MASK = V.U64((1 << HASH_BITS) - 1)

#: Public names of licence families.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPL v3"],
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License", "Apache-2.0", "Apache Software License"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License"],
    "Boost": ["Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike License"],
    "CC0": ["CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero v1.0 Universal", "CC0 Public Domain Dedication"],
    "EPL": ["Eclipse Public License 2.0", "Eclipse Public License", "EPL-2.0", "Eclipse Public License, Version 1.0"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GPL-3.0", "GPL-2.0", "GNU GPL v3", "GPLv2"],
    "ISC": ["ISC License", "ISC"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL-2.1", "LGPL-3.0", "GNU LGPL"],
    "MIT": ["MIT License", "MIT", "Expat License"],
    "MPL": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
}
#: Characteristic sentences of the public licence texts.
TEXTS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Boost": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0": ["the person who associated a work with this deed has dedicated the work to the public domain"],
}
PHRASES = ["{}", "License: {}", "Licensed under the {}.", "Released under the {}.", "Published under the terms of the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the {}. See the file for details.", "This program is made available under the {}.", "SPDX-License-Identifier: {}", "The code in this repository is under {}.", "You may use, copy and modify this under the {}, as described above.", "Copyright 2020 the authors, all text under {}"]
OTHER_NAMES = ["{} Public License", "{} Source License", "{} License, Version 1.1", "{} Community License", "{} Software License Agreement", "{} Open License 2.0"]
ORDINARY = ["He lost his driving license in the spring.", "The license plate was new.", "A fishing licence costs ten pounds a year.", "General terms of the public meeting, version 3.", "They were under the bridge.", "This work is under way.", "All rights reserved.", "Released in the autumn of that year.", "The foundation published a free program for the public.", "The company licensed the song to a film studio.", "The university awards a license to teach.", "Poetic license allows it.", "Copyright 2021 the authors.", "See the file for details.", "Published by the university.", "The software is under test.", "version 2.0", "You may use the library from nine to five.", "He studied at MIT.", "She is a professor at MIT in Boston.", "MIT researchers built a robot.", "Er fuhr mit dem Auto.", "Wir gehen mit der Familie in die Stadt.", "mit", "The ISC met in 2004.", "The Apache helicopter landed.", "The Apache people live in the south.", "Apache", "The Apache server is down.", "Mozilla is a company.", "The eclipse was seen in 1999.", "An expat moved to Spain.", "The boost was small.", "They have much in common.", "The attribution is wrong.", "The painting is public."]
CLASSES = ["none", "unknown", *sorted(NAMES)]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word n-grams within each line of a column, the line of each, and each row's first line (and one more)."""
    data, offsets = V.column_bytes(texts)
    breaks = np.flatnonzero(data == 10)
    first = np.append(0, np.cumsum(np.diff(np.searchsorted(breaks, offsets)) + 1))
    starts, ends, _ = V.spans(data, offsets, V.IS_ALNUM)
    edges = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line = np.searchsorted(edges, starts, "right") - 1
    words = V.span_hashes(V.LOWER[data], starts, ends)
    hashes, lines = [], []
    for n in GRAMS:
        if len(words) >= n:
            same = line[: len(line) - n + 1] == line[n - 1 :]
            hashes.append(V.ngram_hashes(words, n)[same])
            lines.append(line[: len(line) - n + 1][same])
    if not hashes:
        return np.zeros(0, V.U64), np.zeros(0, np.int64), first
    return np.concatenate(hashes), np.concatenate(lines), first


def word_hashes(text: str) -> np.ndarray:
    data, offsets = V.column_bytes(pa.array([text]))
    starts, ends, _ = V.spans(data, offsets, V.IS_ALNUM)
    return V.span_hashes(V.LOWER[data], starts, ends)


def pairs_of(text: str) -> frozenset[tuple[str, str]]:
    words = re.findall(r"\w+", text.lower())
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset((w, "") for w in words)


@functools.lru_cache(maxsize=1)
def templates() -> dict[str, list[frozenset]]:
    """Of each family: word pairs of its names (of two words at least) and texts."""
    return {k: [pairs_of(t) for t in [*names, *TEXTS.get(k, [])] if len(re.findall(r"\w+", t)) > 1] for k, names in NAMES.items()}


#: Names of one word, by lower case: they say a licence only where a cue is next to them.
SINGLE = {n.lower(): k for k, names in NAMES.items() for n in names if len(re.findall(r"\w+", n)) == 1}


def _cues() -> list[re.Pattern]:
    """What confirms a one-word name, the group "name": a word such as "License:" before it, another licence joined to it, the line for itself."""
    single = "|".join(map(re.escape, sorted(SINGLE, key=len, reverse=True)))
    every = "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in sorted((n for names in NAMES.values() for n in names), key=len, reverse=True))
    name, ends = rf"(?<![\w-])(?P<name>{single})(?![\w-])", r"(?=\s*(?:$|[^\w\s]|(?:or|and|with|licen[sc]e[sd]?|as|for|by|in|see|terms)\b))"
    joined = r"(?:\s*[/|,&]\s*|\s+(?:or|and)\s+)(?:the\s+)?"
    before = r"\b(?:licen[sc]e[sd]?|licensing|spdx-license-identifier)\b[\s\"'(`*]*[:=][\s\"'(`*]*|\b(?:under|licen[sc]e\s+is|licen[sc]ed\s+as)[\s\"'(`*]+(?:(?:terms\s+of|either|both|the|an?)[\s\"'(`*]+)*"
    return [re.compile(f"(?:{before}){name}{ends}", re.I), re.compile(rf"(?<![\w-])(?:{every}){joined}{name}", re.I), re.compile(rf"{name}{joined}(?:{every})(?![\w-])", re.I), re.compile(rf"^\W*(?-i:(?P<name>{'|'.join(re.escape(n) for names in NAMES.values() for n in names if n.lower() in SINGLE)}))\W*$")]


CUES = _cues()


@functools.lru_cache(maxsize=1)
def _by_pair() -> dict[tuple[str, str], set[str]]:
    out: dict[tuple[str, str], set[str]] = collections.defaultdict(set)
    for k, own in templates().items():
        for w in frozenset().union(*own):
            out[w].add(k)
    return dict(out)


def families(text: str) -> list[tuple[str, float]]:
    return _short_families(text) if len(text) <= CACHED_CHARS else _families(text)


@functools.lru_cache(maxsize=4096)
def _short_families(text: str) -> list[tuple[str, float]]:
    return _families(text)


def _families(text: str) -> list[tuple[str, float]]:
    """The families that the text's words confirm, with the share of a template that is there.

    The best template comes first and takes the word pairs of its family with it, so that a text which one
    family shares with another counts once.
    """
    words = re.findall(r"\w+", text.lower())
    left = collections.Counter(w for w in zip(words, words[1:], strict=False) if w in _by_pair())
    every = templates()
    known = {k: every[k] for k in {k for w in left for k in _by_pair()[w]}}
    out = []
    while True:
        share, _, family = max(((sum(w in left for w in t) / len(t), len(t), k) for k, own in known.items() if k not in dict(out) for t in own), default=(0.0, 0, ""))
        if share < CONFIRM:
            break
        out.append((family, share))
        left -= collections.Counter(frozenset().union(*known[family]))
    for cue in CUES:
        at = 0
        while m := cue.search(text, at):
            at = m.start("name") + 1
            if (family := SINGLE[m["name"].lower()]) not in dict(out):
                out.append((family, 1.0))
    return sorted(out)


def examples(ordinary: list[str]) -> tuple[list[str], np.ndarray]:
    texts, y = [], []
    for k, family in enumerate(CLASSES[2:], 2):
        made = [p.format(n) for n in NAMES[family] for p in PHRASES if len(n) > 5 or p != "{}"] + TEXTS.get(family, []) * 3
        texts += made
        y += [k] * len(made)
    invented = ["Acme", "Northwind", "Foo Project", "Contoso", "Globex", "Initech", "Umbrella", "Example Org"]
    made = [p.format(n.format(w)) for i, w in enumerate(invented) for n in OTHER_NAMES for p in PHRASES[i % 2 :: 2]]
    texts += made
    y += [1] * len(made)
    texts += ORDINARY * 3 + ordinary
    y += [0] * (3 * len(ORDINARY) + len(ordinary))
    return texts, np.array(y)


@dataclass
class Classifier:
    features: np.ndarray  # hashes of n-grams, sorted; a row of weights for each
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    @functools.cached_property
    def sieve(self) -> np.ndarray:
        out = np.zeros(1 << HASH_BITS, bool)
        out[self.features & _MASK] = True
        return out

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of weights of each n-gram, -1 for those without. A few bits sort out most, whole hashes decide:
        an n-gram of ordinary text must not pass for one of a licence."""
        out = np.full(len(hashes), -1, np.int64)
        near = np.flatnonzero(self.sieve[hashes & _MASK])
        if len(near):
            k = np.minimum(np.searchsorted(self.features, hashes[near]), len(self.features) - 1)
            same = self.features[k] == hashes[near]
            out[near[same]] = k[same]
        return out

    def odds(self, at: np.ndarray, lines: np.ndarray, n: int) -> np.ndarray:
        counts = np.bincount(lines, minlength=n)
        scale = 1 / np.sqrt(np.maximum(counts, 1))
        return np.stack([np.bincount(lines, self.weights[at, c], n) * scale for c in range(len(self.bias))], axis=1) + self.bias

    def probabilities(self, odds: np.ndarray) -> np.ndarray:
        z = odds / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(ordinary: list[str], ridge: float = 0.02) -> Classifier:
    texts, y = examples(ordinary)
    hashes, lines, _ = grams(pa.array([t.replace("\n", " ") for t in texts], pa.string()))
    # Only n-grams that licence phrases hold carry information on the families.
    seen = np.unique(hashes[y[lines] > 0])
    at = Classifier(seen, np.zeros(0), np.zeros(0), 1.0).rows(hashes)
    keys = np.unique(lines[at >= 0] << HASH_BITS | at[at >= 0])
    lines, at = keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)
    n, m, c = len(texts), len(seen), len(CLASSES)
    scale = 1 / np.sqrt(np.maximum(np.bincount(lines, minlength=n), 1))
    target = np.eye(c)[y]

    def fitted(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = train[lines]
        li, ai = lines[own], at[own]

        def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
            w, b = v[: m * c].reshape(m, c), v[m * c :]
            z = np.stack([np.bincount(li, w[ai, k], n) for k in range(c)], axis=1) * scale[:, None] + b
            z -= z.max(axis=1, keepdims=True)
            log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            e = (np.exp(log_p) - target) * train[:, None]
            g = np.stack([np.bincount(ai, (e[:, k] * scale)[li], m) for k in range(c)], axis=1) + ridge * w
            return float(-(log_p * target * train[:, None]).sum() + ridge / 2 * (w * w).sum()), np.append(g.ravel(), e.sum(axis=0))

        v = minimum(loss, np.zeros(m * c + c), rounds=60)
        return v[: m * c].reshape(m, c), v[m * c :]

    held_out = np.arange(n) % 4 == 0
    w, b = fitted(~held_out)
    odds = Classifier(seen, w, b, 1.0).odds(at, lines, n)[held_out]
    loss_of = lambda t: -np.log(np.maximum(1e-12, Classifier(seen, w, b, t).probabilities(odds)[np.arange(held_out.sum()), y[held_out]])).mean()
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss_of)
    w, b = fitted(np.ones(n, bool))
    return Classifier(seen, w, b, temperature)


KIND = "array<struct<line:int,family:string,probability:double,confirmed:boolean>>"


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is judged: lines, joins of two neighbouring lines, and paragraphs.

    A paragraph is a run of lines of one row with words. Returns the n-grams' hashes and the unit of each, each
    unit's first and last line over the column, each line's edge in bytes (and one more), and each row's first line.
    """
    breaks = np.flatnonzero(data == 10)
    first = np.append(0, np.cumsum(np.diff(np.searchsorted(breaks, offsets)) + 1))
    n = int(first[-1])
    edges = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    starts, ends, _ = V.spans(data, offsets, V.IS_ALNUM)
    line = np.searchsorted(edges, starts, "right") - 1
    words = V.span_hashes(V.LOWER[data], starts, ends)
    held = np.bincount(line, minlength=n) > 0
    follows = np.zeros(n, bool)  # the line before belongs to the same paragraph
    follows[1:] = held[1:] & held[:-1]
    follows[first[:-1]] = False
    head = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    tail = np.zeros(n, np.int64)  # by head
    np.maximum.at(tail, head, np.arange(n))
    hashes, owner = [], []
    for k in GRAMS:
        if len(words) < k:
            continue
        a, b = line[: len(line) - k + 1], line[k - 1 :]
        same = head[a] == head[b]
        h, a, b = V.ngram_hashes(words, k)[same], a[same], b[same]
        one, near = a == b, b - a <= 1
        for who, unit in ((one, a), (one & follows[a], n + a - 1), (near & np.append(follows[1:], False)[a], n + a), (slice(None), 2 * n + head[a])):
            hashes.append(h[who])
            owner.append(unit[who])
    at = np.arange(n)
    empty = np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, V.U64), *hashes]), np.concatenate([empty, *owner]), np.concatenate([at, at, at]), np.concatenate([at, at + 1, tail]), np.append(edges, len(data)), first


def stretches(lines: list[str], known: dict[str, list[frozenset]]) -> list[tuple[int, int, str, float]]:
    """(first line, last line, family, share) where a paragraph's words hold most of a licence's text, wherever its lines break."""
    words = [(w, i) for i, t in enumerate(lines) for w in re.findall(r"\w+", t.lower())]
    pairs = [(a[0], b[0]) for a, b in zip(words, words[1:], strict=False)]
    held, best = set(pairs), []
    for family, own in known.items():
        for t in own:
            if len(t) < LONG or sum(w in held for w in t) < CONFIRM * len(t):
                continue
            # The stretch of twice the template's length at most with the largest share of it.
            at = [k for k, w in enumerate(pairs) if w in t]
            count: collections.Counter = collections.Counter()
            i = 0
            for k in at:
                count[pairs[k]] += 1
                while k - at[i] >= 2 * len(t):
                    count[pairs[at[i]]] -= 1
                    if not count[pairs[at[i]]]:
                        del count[pairs[at[i]]]
                    i += 1
                while count[pairs[at[i]]] > 1:
                    count[pairs[at[i]]] -= 1
                    i += 1
                if len(count) >= CONFIRM * len(t):
                    best.append((len(count) / len(t), len(t), at[i], k + 1, family))
    taken: list[tuple[int, int, str, float]] = []
    for share, _, a, b, family in sorted(best, key=lambda x: (-x[0], -x[1], x[3] - x[2], x[2])):
        k = bisect.bisect_left(taken, (b,))  # `taken` is in order and does not overlap
        if not k or taken[k - 1][1] <= a:
            taken.insert(k, (a, b, family, share))
    return [(words[a][1], words[b][1], family, share) for a, b, family, share in taken]


def scan(batches: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    known = templates()
    every = [t for k in known for t in [*NAMES[k], *TEXTS.get(k, [])] if len(pairs_of(t)) >= LONG]
    marks = [np.unique(model.rows(V.ngram_hashes(word_hashes(t), 2))) for t in every]  # training holds all of them
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))
    for batch in V.slices(batches):
        data, offsets = V.column_bytes(batch.column("text"))
        hashes, owner, begin, end, edges, first = units(data, offsets)
        # n-grams count once in a unit; those without weights play no part.
        rows = model.rows(hashes)
        own = rows >= 0
        keys = np.unique(owner[own] << HASH_BITS | rows[own])
        where, place = np.unique(keys >> HASH_BITS, return_inverse=True)
        p = model.probabilities(model.odds(keys & ((1 << HASH_BITS) - 1), place, len(where)))
        found: list[list[tuple]] = [[] for _ in range(len(batch))]
        likely = 1 - p[:, 0] >= REPORT
        # Paragraphs that may hold a licence's text are compared whatever the classifier says of their words at large.
        inner = keys[keys >> HASH_BITS >= 2 * first[-1]]
        inner = inner[np.isin(inner & ((1 << HASH_BITS) - 1), np.concatenate(marks))]
        for own_marks in marks:
            unit, many = np.unique(inner[np.isin(inner & ((1 << HASH_BITS) - 1), own_marks)] >> HASH_BITS, return_counts=True)
            likely[np.searchsorted(where, unit[many >= len(own_marks) / 2])] = True
        for i in np.flatnonzero(likely):
            a, b = int(begin[where[i]]), int(end[where[i]])
            row = int(np.searchsorted(first, a, "right") - 1)
            at = a - int(first[row])
            lines = data[edges[a] : edges[b + 1]].tobytes().decode().split("\n")[: b - a + 1]
            # Every family that the unit confirms; a likely licence without one is unknown. The classifier shares
            # the chance out among families, so several have that of any licence.
            some = 1 - float(p[i, 0])
            if where[i] < 2 * first[-1]:
                confirmed = families("\n".join(lines))
                for family, share in confirmed:
                    chance = float(p[i, CLASSES.index(family)]) if len(confirmed) == 1 else some
                    found[row].append((at, at + b - a, family, chance, share, False))
            else:
                confirmed = stretches(lines, known)
                for x, y, family, share in confirmed:
                    own_text = grams(pa.array([" ".join(lines[x : y + 1])]))
                    inside = np.unique(model.rows(own_text[0]))
                    inside = inside[inside >= 0]
                    chance = model.probabilities(model.odds(inside, np.zeros(len(inside), np.int64), 1))[0, CLASSES.index(family)]
                    found[row].append((at + x, at + y, family, float(chance), share, True))
            if not confirmed and some >= REPORT:
                found[row].append((at, at + b - a, "unknown", some, 0.0, False))
        out = {n: batch.column(n) for n in batch.schema.names} | {"licenses": pa.array([settled(f) for f in found], kind)}
        yield pa.RecordBatch.from_pydict(out)


def settled(found: list[tuple[int, int, str, float, float, bool]]) -> list[dict]:
    """Each licence once, at its first line.

    Of units that overlap, a wider one adds a family if it holds more of it than the narrower ones inside, and then
    stands for these and the unknown ones in it; a wider unknown one counts only where nothing else was found.
    """
    held: dict[int, list[tuple]] = collections.defaultdict(list)  # by line
    for new in sorted(found, key=lambda x: (x[2] == "unknown", x[5], x[1] - x[0], x[0], x[2])):
        a, b, family, _, share, text = new
        over = [x for i in range(a, b + 1) if i in held for x in held[i]]
        same = [x for x in over if x[2] == family]
        if family == "unknown" and over or same and not text and share <= max(x[4] for x in same):
            continue
        if same and share <= max(x[4] for x in same):
            new = (min(a, *(x[0] for x in same)), max(b, *(x[1] for x in same)), *max(same, key=lambda x: x[4])[2:])
        for x in dict.fromkeys(same):
            for i in range(x[0], x[1] + 1):
                held[i].remove(x)
        for i in range(new[0], new[1] + 1):
            held[i].append(new)
    out = {x for own in held.values() for x in own}
    return [{"line": x[0], "family": x[2], "probability": x[3], "confirmed": x[2] != "unknown"} for x in sorted(out, key=lambda x: (x[0], x[2]))]


def scan_licenses(docs: DataFrame, *, carry: tuple[str, ...] = (), fit_documents: int = FIT_DOCUMENTS, fit_lines: int = FIT_LINES) -> DataFrame:
    """Add `licenses` to each document: array of (line, family, probability, confirmed), by line.

    Paragraphs are the lines of the whole text, joins of two neighbouring ones and runs of lines with words; a
    licence is given at its first line. Edge cases: null and empty texts and lines without words have no
    licence; lines whose licence no template confirms are of the family "unknown"; repeated rows are scanned one by
    one; null doc_ids are scanned like others and take no part in the sample; an empty table gives an empty result;
    other columns play no part, and a carried column named `licenses` gives way to the result. `fit_documents` and
    `fit_lines` bound the training sample of ordinary lines, not the scan; the sample goes by hashes, so neither the
    order of the rows nor their partitions matter.
    """
    docs = V.chosen(docs, "doc_id", "text", carry, ("licenses",))
    ids = sample_keys(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").distinct(), fit_documents)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most fit_documents ids
    lines = sample.select(F.explode(F.split("text", "\n")).alias("line")).filter("NOT lower(line) RLIKE 'licen[cs]e|spdx|copyright|redistribut|creative commons|public domain'")
    lines = lines.select(F.explode(F.split("line", rf"(?s)(?<=\G.{{{PIECE_CHARS}}})")).alias("line")).filter("line <> ''")
    lines = materialize(lines.distinct(), "license-lines")
    every = [t for own in templates().values() for t in own]
    held = lambda line: any(len(t & line) >= RESEMBLE * len(t) for t in every)
    ordinary = sorted(r.line for r in sample_keys(lines, fit_lines).toLocalIterator() if not held(pairs_of(r.line)))
    model = docs.sparkSession.sparkContext.broadcast(train(ordinary))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"licenses {KIND}"])
    return docs.mapInArrow(lambda it: scan(it, model.value), fields)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families of all documents."""
    out = scan_licenses(table(spark, sf_dir, "documents"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x.family))), ",")
    lines = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x.line.cast("string"), x.family)), ",")
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), families.alias("families"), lines.alias("lines"), F.round(F.array_max(F.transform("licenses", lambda x: x.probability)), 6).alias("best_probability"))
