"""Licence scan: Dice coefficient over word bigrams against licence templates, short notices and whole licence texts.

A text is cut into segments at newlines and after sentence marks. For each template and each segment as a start the unit
is the shortest run of segments that has as many words as the template, and the run with one segment less; so a notice
is found wherever it stands and however its lines are wrapped. A unit's set of word bigrams is compared only where sizes
allow the wanted coefficient: 2|A and B| / (|A| + |B|) >= t needs t / (2 - t) <= |A| / |B| <= (2 - t) / t, and as many
of the template's bigrams in the unit as that lower bound times |B|. The latter is known for all starts from one running
count of places, so that few units are looked at; it prunes nothing that could match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm._common import annotate, raw_texts
from millrace.llm.decontaminate import words_of

#: Dice coefficient in hundredths from which a unit counts as a licence text.
THRESHOLD = 80
#: Notices by which works name their licence, by licence.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]
#: Whole texts, files named after their licence.
TEXTS = [(p.name.removesuffix(".txt"), p.read_text(encoding="utf-8")) for p in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda p: p.name)]
TEMPLATES = NOTICES + TEXTS
_SEGMENT = re.compile(rb"(?<=[.!?;:])[ \t]+")


def segments(raw: bytes) -> list[tuple[int, list[bytes]]]:
    """(line from 1, words) of each segment that has words."""
    return [(i + 1, w) for i, line in enumerate(raw.split(b"\n")) for part in _SEGMENT.split(line) if (w := words_of(part))]


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


@dataclass
class Template:
    name: str
    n_words: int
    grams: set[tuple[bytes, bytes]]
    needed: int  # of its bigrams, for any match


class Templates:
    def __init__(self, templates: list[tuple[str, str]], threshold: int):
        self.threshold = threshold
        self.known: list[Template] = []
        #: bigram -> the templates that have it
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for name, text in templates:
            words = words_of(text.encode())
            grams = bigrams(words)
            if grams:
                for g in grams:
                    self.holders.setdefault(g, []).append(len(self.known))
                self.known.append(Template(name, len(words), grams, -(-threshold * len(grams) // (200 - threshold))))

    def dice(self, words: list[bytes], t: Template) -> float | None:
        """The coefficient, if it reaches the threshold."""
        grams = bigrams(words)
        total, both = len(grams) + len(t.grams), 0
        if self.threshold * total <= 200 * min(len(grams), len(t.grams)):  # the sizes allow it
            both = len(grams & t.grams)
        return 2 * both / total if both and 200 * both >= self.threshold * total else None

    def match(self, raw: bytes) -> list[tuple[float, int, str]]:
        """(coefficient, first line, licence) of each unit of a text that matches."""
        parts = segments(raw)
        words = [w for _, part in parts for w in part]
        places: dict[int, list[int]] = {}
        holders = self.holders
        for i, g in enumerate(zip(words, words[1:])):
            if g in holders:
                for k in holders[g]:
                    places.setdefault(k, []).append(i)
        starts = np.concatenate([[0], np.cumsum([len(part) for _, part in parts])]).astype(np.int64)
        out = []
        for k, at in sorted(places.items()):
            t, at = self.known[k], np.array(at, dtype=np.int64)
            if len(at) < t.needed:
                continue
            reached = np.minimum(np.searchsorted(starts, starts[:-1] + t.n_words), len(parts))
            inside = np.searchsorted(at, starts[reached] - 1) - np.searchsorted(at, starts[:-1])
            for i in np.flatnonzero(inside >= t.needed).tolist():
                for j in {int(reached[i]), int(reached[i]) - 1} - {i}:
                    d = self.dice(words[starts[i] : starts[j]], t)
                    if d is not None:
                        out.append((d, parts[i][0], t.name))
        return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, license_id and dice of the best match, line_no (from 1, of its first line), licenses, n_matches.

    The best match has the highest coefficient, then the least line_no and licence name; `licenses` are the names of all
    matches, sorted and comma-joined; n_matches counts matching units; no match gives null, null, -1, '' and 0. A null or
    empty text has no units; units without a bigram never match. Repeated rows are scanned each; an empty table gives no
    rows.
    """
    known = Templates(templates, threshold)

    def make(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for raw in raw_texts(texts):
            found = [(-d, line, name) for d, line, name in known.match(raw)] if raw else []
            best = min(found, default=(None, -1, None))
            names = ",".join(sorted({x[2] for x in found}))
            rows.append((best[2], None if best[0] is None else round(-best[0], 6), best[1], names, len(found)))
        columns = list(zip(*rows)) if rows else [[]] * 5
        return [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.string(), pa.int64()))]

    fields = [("license_id", T.StringType()), ("dice", T.DoubleType()), ("line_no", T.LongType()), ("licenses", T.StringType()), ("n_matches", T.LongType())]
    return annotate(docs.select("doc_id", "text"), ["text"], fields, make, ["doc_id"]).select("row.doc_id", "res.*")
