"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Words are runs of letters and digits, lower-cased; a text's bigrams are the distinct pairs of neighbouring words. A template
is compared with the whole text and with every window of as many words as the template has, so a licence inside a longer
document is found; the best place counts, the first of equals. Size bounds prune templates: with b bigrams in
the text and t in the template, the coefficient cannot reach the threshold d where 2 * min(b, t) < d * (b + t) (for whole
texts), where b * (2 - d) < d * t (a shorter text than the window), or where the text has too few of its bigrams at all.

Null, empty and one-word texts match nothing, as do templates of under two words. Whole texts are scanned. Repeated rows
are scanned each; a table without rows gives none. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

LEAST_DICE = 0.8
_WORDS = regex.compile(r"[\p{L}\p{N}]+")

# Notices and short licence texts by SPDX identifier or plain name.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "All-Rights-Reserved": ["All rights reserved."],
}


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _before(codes: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same number, else -1."""
    order = np.argsort(codes, kind="stable")
    again = codes[order[1:]] == codes[order[:-1]]
    out = np.full(len(codes), -1)
    out[order[1:][again]] = order[:-1][again]
    return out


def _distinct(before: np.ndarray, n: int, among: np.ndarray | None = None) -> np.ndarray:
    """How many distinct numbers (``among`` some places) each window of ``n`` places holds. A place is the first of its
    number in the windows that start after the place before it with that number."""
    at = np.arange(len(before)) if among is None else np.flatnonzero(among)
    windows = len(before) - n + 1
    first = np.maximum(np.maximum(before[at] + 1, at - n + 1), 0)
    last = np.minimum(at, windows - 1)
    ok = first <= last
    change = np.bincount(first[ok], minlength=windows + 1) - np.bincount(last[ok] + 1, minlength=windows + 1)
    return np.cumsum(change)[:windows]


class Scanner:
    """Templates prepared for scanning: (name, words, distinct bigrams)."""

    def __init__(self, templates: dict[str, list[str]], least: float) -> None:
        self.least = least
        lists = [(name, words(t)) for name, texts in templates.items() for t in texts]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in lists for w in ws))}
        self.base = len(self.ids) + 1
        self.templates = []
        for name, ws in lists:
            if len(ws) > 1:
                a = np.array([self.ids[w] for w in ws])
                self.templates.append((name, len(ws), np.unique(a[:-1] * self.base + a[1:])))
        self.known = np.unique(np.concatenate([t[2] for t in self.templates])) if self.templates else np.empty(0, np.int64)

    def scan(self, text: str | None) -> dict[str, tuple[float, int, int]]:
        """{name: (coefficient, first word, words)} of templates that reach the least coefficient, the best place of each."""
        ws = words(text)
        out: dict[str, tuple[float, int, int]] = {}
        if len(ws) < 2 or not self.templates:
            return out
        get = self.ids.get
        a = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        codes = np.where((a[:-1] >= 0) & (a[1:] >= 0), a[:-1] * self.base + a[1:], -1)
        hits = np.isin(codes, self.known)
        if not hits.any():
            return out
        found = np.unique(codes[hits])
        foreign: dict[tuple[str, str], int] = {}  # all bigrams need numbers to count distinct ones
        d = self.least
        whole = before = None
        for name, k, grams in self.templates:
            t, common = len(grams), len(np.intersect1d(found, grams, assume_unique=True))
            # a window holds at most k - 1 bigrams; common ones bound the coefficient in any place
            if 2 * common < d * (common + t) or len(codes) * (2 - d) < d * t:
                continue
            if whole is None:
                whole = np.array([c if c >= 0 else -1 - foreign.setdefault(p, len(foreign)) for c, p in zip(codes.tolist(), zip(ws, ws[1:]))])
                distinct = len(np.unique(whole))
            best = (2 * common / (distinct + t), 0, len(ws))
            if before is None:
                before = _before(whole)
            n = min(k - 1, len(codes))
            mine = np.isin(codes, grams)
            score = 2 * _distinct(before, n, mine) / (_distinct(before, n) + t)
            start = int(score.argmax())
            best = max(best, (float(score[start]), start, n + 1), key=lambda x: x[0])
            if best[0] >= d and best[0] > out.get(name, (0.0,))[0]:
                out[name] = best
        return out


def scanned(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, license (the best, null for none; the first by name of equals), dice (its coefficient, 0 for none), n_licenses and licenses (all names, in order,
    joined by commas): one row per document."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for b in batches:
            found = [scanner.scan(t.as_py()) for t in b.column(1)]
            best = [min(((-v[0], k) for k, v in f.items()), default=None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[1] if x else None for x in best], pa.string()), pa.array([round(-x[0], 6) if x else 0.0 for x in best]), pa.array([len(f) for f in found], pa.int32()), pa.array([",".join(sorted(f)) for f in found])],
                names=["doc_id", "license", "dice", "n_licenses", "licenses"],
            )

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return in_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, license string, dice double, n_licenses int, licenses string")
