"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them.

1. Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII case folded;
   a shingle is ``SHINGLE`` consecutive words.  Templates of like length share a window
   class, the least size of the geometric series ``sizes`` that holds the template and one
   stride more, so that some window of that class covers a copy wherever it begins.
2. Every window of every class gets a MinHash signature.  Windows step by ``STRIDE``
   shingles; the minima of the strides are taken once and shared by all classes.
3. Bands: how small the Jaccard index of a window and a template can be, if the window holds the
   share ``containment`` of the template's shingles, follows from their sizes.  Each class
   has the least number of bands that retrieves such a pair with a probability of ``target``
   or more.
4. Retrieved pairs are verified: the share of the template's distinct shingles that the window
   contains, counted exactly, must reach ``containment``.  Windows of one template
   that overlap are one match: the widest cover, the highest share.  A match goes if another
   template fits more than half of its stretch with a higher share (versions of one text).
5. A template of a single shingle is either there or not: it is looked up among the shingles
   of a text, without bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _vec as V

SHINGLE, STRIDE, ROWS, CONTAINMENT, TARGET, FIRST_SIZE, GROWTH = 3, 4, 2, 0.8, 0.995, 8, 1.5

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version %s of the License, or (at your option) any later version."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"""

#: (license, template): public notices, their openings, and the one-line statements of a license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", _WARRANTY), ("MIT", "Released under the MIT License"), ("MIT", "Licensed under the MIT License"),
    ("BSD", _BSD), ("BSD", "Released under the BSD License"), ("ISC", _ISC),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", _GPL % "3"), ("GPL-2.0", _GPL % "2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"), ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL", _LGPL), ("MPL-2.0", _MPL), ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission"),
    ("Proprietary", "All rights reserved"),
)


def bands_for(jaccard: float, rows: int, target: float) -> int:
    """Least number of bands of ``rows`` rows that meets at this Jaccard index with the target probability."""
    return int(np.ceil(np.log(1 - target) / np.log(1 - jaccard**rows)))


@dataclass
class Class:
    """A window class: its size in shingles, its bands, and the sorted keys with the template of each."""

    size: int
    bands: int
    keys: np.ndarray
    owner: np.ndarray
    near: np.ndarray  # by the top bits of a key: whether any key has them


@dataclass
class Templates:
    names: list[str]
    number: list[int]  # of those below, in names
    grams: list[np.ndarray]  # sorted distinct shingles of the templates of several
    single: dict[int, list[int]]  # the shingle of a template that has but one: its numbers
    classes: list[Class]
    rows: int
    odd: np.ndarray
    containment: float


def grams(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the shingles; ``V.shingles`` without those of rows too short for one."""
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return h[:0], row[:0]
    s = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        s = s * V.U64(0xD6E8FEB86659FD93) + h[j : j + n]
    ok = row[:n] == row[SHINGLE - 1 :]
    return V.mix(s[ok]), row[:n][ok]


def _minima(values: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Least hash of each column of ``values`` (uint32, few rows) under every hash function."""
    out = np.empty((len(odd), values.shape[1]), dtype=np.uint32)
    for j, a in enumerate(odd):
        np.minimum.reduce(values * a, axis=0, out=out[j])
    return out


def _key(sig: np.ndarray, band: int, rows: int) -> np.ndarray:
    key = np.full(sig.shape[1], band + 1, dtype=np.uint64)
    for j in range(band * rows, band * rows + rows):
        key = (key * V.U64(V.P)) ^ sig[j]
    return key * V.U64(0x9FB21C651E98DF25)


def prepare(templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT, rows: int = ROWS, target: float = TARGET) -> Templates:
    """Templates of fewer than ``SHINGLE`` words are too short to be told from chance and are left out."""
    names, number, sets = [], [], []
    single: dict[int, list[int]] = {}
    for name, text in templates:
        for w in V.words(pa.array([text], pa.large_string())):
            g = np.unique(grams(w.hash, w.row)[0])
            if len(g) == 1:
                single.setdefault(int(g[0]), []).append(len(names))
            elif len(g):
                number.append(len(names))
                sets.append(g)
            if len(g):
                names.append(name)
    sizes = [FIRST_SIZE]
    while sets and sizes[-1] < max(map(len, sets)) + STRIDE:
        sizes.append(-(-int(sizes[-1] * GROWTH) // STRIDE) * STRIDE)
    size = [min(s for s in sizes if s >= len(g) + STRIDE) for g in sets]
    # a window with the share c of n shingles, and s - c n others at most
    kept = [int(np.ceil(containment * len(g) - 1e-9)) for g in sets]
    jaccard = [k / (s + len(g) - k) for k, g, s in zip(kept, sets, size)]
    bands = {c: bands_for(min(j for j, s in zip(jaccard, size) if s == c), rows, target) for c in set(size)}
    odd = np.random.default_rng(5).integers(0, 1 << 31, rows * max(bands.values(), default=0), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    classes = []
    for c in sorted(bands):
        own = [i for i, s in enumerate(size) if s == c]
        sig = np.concatenate([_minima((sets[i] >> V.U64(32)).astype(np.uint32)[:, None], odd) for i in own], axis=1)
        key = np.concatenate([_key(sig, k, rows) for k in range(bands[c])])
        order = np.argsort(key, kind="stable")
        near = np.zeros(1 << 18, dtype=bool)
        near[(key >> V.U64(46)).astype(np.int64)] = True
        classes.append(Class(c, bands[c], key[order], np.tile(np.array(own), bands[c])[order], near))
    return Templates(names, number, sets, single, classes, rows, odd, containment)


def _windows(minima: np.ndarray, first: np.ndarray, many: int) -> np.ndarray:
    """Minima over ``many`` strides from each; those of a text of fewer strides, over all of it, at its first."""
    sig, span = minima, 1
    while span < many:
        step = min(span, many - span)
        sig = np.minimum(sig[:, :-step], sig[:, step:]) if sig.shape[1] > step else sig[:, :0]
        span += step
    out = np.empty_like(minima)
    out[:, : sig.shape[1]] = sig
    count = np.diff(np.r_[first, minima.shape[1]])
    short = first[count < many]
    if len(short):
        out[:, short] = np.minimum.reduceat(minima, first, axis=1)[:, count < many]
    return out


def search(col, t: Templates) -> Iterator[tuple[int, int, float, int, int]]:
    """Yields (row, template, containment, first word, last word)."""
    for w in V.words(col):
        g, row = grams(w.hash, w.row)
        if not len(g) or not t.names:
            continue
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        length = np.diff(np.r_[start, len(g)])
        strides = -(-length // STRIDE)
        first = np.cumsum(strides) - strides
        owner = np.repeat(np.arange(len(start)), strides)
        within = np.arange(len(owner)) - first[owner]
        block = start[owner] + within * STRIDE
        last = (start + length - 1)[owner]
        short = (g >> V.U64(32)).astype(np.uint32)
        minima = _minima(np.stack([short[np.minimum(block + i, last)] for i in range(STRIDE)]), t.odd)
        found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for i in np.flatnonzero(np.isin(g, np.array([*t.single], np.uint64))).tolist():
            s = i - int(start[np.searchsorted(start, i, side="right") - 1])
            for who in t.single[int(g[i])]:
                found.setdefault((int(row[i]), who), []).append((s, s + SHINGLE - 1, 1.0))
        for c in t.classes:
            many = c.size // STRIDE
            whole = (within == 0) | (within + many <= strides[owner])
            sig = _windows(minima[: c.bands * t.rows], first, many)
            pairs: set[tuple[int, int]] = set()
            for k in range(c.bands):
                key = _key(sig, k, t.rows)
                near = np.flatnonzero(c.near[(key >> V.U64(46)).astype(np.int64)])
                place = np.searchsorted(c.keys, key[near])
                for i, x in zip(near.tolist(), place.tolist()):
                    while whole[i] and x < len(c.keys) and c.keys[x] == key[i]:
                        pairs.add((i, int(c.owner[x])))
                        x += 1
            for i, who in sorted(pairs):
                r, lo = int(owner[i]), int(block[i])
                own = g[lo : min(lo + c.size, int(start[r] + length[r]))]
                inside = np.flatnonzero(np.isin(own, t.grams[who]))
                share = len(np.unique(own[inside])) / len(t.grams[who])
                if share >= t.containment:
                    base = lo - int(start[r])
                    found.setdefault((int(row[lo]), t.number[who]), []).append((base + int(inside[0]), base + int(inside[-1]) + SHINGLE - 1, share))
        by_row: dict[int, list[list]] = {}
        for (x, who), hits in sorted(found.items()):
            merged: list[list] = []
            for s, e, share in sorted(hits):
                if merged and s <= merged[-1][1]:
                    merged[-1][1:3] = max(e, merged[-1][1]), max(share, merged[-1][2])
                else:
                    merged.append([s, e, share, who])
            by_row.setdefault(x, []).extend(merged)
        for x, hits in sorted(by_row.items()):
            hits.sort()
            starts = np.array([h[0] for h in hits])
            lows = np.searchsorted(np.maximum.accumulate([h[1] for h in hits]), starts)  # the first that can reach it
            highs = np.searchsorted(starts, [h[1] for h in hits], side="right")
            for i, (s, e, share, who) in enumerate(hits):
                near = [o for o in hits[lows[i] : highs[i]] if o[2] > share]
                if not any(2 * (min(e, o[1]) - max(s, o[0]) + 1) > e - s + 1 for o in near):
                    yield w.lo + x, who, share, s, e


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: tuple[tuple[str, str], ...] = TEMPLATES, **settings) -> DataFrame:
    """(doc_id, license, template, containment, first_word, last_word) of every template found, words
    counted from 0; ``template`` is the number of the template among those long enough to use.

    Ids are integers.  Null and empty texts and those of fewer words than a shingle hold none; a null id is
    reported as null; repeated rows are reported repeatedly; templates that tie are all
    reported; texts are searched whole; an empty table or no templates give no rows;
    other columns are never looked at.
    """
    ready = prepare(templates, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(search(b.column(1), ready))
            if got:
                r, who, share, s, e = zip(*got)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(r)), pa.array([ready.names[i] for i in who]), pa.array(who, pa.int32()), pa.array(share, pa.float64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())],
                    ["doc_id", "license", "template", "containment", "first_word", "last_word"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, license string, template int, containment double, first_word long, last_word long")
