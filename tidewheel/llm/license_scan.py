"""License scans: MinHash bands over overlapping text windows, then exact containment.

Templates fall into classes by length.  A class has windows of two strides, each
long enough for its longest template, so every place where a template may stand
lies within one window.  For such a window the similarity to its template is
bounded from below; bands of one minimum each, as many as the bound asks for,
retrieve the template with a miss probability below ``MISS``.  A retrieved template
is verified exactly: the share of its distinct shingles that some stretch of the
window's words holds.

The templates are a fixed table and go to the tasks; documents pass by once,
without a shuffle.

Tokens: runs of ASCII letters and digits and of non-ASCII characters, ASCII
letters lower-cased; shingles: five words.

Edge cases: null and empty texts match nothing; a null ``doc_id`` stays null;
repeated rows give their results each; other columns are ignored; an empty table
gives an empty result; templates of fewer than five words are refused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, odd_multipliers, shingles, table, utf8
from .decontamination import tokens

WIDTH = 5
CONTAINMENT = 0.8
MISS = 1e-4

#: Notices by which texts name their license; fixed values.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "This project is licensed under the terms of the MIT license.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-short": "under the Apache License 2.0",
    "BSD-licensed": "Licensed under the BSD License.",
    "BSD-2-Clause": "under the BSD 2-Clause License",
    "BSD-3-Clause": "under the BSD 3-Clause License",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-2.0-short": "GNU General Public License v2",
    "GPL-3.0-version": "GNU General Public License, version 3",
    "GPL-3.0-short": "GNU General Public License v3",
    "LGPL": "GNU Lesser General Public License",
    "AGPL": "GNU Affero General Public License",
    "GFDL": "under the terms of the GNU Free Documentation License",
    "MPL-2.0-short": "Mozilla Public License, version 2.0",
    "MPL-2.0-licensed": "under the Mozilla Public License 2.0",
    "EPL-1.0": "Eclipse Public License v1.0",
    "EPL-2.0-short": "Eclipse Public License v2.0",
    "CDDL": "Common Development and Distribution License",
    "EUPL": "the European Union Public Licence",
    "Artistic-2.0": "under the Artistic License 2.0",
    "OFL-1.1": "SIL Open Font License, Version 1.1",
    "ODbL": "made available under the Open Database License",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "WTFPL": "Do What The Fuck You Want To Public License",
    "CC0-1.0-short": "Licensed under CC0 1.0.",
    "CC0-1.0-name": "Creative Commons CC0 1.0 Universal",
}

#: Creative Commons licenses: the parts of their names, by short form.
CREATIVE_COMMONS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
for _short, _long in CREATIVE_COMMONS.items():
    TEMPLATES[f"CC-{_short}"] = f"a Creative Commons {_long} License"
    for _version in ("3.0", "4.0"):
        TEMPLATES[f"CC-{_short}-{_version}-name"] = f"Creative Commons {_long} {_version}"
        if _short == "BY":  # four words say too little
            TEMPLATES[f"CC-BY-{_version}-short"] = f"Licensed under CC BY {_version}."
            TEMPLATES[f"CC-BY-{_version}-a"] = f"under a CC BY {_version} license"
            TEMPLATES[f"CC-BY-{_version}-the"] = f"under the CC BY {_version} license"
        else:
            TEMPLATES[f"CC-{_short}-{_version}-short"] = f"CC {_short} {_version}"
    if "ND" in _short:  # as it is written up to 3.0
        TEMPLATES[f"CC-{_short}-3.0-derivs"] = f"Creative Commons {_long} 3.0".replace("NoDerivatives", "NoDerivs")


def bands_needed(similarity: float, miss: float = MISS) -> int:
    """Bands of one minimum that a pair this similar misses all of with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


BITS = 18  #: of the table that minima are looked up in first
BASE = 8  #: shingles of the shortest stride; the others are powers of two of it


def stride_minima(items: np.ndarray, a: np.ndarray, b: np.ndarray, base: int = BASE) -> np.ndarray:
    """Minima of every stretch of ``base`` shingles, one column for each hash function."""
    out = []
    step = 1024 * base
    for k in range(0, len(items), step):
        h = items[k : k + step, None] * a
        h += b
        h >>= np.uint64(32)
        out.append(np.minimum.reduceat(h.astype(np.uint32), np.arange(0, len(h), base), axis=0))
    return np.concatenate(out)


def window_minima(strides: np.ndarray) -> np.ndarray:
    """Minima of the windows of two neighbouring strides."""
    out = strides.copy()
    np.minimum(out[:-1], strides[1:], out=out[:-1])
    return out


class TemplateClass:
    """Templates of similar length and their minima; strides that hold the longest one."""

    def __init__(self, stride: int, templates: list[tuple[str, np.ndarray, int]], containment: float, miss: float):
        self.stride = stride
        self.templates = [(name, np.unique(s), n) for name, s, n in templates]
        least = [(math.ceil(containment * len(s)), len(s)) for _, s, _ in self.templates]
        self.bands = bands_needed(min(k / (2 * stride + n - k) for k, n in least), miss)
        a, b = odd_multipliers(self.bands, 71), odd_multipliers(self.bands, 72)
        minima = np.array([((s[:, None] * a + b) >> np.uint64(32)).min(axis=0) for _, s, _ in self.templates])
        keys = (np.arange(self.bands, dtype=np.uint64) << np.uint64(32) | minima).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.whose = keys[order], order // self.bands
        self.bits = np.zeros(1 << BITS, bool)  # few values pass by chance
        self.bits[minima & np.uint64(len(self.bits) - 1)] = True

    def candidates(self, windows: np.ndarray) -> list[tuple[int, int]]:
        """(template, first shingle of the window) of every pair that shares a band."""
        part = windows[:, : self.bands]
        row, band = np.nonzero(self.bits[part & np.uint32(len(self.bits) - 1)])
        key = band.astype(np.uint64) << np.uint64(32) | part[row, band]
        begin, end = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        found = {(t, row[k]) for k in np.flatnonzero(end > begin).tolist() for t in self.whose[begin[k] : end[k]].tolist()}
        return [(t, int(w) * self.stride) for t, w in sorted(found)]


def compile_templates(templates: dict[str, str], containment: float = CONTAINMENT, miss: float = MISS) -> list[TemplateClass]:
    hashes, by_size = WordHashes(), {}
    for name, text in sorted(templates.items()):
        words = tokens(text.encode())
        if len(words) < WIDTH:
            raise ValueError(f"{name} has fewer than {WIDTH} words")
        stride = max(BASE, 1 << (len(words) - WIDTH).bit_length())  # holds the template's shingles
        by_size.setdefault(stride, []).append((name, shingles(hashes.of(words), WIDTH), len(words)))
    return [TemplateClass(stride, group, containment, miss) for stride, group in sorted(by_size.items())]


def _verify(items: np.ndarray, template: np.ndarray, size: int, containment: float) -> tuple[float, int]:
    """(containment, place) of the stretch of the template's length that holds most of its distinct shingles."""
    width = size - WIDTH + 1
    inside = np.flatnonzero(np.isin(items, template))
    best, where = 0, 0
    for at in inside.tolist():
        held = len(np.unique(items[inside[(inside >= at) & (inside < at + width)]]))
        if held > best:
            best, where = held, at
    share = best / len(template)
    return (share, where) if share >= containment else (0.0, 0)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, containment: float = CONTAINMENT, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, first_word): each document's best match of each template it holds."""
    classes = docs.sparkSession.sparkContext.broadcast(compile_templates(templates or TEMPLATES, containment, miss))

    def run(batches):
        hashes, most = WordHashes(), max(c.bands for c in classes.value)
        a, b = odd_multipliers(most, 71), odd_multipliers(most, 72)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                row, out = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    items = shingles(hashes.of(tokens(text)), WIDTH)
                    best = {}
                    if not len(items):
                        continue
                    strides, stride = stride_minima(items, a, b), BASE
                    for c in classes.value:  # from short strides to long ones
                        while stride < c.stride:
                            strides, stride = np.minimum.reduceat(strides, np.arange(0, len(strides), 2), axis=0), stride * 2
                        for t, start in c.candidates(window_minima(strides)):
                            name, template, size = c.templates[t]
                            share, at = _verify(items[start : start + 2 * c.stride], template, size, containment)
                            if share > best.get(name, (0.0, 0))[0]:
                                best[name] = (share, start + at)
                    for name in sorted(best):
                        row.append(i)
                        out.append((name, *best[name]))
                columns = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], ["id", "license", "containment", "first_word"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return text.mapInArrow(run, f"id {kind}, license string, containment double, first_word long").withColumnRenamed("id", id_col)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
