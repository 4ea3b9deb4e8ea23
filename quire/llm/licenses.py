"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Templates are grouped by length. For a group whose longest template has ``m`` shingles, windows of ``2 m`` shingles
start at every ``m``-th one, so each occurrence lies whole in a window, whose Jaccard similarity with the template is
0.19 at least. With ``BANDS`` bands of one minimum each, such a window misses its template with a probability
of 0.81 ** 64, one in 700,000. Windows without any template shingle cannot share a minimum with a template and are
not hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import Piece, mix, pieces, shingles, words

SHINGLE, CONTAINED, BANDS = 5, 0.8, 64

#: Notices of public licenses. Fixed values; (license, text).
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 International."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]

_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_SEEDS = np.random.default_rng(5).integers(1, 2**64, BANDS, dtype=np.uint64)
_NONE = np.uint64(2**64 - 1)


class Scanner:
    """The templates' shingles and bands; its size depends on the templates alone."""

    def __init__(self, templates: list[tuple[str, str]], contained: float):
        self.templates, self.contained = templates, contained
        self.sets = []
        for name, text in templates:
            raw = np.frombuffer(text.encode(), np.uint8)
            w = words(Piece(0, 1, raw, np.array([0, len(raw)])), keep=_WORD)
            if len(w.hash) < SHINGLE:
                raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
            self.sets.append(np.unique(shingles(w, SHINGLE)[2]))
        self.all = np.unique(np.concatenate(self.sets))
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.all & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.groups: dict[int, dict[tuple[int, int], list[int]]] = {}
        for t, s in enumerate(self.sets):
            bands = self.groups.setdefault(1 << (len(s) - 1).bit_length(), {})
            for band, low in enumerate(mix(s[:, None] ^ _SEEDS).min(0)):
                bands.setdefault((band, int(low)), []).append(t)

    def known(self, value: np.ndarray) -> np.ndarray:
        out = self.bits[(value & np.uint64(0xFFFF)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = self.all[np.minimum(np.searchsorted(self.all, value[at]), len(self.all) - 1)] == value[at]
        return out

    def matches(self, value: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first shingle, last shingle, containment) in one text's shingles; ``hit``: places of known ones."""
        found: dict[int, list[tuple[int, int, float]]] = {}
        for m, bands in self.groups.items():
            starts = np.unique(np.concatenate([hit // m, hit // m - 1]))
            for begin in (starts[starts >= 0] * m).tolist():
                window = value[begin : begin + 2 * m]
                lows = mix(window[:, None] ^ _SEEDS).min(0)
                for t in sorted({t for band, low in enumerate(lows.tolist()) for t in bands.get((band, low), ())}):
                    inside = np.flatnonzero(np.isin(window, self.sets[t]))
                    share = len(np.unique(window[inside])) / len(self.sets[t])
                    if share >= self.contained:
                        found.setdefault(t, []).append((begin + int(inside[0]), begin + int(inside[-1]), share))
        out = []
        for t, spans in sorted(found.items()):
            now = None
            for a, b, share in sorted(spans):
                if now and a <= now[1]:
                    now = (now[0], max(b, now[1]), max(share, now[2]))
                else:
                    out += [(t, *now)] if now else []
                    now = (a, b, share)
            out.append((t, *now))
        return out


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, contained: float = CONTAINED) -> DataFrame:
    """``(doc_id, license, template, start, end, containment)``: one row for each place of each template found.

    ``start`` and ``end`` are code points in the text, ``template`` the index in ``templates``. Texts are compared by
    their letters and digits, A-Z in lower case. Null, empty and short texts (under five words) have no row; a null
    ``doc_id`` is carried. Templates that match at one place are all reported. Repeated rows each give their rows;
    an empty table gives an empty one; extra columns are not read. One pass, nothing is shuffled.
    """
    scanner = Scanner(templates or TEMPLATES, contained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column(1)):
                w = words(p, keep=_WORD)
                row, at, value = shingles(w, SHINGLE, whole=False)
                spot = np.flatnonzero(scanner.known(value))
                rows: list[tuple] = []
                if len(spot):
                    chars = np.concatenate([[0], np.cumsum((p.data & 0xC0) != 0x80)])
                    bounds = np.searchsorted(row, np.arange(p.rows + 1))
                    for r in np.unique(row[spot]).tolist():
                        lo, hi = bounds[r], bounds[r + 1]
                        mine = spot[(spot >= lo) & (spot < hi)] - lo
                        base = chars[p.offsets[r]]
                        for t, a, b, share in scanner.matches(value[lo:hi], mine):
                            rows.append((p.first + r, scanner.templates[t][0], t, int(chars[w.start[at[lo + a]]] - base), int(chars[w.end[at[lo + b] + SHINGLE - 1]] - base), share))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True))],
                    names=["doc_id", "license", "template", "start", "end", "containment"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, license string, template int, start long, end long, containment double")
