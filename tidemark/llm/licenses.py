"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

A template is cut into five-word shingles. Texts are scanned in windows somewhat longer than the template, at a
stride of a quarter of it, so any stretch of the template's length lies whole in some window. A stretch that
holds 80 % of the template's shingles then has a Jaccard similarity with its window of at least least_similarity();
bands of one hash each retrieve it, so many that the chance to miss it is at most MISS. Retrieved templates are verified by
counting their shingles in the window exactly. A template of fewer than five words is one shingle of all its
words, which is looked up at that width wherever it stands. Licenses share wording: of matches on one stretch the
one of highest containment is reported.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches
from .words import HashedWords, blocks, folded_words, mix, rolled

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-4
#: Bytes of template text that a scan takes: it is broadcast and each worker indexes it.
MOST_BYTES = 8 << 20
FOUND = "doc_id long, n_words long, licenses array<struct<license:string,first_word:int,last_word:int,shingles:int,matched:int>>"

# Fixed texts: license notices as their publishers ask to put them into works, and short statements as authors write them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-notice": "Released under the MIT License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}
_FREE = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
TEMPLATES |= {
    "GPL-3.0-notice": _FREE.format("program", ":", "General Public License", ",", "3"),
    "AGPL-3.0-notice": _FREE.format("program", ":", "Affero General Public License", ",", "3"),
    "LGPL-2.0-notice": _FREE.format("library", ";", "Library General Public License", ";", "2"),
    "LGPL-2.1-notice": _FREE.format("library", ";", "Lesser General Public License", ";", "2.1"),
    "LGPL-3.0-notice": _FREE.format("program", ":", "Lesser General Public License", ",", "3"),
}

_BSD = TEMPLATES["BSD"] + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES |= {"BSD-2-Clause": _BSD + _AS_IS, "BSD-3-Clause": _BSD + _BSD_3 + _AS_IS}

# Whole licenses, a file each.
TEMPLATES |= {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

# Notices of fewer than five words.
SHORT = {"all-rights-reserved-notice": "All rights reserved."}

# Identifiers of the SPDX license list, for the tags that source files carry.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
for _id in SPDX.split():
    _tag = f"SPDX-License-Identifier: {_id}"
    (SHORT if len(folded_words(_tag)) < SHINGLE else TEMPLATES)[f"SPDX-{_id}"] = _tag


def least_similarity(shingles: int, window: int) -> float:
    """The least Jaccard similarity of a template of so many shingles and a window of `window` shingles that
    holds a share of CONTAINMENT of them."""
    held = math.ceil(CONTAINMENT * shingles - 1e-9)
    return held / (shingles + window - held)


def bands(similarity: float) -> int:
    """Bands of one hash each that all miss a window of this similarity with a chance of MISS at most."""
    return math.ceil(math.log(MISS) / math.log(1 - similarity)) if similarity < 1 else 1


class Templates:
    """Templates by window class, (window, stride), with the number of bands that the class needs."""

    def __init__(self, texts: dict[str, str]):
        def hashes(text: str) -> np.ndarray:
            h = HashedWords([folded_words(text)]).name
            return np.unique(rolled(h, min(SHINGLE, len(h)))) if len(h) else h

        self.names = [k for k in sorted(texts) if len(folded_words(texts[k])) >= SHINGLE]
        self.short = [(k, w, hashes(texts[k])[0]) for k in sorted(texts) if 0 < (w := len(folded_words(texts[k]))) < SHINGLE]
        self.shingles = [hashes(texts[k]) for k in self.names]
        self.classes: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, x in enumerate(self.shingles):
            size = 1 << (len(x) - 1).bit_length()  # templates of up to `size` shingles share a scan
            self.classes[max(len(x) + len(x) // 4, size + size // 4), max(1, size // 8)].append(k)
        self.bands = {c: max(bands(least_similarity(len(self.shingles[k]), c[0])) for k in members) for c, members in self.classes.items()}
        self.seeds = mix(np.arange(1, max(self.bands.values(), default=0) + 1, dtype=np.uint64))
        self.minima = [np.array([mix(x ^ s).min() for s in self.seeds]) for x in self.shingles]


def sliding_min(x: np.ndarray, width: int, stride: int) -> np.ndarray:
    """The least of each `width` items from each stride-th on; the last windows are cut short by the end."""
    n = len(x)
    out, have = x.copy(), 1
    while have < width:  # doubling: windows of `have` items become ones of up to twice that
        step = min(have, width - have)
        if step < n:
            out[: n - step] = np.minimum(out[: n - step], out[step:])
        have += step
    return out[::stride]


def sliding_minima(x: np.ndarray, classes: Iterable[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """sliding_min() of each (width, stride), over one doubling of the windows for all."""
    n, out, run, have = len(x), {}, x.copy(), 1
    for width, stride in sorted(classes):
        while 2 * have <= width:
            if have < n:
                run[: n - have] = np.minimum(run[: n - have], run[have:])
            have *= 2
        least, later = run[::stride].copy(), run[width - have :: stride]
        least[: len(later)] = np.minimum(least[: len(later)], later)
        out[width, stride] = least
    return out


def _best(rows: list[tuple]) -> list[tuple]:
    """Of (license, first word, last word, shingles, matched), those that no better one covers: matches whose overlap
    is half of the longer one or more are on one stretch; the higher containment wins, then the more words."""
    kept: list[tuple] = []
    for r in sorted(rows, key=lambda r: (-r[4] / r[3], -r[4], r)):
        if not any(2 * (min(r[2], k[2]) - max(r[1], k[1]) + 1) >= max(r[2] - r[1], k[2] - k[1]) + 1 for k in kept):
            kept.append(r)
    return sorted(kept)


def _scan(block: HashedWords, known: Templates) -> list[list[tuple]]:
    """For each text, (license, first word, last word, shingles, matched) of the verified matches."""
    found: list[dict] = [{} for _ in block.counts]
    words = block.name
    short: list[list[tuple]] = [[] for _ in found]
    for width in sorted({w for _, w, _ in known.short}):
        x = rolled(words, width)
        one = block.owner[: len(x)] == block.owner[width - 1 :][: len(x)]
        for name, _, wanted in (k for k in known.short if k[1] == width):
            for i in np.flatnonzero((x == wanted) & one).tolist():
                d = int(block.owner[i])
                short[d].append((name, i - int(block.starts[d]), i - int(block.starts[d]) + width - 1, 1, 1))
    x = rolled(words, SHINGLE)
    if not len(x) or not known.names:
        return [sorted(of) for of in short]
    inside = block.owner[: len(x)] == block.owner[SHINGLE - 1 :]
    minima = [sliding_minima(np.where(inside, mix(x ^ s), np.uint64((1 << 64) - 1)), [c for c, n in known.bands.items() if b < n]) for b, s in enumerate(known.seeds)]
    for (width, stride), members in known.classes.items():
        hits: set[tuple[int, int]] = set()
        for b in range(known.bands[width, stride]):
            least = minima[b][width, stride]
            values = np.array([known.minima[k][b] for k in members])
            order = np.argsort(values)
            at = np.clip(np.searchsorted(values[order], least), 0, len(values) - 1)
            for i in np.flatnonzero(values[order][at] == least).tolist():
                hits.update((k, i * stride) for k in np.array(members)[values == least[i]].tolist())
        for k, start in sorted(hits):
            shingles = known.shingles[k]
            held = np.flatnonzero(np.isin(x[start : start + width], shingles) & inside[start : start + width]) + start
            for d in np.unique(block.owner[held]).tolist():
                own = held[block.owner[held] == d]
                matched = len(np.unique(x[own]))
                if matched >= CONTAINMENT * len(shingles) - 1e-9:
                    base = int(block.starts[d])
                    span = (int(own[0]) - base, int(own[-1]) - base + SHINGLE - 1)
                    rows = found[d].setdefault(k, [])
                    if rows and rows[-1][0] <= span[0] <= rows[-1][1]:  # the windows overlap: one match
                        first, last, most = rows[-1]
                        rows[-1] = (first, max(last, span[1]), max(most, matched))
                    else:
                        rows.append((*span, matched))
    return [sorted([*few, *((known.names[k], a, b, len(known.shingles[k]), m) for k, rows in of.items() for a, b, m in rows)]) for few, of in zip(short, found, strict=True)]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FOUND, a row per input row: the stretches of words that hold 80 % or more of a template's five-word
    shingles, with the best template of each (all words of a template of fewer than five). A null or empty text has none. Repeated rows
    give their result each. Templates beyond MOST_BYTES are an error."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if sum(len(t.encode("utf-8", "surrogatepass")) for t in templates.values()) > MOST_BYTES:
        raise ValueError(f"templates of more than {MOST_BYTES} bytes: scan for them in several calls")
    sent = spark.sparkContext.broadcast(templates)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(sent.value)
        kind = pa.list_(pa.struct([("license", pa.string()), *((c, pa.int32()) for c in ("first_word", "last_word", "shingles", "matched"))]))
        names = ["license", "first_word", "last_word", "shingles", "matched"]
        for rows in blocks(batches, 2 << 20):
            block = HashedWords(folded_words(r[1]) for r in rows)
            merged = [[dict(zip(names, m, strict=True)) for m in _best(of)] for of in _scan(block, known)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(block.counts), pa.array(merged, kind)], names=["doc_id", "n_words", "licenses"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)
