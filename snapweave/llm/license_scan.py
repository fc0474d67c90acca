"""Licence scan: a trained paragraph classifier over sparse word n-grams, a calibrated unknown class, and template comparison.

A paragraph is a run of lines with words; marks of comments are no words. What is judged are its windows: each line, runs of
lines of up to WIDE words together, and stretches of WIDE words of longer lines, so that a notice is found where it is
wrapped and where it stands in a line among others.

The classifier is a multinomial logistic regression (Spark ML) over hashed one- and two-word grams. It learns from
the templates below, each in many cut and embedded forms, and from windows of the corpus that share
no three words in a row with any template, which are the unknown class. A temperature calibrates the probabilities: it is chosen
on templates that the classifier (trained without them) has not seen. A prediction is confirmed if the window holds a large part
of the three-word grams of a template of the predicted family.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import _PART, _line_pieces
from .scratch import Scratch
from .words import _SPOT, hash_runs, mix, runs, text_bytes, trimmed

BUCKETS = 1 << 13
#: Corpus windows of the unknown class that training sees: those of the least hash.
UNKNOWN_ROWS = 2000
#: Words of a window at most, lines of one of several lines, and words between the stretches of a longer line.
WIDE, LINES, STRIDE = 96, 12, 24
#: Forms made of each template.
FORMS = 60

# Sentences by which licence families are named or granted, from the public texts of the licences.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": [
        "This work has been dedicated to the public domain under CC0 1.0.",
        "No rights reserved. This work is in the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."],
}
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]


def _back(data: np.ndarray, first: int, low: int) -> int:
    """Where the LINES - 1 lines before `low`, a line's begin, start; not before `first`."""
    width = 1 << 16
    while True:
        begin = max(first, low - width)
        ends = np.flatnonzero(data[begin:low] == 10)
        if len(ends) >= LINES:
            return begin + int(ends[-LINES]) + 1
        if begin == first:
            return first
        width *= 4


def paragraphs(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Of all lines with words: (row, line from 0, word hashes, where each line's words begin and the last end, number of each line's paragraph, lines that have come before, places of the words' first bytes, places past their last).

    A text of over PIECE bytes comes in several parts, cut at line ends. A part begins with the LINES - 1 lines before it once more, so that every window lies whole in
    one part; windows of nothing but lines that have come before are left out by windows().
    """
    data, offsets = text_bytes(column)
    ahead: dict[int, int] = {}
    for row, stop, low, high in _line_pieces(data, offsets):
        back = _back(data, int(offsets[row]), low) if low > offsets[row] else low
        part = data[back:high]
        begins = np.clip(offsets[row : stop + 1] - back, 0, high - back)
        newline = np.flatnonzero(part == 10) + 1
        starts, ends = runs(part, _PART[part], np.concatenate([begins[:-1], newline[newline < len(part)]]))
        own = np.searchsorted(begins, starts, "right") - 1
        again = int(np.searchsorted(newline, low - back, "right"))  # lines of the part before
        line = np.searchsorted(newline, starts, "right") - np.searchsorted(newline, begins[:-1], "right")[own] + (ahead.get(row, 0) - again) * (own == 0)
        if stop == row + 1:
            ahead[row] = ahead.get(row, 0) + len(newline) - again
        if len(starts):
            cut = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (own[1:] != own[:-1])))
            row_of, line = row + own[cut], line[cut]
            fresh = np.append(True, (row_of[1:] != row_of[:-1]) | (line[1:] != line[:-1] + 1))
            old = int(np.searchsorted(starts[cut], low - back))
            yield row_of, line, hash_runs(part, starts, ends), np.append(cut, len(starts)), np.cumsum(fresh), old, back + starts, back + ends


def windows(begins: np.ndarray, paragraph: np.ndarray, old: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last word (past it), first line and number of lines of all windows that hold more than the `old` first lines."""
    size = np.diff(begins)
    own = np.arange(len(size)) >= old
    short, long = np.flatnonzero((size <= WIDE) & own), np.flatnonzero((size > WIDE) & own)
    out = [(begins[short], begins[short + 1], short, np.ones(len(short), np.int64))]
    for k in long.tolist():
        at = np.append(np.arange(begins[k], begins[k + 1] - WIDE, STRIDE), begins[k + 1] - WIDE)
        out.append((at, at + WIDE, np.full(len(at), k), np.ones(len(at), np.int64)))
    for n in range(2, min(LINES, len(size)) + 1):
        at = np.flatnonzero((paragraph[n - 1 :] == paragraph[: len(size) - n + 1]) & (begins[n:] - begins[: len(begins) - n] <= WIDE))
        if not len(at):
            break
        at = at[at + n > old]
        out.append((begins[at], begins[at + n], at, np.full(len(at), n)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def grams(words: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each place on; 0 where a paragraph ends before."""
    out = np.zeros(len(words), np.uint64)
    n = len(words) - size + 1
    if n > 0:
        total = words[:n] * _SPOT[0]
        for k in range(1, size):
            total = total + words[k : n + k] * _SPOT[k]
        left = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(words))
        out[:n] = np.where(left[:n] >= size, mix(total, size), np.uint64(0))
    return out


def _buckets(words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the one- and the two-word gram that begin at each word (-1: none); `begins` are those of paragraphs."""
    two = grams(words, begins, 2)
    low = np.uint64(BUCKETS - 1)
    return (mix(words, 21) & low).astype(np.int64), np.where(two == 0, -1, (two & low).astype(np.int64))


def _words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [(w, b) for _, _, w, b, *_ in paragraphs(pa.array([t.replace("\n", " ") for t in texts]))]
    words = np.concatenate([w for w, _ in found])
    sizes = np.concatenate([np.diff(b) for _, b in found])
    return words, np.append(0, np.cumsum(sizes))


def _ends_of(begins: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    """Where each paragraph's words begin and the last end."""
    return np.append(begins[:-1][np.append(True, paragraph[1:] != paragraph[:-1])], begins[-1])


def _template_grams(size: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct grams over all templates with the number of each template that holds them (as pairs), templates' families and sizes."""
    pairs, family, sizes = set(), [], []
    for k, texts in enumerate(TEMPLATES.values()):
        for text in texts:
            words, begins = _words_of([text])
            own = {int(g) for g in grams(words, begins, min(size, len(words))) if g}
            pairs |= {(g, len(family)) for g in own}
            family.append(k)
            sizes.append(len(own))
    flat = sorted(pairs)
    return np.array([g for g, _ in flat], np.uint64), np.array([t for _, t in flat]), np.array(family), np.array(sizes)


def _forms(seed: int) -> list[tuple[str, int, bool]]:
    """Training texts of the families, a template whole, cut short, or with other words around it; and whether it is of its family's last template of several."""
    random = np.random.Generator(np.random.PCG64(seed))
    out = []
    for k, texts in enumerate(TEMPLATES.values()):
        for at, text in enumerate(texts):
            words = text.split()
            for n in range(FORMS):
                part = list(words)
                if n % 3 == 1 and len(part) > 6:
                    keep = int(random.integers(6, len(part) + 1))
                    first = int(random.integers(0, len(part) - keep + 1))
                    part = part[first : first + keep]
                if n % 3 == 2:
                    noise = [f"w{x}" for x in random.integers(0, 10**9, 8)]
                    part = noise[: int(random.integers(0, 5))] + part + noise[4 : 4 + int(random.integers(0, 5))]
                out.append((" ".join(part), k, at == len(texts) - 1 > 0))
    return out


def train(spark: SparkSession, docs: DataFrame, unknown_rows: int = UNKNOWN_ROWS, steps: int = 30, scratch: Scratch | None = None) -> dict:
    """Weights (BUCKETS x families), intercepts and temperature. Of the corpus's windows training sees a bounded sample: the `unknown_rows` of least hash.

    A corpus without text leaves the unknown class without examples; it then is never predicted.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    known = _template_grams()[0]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each task the windows of least hash that share no gram with a template; a bounded number."""
        best: list[tuple[int, list[int]]] = []
        for batch in batches:
            for _, _, words, begins, paragraph, old, _, _ in paragraphs(batch.column(0)):
                start, end, _, _ = windows(begins, paragraph, old)
                three = np.append(0, np.cumsum(np.isin(grams(words, _ends_of(begins, paragraph), 3), known)))
                shared = three[np.maximum(end - 2, start)] > three[start]
                total = np.append(np.uint64(0), np.cumsum(mix(words, 31), dtype=np.uint64))
                code = mix(total[end] - total[start]).view(np.int64)
                worst = best[-1][0] if len(best) >= unknown_rows else 2**63 - 1
                fresh = np.flatnonzero(~shared & (code < worst))
                fresh = fresh[np.argsort(code[fresh])][:unknown_rows]
                best += [(int(code[k]), words[start[k] : end[k]].view(np.int64).tolist()) for k in fresh.tolist()]
                best = sorted({c: (c, w) for c, w in best}.values())[:unknown_rows]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in best], pa.int64()), pa.array([w for _, w in best], pa.list_(pa.int64()))], ["code", "words"])

    scratch = scratch or Scratch(spark, "licence")
    best = scratch.table(docs.select("text").mapInArrow(trimmed(plain), "code long, words array<long>"), "best")
    last = best.select("code").distinct().orderBy("code").limit(unknown_rows).agg(F.max("code").alias("code")).first().code  # codes alone, of each task of the distinct unknown_rows at most
    sample = best.where(F.col("code") <= (0 if last is None else last)).dropDuplicates(["code"]).collect()  # unknown_rows at most
    sample.sort(key=lambda r: r.code)
    rows = []

    def add(words: np.ndarray, begins: np.ndarray, labels: list[int], held: list[bool]) -> None:
        one, two = _buckets(words, begins)
        for k, label in enumerate(labels):
            a, b = begins[k], begins[k + 1]
            own = np.concatenate([one[a:b], two[a:b]])
            index, number = np.unique(own[own >= 0], return_counts=True)
            rows.append((float(label), SparseVector(BUCKETS, index.tolist(), (number / np.sqrt(2 * (b - a) - 1)).tolist()), held[k]))

    forms = _forms(1)
    add(*_words_of([t for t, _, _ in forms]), [k for _, k, _ in forms], [h for _, _, h in forms])
    if sample:
        add(np.concatenate([np.array(r.words, np.int64) for r in sample]).view(np.uint64), np.append(0, np.cumsum([len(r.words) for r in sample])), [len(TEMPLATES)] * len(sample), [k % 4 == 3 for k in range(len(sample))])
    kind = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT()), StructField("held", BooleanType())])
    data = spark.createDataFrame(rows, kind)  # the bounded sample

    def fitted(data: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        model = LogisticRegression(maxIter=steps, regParam=1e-4, family="multinomial", standardization=False).fit(data)
        families = model.coefficientMatrix.numRows
        weights, bias = np.zeros((BUCKETS, len(FAMILIES))), np.full(len(FAMILIES), -30.0)
        weights[:, :families] = model.coefficientMatrix.toArray().T
        bias[:families] = model.interceptVector.toArray()
        return weights, bias

    weights, bias = fitted(data.where("not held"))
    logits = np.array([bias + weights[f.indices].T @ f.values for _, f, held in rows if held])
    truth = np.array([int(y) for y, _, held in rows if held])

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    weights, bias = fitted(data)
    return {"weights": weights.astype(np.float32), "bias": bias, "temperature": temperature}


def _settled(hits: list[tuple], until: int | None) -> tuple[list[tuple], list[tuple]]:
    """Of windows (first byte, past the last, order, number of words, row to give) the rows of those that are reported, and windows that later ones from byte `until` on may overlap (None: none come).

    Windows that overlap, directly or by others between, are a run; within it the first in order that overlaps none before it is reported, again and again.
    """
    out: list[tuple] = []
    run: list[tuple] = []
    reach = -1

    def settle() -> None:
        taken: list[tuple[int, int]] = []  # in order of place
        for low, high, _, _, row in sorted(run, key=lambda h: (h[2], h[3], h[0], h[4])):
            at = bisect_left(taken, (low, high))
            if (at == 0 or taken[at - 1][1] <= low) and (at == len(taken) or taken[at][0] >= high):
                taken.insert(at, (low, high))
                out.append(row)

    for hit in sorted(hits, key=lambda h: h[0]):
        if hit[0] >= reach:
            settle()
            run = []
        run.append(hit)
        reach = max(reach, hit[1])
    if until is not None and reach > until:
        return out, run
    settle()
    return out, []


def scan(docs: DataFrame, model: dict, least: float = 0.5, confirm: float = 0.6) -> DataFrame:
    """One row per window that is of a licence family: doc_id, line_no (its first line), n_lines, family, probability, template_share, confirmed.

    Every window of every whole text is scored. It counts if its best family is not unknown and has a
    calibrated probability of at least `least`. Of windows that overlap one is reported: that of the largest template_share,
    then the one of fewest words. It is confirmed if it holds the share `confirm` of the three-word grams of one
    template of that family. Null and empty texts and lines without words have none. Columns other than doc_id and text are
    not read. Empty in, empty out.
    """
    known, template, family, sizes = _template_grams()
    held = docs.sparkSession.sparkContext.broadcast(model["weights"])  # BUCKETS x families
    bias, temperature = model["bias"], model["temperature"]
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int64()), ("n_lines", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("template_share", pa.float64()), ("confirmed", pa.bool_())])

    def told(batch: pa.RecordBatch, out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            columns = list(zip(*sorted(out), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[1:], strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.vstack([held.value, np.zeros((1, len(FAMILIES)), np.float32)])  # the last row is for no gram
        for batch in batches:
            held_hits: list[tuple] = []
            for row, line, words, begins, paragraph, old, opens, closes in paragraphs(batch.column(1)):
                if held_hits:  # no window to come begins before this part
                    out, held_hits = _settled(held_hits, int(opens[0]))
                    yield from told(batch, out)
                start, end, first, lines = windows(begins, paragraph, old)
                one, two = _buckets(words, _ends_of(begins, paragraph))
                sums = [np.zeros((len(words) + 1, len(FAMILIES))) for _ in range(2)]
                for total, bucket in zip(sums, (one, two), strict=True):
                    np.cumsum(weights[bucket], axis=0, dtype=np.float64, out=total[1:])
                logits = (sums[0][end] - sums[0][start] + sums[1][np.maximum(end - 1, start)] - sums[1][start]) / np.sqrt(2 * (end - start) - 1)[:, None]
                logits = (logits + bias) / temperature
                best = logits.argmax(axis=1)
                hits = np.flatnonzero(best < len(TEMPLATES))
                chance = np.exp(logits[hits] - logits[hits].max(axis=1, keepdims=True))
                chance = chance.max(axis=1) / chance.sum(axis=1)
                hits, chance = hits[chance >= least], chance[chance >= least]
                for k, p in zip(hits.tolist(), chance.tolist(), strict=True):
                    part, ends = words[start[k] : end[k]], np.array([0, end[k] - start[k]])
                    own = np.concatenate([grams(part, ends, s) for s in (1, 2, 3)])
                    count = np.bincount(template[np.isin(known, own)], minlength=len(sizes)) / np.maximum(sizes, 1)
                    share = float(count[family == best[k]].max())
                    held_hits.append((int(opens[start[k]]), int(closes[end[k] - 1]), -share, int(end[k] - start[k]), (int(row[first[k]]), int(line[first[k]]), int(lines[k]), FAMILIES[best[k]], p, share, share >= confirm)))
            yield from told(batch, _settled(held_hits, None)[0])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, line_no long, n_lines long, family string, probability double, template_share double, confirmed boolean")
