"""License scan by diagonal voting.

All rolling word k-gram hashes of all texts are joined to the positions of the templates' k-grams (a table as small as the
templates, which are a parameter and checked against a bound before it is broadcast). A hit votes for the diagonal
document position - template position. Votes are counted per diagonal, and diagonals at most `slack` apart are merged (words put
in or left out shift the diagonal). A merged stretch whose votes make up `votes` of the template's k-grams is a candidate. Its words, with
the room at both ends that its votes leave open, are then compared with the template's word by word: the span accepted is
what the words have in common, in order, if that is enough of the template and of the span.

Beside that, fixed phrases are found wherever their words stand consecutively.

Defined results: a null text is an empty text: no words, no labels, score 0. Rows that repeat doc_id and text give repeated
result rows with equal values. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.wordhash import ALNUM, WordHasher, grams, runs
from strata.runtime import ship

#: Phrases and labels of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Whole short licenses, and the openings and notices of others. Their words are matched as in the texts.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("arr", "All rights reserved. No part of this publication may be reproduced"),
)
MOST_TEMPLATE_GRAMS = 100_000


@dataclass(frozen=True)
class LicenseParams:
    k: int = 3
    slack: int = 3
    votes: float = 0.4  # of the template's k-grams, for a candidate
    cover: float = 0.75  # of the template's words, in the span
    dense: float = 0.6  # of the span's words, in the template
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())


def template_grams(p: LicenseParams) -> list[tuple[int, int, int, int]]:
    """(hash, template, position, words) of every k-gram of every template."""
    hasher, out = WordHasher(ALNUM), []
    for t, (_, text) in enumerate(p.templates):
        words = hasher.batch([text.encode()])
        _, h = grams(words, p.k)
        out += [(int(x), t, i, int(words.counts[0])) for i, x in enumerate(h.view(np.int64))]
    if len(out) > MOST_TEMPLATE_GRAMS:
        raise ValueError(f"the templates have {len(out)} k-grams; {MOST_TEMPLATE_GRAMS} may be broadcast")
    return out


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def base_scan(docs: DataFrame, p: LicenseParams) -> DataFrame:
    """doc_id, h, n_words, n_base, first_word, last_word, base (labels of the phrases found)."""
    ship(docs.sparkSession)

    def run(batches):
        hasher = WordHasher(ALNUM)
        wanted = [(hasher.batch([phrase.encode()]).hash, label) for phrase, label in p.phrases]
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            n, count, first, last, labels = [], [], [], [], []
            for lo, hi in runs(texts):
                w = hasher.batch(texts[lo:hi])
                begin = np.cumsum(w.counts) - w.counts
                found: dict[int, list] = {}
                for seq, label in wanted:
                    at = np.flatnonzero(w.hash == seq[0])
                    at = at[at + len(seq) <= len(w.hash)]
                    for j in range(1, len(seq)):
                        at = at[w.hash[at + j] == seq[j]]
                    at = at[w.doc[at] == w.doc[at + len(seq) - 1]]
                    for d, x in zip(w.doc[at].tolist(), at.tolist(), strict=True):
                        found.setdefault(d, []).append((x - int(begin[d]), label))
                n += w.counts.tolist()
                for d in range(hi - lo):
                    f = found.get(d, [])
                    count.append(len(f))
                    first.append(min(f)[0] if f else None)
                    last.append(max(f)[0] if f else None)
                    labels.append(sorted({x for _, x in f}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (n, count, first, last)), pa.array(labels, pa.list_(pa.string()))], names=["doc_id", "h", "n_words", "n_base", "first_word", "last_word", "base"])

    return _rows(docs).mapInArrow(run, "doc_id long, h long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def license_spans(docs: DataFrame, p: LicenseParams | None = None) -> DataFrame:
    """Accepted spans: doc_id, h, template, label, first_word, end_word, cover (the words in common, of the longer of template and span). Real output of the operator."""
    spark = docs.sparkSession
    ship(spark)
    p = p or LicenseParams()

    def run(batches):
        hasher = WordHasher(ALNUM)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            for lo, hi in runs(texts, 4 << 20):
                doc, h = [], []
                for a, b in runs(texts[lo:hi]):
                    d, g = grams(hasher.batch(texts[lo + a : lo + b]), p.k)
                    doc.append(d + a)
                    h.append(g)
                doc, h = np.concatenate(doc), np.concatenate(h)
                offsets = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], names=["doc_id", "h", "grams"])

    all_grams = _rows(docs).mapInArrow(run, "doc_id long, h long, grams array<long>").select("doc_id", "h", F.posexplode("grams").alias("pos", "gram"))
    places = spark.createDataFrame(template_grams(p), "gram long, template int, tpos int, twords int")
    hits = all_grams.join(F.broadcast(places), "gram")
    key = ["doc_id", "h", "template"]
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy(*key, "twords", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    w = Window.partitionBy(*key).orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > p.slack, F.lit(True)).cast("int")
    merged = votes.withColumn("island", F.sum(far).over(w)).groupBy(*key, "twords", "island").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("diagonal"), F.max("diagonal").alias("last"))
    grams_of = F.greatest(F.col("twords") - (p.k - 1), F.lit(1))
    likely = merged.where(F.col("votes") >= p.votes * grams_of).select("doc_id", "h", F.struct("template", (F.col("diagonal") - p.slack).alias("a"), (F.col("last") + F.col("twords") + p.slack).alias("b")).alias("c"))
    wanted = likely.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set("c").alias("spans"))
    texts = _rows(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("doc_id", "h", "text", "spans").dropDuplicates(["doc_id", "h"])
    return texts.mapInArrow(_verify(p), "doc_id long, h long, template int, label string, first_word long, end_word long, cover double")


def common(template: np.ndarray, span: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches (place in template, place in span, words) that both have in common, in order."""
    return [tuple(m) for m in SequenceMatcher(None, template.tolist(), span.tolist(), autojunk=False).get_matching_blocks() if m.size]


def _verify(p: LicenseParams):
    """Compares candidate spans with their templates word by word."""

    def run(batches):
        hasher = WordHasher(ALNUM)
        templates = [hasher.batch([t.encode()]).hash for _, t in p.templates]
        for batch in batches:
            out = []
            for doc_id, h, text, spans in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                words = hasher.batch([text]).hash
                for s in spans:
                    t, a = templates[s["template"]], max(0, s["a"])
                    m = common(t, words[a : max(0, s["b"])])
                    while len(m) > 1 and m[0][2] == 1:  # a word in common by chance before or after the span
                        m = m[1:]
                    while len(m) > 1 and m[-1][2] == 1:
                        m = m[:-1]
                    if not m:
                        continue
                    first, end, same = a + m[0][1], a + m[-1][1] + m[-1][2], sum(x[2] for x in m)
                    if same >= p.cover * len(t) and same >= p.dense * (end - first):
                        out.append((doc_id, h, s["template"], p.templates[s["template"]][0], first, end, same / max(len(t), end - first)))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "h", "template", "label", "first_word", "end_word", "cover"])

    return run


def license_digest(docs: DataFrame, p: LicenseParams | None = None) -> DataFrame:
    p = p or LicenseParams()
    base = base_scan(docs, p)
    per = license_spans(docs, p).groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set("label").alias("found"), F.max("cover").alias("score"))
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    out = base.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(F.concat("base", F.coalesce("found", none))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
