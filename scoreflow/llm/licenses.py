"""License scans by diagonal voting.

All rolling word k-grams of the documents (one hash for short phrases, one for license texts) meet
the positions of the same k-grams in the templates in a Spark join; the templates are constants of this
module, so their side is broadcast. Each hit votes for its diagonal (word minus template position).
A phrase needs every k-gram on one diagonal. For a text, neighbouring diagonals merge, so
that inserted or missing words do not split a span, and the span's words are then verified in the
document: the share of template words that stand there in order must reach ``COVER``, and they must be ``DENSE``
of the span, so that a long chain of scattered diagonals is no license. Of several templates of one label each
has its own span; a whole license and its first passage are both found in it. Where licenses differ by a few words, as
the GNU ones do, a span gives way to one of another label that fits better and holds over half of its words.

Words: A-Z lower-cased, maximal runs of ASCII digits, letters and non-ASCII characters.

Defined cases: a null or empty text has no words, no places and score 0; rows repeated under one
doc_id are judged by (doc_id, hash of the text); empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scoreflow.llm.common import ALNUM, hashed, mixed, rolling, slices, texts_of, word_hashes

# Phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# License texts, notices and passages of them with their labels.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license you may obtain a copy of the license at"),
    ("apache", "distributed under the license is distributed on an as is basis without warranties or conditions of "
               "any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
             "lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
            "was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("apache", "licensed under the apache license version"),
    ("mit", "released under the mit license"),
    ("cc-by", "licensed under cc by"),
    # Whole licenses and notices as they are published.
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law."""),
    ("bsl", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:"""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("gpl", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
work."""),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]
#: k of phrases and of license texts.
PHRASE_K, TEXT_K = 2, 4
#: Diagonals of one template that are at most so far apart belong to one span.
NEAR = 6
#: Least share of a template's words that a span holds in order.
COVER = 0.8
#: Least share of a span's words that are the template's, between the first and the last of its runs of ``TEXT_K`` words.
DENSE = 0.6
SPANS = "doc_id long, key long, spans array<struct<template:int,first:long,last:long>>"


def templates() -> list[tuple[str, list[bytes], int]]:
    """(label, words, k); the phrases first."""
    short = [(label, phrase.encode().split(), PHRASE_K) for phrase, label in PHRASES.items()]
    return short + [(label, text.encode().translate(ALNUM).split(), TEXT_K) for label, text in TEXTS]


def _verified(here: list[bytes], wanted: list[bytes]) -> tuple[int, int, float, float]:
    """First and last word of a text in a merged run of diagonals, the template's share found in order, and the span's."""
    same = [m for m in SequenceMatcher(None, here, wanted, autojunk=False).get_matching_blocks() if m.size]
    ends = [m for m in same if m.size >= TEXT_K] or same
    if not ends:
        return 0, 0, 0.0, 0.0
    first, last = ends[0].a, ends[-1].a + ends[-1].size - 1
    held = sum(m.size for m in same if first <= m.a <= last)
    return first, last, held / len(wanted), held / (last - first + 1)


def _fitting(found: list[dict]) -> list[dict]:
    """Verified spans of license texts without those that another label fits better at the same place."""

    def beaten(s: dict) -> bool:
        return any(
            o["label"] != s["label"] and o["fit"] > s["fit"]
            and 2 * (min(o["last"], s["last"]) - max(o["first"], s["first"]) + 1) > s["last"] - s["first"] + 1
            for o in found if not o["base"]
        )

    return [s for s in found if s["base"] or not beaten(s)]


def _grams(docs: DataFrame) -> DataFrame:
    """(doc_id, key, word, g2, g4): the k-gram hashes that start at each word; null at the text's end."""

    def emit(batches):
        cache = word_hashes()
        for batch in batches:
            texts, ids, keys = texts_of(batch), batch.column("doc_id"), batch.column("key").to_numpy()
            for lo, hi in slices(texts, 1 << 20):
                words = [(t or b"").translate(ALNUM).split() for t in texts[lo:hi]]
                sizes = np.array([len(w) for w in words])
                flat = hashed([w for x in words for w in x], cache)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                left = np.repeat(sizes, sizes) - place
                grams = []
                for k in (PHRASE_K, TEXT_K):
                    h = np.zeros(len(flat), np.int64)
                    own = mixed(rolling(flat, k)).view(np.int64)
                    h[: len(own)] = own
                    grams.append(pa.array(h, mask=left < k))
                at = pa.array(np.repeat(np.arange(lo, hi), sizes))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), pa.array(np.repeat(keys[lo:hi], sizes)), pa.array(place), *grams],
                    ["doc_id", "key", "word", "g2", "g4"],
                )

    return docs.mapInArrow(emit, "doc_id long, key long, word long, g2 long, g4 long")


def _places(spark) -> DataFrame:
    """(gram, template, position) of all templates: some hundreds of rows."""
    rows, cache = [], word_hashes()
    for no, (_, words, k) in enumerate(templates()):
        grams = mixed(rolling(hashed(words, cache), k)).view(np.int64)
        rows += [(int(g), no, i) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, position long")


def _spans(grams: DataFrame) -> DataFrame:
    """Candidate spans of each document: full phrases, and merged diagonals of license texts."""
    hits = grams.select("doc_id", "key", "word", F.explode(F.array("g2", "g4")).alias("gram"))
    hits = hits.join(F.broadcast(_places(grams.sparkSession)), "gram")
    votes = hits.groupBy("doc_id", "key", "template", (F.col("word") - F.col("position")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("word").alias("first"), F.max("word").alias("last")
    )
    full = {no: len(words) - k + 1 for no, (_, words, k) in enumerate(templates()) if k == PHRASE_K}
    width = F.when(F.col("template") < len(full), PHRASE_K).otherwise(TEXT_K)
    needed = F.element_at(F.create_map(*[F.lit(x) for pair in full.items() for x in pair]), F.col("template"))
    # Rows repeated under one key vote twice; what that lets through fails the check of its words.
    phrases = votes.where((F.col("template") < len(full)) & (F.col("votes") >= needed))
    texts = votes.where(F.col("template") >= len(full))
    order = W.partitionBy("doc_id", "key", "template").orderBy("diagonal", "first")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR) | (F.col("first") - F.lag("last").over(order) > 4 * NEAR)
    texts = texts.withColumn("run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order))
    texts = texts.groupBy("doc_id", "key", "template", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    span = F.struct("template", "first", (F.col("last") + width - 1).alias("last"))
    both = phrases.select("doc_id", "key", span.alias("s")).union(texts.select("doc_id", "key", span.alias("s")))
    return both.groupBy("doc_id", "key").agg(F.collect_list("s").alias("spans"))


def license_places(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, spans (label, first, last, cover, base) that were verified."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    spans = _spans(_grams(rows)).withColumnRenamed("doc_id", "id2").withColumnRenamed("key", "key2")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    known = [(label, words, k == PHRASE_K) for label, words, k in templates()]
    kind = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64()), ("base", pa.bool_())])

    def verify(batches):
        for batch in batches:
            sizes, out = [], []
            for text, found in zip(texts_of(batch), batch.column("spans").to_pylist()):
                words, kept = text.translate(ALNUM).split(), []
                for s in found or []:
                    label, wanted, base = known[s["template"]]
                    here = words[s["first"] : s["last"] + 1]
                    if base:
                        first, last, cover, dense = 0, len(here) - 1, float(here == wanted), 1.0
                    else:
                        first, last, cover, dense = _verified(here, wanted)
                    if cover >= (1 if base else COVER) and dense >= DENSE:
                        kept.append(
                            {"label": label, "first": s["first"] + first, "last": s["first"] + last, "cover": cover, "base": base, "fit": cover * dense}
                        )
                sizes.append(len(words))
                kept = [{k: s[k] for k in ("label", "first", "last", "cover", "base")} for s in _fitting(kept)]
                out.append(sorted(kept, key=lambda s: (s["first"], s["last"], s["label"], s["base"])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(kind))],
                ["doc_id", "n_words", "spans"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(
        verify, "doc_id long, n_words long, spans array<struct<label:string,first:long,last:long,cover:double,base:boolean>>"
    )
