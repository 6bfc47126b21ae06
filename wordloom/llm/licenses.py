"""Operator 2: licence scan by a positional index of rare tokens, in native expressions.

Templates are licence texts and notices.  A first pass counts in how many
texts of the corpus each of their words stands; the index holds, for each
template, its words of highest inverse document frequency (``rare``: an eighth
of its words, 4 to 12) with all their positions.  Then every whole text is
split into words, the places of its index words are looked up, and the
postings of a template are intersected by relative position (place in the
text less place in the template; places up to ``SLACK`` words out of line
still meet).  The best such offset scores the share of the template's rare
weight found there.  A template counts if that reaches ``THRESHOLD`` and one
of its mandatory key phrases, verified last, stands where the template does.

Base labels (fixed phrases) are found in the same pass, place by place, and
stay whatever the index says.  ``score`` is the largest share of a template of
one of the row's labels, 0 where there is none.

Null text is empty.  Rows that repeat a doc_id and a text share one lookup and
are returned apiece.  Words of equal frequency are taken in the order of the
template; labels are sorted, so ties cannot change the result.  An empty table
gives an empty table.  Only doc_id and text are read, whatever other columns
are named.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import ASCII_LOWER, ASCII_UPPER, materialize, text_of

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Texts and notices of public licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."""

#: (label, text, mandatory key phrases, one of which must stand there)
TEMPLATES = (
    ("mit", "released under the MIT license", ("mit license",)),
    ("mit", _MIT, ("deal in the software without restriction", "permission is hereby granted free of charge")),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", _APACHE, ("apache license version 2 0",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    ("gpl-3.0", _GNU.format("General", "3", "General"), ("either version 3 of the license",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("general public license version 2",)),
    ("gpl-2.0", _GNU.format("General", "2", "General"), ("either version 2 of the license",)),
    ("gpl", "licensed under the GNU General Public License", ("general public license",)),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("lgpl", _GNU.format("Lesser General", "3", "Lesser General"), ("lesser general public license",)),
    ("agpl-3.0", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("agpl-3.0", _GNU.format("Affero General", "3", "Affero General"), ("affero general public license",)),
    ("bsd-2-clause", f"{_BSD} {_BSD_END}", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", f"{_BSD} {_BSD_3} {_BSD_END}", ("endorse or promote products",)),
    ("mpl-2.0", _MPL, ("mozilla public license",)),
    ("isc", _ISC, ("for any purpose with or without fee",)),
    ("zlib", _ZLIB, ("origin of this software must not be misrepresented",)),
    ("unlicense", _UNLICENSE, ("free and unencumbered software",)),
    ("bsl-1.0", _BOOST, ("any person or organization obtaining a copy",)),
    ("cc-by", "licensed under CC BY 4.0", ("cc by",)),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
)
THRESHOLD = 0.6
#: Words by which places of one template may be out of line.
SLACK = 4
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def idf(texts: int, holding: int) -> float:
    return math.log(1 + (texts + 1) / (holding + 1))


def postings(frequency: dict[str, int], texts: int, templates=TEMPLATES) -> list[tuple[int, str, int, float]]:
    """(template, word, position, weight): each template's rarest words at all their places; weights of a template's words sum to 1."""
    out = []
    for t, (_, text, _) in enumerate(templates):
        ws = words_of(text)
        rarity = {w: idf(texts, frequency.get(w, 0)) for w in ws}
        chosen = sorted(rarity, key=lambda w: (-rarity[w], ws.index(w)))[: min(12, max(4, len(ws) // 8))]
        total = sum(rarity[w] for w in chosen)
        out += [(t, w, at, rarity[w] / total) for at, w in enumerate(ws) if w in chosen]
    return out


def _places(words: Column, phrase: list[str], anchor: int, hits: Column) -> Column:
    """Places of a phrase, from those (i, w) among ``hits`` of its word number ``anchor``."""

    def here(x: Column) -> Column:
        test = (x["w"] == phrase[anchor]) & (x["i"] >= anchor)
        for k, w in enumerate(phrase):
            if k != anchor:
                test = test & F.coalesce(F.get(words, x["i"] + (k - anchor)) == w, F.lit(False))
        return test

    return F.transform(F.filter(hits, here), lambda x: x["i"] - anchor)


def _named(t: int, places: Column) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(t).alias("t"), i.alias("i")))


def _words(docs: DataFrame) -> DataFrame:
    low = F.translate(text_of(), ASCII_UPPER, ASCII_LOWER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_t"), F.array_remove(F.split(low, _SPLIT), "").alias("w"))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each word of a vocabulary stands; as many rows as it has words reach the driver."""
    found = _words(docs).select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), "w")).alias("x"))
    return {r["x"]: r["n"] for r in found.groupBy("x").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    phrases = [(t, p.split()) for t, (_, _, many) in enumerate(templates) for p in many]
    base = [(label, p.split()) for p, label in BASE]
    vocabulary = sorted({w for _, text, _ in templates for w in words_of(text)} | {w for _, p in phrases + base for w in p})
    frequency, texts = frequencies(docs, vocabulary), docs.count()
    index = postings(frequency, texts, templates)

    def anchor(phrase: list[str]) -> int:
        return min(range(len(phrase)), key=lambda k: (frequency.get(phrase[k], 0), k))

    wanted = sorted({w for _, w, _, _ in index} | {p[anchor(p)] for _, p in phrases + base})
    hit = _words(docs).select("*", F.arrays_overlap("w", F.array(*map(F.lit, wanted))).alias("_hit"))
    none = F.array().cast("array<struct<i:int,w:string>>")
    found = hit.select("*", F.when(F.col("_hit"), F.filter(F.transform("w", lambda w, i: F.when(w.isin(wanted), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())).otherwise(none).alias("h"))
    some = F.size("h") > 0
    verified = F.concat(*[_named(t, _places(F.col("w"), p, anchor(p), F.col("h"))) for t, p in phrases])
    own = found.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.when(some, F.xxhash64("doc_id", "_t", F.lit(1))).alias("key"), F.when(some, F.xxhash64("doc_id", "_t", F.lit(2))).alias("key2"), "h",
        *[F.when(some, _places(F.col("w"), p, anchor(p), F.col("h"))).alias(f"b{k}") for k, (_, p) in enumerate(base)], F.when(some, verified).alias("phrases"),
    )
    own = materialize(own, "licence-hits")

    # the postings of all templates are a bounded list of a few hundred rows
    lookup = F.broadcast(spark.createDataFrame(index, "t int, word string, place int, weight double"))
    names = F.broadcast(spark.createDataFrame([(t, label, len(words_of(text))) for t, (label, text, _) in enumerate(templates)], "t int, label string, size int"))
    rows = own.where(some).select("key", "key2", "phrases", F.explode("h").alias("x"))
    at = rows.join(lookup, F.col("x.w") == F.col("word")).select("key", "key2", "phrases", "t", "word", (F.col("x.i") - F.col("place")).alias("shift"), "weight")
    # two rows of bins, half a bin apart: offsets up to SLACK words apart share one
    wide = F.lit(2 * SLACK)
    bins = at.select("key", "key2", "phrases", "t", "word", "weight", F.explode(F.array(*[(F.floor((F.col("shift") + k) / wide) * wide - k).cast("int") for k in (0, SLACK)])).alias("low"))
    # a word counts once at an offset, however often it stands there
    once = bins.groupBy("key", "key2", "t", "low", "word").agg(F.max("weight").alias("weight"), F.any_value("phrases").alias("phrases"))
    offsets = once.groupBy("key", "key2", "t", "low").agg(F.sum("weight").alias("weight"), F.any_value("phrases").alias("phrases")).join(names, "t")
    stands = F.exists("phrases", lambda p: (p["t"] == F.col("t")) & (p["i"] >= F.col("low") - SLACK) & (p["i"] < F.col("low") + F.col("size") + 3 * SLACK))
    share = F.round(F.least(F.lit(1.0), "weight"), 6)
    best = offsets.groupBy("key", "key2", "label").agg(F.max(share).alias("share"), F.max((F.col("weight") >= THRESHOLD - 1e-9) & stands).alias("found"))
    more = best.groupBy("key", "key2").agg(F.collect_list(F.struct("label", "share", "found")).alias("_more"))

    places = [F.coalesce(f"b{k}", F.array().cast("array<int>")) for k in range(len(base))]
    every = F.flatten(F.array(*places))
    named = F.filter(F.array(*[F.when(F.size(p) > 0, label) for p, (label, _) in zip(places, base)]), lambda x: x.isNotNull())
    stats = own.select("doc_id", "n_words", "key", "key2", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), named.alias("_base"))
    # rows without hits have no key and need no join
    plain = stats.where("key is null").select("*", F.array().cast("array<struct<label:string,share:double,found:boolean>>").alias("_more"))
    joined = stats.where("key is not null").join(more, ["key", "key2"], "left").select(*stats.columns, F.coalesce("_more", F.array().cast("array<struct<label:string,share:double,found:boolean>>")).alias("_more"))
    both = plain.unionByName(joined)
    labels = F.array_union("_base", F.transform(F.filter("_more", lambda m: m["found"]), lambda m: m["label"]))
    shares = F.transform(F.filter("_more", lambda m: m["found"] | F.array_contains("_base", m["label"])), lambda m: m["share"])
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )
