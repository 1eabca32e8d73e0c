"""License scans: base phrases, and an exact set-similarity join with templates (DataFrame functions only).

A text block matches a template when it holds at least ``threshold`` of the
template's distinct words.  Blocks are all windows of the text's words, over
line ends, ``slack`` times as long as the template: notices are found wherever
they stand, wrapped, in comments, or inside a longer line.  Words are ordered by
how many documents hold them, rarest first, counted over all documents.  Three
filters come before the exact overlap:

* prefix: a match holds one of the template's first ``n - need + 1`` words, so
  only windows around such words are looked at;
* length: the words around it hold at least ``need`` of the template's;
* position: a window is judged from its rarest shared word, and only words from
  there on in the order count, so that enough must follow.

The templates are a fixed relation of a few rows, so the join runs where the
documents are, without a shuffle; only the counts of their words, a table as
long as the vocabulary, reach the driver.  A block may meet several templates
(the notices of one family share most words); all their labels are given.

Rules: null text counts as empty: no words, no labels, score 0; so do texts of
white space or signs.  Repeated rows are scanned one by one, ties of frequency
go by the word, and every match counts, so no order matters.  Texts of any
length are scanned whole; the cost is that of splitting them, and a window for
each rare word.  An empty table gives none.  A column ``license`` is replaced;
other columns stay, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.store import LOWER, UPPER, bind

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed value: what stands between words.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Public notices and licences, whole or by the paragraph that names them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:",
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
        "all copies.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, "
        "display, distribute, execute, and transmit the Software",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
)


def words_of(s: str) -> list[str]:
    return [w for w in re.split(BREAKS, s.lower()) if w]


def word_list(s: str) -> list[str]:
    return list(dict.fromkeys(words_of(s)))


def window(template: str, slack: float = 1.25) -> int:
    """Words of a block that is compared with the template."""
    return math.ceil(slack * len(words_of(template)))


#: The same characters one by one, and the upper-case letters: each becomes a space, or its lower case.
OTHERS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, OTHERS + UPPER, " " * len(OTHERS) + LOWER), " "), "")


def _spaced(words: Column) -> Column:
    """Words with two spaces between and one at either end: each word owns the spaces around it."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def _n_words(spaced: Column) -> Column:
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def word_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Documents that hold each word of the vocabulary."""
    own = docs.select(F.explode(F.array_intersect(_words(docs[text_col]), F.array(*[F.lit(w) for w in vocabulary]))).alias("w"))
    return {r["w"]: r["n"] for r in own.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def scan(docs: DataFrame, text_col: str = "text", threshold: float = 0.9, slack: float = 1.25, templates=TEMPLATES) -> DataFrame:
    """``docs`` with one more column, ``license``: n_words, places of base phrases, labels, score, and the blocks that match."""
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    held = word_counts(docs, vocabulary, text_col)
    order = lambda w: (held.get(w, 0), w)
    ranked = [(label, sorted(word_list(t), key=order), window(t, slack)) for label, t in templates]
    need = lambda words: max(1, math.ceil(threshold * len(words) - 1e-9))
    prefixes = {w for _, t, _ in ranked for w in t[: len(t) - need(t) + 1]}
    texts = lambda x: F.array(*[F.lit(w) for w in x])
    by_word = {w: F.array(*[F.lit(k) for k, (_, t, _) in enumerate(ranked) if w in t[: len(t) - need(t) + 1]]) for w in sorted(prefixes)}
    relation = F.array(*[F.struct(F.lit(label).alias("label"), texts(t).alias("words"), F.lit(need(t)).alias("need"), F.lit(n).alias("n")) for label, t, n in ranked])
    meeting = F.create_map(*[x for w, k in by_word.items() for x in (F.lit(w), k)])
    text = F.coalesce(docs[text_col], F.lit(""))

    def around(words: Column, at: Column, t: Column) -> Column:
        """The best window that holds the word at this place as its rarest shared one, if it meets the threshold."""
        left = F.least(at, t["n"] - 1)  # words before it
        near = F.slice(words, at - left + 1, left + t["n"])
        places = F.transform(near, lambda w: F.array_position(t["words"], w).cast("int"))

        def judged(p: Column) -> Column:
            own = F.get(p, left)
            inside = F.transform(p, lambda x: F.when(x >= own, x))
            some = lambda x: F.size(F.array_compact(F.array_distinct(x)))

            def best(q: Column) -> Column:
                starts = F.filter(F.sequence(F.lit(0), left), lambda i: F.get(q, i).isNotNull())
                each = F.transform(starts, lambda i: F.struct(some(F.slice(q, i + 1, t["n"])).alias("shared"), (-(at - left + i)).alias("first")))
                return F.array_max(each)

            return bind(inside, lambda q: F.when(some(q) >= t["need"], best(q)))

        return bind(bind(places, judged), lambda x: F.when(x["shared"] >= t["need"], F.struct(t["label"].alias("label"), (-x["first"]).cast("bigint").alias("first_word"), t["n"].cast("bigint").alias("n_words"), (x["shared"] / F.size(t["words"])).alias("share"))))

    def found(words: Column) -> Column:
        """The matches around each rare word."""

        def blocks(words: Column) -> Column:
            rare = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*sorted(prefixes)), i)))
            pairs = F.flatten(F.transform(rare, lambda i: F.transform(F.element_at(meeting, F.get(words, i)), lambda k: around(words, i, F.get(relation, k)))))
            return F.array_distinct(F.array_compact(pairs))

        return F.when(F.arrays_overlap(words, texts(sorted(prefixes))), bind(words, blocks)).otherwise(F.array().cast("array<struct<label:string,first_word:bigint,n_words:bigint,share:double>>"))

    def places(spaced: Column, n: Column) -> Column:
        """Number, first and last place of each base phrase that the text holds."""
        each = []
        for phrase, label in PHRASES.items():
            p = f" {phrase.replace(' ', '  ')} "
            many = F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(p), F.lit("")))) / len(p)).cast("bigint")
            first = _n_words(F.substring_index(spaced, p, 1))
            last = n - _n_words(F.substring_index(spaced, p, -1)) - len(phrase.split())
            each.append(F.when(spaced.contains(p), F.struct(F.lit(label).alias("label"), many.alias("n"), first.alias("first"), last.alias("last"))))
        return F.filter(F.array(*each), lambda x: x.isNotNull())

    heads = sorted({p.split()[0] for p in PHRASES})

    def both(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        base = F.when(F.arrays_overlap(words, texts(heads)), bind(_spaced(words), lambda s: places(s, n)))
        none = F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>")
        return F.struct(n.alias("n_words"), F.coalesce(base, none).alias("base"), found(words).alias("m"))

    def digest(x: Column) -> Column:
        base, hits = x["base"], x["m"]
        base_labels = F.transform(base, lambda p: p["label"])
        labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(hits, lambda p: p["label"]))))
        best = F.coalesce(F.array_max(F.transform(hits, lambda p: p["share"])), F.lit(0.0))
        return F.struct(
            x["n_words"].alias("n_words"),
            F.aggregate(base, F.lit(0).cast("bigint"), lambda a, p: a + p["n"]).alias("n_base"),
            F.array_min(F.transform(base, lambda p: p["first"])).alias("first_word"),
            F.array_max(F.transform(base, lambda p: p["last"])).alias("last_word"),
            F.array_sort(base_labels).alias("base_labels"),
            labels.alias("labels"),
            F.when(F.size(base) > 0, F.lit(1.0)).otherwise(best).alias("score"),
            hits.alias("blocks"),
        )

    return docs.withColumn("license", bind(bind(_words(text), both), digest))
