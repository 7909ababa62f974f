"""License scans by an exact set-similarity join between text blocks and license notices, in DataFrame operations only.

Blocks are sentences of paragraphs, so a notice may be wrapped over lines, commented ones too. Tokens are ordered by their document frequency in the whole corpus, rarest
first. A block holds a notice if it has at least ``threshold`` of the notice's distinct words. That needs one
of the notice's first |t| - c + 1 words (its prefix, c being the words needed) among the block's own first
words, at least c known words in the block (length filter), and enough words left behind the meeting place
on either side (positional filter). Blocks that pass are counted exactly. A bag of words cannot tell licenses apart that
differ in one, so the words that decide (Affero, Lesser, NonCommercial, ...) must be the notice's own, as must the
versions it names, and most of its neighbouring words must be neighbours in the block too. A block has one label: its best notice's.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import NOT_WORD, ascii_lower, joined_back, texts, word_array

# Phrases that name a license outright, and the label each stands for.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Texts and customary notices of public licenses.
NOTICES = (
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("apache-2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied."),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind."),
    ("apache-2", "See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("mpl-2", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

# Words that decide between licenses whose notices are alike otherwise, and how else they are spelt.
DECIDING = ("affero", "lesser", "library", "noncommercial", "noderivatives", "sharealike")
SPELT = ((" non commercial ", " noncommercial "), (" no derivatives ", " noderivatives "), (" noderivs ", " noderivatives "), (" share alike ", " sharealike "))
#: Versions that a text names, and the share of a notice's neighbouring words that must be neighbours in a block.
VERSION, NEIGHBOURS = " version ([0-9]+(?: [0-9]+)?)", 0.7

#: A block ends at a line without words, or behind a full stop, question or exclamation mark that white space follows.
BLOCK_END = r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n|(?<=[.!?])[\x20\x09-\x0D]+"


def _distinct_words(text: str) -> list[str]:
    kept = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower())
    return sorted(set(kept.split()))


def in_order(text: str) -> list[str]:
    """A notice's words as they stand."""
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def deciding(text: str) -> list[str]:
    """The deciding words of a notice. "Library" decides only as part of the license's name, so it counts after GNU alone."""
    line = f" {' '.join(in_order(text))} "
    for a, b in SPELT:
        line = line.replace(a, b)
    return [w for w in DECIDING if (f" gnu {w} " if w == "library" else f" {w} ") in line]


def versions(text: str) -> list[str]:
    return sorted(set(re.findall(VERSION, f" {' '.join(in_order(text))} ")))


def neighbours(text: str) -> list[str]:
    """Distinct pairs of words that stand side by side in a notice."""
    words = in_order(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _decides_alike(line: Column) -> Column:
    """Whether a block's words (one line, blanks around) hold the deciding words and the versions of a notice, no others of them."""
    for a, b in SPELT:
        line = F.replace(line, F.lit(a), F.lit(b))
    own = F.array_compact(F.array(*[F.when(F.contains(line, F.lit(f" gnu {w} " if w == "library" else f" {w} ")), F.lit(w)) for w in DECIDING]))
    named = F.array_sort(F.array_distinct(F.regexp_extract_all(line, F.lit(VERSION), F.lit(1))))
    return (own == F.col("_pw_deciding")) & ((F.size("_pw_versions") == 0) | (named == F.col("_pw_versions")))


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Places where the words of a phrase stand consecutively; overlapping places count."""
    wanted = phrase.split()
    stands = f" {phrase} "
    whole = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def here(i: Column) -> Column:
        out = F.get(words, i) == wanted[0]
        for k, w in enumerate(wanted[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(wanted)), here)
    return F.when(F.contains(whole, F.lit(stands)), starts).otherwise(F.array().cast("array<int>"))


def license_scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    notices: tuple[tuple[str, str], ...] = NOTICES,
    threshold: float = 0.9,
) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels and score 0; first_word and last_word are null where no
    phrase stands; very long texts are read whole, one row each; words that are equally frequent are ordered by
    themselves; repeated rows get the same result; an empty table gives no rows; other columns are not read, whatever
    their names. score is 1 where a phrase stands, else the greatest
    share of a block's notice; notices that tie in a block go by their neighbouring words, then by label. The notices are a fixed list, so their words have a fixed size:
    only they, and their frequencies, are sent to every task.
    """
    base = texts(docs, id_col, text_col).withColumn("_pw_words", word_array(F.col("_pw_text")))
    notice_words = [(label, _distinct_words(text)) for label, text in notices]
    vocabulary = sorted({w for _, ws in notice_words for w in ws})
    counts = (
        base.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), "_pw_words")).alias("_pw_word"))
        .groupBy("_pw_word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seen = {r["_pw_word"]: r["n"] for r in counts.collect()}  # at most as many rows as the notices have words
    ordered = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(ordered)}

    rows, least = [], len(ordered)
    for number, (label, ws) in enumerate(notice_words):
        ws = sorted(ws, key=place.__getitem__)
        needed = math.ceil(threshold * len(ws) - 1e-9)
        least = min(least, needed)
        rows += [
            F.struct(
                F.lit(number).alias("_pw_notice"), F.lit(label).alias("_pw_label"), F.lit(w).alias("_pw_word"),
                F.lit(j).alias("_pw_j"), F.lit(needed).alias("_pw_needed"), F.array(*map(F.lit, ws)).alias("_pw_notice_words"),
            )
            for j, w in enumerate(ws[: len(ws) - needed + 1])
        ]
    spark = docs.sparkSession
    prefixes = spark.range(1).select(F.inline(F.array(*rows)))
    checks = [(k, deciding(text), versions(text), neighbours(text)) for k, (_, text) in enumerate(notices)]
    decided = spark.createDataFrame(checks, "_pw_notice int, _pw_deciding array<string>, _pw_versions array<string>, _pw_pairs array<string>")

    blocks = base.select(
        "_pw_id", "_pw_key", F.posexplode(F.split(ascii_lower(F.col("_pw_text")), BLOCK_END)).alias("_pw_n", "_pw_block")
    )
    known = F.array_intersect(F.array(*map(F.lit, ordered)), F.split("_pw_block", NOT_WORD))
    blocks = blocks.withColumn("_pw_known", known).where(F.size("_pw_known") >= least)
    met = blocks.select(
        "_pw_id", "_pw_key", "_pw_n", "_pw_block", "_pw_known",
        F.posexplode(F.slice("_pw_known", F.lit(1), F.size("_pw_known") - least + 1)).alias("_pw_i", "_pw_word"),
    ).join(F.broadcast(prefixes), "_pw_word")
    b, t = F.size("_pw_known"), F.size("_pw_notice_words")
    ahead = F.least(F.col("_pw_i"), F.col("_pw_j"))
    behind = F.least(b - F.col("_pw_i"), t - F.col("_pw_j"))
    passed = (
        met.where((b >= F.col("_pw_needed")) & (ahead + behind >= F.col("_pw_needed")))
        .withColumn("_pw_shared", F.size(F.array_intersect("_pw_known", "_pw_notice_words")))
        .where(F.col("_pw_shared") >= F.col("_pw_needed"))
    )
    words = word_array(F.col("_pw_block"))
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    here = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda x, y: F.concat_ws(" ", x, y))
    beside = F.size(F.array_intersect(here, "_pw_pairs")) / F.size("_pw_pairs")
    rank = F.struct((-F.col("_pw_shared") / t).alias("a"), (-F.col("_pw_beside")).alias("b"), F.col("_pw_label").alias("c"))
    best = (
        passed.join(F.broadcast(decided), "_pw_notice")  # one row a notice
        .where(_decides_alike(line))
        .withColumn("_pw_beside", beside)
        .where(F.col("_pw_beside") >= NEIGHBOURS)
        .groupBy("_pw_id", "_pw_key", "_pw_n")
        .agg(F.min(rank).alias("_pw_best"))
    )
    found = best.groupBy("_pw_id", "_pw_key").agg(F.collect_set("_pw_best.c").alias("_pw_labels"), F.max(-F.col("_pw_best.a")).alias("_pw_share"))

    starts = [_phrase_starts(F.col("_pw_words"), p) for p, _ in phrases]
    named = base.select("_pw_id", "_pw_key", F.size("_pw_words").cast("long").alias("n_words"), F.array(*starts).alias("_pw_starts"))
    flat = F.flatten("_pw_starts")
    labels = F.array_compact(
        F.array(*[F.when(F.size(F.col("_pw_starts")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)])
    )
    named = named.select(
        "_pw_id", "_pw_key", "n_words", F.size(flat).cast("long").alias("n_base"),
        F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("_pw_base"),
    )
    out = joined_back(named, found)
    every = F.array_sort(F.array_union("_pw_base", F.coalesce("_pw_labels", F.array().cast("array<string>"))))
    return out.select(
        F.col("_pw_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("_pw_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_pw_share", F.lit(0.0))).alias("score"),
    )
