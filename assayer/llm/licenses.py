"""License templates in texts, by MinHash bands over overlapping windows of words.

Only DataFrame functions are used. Words are runs of a-z and 0-9 of the lower-cased text,
shingles are five words. Templates are cut to windows at every word, documents to
overlapping windows. Window sizes are chosen so that retrieval is certain, not just probable:

- Templates of 12 words or more take windows of 8 words (4 shingles), in documents every 4
  words. A text that holds 0.8 of the template's shingles keeps a run of 7 shingles or more unbroken
  (a change or an insertion breaks at least 4 shingles, and a fifth may break), so one
  window of the document lies in it and equals a window of the template; equal windows collide in every band.
- Shorter templates (5 to 11 words) take windows of one shingle, at every word.

Windows that only resemble each other collide in at least one of 6 bands of 2 rows with
probability 1 - (1 - J^2)^6. Before hashing, windows without any run of five words of the
templates' vocabulary are left out: they share no shingle with any template. Band keys of
documents meet those of templates in a join; the pairs of document and template that it retrieves are
verified by exact containment: the share of the template's distinct shingles that the
whole text holds. What is put in between, however long, doesn't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.frames import fixed_table

SHINGLE = 5
WINDOW, STEP = 8, 4
LONG_TEMPLATE = 12
BANDS, ROWS = 6, 2
#: Templates of so many words together are broadcast (some 20 MB); more of them are joined by shuffles.
BROADCAST_WORDS = 100_000
#: Distinct words that the first filter of windows knows, at most; beyond it all windows are hashed.
MOST_VOCABULARY = 50_000

# The wording of common notices.
TEMPLATES = [
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd-line", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingle(words: Column, at: Column) -> Column:
    """The shingle that starts at a word (from 1)."""
    return F.array_join(F.slice(words, at, SHINGLE), " ")


def shingles(words: Column) -> Column:
    """All shingles in order; none where there are fewer than five words."""
    return F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: shingle(words, i))).otherwise(F.array().cast("array<string>"))


def min_hash(hashed: Column, seed: int) -> Column:
    return F.array_min(F.transform(hashed, lambda x: F.xxhash64(x, F.lit(seed))))


def bands(words: Column, at: Column, size: int) -> Column:
    """Band keys of the window of ``size`` words at a word."""
    hashed = F.transform(F.sequence(at, at + (size - SHINGLE)), lambda i: F.xxhash64(shingle(words, i)))
    least = [min_hash(hashed, k) for k in range(BANDS * ROWS)]
    return F.array(*[F.xxhash64(F.lit(size), F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters use, worked out once (a generator keeps them from being pushed down and repeated)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def template_windows(templates: DataFrame) -> DataFrame:
    """Band keys of all windows of templates (license, t_text): rows (key, license), each once."""
    rows = templates.select("license", words_of(F.col("t_text")).alias("t_words"))
    rows = rows.select("*", F.size("t_words").alias("n"))
    size = F.when(F.col("n") >= LONG_TEMPLATE, WINDOW).otherwise(SHINGLE)
    rows = rows.select("*", size.alias("size")).select("*", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("at"))
    keys = F.when(F.col("size") == WINDOW, bands(F.col("t_words"), F.col("at"), WINDOW)).otherwise(bands(F.col("t_words"), F.col("at"), SHINGLE))
    return rows.select("license", F.explode(keys).alias("key")).distinct()


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Licenses found: doc_id, license, n_shingles (of the template), n_hit (of them in the text), first_word (from 0), n_places.

    A template is found where the text holds at least 0.8 of its distinct shingles, with anything of
    any length in between. ``first_word`` is where the first of its shingles starts, ``n_places`` how often that
    shingle stands in the text. NULL and empty texts hold none; rows with the same doc_id are put together (the
    fullest text counts), rows without one likewise. Texts and templates of fewer than five words hold
    no shingle; such templates are refused. Any number of templates can be given.
    """
    cut = [re.findall("[a-z0-9]+", text.lower()) for _, text in templates]
    if len({name for name, _ in templates}) < len(templates) or min(map(len, cut)) < SHINGLE:
        raise ValueError("templates need distinct names and five words or more")
    few = sum(map(len, cut)) <= BROADCAST_WORDS
    sized = lambda df: F.broadcast(df) if few else df
    texts = fixed_table(docs.sparkSession, ["license", "t_text"], templates)
    vocabulary = sorted({w for words in cut for w in words})

    w, n = F.col("w"), F.size("w")
    rows = once(docs.where("text IS NOT NULL").select("doc_id", "text"), w=words_of(F.col("text"))).drop("text")
    if len(vocabulary) <= MOST_VOCABULARY:
        rows = once(rows, known=F.transform(w, lambda x: x.isin(vocabulary)))
        in_run = F.array_join(F.transform("known", lambda x: F.when(x, "1").otherwise("0")), "")
        rows = rows.where(F.contains(in_run, F.lit("1" * SHINGLE)))
    else:
        rows = once(rows.where(n >= SHINGLE), known=F.transform(w, lambda x: F.lit(True)))
    get = lambda a, i: F.element_at(a, i)
    starts = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: get(F.col("known"), i) & get(F.col("known"), i + 1) & get(F.col("known"), i + 2) & get(F.col("known"), i + 3) & get(F.col("known"), i + 4))
    rows = once(rows, runs=starts).drop("known")
    short = F.filter(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda p: get(F.col("runs"), p))
    every = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    wide = F.filter(every, lambda p: get(F.col("runs"), p) | get(F.col("runs"), p + 1) | get(F.col("runs"), p + 2) | get(F.col("runs"), p + 3))

    # retrieval: pairs of document and template with a common band
    keys = F.array_distinct(F.flatten(F.concat(F.transform(short, lambda p: bands(w, p, SHINGLE)), F.transform(wide, lambda p: bands(w, p, WINDOW)))))
    keyed = rows.select("doc_id", F.explode(keys).alias("key"))
    found = keyed.join(sized(template_windows(texts)), "key").select("doc_id", "license").distinct()
    per_document = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("license").alias("licenses"))

    # verification: the shingles of the texts that have a candidate
    whole = once(rows, own=F.transform(short, lambda p: F.struct(p.alias("at"), shingle(w, p).alias("text")))).select("doc_id", "own")
    whole = whole.join(per_document.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")))
    whole = once(whole, texts=F.col("own.text")).select("doc_id", "own", "texts", F.explode("licenses").alias("license"))
    wanted = texts.select("license", F.array_distinct(shingles(words_of(F.col("t_text")))).alias("t_shingles"))
    found = whole.join(sized(wanted), "license")
    found = once(found, hits=F.array_intersect("texts", "t_shingles"))
    first = F.get(F.filter("own", lambda x: F.array_contains(F.col("t_shingles"), x["text"])), F.lit(0))
    found = found.where(F.size("hits") * 10 >= F.size("t_shingles") * 8)
    found = once(found, first=first).select(
        "doc_id", "license", F.size("t_shingles").cast("long").alias("n_shingles"), F.size("hits").cast("long").alias("n_hit"),
        (F.col("first.at") - 1).cast("long").alias("first_word"),
        F.size(F.filter("texts", lambda x: x == F.col("first.text"))).cast("long").alias("n_places"),
    )
    return found.groupBy("doc_id", "license").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("n_hit").alias("n_hit"), F.min("first_word").alias("first_word"), F.sum("n_places").alias("n_places")
    )
