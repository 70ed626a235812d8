"""License scans by diagonal voting.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. All rolling word k-grams of all texts
are hashed and joined to the positions where template notices have the same k-gram. A hit votes for the diagonal
(document position minus template position). Neighbouring diagonals are merged as long as the first and the last of a
span are no further apart than a template's slack (a sixth of its words, two at least): a copy may have so many words
added or left out in all, so its words stand in the template's order, and a span is hardly longer than the template. A
merged span is verified by the share of the template's words that its k-grams cover. Where spans overlap, the one with
the larger share of its template's k-grams has each word, then the longer template; a span that has fewer than half of
its words is dropped, so of notices that differ by a word only the right one is left. Beside that, base phrases are
found word by word.

Null and empty texts have no words and no labels. A row is known by its id and a hash of its text, so rows that share
an id, or have none, have labels of their own. The templates are a fixed list of this module, so that side of the join
has a constant size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, let, table

#: All but the ASCII characters 00-2F, 3A-60 and 7B-7F; the regex engine is many times faster on the class put this way.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The same words before lower-casing.
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
K, SLACK, LEAST_SLACK, COVER = 3, 6, 2, 0.7

#: Phrases that count by themselves, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The standard notices of common licenses, in their published wording.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
        OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
        ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
        OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    ),
)


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased, as an array."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(words: Column, k: int) -> Column:
    """The hashes of an array's rolling k-grams."""

    def gram(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + j) for j in range(k)])

    return let(words, lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: gram(w, i))).otherwise(F.array().cast("array<bigint>")))


def phrase_places(text: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """array of (at, label): the places where a phrase's words stand one after the other.

    Texts without any phrase's last word as a plain substring are not cut into words.
    """

    def label(w: Column, i: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for phrase, name in phrases.items():
            here = F.lit(True)
            for j, part in enumerate(phrase.split()):
                here = here & (F.get(w, i + j) == part)
            chosen = F.when(here, F.lit(name)).otherwise(chosen)
        return chosen

    def found(w: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: F.struct(i.alias("at"), label(w, i).alias("label")))
        return F.filter(places, lambda p: p["label"].isNotNull())

    some = F.lit(False)
    for last in sorted({p.split()[-1] for p in phrases}):
        some = some | ascii_lower(text).contains(last)
    return F.when(some, let(words_of(text), found)).otherwise(F.array().cast("array<struct<at:int,label:string>>"))


def templates(spark: SparkSession, notices=TEMPLATES, k: int = K) -> DataFrame:
    """gram, template, label, at, n (words): each k-gram of each notice."""
    notes = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(notices)], "template int, label string, text string")
    grams = notes.withColumn("words", words_of(F.col("text"))).select("template", "label", F.size("words").alias("n"), F.posexplode(_grams(F.col("words"), k)).alias("at", "gram"))
    return grams


def notice_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=TEMPLATES, k: int = K, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """id, text_hash, label, template, first_word, last_word, score of every verified span (score: the share of the notice's words found).

    slack: a template of n words may be shifted by n / slack words within a span.
    """
    spark = docs.sparkSession
    known = templates(spark, notices, k)
    widest = known.agg(F.max(F.greatest(F.floor(F.col("n") / slack), F.lit(LEAST_SLACK)))).first()[0] or 0  # of constants
    grams = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(_grams(words_of(F.col(text_col)), k)).alias("pos", "gram"))
    hits = grams.join(F.broadcast(known), "gram")  # the notices are constants
    row, key = ["id", "text_hash"], ["id", "text_hash", "template"]
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*key, "label", "n", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    near = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(0, int(widest))
    met = F.collect_list(F.struct("diagonal", "ats", "low", "high")).over(near)
    within = F.col("diagonal") + F.greatest(F.floor(F.col("n") / slack), F.lit(LEAST_SLACK))
    merged = votes.withColumn("met", met).withColumn("met", F.filter("met", lambda m: m["diagonal"] <= within))
    ats = F.array_distinct(F.flatten(F.transform("met", lambda m: m["ats"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (k - 1))))))
    spans = merged.withColumn("ats", ats).withColumn("score", covered / F.col("n")).where(F.col("score") >= cover)
    share = F.size("ats") / (F.col("n") - (k - 1))
    placed = spans.select(*key, "label", "n", "diagonal", "score", share.alias("share"), F.array_min(F.transform("met", lambda m: m["low"])).alias("first_word"), (F.array_max(F.transform("met", lambda m: m["high"])) + k - 1).alias("last_word"))
    # a word goes to the best span over it; what makes spans unlike comes last, so that there is one best
    order = F.struct("share", "n", (-F.col("template")).alias("t"), "diagonal", "label", "score", "first_word", "last_word")
    words = placed.select(*row, order.alias("span"), F.explode(F.sequence("first_word", "last_word")).alias("word"))
    best = words.groupBy(*row, "word").agg(F.max("span").alias("span"))
    owners = best.groupBy(*row, "span").agg(F.count("*").alias("own")).where("2 * own >= span.last_word - span.first_word + 1")
    return owners.select(*row, "span.label", (-F.col("span.t")).alias("template"), "span.first_word", "span.last_word", "span.score")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: id, n_words, places (of phrases), method_labels, score."""
    spans = notice_spans(docs, id_col, text_col, **how)
    labels = spans.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("label").alias("method_labels"), F.max("score").alias("score"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"), phrase_places(text).alias("places"))
    joined = base.join(labels, F.expr("id <=> _id and text_hash = _hash"), "left").drop("_id", "_hash", "text_hash")
    return joined.withColumn("method_labels", F.coalesce("method_labels", F.array().cast("array<string>"))).withColumn("score", F.coalesce("score", F.lit(0.0)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of all documents."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.transform("places", lambda p: p["label"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.col("method_labels"))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.col("score")).alias("score"),
    )


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES: dict[str, str] = {}
