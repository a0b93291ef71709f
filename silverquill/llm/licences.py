"""License scans: an exact set-similarity join of text blocks with licence templates, in DataFrame functions only.

A template of n words belongs to the class of the least power of two S that is at least n and ``STRIDE``; it is matched against
blocks of 2 S consecutive words, a new one every S, so that any passage of the template's length lies whole in a block. A
template matches a block if the block holds at least 0.8 of the template's distinct words (containment).
Template words are ordered by how many documents hold them, rarest first. A block that meets the threshold
shares one of a template's first ``s - ceil(0.8 s) + 1`` words (prefix filter), has ``ceil(0.8 s)`` template
words (length filter), and behind the first shared word enough words are left on both sides (positional
filter). The filters only drop pairs that can't meet the threshold; what is left is counted exactly.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

STRIDE, THRESHOLD = 32, 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that give the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Wordings of public licences and notices, and the label of each.
TEMPLATES = (
    ("gpl-notice", "licensed under the gnu general public license version"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit-notice", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd-2-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "zlib-text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software "
        "must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution.",
    ),
    (
        "unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
        "copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication "
        "to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
)


def words_of(text: Column) -> Column:
    """The words of a text (null: none): runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    first, last = (F.element_at(parts, 1) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def phrase_places(words: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand one after another."""
    parts = phrase.split()
    first = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    return F.filter(first, lambda i: F.slice(words, i + 1, len(parts)) == F.array(*map(F.lit, parts)))


def template_rows(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, distinct words, how many of them a block must hold, class) of each template; one without words matches nothing."""
    rows = []
    for k, (label, text) in enumerate(templates):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        if words:
            stride = max(STRIDE, 1 << (len(words) - 1).bit_length())
            rows.append((k, label, sorted(set(words)), max(1, math.ceil(threshold * len(set(words)) - 1e-9)), stride))
    return rows


def scan(documents: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every document.

    Null and empty texts have no words and no labels (empty strings), and score 0. score is 1 where a base
    phrase stands, else the greatest containment of a template met, else 0. Repeated rows are answered
    each. Texts are read and cut into words once; only documents that hold enough words of a template somewhere are cut into
    blocks, those of that template's class; a long document's blocks are rows. Templates are a parameter of the plan:
    their words are literals of it (thousands of templates are one plan, larger lists want several scans).
    """
    spark, rows = documents.sparkSession, template_rows(templates, threshold)
    tokens = sorted({t for _, _, ts, _, _ in rows for t in ts})
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    listed = lambda ts: f"array({', '.join(map(quoted, ts))})" if ts else "cast(array() AS array<string>)"
    base = F.array(*(F.struct(F.lit(label).alias("label"), phrase_places(F.col("words"), phrase).alias("at")) for phrase, label in PHRASES.items()))
    maybe = F.arrays_overlap("words", F.array(*map(F.lit, sorted({p.split()[0] for p in PHRASES}))))
    every = F.expr("array(" + ", ".join(f"named_struct('k', {k}, 'stride', {stride}, 'need', {need}, 'tokens', {listed(ts)})" for k, _, ts, need, stride in rows) + ")") if rows else None
    classes = F.array_distinct(F.transform(F.filter(every, lambda t: F.size(F.array_intersect("held", t["tokens"])) >= t["need"]), lambda t: t["stride"])) if rows else F.array().cast("array<int>")
    texts = documents.select("doc_id", F.col("text").alias("text"), words_of(F.col("text")).alias("words"))
    judged = texts.select("doc_id", F.xxhash64("text").alias("_key"), F.size("words").cast("long").alias("n_words"), F.when(maybe, base).alias("_base"), "words", F.array_intersect("words", F.expr(listed(tokens))).alias("held"))
    judged = judged.withColumn("_classes", F.when(F.size("held") >= min((need for *_, need, _ in rows), default=1), classes).otherwise(F.array().cast("array<int>")))
    judged = judged.withColumn("words", F.when(F.size("_classes") > 0, F.col("words")))
    judged = judged.withColumn("_at", F.coalesce(F.flatten(F.col("_base.at")), F.array().cast("array<int>")))
    judged = judged.withColumn("_labels", F.coalesce(F.transform(F.filter("_base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"]), F.array().cast("array<string>"))).drop("_base")
    judged = materialize(judged, "licence-words")

    seen = dict(judged.select(F.explode("held").alias("token")).groupBy("token").count().collect())  # one row per template word
    rank = {t: k for k, t in enumerate(sorted(tokens, key=lambda t: (seen.get(t, 0), t)))}
    ranked = [(k, label, sorted(ts, key=rank.get), need, stride) for k, label, ts, need, stride in rows]
    prefix = [(stride, t, k, p) for k, _, ts, need, stride in ranked for p, t in enumerate(ts[: len(ts) - need + 1])]
    words_by_class = {}
    for _, _, ts, need, stride in ranked:
        least, some = words_by_class.get(stride, (need, set()))
        words_by_class[stride] = (min(least, need), some | set(ts))
    blocks = judged.where("words is not null").select("doc_id", "_key", "words", "_classes").dropDuplicates(["doc_id", "_key"]).select("doc_id", "_key", "words", F.explode("_classes").alias("stride"))
    blocks = blocks.select("doc_id", "_key", "words", "stride", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.col("stride"))).alias("block"))
    held, least = F.lit(None).cast("array<string>"), F.lit(1)
    for stride, (need, some) in words_by_class.items():
        own = F.col("stride") == stride
        held = F.when(own, F.array_intersect(F.expr(listed(sorted(some, key=rank.get))), F.slice("words", F.col("block") + 1, 2 * stride))).otherwise(held)
        least = F.when(own, need).otherwise(least)
    blocks = blocks.withColumn("held", held).drop("words").where(F.size("held") >= least)
    index = spark.sql("SELECT * FROM VALUES " + (", ".join(f"({stride}, {quoted(t)}, {k}, {p})" for stride, t, k, p in prefix) or "(0, '', 0, 0)") + " AS x(stride, token, template, place)")
    whole = spark.sql("SELECT * FROM VALUES " + (", ".join(f"({k}, {quoted(label)}, {listed(ts)}, {need})" for k, label, ts, need, _ in ranked) or "(0, '', array(''), 1)") + " AS x(template, label, tokens, need)")
    pairs = blocks.select("doc_id", "_key", "stride", "held", F.posexplode("held").alias("_q", "token")).join(F.broadcast(index), ["stride", "token"])
    pairs = pairs.join(F.broadcast(whole), "template").where("size(held) >= need and 1 + least(size(tokens) - place - 1, size(held) - _q - 1) >= need")
    found = pairs.withColumn("_n", F.size(F.array_intersect("held", "tokens"))).where("_n >= need").withColumn("contained", F.col("_n") / F.size("tokens"))
    hits = found.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(F.collect_set("label").alias("_more"), F.max("contained").alias("_best"))
    joined = judged.drop("words", "held", "_classes").join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left")
    every = F.array_sort(F.array_distinct(F.concat("_labels", F.coalesce("_more", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_labels"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("_at") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op9_sql(templates=TEMPLATES) -> str:
    """The same result by brute force: every block with every template of its class."""
    values = ", ".join(f"({k}, '{label}', {ts!r}, {need}, {stride})" for k, label, ts, need, stride in template_rows(templates))
    phrases = ", ".join(f"('{label}', [{', '.join(repr(w) for w in phrase.split())}])" for phrase, label in PHRASES.items())
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
phrases(label, parts) AS (VALUES {phrases}), templates(template, label, tokens, need, stride) AS (VALUES {values}),
places AS (SELECT rid, label, i - 1 AS place FROM w, phrases, unnest(range(1, len(words) + 1)) AS r(i) WHERE words[i] = parts[1] AND words[i : i + len(parts) - 1] = parts),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base FROM places GROUP BY rid),
blocks AS (SELECT rid, stride, list_distinct(words[s + 1 : s + 2 * stride]) AS held FROM w, (SELECT DISTINCT stride FROM templates), unnest(range(0, greatest(len(words), 1), stride)) AS r(s)),
hits AS (SELECT rid, list(DISTINCT label) AS more, max(n::double / len(tokens)) AS best FROM (
    SELECT rid, label, tokens, need, len(list_intersect(tokens, held)) AS n FROM blocks JOIN templates USING (stride)) WHERE n >= need GROUP BY rid)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
    coalesce(array_to_string(base, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::double ELSE coalesce(best, 0.0)::double END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN hits USING (rid)
"""
