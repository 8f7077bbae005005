"""License scans as an exact set-similarity join, with DataFrame functions alone.

Text is cut into blocks of ``2 * step`` words that start every ``step`` words, step being the length
of the longest notice or, for whole license texts, of the longest text, so that a passage as long as a
template lies whole in one block. A block
meets a template's containment threshold if it holds that share of the template's distinct words.
Template words are ordered by their counts in all documents, rarest first. A template's prefix is
its rarest ``size - needed + 1`` words: a block without any of them cannot reach the ``needed``
overlap. So only blocks that hold a prefix word are built; they join templates on prefix words, pass
the length filter (enough distinct words) and the positional filter (enough words left on either
side behind the first match), and are verified by their whole overlap.

Phrases are templates with threshold 1; their places are then checked word for word.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose consecutive words count as places, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Opening words of public license notices, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "you may not use this file except in compliance with the license apache": "apache-2",
    "licensed under the apache license version 2 0": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license version": "gpl",
    "this work is licensed under a creative commons attribution sharealike license": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "subject to the terms of the mozilla public license": "mpl",
}

#: Whole public license texts, as words, and their labels.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program": "gpl",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution": "zlib",
}
THRESHOLD = 0.8
#: Templates of up to so many words are sought in shorter blocks than whole texts.
SHORT = 32
#: What separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template:
    def __init__(self, words: str, label: str, threshold: float, phrase: bool):
        self.words, self.label, self.threshold, self.phrase = words.split(), label, threshold, phrase
        self.tokens = sorted(set(self.words))
        self.needed = math.ceil(threshold * len(self.tokens) - 1e-9)


def templates(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES | TEXTS, threshold: float = THRESHOLD) -> list[Template]:
    own = [Template(w, label, threshold, False) for w, label in notices.items()]
    return [Template(w, label, 1.0, True) for w, label in phrases.items()] + own


def words_of(text):
    """Column of the words with A-Z lower-cased and no other letter changed; null texts have none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), GAP), lambda w: w != "")


def frequency_order(docs: DataFrame, text: str, known: list[Template]) -> list[str]:
    """The templates' words, rarest in all documents first, ties by the word."""
    vocabulary = sorted({w for t in known for w in t.tokens})
    met = docs.select(F.explode(F.filter(words_of(F.col(text).cast("string")), lambda w: w.isin(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in met.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def steps(known: list[Template]) -> list[int]:
    """The block step of each template: the length of the longest among those of up to ``SHORT`` words, or of all."""
    short = max((len(t.words) for t in known if len(t.words) <= SHORT), default=1)
    whole = max((len(t.words) for t in known), default=1)
    return [short if len(t.words) <= SHORT else whole for t in known]


def _cut(step: int, anchors: list[str]):
    """Array of (step, start, words) of the blocks that hold an anchor."""
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchors), F.floor(i / step).cast("int"))), lambda b: b.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda b: F.when(b > 0, F.array(b - 1, b)).otherwise(F.array(b)))))
    return F.transform(starts, lambda b: F.struct(F.lit(step).alias("step"), (b * step).alias("start"), F.slice("words", b * step + 1, 2 * step).alias("words")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: list[Template] | None = None) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is the largest share of a template's words that a block meeting its threshold holds, else
    0. Null and empty texts have no words and no labels. Repeated rows each keep their row; labels of
    templates that tie are all given; texts of any length are cut into blocks whole. An empty table
    gives no rows. Other columns of ``docs`` are not read, whatever their names. Only counts and one
    narrow row a block or document are shuffled.
    """
    known = known or templates()
    order = frequency_order(docs, text, known)
    rank = {w: i for i, w in enumerate(order)}
    spark = docs.sparkSession

    rows, anchors = [], {step: set() for step in steps(known)}
    for i, (t, step) in enumerate(zip(known, steps(known), strict=True)):
        ranks = sorted(rank[w] for w in t.tokens)
        prefix = ranks[: len(ranks) - t.needed + 1]
        anchors[step].update(prefix)
        rows += [(i, t.label, t.phrase, t.words, ranks, prefix, t.needed, step, r, at) for at, r in enumerate(prefix)]
    # One row for each prefix word of each template: as many as the templates have words.
    index = spark.createDataFrame(rows, "template int, label string, phrase boolean, phrase_words array<string>, wanted array<int>, prefix array<int>, needed int, step int, rank int, at int")

    lookup = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(F.col(text).cast("string")).alias("words"))
    cuts = []
    for step, own in sorted(anchors.items()):
        cuts.append(_cut(step, [order[r] for r in sorted(own)]))
    blocks = words.select("row", "key", F.size("words").cast("bigint").alias("n_words"), F.explode_outer(F.concat(*cuts)).alias("block"))

    held = F.filter(F.transform(F.array_distinct("block.words"), lambda w: lookup[w]), lambda r: r.isNotNull())
    blocks = blocks.select("row", "key", "n_words", "block", F.array_sort(held).alias("held"), F.size(F.array_distinct("block.words")).alias("distinct"))
    met = F.array_intersect("held", F.array(*[F.lit(r) for r in sorted(set().union(*anchors.values()))]))
    pairs = blocks.select("*", F.col("block.step").alias("step"), F.explode_outer(met).alias("rank")).join(F.broadcast(index), ["rank", "step"], "left")

    first = F.col("rank") == F.array_min(F.array_intersect("held", "prefix"))
    length = F.col("distinct") >= F.col("needed")
    left = F.least(F.size("wanted") - F.col("at"), F.size("held") - F.array_position("held", F.col("rank")).cast("int") + 1)
    candidate = first & length & (left >= F.col("needed"))
    overlap = F.when(candidate, F.size(F.array_intersect("held", "wanted"))).otherwise(0)
    verified = pairs.withColumn("share", F.when(overlap >= F.col("needed"), overlap / F.size("wanted")).otherwise(0.0))

    size = F.size("phrase_words")
    places = F.filter(F.sequence(F.lit(0), F.col("step") - 1), lambda s: F.slice("block.words", s + 1, size) == F.col("phrase_words"))
    found = F.when(F.col("phrase") & (F.col("share") > 0), F.transform(places, lambda s: (F.col("block.start") + s).cast("bigint")))
    verified = verified.select("row", "key", "n_words", "label", "phrase", "share", found.alias("places"))
    has = F.size("places") > 0
    out = verified.groupBy("row", "key", "n_words").agg(
        F.coalesce(F.sum(F.when(has, F.size("places"))), F.lit(0)).cast("bigint").alias("n_base"),
        F.min(F.array_min("places")).alias("first_word"),
        F.max(F.array_max("places")).alias("last_word"),
        F.collect_set(F.when(has, F.col("label"))).alias("base"),
        F.collect_set(F.when(F.when(F.col("phrase"), has).otherwise(F.col("share") > 0), F.col("label"))).alias("all"),
        F.max(F.when(F.when(F.col("phrase"), has).otherwise(True), F.col("share")).otherwise(0.0)).alias("score"),
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The same in SQL: every block against every template."""
    known = templates()
    tokens = ", ".join(f"({i}, '{t.label}', {str(t.phrase).lower()}, {len(t.tokens)}, {t.needed}, {step}, '{w}')" for i, (t, step) in enumerate(zip(known, steps(known), strict=True)) for w in t.tokens)
    runs = " UNION ALL ".join("SELECT doc_id, i, '{}' AS label FROM nexts WHERE {}".format(t.label, " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(t.words))) for t in known if t.phrase)
    longest = max(len(t.words) for t in known if t.phrase)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH lists AS (SELECT doc_id, list_filter(regexp_split_to_array({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM lists),
tokens(template, label, phrase, size, needed, step, w) AS (VALUES {tokens}),
steps AS (SELECT DISTINCT step FROM tokens),
known AS (SELECT * FROM words WHERE w IN (SELECT w FROM tokens)),
near AS (SELECT doc_id, w, step, i // step AS b FROM known, steps UNION SELECT doc_id, w, step, i // step - 1 FROM known, steps WHERE i >= step),
met AS (SELECT doc_id, b, template, label, phrase, size, count(DISTINCT w) AS n FROM near JOIN tokens USING (w, step) GROUP BY ALL HAVING count(DISTINCT w) >= any_value(needed)),
notices AS (SELECT doc_id, label, n / size AS share FROM met WHERE NOT phrase),
nexts AS (SELECT doc_id, i, w AS w0, {", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, longest))} FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
places AS ({runs}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT doc_id, label, share FROM notices UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM lists LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""
