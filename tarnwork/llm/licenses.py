"""License scans by diagonal voting, in DataFrame functions only.

Every rolling k-word gram of every text meets the positions at which a template has that gram; each meeting votes for
a diagonal (text position - template position). A diagonal takes in its neighbours up to ``slack`` words off, and no
further: they are one alignment with a few words put in or left out. An alignment stands if, word for word, the longest
common run of words in order that it holds covers enough of its template; of alignments within ``slack`` of each other
the best stands.

Rows: a null text is an empty one. A repeated row is returned as often as it came. Equal positions are counted once; of
equally good alignments side by side the first stands. Texts of any length are read whole: a phrase repeated in a text
gives one diagonal each time, and no diagonal sees more than its neighbours. Other columns of the input are not looked
at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import each_copy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything between words; upper-case ASCII is lowered first.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that label a text wherever their words stand consecutively.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and whole license texts, as (label, words).
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce "
        "the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def template_grams(spark: SparkSession, templates, k: int) -> DataFrame:
    """(gram, t, label, t_len, t_pos): a row for each gram of each template; as many as the templates have words."""
    rows = []
    for t, (label, phrase) in enumerate(templates):
        words = phrase.split()
        rows += [(" ".join(words[i : i + k]), t, label, len(words), i) for i in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "gram string, t int, label string, t_len int, t_pos int").withColumn("gram_hash", F.xxhash64("gram"))


def scan(docs: DataFrame, k: int = 3, slack: int = 3, cover: float = 0.8, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: label, start, end (words from 0, end exclusive) and covered share of each verified alignment. score: the
    largest covered share, 1 where a base phrase stands, 0 without any.
    """
    spark = docs.sparkSession
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), BETWEEN), "")
    n = F.size("_w")
    at = {label: F.filter(F.sequence(F.lit(0), n - len(p.split())), (lambda ws: lambda i: _all(F.get("_w", i + j) == w for j, w in enumerate(ws)))(p.split())) for p, label in base.items()}
    none = F.array().cast("array<int>")
    starts = {label: F.when((n >= len(p.split())) & F.contains("_joined", F.lit(f" {p} ")), at[label]).otherwise(none) for p, label in base.items()}
    grams = F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat_ws(" ", *(F.get("_w", i + j) for j in range(k))))).otherwise(F.array().cast("array<string>"))
    each = (
        docs.select(F.col("doc_id"), F.xxhash64("text").alias("_key"), words.alias("_w"))
        .withColumn("_joined", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")))
        .select("doc_id", "_key", n.cast("long").alias("n_words"), F.struct(*(starts[x].alias(x) for x in starts)).alias("_at"), grams.alias("_grams"))
        .select("doc_id", "_key", "n_words", F.flatten(F.array(*(F.col("_at")[x] for x in starts))).alias("_starts"), F.array_join(F.array_sort(F.array_compact(F.array(*(F.when(F.size(F.col("_at")[x]) > 0, F.lit(x)) for x in starts)))), ",").alias("base_labels"), "_grams")
        .select("doc_id", "_key", "n_words", F.size("_starts").cast("long").alias("n_base"), F.array_min("_starts").cast("long").alias("first_word"), F.array_max("_starts").cast("long").alias("last_word"), "base_labels", F.concat(F.array(F.lit(None).cast("string")), "_grams").alias("_grams"))
    )
    facts = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    # A first element without a gram stands for the row itself, so that texts are read and split once. The outer form keeps
    # the optimizer from inferring a size filter, which would repeat the split inside the lambda for every element.
    rolled = each.select("doc_id", "_key", *facts, F.posexplode_outer("_grams").alias("_p", "_gram"))
    met = (
        rolled.join(F.broadcast(template_grams(spark, templates, k)), F.xxhash64("_gram") == F.col("gram_hash"), "left")
        .filter((F.col("_p") == 0) | (F.col("gram") == F.col("_gram")))
        .select("doc_id", "_key", *facts, (F.col("_p") - 1).alias("_pos"), "t", "label", "t_len", "t_pos")
    )
    # Votes are combined before they are shuffled; what is shuffled are diagonals and one row a text.
    by_diagonal = met.groupBy("doc_id", "_key", "t", (F.col("_pos") - F.col("t_pos")).alias("_d")).agg(
        *(F.max(x).alias(x) for x in facts), F.count("*").alias("_n"), F.max("label").alias("label"), F.max("t_len").alias("t_len"), F.collect_set("t_pos").alias("_ts")
    )
    beside = Window.partitionBy("doc_id", "_key", "t").orderBy("_d").rangeBetween(-slack, slack)
    banded = by_diagonal.withColumn("_band", F.collect_list(F.struct("_d", "_ts")).over(beside))
    words_at = lambda starts: F.array_distinct(F.flatten(F.transform(starts, lambda x: F.sequence(x, x + (k - 1)))))
    near = F.size(words_at(F.flatten(F.transform("_band", lambda b: b["_ts"])))) >= cover * F.col("t_len")
    # Word for word only where enough words are there at all. By offset: the template's words that stand in grams there.
    offsets = range(-slack, slack + 1)
    at_offset = lambda o: F.flatten(F.transform(F.filter("_band", lambda b: b["_d"] - F.col("_d") == o), lambda b: b["_ts"]))
    placed = banded.withColumn("_words", F.when(F.col("t").isNotNull() & near, F.array(*(words_at(at_offset(o)) for o in offsets))))
    placed = placed.withColumn("_share", F.when(F.col("_words").isNotNull(), _in_order(F.col("_words"), F.col("t_len"), len(offsets)) / F.col("t_len")))
    placed = placed.withColumn("_share", F.when(F.col("_share") >= cover, F.col("_share")))
    best = F.max(F.when(F.col("_share").isNotNull(), F.struct("_share", (-F.col("_d")).alias("_x")))).over(beside)
    stands = F.col("_share").isNotNull() & (F.col("_best._x") == -F.col("_d"))
    first = F.array_min(F.transform("_band", lambda b: b["_d"] + F.array_min(b["_ts"]))).cast("long")
    last = F.array_max(F.transform("_band", lambda b: b["_d"] + F.array_max(b["_ts"]))).cast("long") + k
    span = F.when(stands, F.struct("label", first.alias("start"), last.alias("end"), F.col("_share").alias("covered")))
    out = placed.withColumn("_best", best).groupBy("doc_id", "_key").agg(
        *(F.max(x).alias(x) for x in facts), F.max(F.when(F.col("t").isNull(), F.col("_n"))).alias("_copies"), F.array_sort(F.collect_list(span)).alias("spans")
    )
    all_labels = F.array_sort(F.array_distinct(F.concat(F.array_remove(F.split("base_labels", ","), ""), F.transform("spans", lambda s: s["label"]))))
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    out = out.select("doc_id", *facts, F.array_join(all_labels, ",").alias("labels"), F.greatest(score, F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"), "spans", "_copies")
    return each_copy(out, "_copies", "_copy").drop("_copy")


def _in_order(words, size, wide: int):
    """Most of a template's words that the alignment has in order, in the text and in the template.

    words: for each offset from the diagonal, the template's words that stand there. Read by template word; the state is,
    for each offset, the most words in order up to there: one more if the word stands at this offset, else what was known
    of the same text position (one offset further before) or of the position ahead of it (one offset less).
    """

    def step(state, j):
        out = []
        for o in range(wide):
            ways = [F.get(state, F.lit(o)) + F.array_contains(F.get(words, F.lit(o)), j).cast("int")]
            ways += [F.get(state, F.lit(o + 1))] if o + 1 < wide else []
            ways += [out[-1]] if out else []
            out.append(F.greatest(*ways) if len(ways) > 1 else ways[0])
        return F.array(*out)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.array(*[F.lit(0)] * wide), step, lambda state: F.get(state, F.lit(wide - 1)))


def _all(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out
