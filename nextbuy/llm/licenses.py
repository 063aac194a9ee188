"""License scans by diagonal voting (operator 13).

Templates are word sequences with a label: phrases and whole license notices.

1. *Join.* All rolling word k-grams of the documents are hashed and joined with
   the templates' k-gram positions (k is 4, or the length of a shorter template).
2. *Vote.* Hits are counted by (document, template, diagonal), the diagonal being
   the document position minus the template position.
3. *Merge.* Diagonals of a template that lie at most its ``slack`` apart form one
   span: words put in or left out shift the rest to a neighbouring diagonal.
   Templates of fewer than ``SHORT`` words have no slack, longer ones a twelfth of their length.
4. *Verify.* A span needs votes from a quarter of the template's k-grams (a short one: from all). Its
   template is then laid along each of its diagonals, word by word; the words of the template that
   agree on some diagonal must be 80 % of it (a short one: all).

A place of a short template is thus exactly a place where its words stand consecutively.
Everything is DataFrame expressions. Templates are few, but nothing relies on it:
they and the hits are broadcast only when proven to be within ``BROADCAST_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEY, ascii_lower, fits_broadcast, keyed, stored

GRAM, SHORT, SHARE = 4, 12, 0.8
#: What separates words: ASCII other than digits and (lower-cased) letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000
#: Diagonals of so many neighbouring positions travel in one row.
REGION = 65_536
#: The phrases whose places count as base places, and their labels.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
#: Sentences of common public license notices.
NOTICES = [
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software"),
]


def task_templates(spark: SparkSession) -> DataFrame:
    """(label, text, base) of the phrases and notices."""
    return spark.createDataFrame([(x, t, True) for x, t in PHRASES] + [(x, t, False) for x, t in NOTICES], "label string, text string, base boolean")


def words_of(text: Column) -> Column:
    """A-Z lower-cased words of a text: runs of letters, digits and all that is not ASCII."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, BROADCAST_ROWS) else df


def prepared(templates: DataFrame) -> DataFrame:
    """(template, label, base, words, n, k, slack, need, votes) of the templates that have words; repeated ones are one."""
    rows = templates.select(F.col("label"), F.coalesce("base", F.lit(False)).alias("base"), words_of(F.coalesce("text", F.lit(""))).alias("words"))
    rows = rows.filter(F.col("label").isNotNull() & (F.size("words") > 0)).distinct().withColumn("n", F.size("words"))
    n, short = F.col("n"), F.col("n") < SHORT
    rows = rows.withColumn("k", F.least(n, F.lit(GRAM)))
    grams = n - F.col("k") + 1
    return rows.select(
        F.xxhash64("label", "base", F.concat_ws(" ", "words")).alias("template"), "label", "base", "words", "n", "k",
        F.when(short, 0).otherwise(F.floor(n / SHORT)).cast("int").alias("slack"),
        F.when(short, n).otherwise(F.ceil(n * F.lit(SHARE))).cast("int").alias("need"),
        F.when(short, grams).otherwise(F.ceil(grams / 4)).cast("int").alias("votes"))


def _paired(a: str, b: str, shift: int) -> Column:
    """At each position i a hash of a[i] and b[i + shift]; null where either is missing."""
    ahead = F.slice(b, F.lit(shift + 1), F.greatest(F.size(b) - shift, F.lit(0)))
    return F.zip_with(a, ahead, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.xxhash64(F.lit(shift), x, y)))


def _positions(rows: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """``keep`` columns with (k, gram, pos) of every rolling k-gram of ``words`` for each k of ``sizes``.

    A gram's hash is made of the hashes of its two parts, the first of a power of two words; each is computed once.
    """
    wanted, todo = {1}, list(sizes)
    while todo:
        if (k := todo.pop()) not in wanted:
            half = 1 << (k - 1).bit_length() - 1
            wanted.add(k)
            todo += [half, k - half]
    rows = rows.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("g1"))
    for k in sorted(wanted - {1}):
        half = 1 << (k - 1).bit_length() - 1
        rows = rows.select("*", _paired(f"g{half}", f"g{k - half}", half).alias(f"g{k}"))
    rows = rows.select(*keep, F.size("g1").alias("_n"), F.posexplode(F.concat(*[F.col(f"g{k}") for k in sizes])).alias("_at", "gram"))
    rows = rows.filter(F.col("gram").isNotNull())
    which = F.floor(F.col("_at") / F.col("_n")).cast("int")
    return rows.select(*keep, F.element_at(F.array(*[F.lit(k) for k in sizes]), which + 1).alias("k"), "gram", (F.col("_at") % F.col("_n")).alias("pos"))


def license_spans(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(k1, k2, template, label, base, first, last, votes, agree, score) of the verified spans in keyed documents.

    first and last are the document's word positions of the first and last word that agrees, score the share of the template that agrees.
    """
    own = stored(prepared(templates), "templates")
    sizes = sorted(r.k for r in own.select("k").distinct().collect())  # at most GRAM values
    columns = "k1, k2, template, label, base, first, last, votes, agree, score"
    if not sizes:
        none = docs.select(*KEY).limit(0)
        return none.selectExpr("k1", "k2", "0L template", "'' label", "false base", "0 first", "0 last", "0L votes", "0L agree", "0D score")
    seeds = _positions(own.select("template", "k", "words").withColumnRenamed("k", "own_k"), ["template", "own_k"], sizes)
    seeds = seeds.filter("k = own_k").select("template", "k", "gram", F.col("pos").alias("at"))
    worded = docs.select(*KEY, words_of(F.col("text")).alias("words"))
    hits = _positions(worded, KEY, sizes).join(_small(stored(seeds, "template-grams")), ["k", "gram"])
    hits = hits.groupBy(*KEY, "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count_distinct("pos").alias("votes"))  # distinct: a repeated row votes once
    hits = hits.join(_small(own.select("template", "n", "slack", F.col("votes").alias("least"))), "template")
    # neighbouring diagonals of one document and template
    line = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > F.col("slack"), F.lit(True))
    hits = hits.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(line))
    total = F.sum("votes").over(Window.partitionBy(*KEY, "template", "span"))
    hits = hits.withColumn("all_votes", total).filter("all_votes >= least").select(*KEY, "template", "n", "span", "diagonal", "all_votes")
    hits = stored(hits, "diagonals")
    # the template's words along each diagonal; a document's diagonals travel together, those of one region in one row
    hit = F.struct("template", "n", "span", "diagonal", "all_votes")
    per_doc = hits.groupBy(*KEY, F.floor(F.col("diagonal") / REGION).alias("region")).agg(F.collect_set(hit).alias("hits"))
    rows = worded.join(_small(stored(per_doc, "diagonals-by-document")), KEY)

    def beside(x: Column, words: Column) -> Column:
        low = F.greatest(F.lit(0), -x.diagonal)  # the part of the template that lies within the document
        return F.struct(x.template.alias("template"), x.span.alias("span"), x.diagonal.alias("diagonal"), x.all_votes.alias("all_votes"),
                        low.alias("low"), F.slice(words, x.diagonal + low + 1, x.n - low).alias("part"))

    cut = rows.select(*KEY, F.inline(F.transform("hits", lambda x: beside(x, F.col("words")))))
    cut = cut.join(_small(own.select("template", F.col("words").alias("theirs"))), "template")
    same = F.zip_with("part", F.slice("theirs", F.col("low") + 1, F.size("part")), lambda a, b: a == b)
    agree = F.filter(F.transform(same, lambda s, i: F.when(s, i + F.col("low"))), lambda i: i.isNotNull())
    found = cut.select(*KEY, "template", "span", "diagonal", "all_votes", F.explode(agree).alias("at"))
    place = (F.col("diagonal") + F.col("at")).alias("place")
    found = found.select(*KEY, "template", "span", "all_votes", "at", place).groupBy(*KEY, "template", "span", "all_votes", "at").agg(
        F.min("place").alias("first"), F.max("place").alias("last"))  # one row for each word of the template at most
    spans = found.groupBy(*KEY, "template", "span", F.col("all_votes").alias("votes")).agg(
        F.count("*").alias("agree"), F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.join(_small(own.select("template", "label", "base", "n", "need")), "template").filter("agree >= need")
    return spans.withColumn("score", F.col("agree") / F.col("n")).selectExpr(*columns.split(", "))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base counts the places of base templates, first_word and last_word are the least and
    largest start of such a place (null without one); base_labels and labels are the sorted labels of
    base templates and of all, joined by commas (empty without any); score is the largest share of a
    template that agrees in a verified span (0 without one). Base templates of ``SHORT`` words or more count where their span begins.
    Null and empty texts have no words; repeated rows get the same result each; no rows give no rows; templates without words are
    left out. Only ids and texts are read.
    """
    docs = keyed(docs, id_col, text_col)
    spans = stored(license_spans(docs, task_templates(docs.sparkSession) if templates is None else templates), "license-spans")
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    base = lambda c: F.when(F.col("base"), F.col(c))
    per_doc = spans.groupBy(*KEY).agg(
        F.count_if("base").alias("n_base"), F.min(base("first")).cast("long").alias("first_word"), F.max(base("first")).cast("long").alias("last_word"),
        joined(F.collect_set(base("label"))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"), F.max("score").alias("score"))
    out = docs.select(*KEY, "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = out.join(_small(stored(per_doc, "licensed")), KEY, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))
