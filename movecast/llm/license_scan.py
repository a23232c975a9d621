"""License scans by diagonal voting.

All word pairs of all texts, as rolling hashes, are joined in Spark with the places of the same pairs in license templates. A
match at word p of a text and word q of a template votes for the diagonal p - q. Each diagonal is merged with its neighbours up to
``DRIFT`` words further (words put in or left out on the way through a template), never with a longer chain of them. Where a
band has ``LEAST_VOTES`` of a template's pairs, its span is verified: the words of the text from the first to the last vote are
compared with the template, all of them and in order, by edit distance over words. The score is the likeness of the best verified span,
so words of a license that stand scattered give neither label nor score. The join compares the pairs themselves besides their
hashes, so no vote is a hash collision. Phrases are exact: a diagonal that has all pairs of a phrase.

Letters A-Z count as a-z. Words are runs of ASCII digits and letters and of all characters beyond ASCII. A null text has no words.
Rows with equal doc_id and text (also null ones) are the same document and get the same result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .line_dedup import _key, _told

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases whose places are counted exactly, and their labels.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
# Sentences of public licenses, and one of them in full.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
        "from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc", "this work is licensed under a creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Likeness that a verified span must have to give its label.
LEAST_LIKENESS = 0.8
#: Share of a template's pairs that a band must have to be verified.
LEAST_VOTES = 0.5
#: Diagonals of a band lie so many words apart, at most.
DRIFT = 4
#: Characters that stand for words while spans are compared; the first for all that a template does not have.
LETTERS = "".join(map(chr, range(0x4E00, 0x9E00)))


def license_words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lower, NOT_WORD), lambda w: w != "")


def template_pairs(spark, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(hash, pair, template, at, pairs): each pair of words of each template. As large as the list of templates."""
    rows = []
    for number, (_, text) in enumerate(templates):
        words = text.split()
        if len(words) < 2:
            raise ValueError("a template has two words or more")
        rows += [(f"{a} {b}", number, at, len(words) - 1) for at, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    table = spark.createDataFrame(rows, "pair string, template int, at int, pairs int")
    return table.withColumn("hash", F.xxhash64("pair"))


def template_words(spark, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, known, letters, n): the different words of each template, all its words as letters, and their number."""
    rows = []
    for number, (_, text) in enumerate(templates):
        words = text.split()
        known = list(dict.fromkeys(words))
        if len(known) >= len(LETTERS):
            raise ValueError(f"a template has fewer than {len(LETTERS)} different words")
        rows.append((number, known, "".join(LETTERS[1 + known.index(w)] for w in words), len(words)))
    return spark.createDataFrame(rows, "template int, known array<string>, letters string, n int")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, words and a key that equal documents share."""
    return docs.select("doc_id", "text").select("doc_id", _key(), license_words(F.col("text")).alias("words"))


def diagonals(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(doc_id, key, template, pairs, diagonal, votes, lo, hi): votes of each diagonal, the first and the last of them in words, from 0.
    A diagonal has each pair of a template once at most."""
    # Outer, as Spark would put a filter below a plain explode that works out all words again for each word.
    votes = keyed(docs).select(
        "doc_id",
        "key",
        F.posexplode_outer(
            F.transform(
                F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))),
                lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)),
            )
        ).alias("place", "pair"),
    ).withColumn("hash", F.xxhash64("pair"))
    table = template_pairs(docs.sparkSession, templates)
    hits = votes.alias("v").join(F.broadcast(table).alias("t"), (F.col("v.hash") == F.col("t.hash")) & (F.col("v.pair") == F.col("t.pair")))
    place = F.col("place")
    return (
        hits.select("doc_id", "key", "template", "pairs", "place", (place - F.col("at")).alias("diagonal"))
        .groupBy("doc_id", "key", "template", "pairs", "diagonal")
        .agg(F.count("*").alias("votes"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    )


def bands(voted: DataFrame) -> DataFrame:
    """(doc_id, key, template, start, end) of each span with votes enough; ends are exclusive."""
    near = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    merged = voted.withColumns({"total": F.sum("votes").over(near), "start": F.min("lo").over(near), "end": F.max("hi").over(near) + 2})
    return merged.where(F.col("total") >= LEAST_VOTES * F.col("pairs")).select("doc_id", "key", "template", "start", "end").distinct()


def verified(docs: DataFrame, spans: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """``spans`` with ``likeness``: 1 less the edit distance between the words of a span and of its template, over the template's length."""
    _, few = _told(docs.select("doc_id", "text"), spans)
    words = keyed(few.select("row.*")).drop("doc_id").dropDuplicates(["key"])
    both = spans.join(words, "key").join(F.broadcast(template_words(docs.sparkSession, templates)), "template")
    span = F.slice("words", F.col("start") + 1, F.col("end") - F.col("start"))
    letters = F.transform(span, lambda w: F.substring(F.lit(LETTERS), (F.array_position("known", w) + 1).cast("int"), F.lit(1)))
    distance = F.levenshtein(F.array_join(letters, ""), F.col("letters"))
    return both.select("doc_id", "key", "template", "start", "end", F.greatest(F.lit(0.0), 1 - distance / F.col("n")).alias("likeness"))


def license_digest(docs: DataFrame) -> DataFrame:
    """One row for each document: all places of the phrases, the labels that they and the templates give, and the likeness of the best
    span (1 for a phrase). Documents without any have no labels (empty) and score 0."""
    named_ = (*PHRASES, *TEMPLATES)
    label = F.get(F.array(*[F.lit(x) for x, _ in named_]), F.col("template")).alias("label")
    base = F.col("template") < len(PHRASES)
    voted = durable(diagonals(docs, named_))
    phrases = voted.where(base & (F.col("votes") == F.col("pairs")))
    spans = durable(bands(voted.where(~base)))
    found = phrases.select("doc_id", "key", label, "diagonal", F.lit(1.0).alias("likeness")).unionByName(
        verified(docs, spans, named_).select("doc_id", "key", label, F.lit(None).cast("int").alias("diagonal"), "likeness")
    )
    found = found.groupBy("doc_id", "key").agg(
        F.count("diagonal").alias("n_base"),
        F.min("diagonal").alias("first_word"),
        F.max("diagonal").alias("last_word"),
        F.collect_set(F.when(F.col("diagonal").isNotNull(), F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(F.col("likeness") >= LEAST_LIKENESS, F.col("label"))).alias("labels"),
        F.max("likeness").alias("score"),
    )
    counted = keyed(docs).select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    named = lambda c: F.coalesce(F.concat_ws(",", F.sort_array(F.col(c))), F.lit(""))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key"))
    return (
        counted.alias("d")
        .join(found.alias("f"), same, "left")
        .select(
            "d.doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            F.col("first_word").cast("long").alias("first_word"),
            F.col("last_word").cast("long").alias("last_word"),
            named("base_labels").alias("base_labels"),
            named("labels").alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
