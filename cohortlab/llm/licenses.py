"""Operator 5, licence scans by a positional rare-token index. DataFrame functions only.

Templates are short fixed passages with a label. Their words of low document frequency are the index:
word -> (template, position). One pass over the documents keeps, per file, the positions of licence words
(a fixed vocabulary, so what is kept is small) and the places of the base phrases. From these

1. the licence words' inverse document frequencies are counted over all documents,
2. each file looks up all its licence words (the vocabulary is bounded) and votes for (template, position in file - position in
   template); postings that agree on the difference are one alignment,
3. an alignment counts if its IDF weight is a set share of the template's and the words of a mandatory key
   phrase stand at their aligned places.

Cases: null, empty or wordless text -> no words, no labels, score 0; ties between alignments go to the
smaller difference; repeated rows give equal rows; very long texts are read whole; no rows -> no rows.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, passage, mandatory key phrases (one of them must be aligned). Fixed values.
TEMPLATES = [
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3", ["either version 3"]),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2", ["either version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["public domain dedication"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
]
#: Words of the templates that say nothing about licences; they are not indexed.
COMMON = "a and any are as by for in into is may no of or part the this to use with without 0 1 2 3 4".split()

LEAST_SHARE = 0.6       # of a template's IDF weight that an alignment must reach


def _template_words() -> list[tuple[int, str, int, str]]:
    return [(t, label, i, w) for t, (label, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())]


VOCABULARY = sorted({w for *_, w in _template_words()} - set(COMMON))
KEY_WORDS = sorted({w for _, _, phrases in TEMPLATES for p in phrases for w in p.split()} & set(COMMON))


def _phrase_starts(words: Column, places: Column, phrase: str) -> Column:
    """Places where the phrase's words stand one after the other, given the places of its first word's candidates."""
    parts = phrase.split()
    return F.filter(places, lambda i: reduce(lambda a, b: a & b, [
        F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(parts)]))


def _moved(places: str, k: int) -> Column:
    return F.filter(F.transform(places, lambda i: i - k), lambda i: i >= 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base places by label, licence words with positions. One pass, no shuffle."""
    words = F.filter(F.split(F.translate("text", UPPER, LOWER), BREAK), lambda w: w != "")
    src = text_column(docs, id_col, text_col).select("doc_id", words.alias("words"))
    # places of licence words; everything later looks at these only
    rare = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*VOCABULARY), i)), lambda i: i.isNotNull())
    src = src.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), rare.alias("places"))
    near = {}       # the base phrases begin a fixed way before a rare word of theirs
    for phrase, label in BASE.items():
        parts = phrase.split()
        k = next(i for i, w in enumerate(parts) if w in VOCABULARY)
        near[label] = _phrase_starts(F.col("words"), _moved("places", k), phrase)
    hit = F.size("places") > 0
    none = F.array().cast("array<int>")
    around = F.array_distinct(F.flatten(F.transform("places", lambda i: F.sequence(F.greatest(i - 24, F.lit(0)), F.least(i + 24, F.size("words") - 1)))))
    kept = F.filter(around, lambda i: F.get("words", i).isin(*VOCABULARY, *KEY_WORDS))
    return src.select(
        "doc_id", "n_words", *(F.when(hit, v).otherwise(none).alias(k) for k, v in near.items()),
        F.when(hit, F.transform(kept, lambda i: F.struct(i.alias("pos"), F.get("words", i).alias("word"))))
        .otherwise(F.array().cast("array<struct<pos:int,word:string>>")).alias("hits"))


def alignments(scanned: DataFrame) -> DataFrame:
    """(row, label, share): templates found in a file, with the share of their IDF weight that is aligned.

    Files are told apart by their row number, so rows with one id, or none, do not add up."""
    spark = scanned.sparkSession
    n = scanned.count()
    hits = scanned.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.word")
    rare = hits.filter(F.col("word").isin(*VOCABULARY))
    idf = (rare.groupBy("word").agg(F.countDistinct("row").alias("df"))
           .select("word", F.log((F.lit(n) + 1) / (F.col("df") + 0.5)).alias("idf")))
    # fixed values, about 150 rows: safe to broadcast
    postings = spark.createDataFrame(_template_words(), "template int, label string, tpos int, word string")
    indexed = F.broadcast(postings.filter(F.col("word").isin(*VOCABULARY)))
    vocabulary = spark.createDataFrame([(w,) for w in VOCABULARY], "word string")
    unseen = F.log((F.lit(n) + 1) / 0.5)
    weights = F.broadcast(vocabulary.join(idf, "word", "left").select("word", F.coalesce("idf", unseen).alias("idf")))  # one row a vocabulary word
    weight = indexed.join(weights, "word").groupBy("template").agg(F.sum("idf").alias("weight"))
    votes = (rare.join(weights, "word").join(indexed, "word").withColumn("shift", F.col("pos") - F.col("tpos"))
             .groupBy("row", "template", "label", "shift").agg(F.sum("idf").alias("got"))
             .join(F.broadcast(weight), "template")
             .withColumn("share", F.when(F.col("weight") > 0, F.col("got") / F.col("weight")).otherwise(0.0))
             .filter(F.col("share") >= LEAST_SHARE))
    # key phrases: all their words at the aligned places
    keys = [(t, f"{t}.{k}", i + j, w, len(p.split())) for t, (_, text, phrases) in enumerate(TEMPLATES) for k, p in enumerate(phrases)
            for i in range(len(text.split())) if text.split()[i:i + len(p.split())] == p.split() for j, w in enumerate(p.split())]
    wanted = F.broadcast(spark.createDataFrame(keys, "template int, phrase string, tpos int, word string, size int"))
    asked = votes.join(wanted, "template").withColumn("pos", F.col("shift") + F.col("tpos"))
    verified = (asked.join(hits, ["row", "pos", "word"], "left_semi")
                .groupBy("row", "template", "label", "shift", "share", "phrase", "size").agg(F.count("*").alias("n")).filter("n = size"))
    return verified.groupBy("row", "label").agg(F.max("share").alias("share"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base places, labels and a score (1 with a base phrase, else the best aligned share)."""
    scanned = saved(scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "license-hits")
    found = alignments(scanned).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    places = F.concat(*(F.col(v) for v in (f"`{x}`" for x in BASE.values())))
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"`{x}`") > 0, F.lit(x)) for x in BASE.values()))))
    rows = scanned.join(found, "row", "left").withColumn("places", places).withColumn("base", base)
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))).alias("score"))
