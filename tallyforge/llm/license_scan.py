"""License scan by diagonal voting, with DataFrame functions only.

Words of every text give rolling hashes of k words. A Spark join puts each hash beside the places of the templates where it
stands; a hit's diagonal is its place in the text minus its place in the template. Hits are summed by diagonal, hits
of neighbouring diagonals (few words inserted or dropped) are merged into one span, and spans are verified word
against word. Phrases that name a license are templates of two or three words, for which every word must match;
license texts are longer templates, for which `least` of the template's words must be found in a span.

Templates are a fixed list of this module (a few hundred words), so broadcasting their hashes is bounded.

Null and empty texts have no words and no labels. Equal rows are told apart by nothing: they share a result, and each
row of the input gets its row. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import alnum_words, let, stored

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Openings of public license texts and headers, lower-cased, without punctuation.
TEXTS = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}

K_PHRASE, K_TEXT = 2, 4


def grams(words: Column, k: int) -> Column:
    """The hash of each run of k words."""
    last = F.size(words) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(k), *(F.get(words, i + j) for j in range(k))))


def placed(words: Column, k: int) -> Column:
    """An array of (at, hash) for grams()."""
    return F.transform(grams(words, k), lambda h, i: F.struct(i.alias("at"), h.alias("hash")))


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, phrase, words, k, n_grams, t_at, hash: a row for each place of each template."""
    rows = [(f"phrase:{p}", label, True, p.split(), K_PHRASE) for p, label in PHRASES.items()] + [(f"text:{label}", label, False, t.split(), K_TEXT) for label, t in TEXTS.items()]
    row = lambda r: F.struct(F.lit(r[0]).alias("template"), F.lit(r[1]).alias("label"), F.lit(r[2]).alias("phrase"), F.split(F.lit(" ".join(r[3])), " ").alias("t_words"), F.lit(r[4]).alias("k"))
    df = spark.range(1).select(F.inline(F.array(*map(row, rows))))
    gram = F.when(F.col("k") == K_PHRASE, grams(F.col("t_words"), K_PHRASE)).otherwise(grams(F.col("t_words"), K_TEXT))
    df = df.withColumn("g", gram)
    return df.select("template", "label", "phrase", "t_words", F.size("g").alias("n_grams"), F.posexplode("g").alias("t_at", "hash"))


def votes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_words, at, and for hits: template, label, phrase, t_size, diagonal, matched.

    One row per hit, and one with at = -1 per document. The k-grams of both sizes are exploded and joined in one stage
    without a shuffle; few rows leave it. matched: the template's places whose words stand on this diagonal, compared
    word by word.
    """
    spark = docs.sparkSession
    places = template_grams(spark)
    own = let(alnum_words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.struct(w.alias("w"), F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("hash"))), placed(w, K_PHRASE), placed(w, K_TEXT)).alias("grams")))
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), own.alias("own"))
    rows = rows.select("doc_id", "text_hash", F.size("own.w").alias("n_words"), F.col("own.w").alias("w"), F.explode("own.grams").alias("gram"))
    rows = rows.select("doc_id", "text_hash", "n_words", "w", "gram.at", "gram.hash")
    joined = rows.join(F.broadcast(places), "hash", "left").where((F.col("at") == -1) | F.col("t_at").isNotNull())
    diagonal = F.when(F.col("at") >= 0, F.col("at") - F.col("t_at"))
    joined = joined.withColumn("diagonal", diagonal)
    matched = F.filter(F.sequence(F.lit(0), F.size("t_words") - 1), lambda t: F.coalesce(F.get("w", F.col("diagonal") + t) == F.get("t_words", t), F.lit(False)))
    return joined.select("doc_id", "text_hash", "n_words", "at", "template", "label", "phrase", F.size("t_words").alias("t_size"), "n_grams", "diagonal", F.when(F.col("at") >= 0, matched).alias("matched"))


def spans(found: DataFrame, least: float = 0.6, apart: int = 3) -> DataFrame:
    """doc_id, text_hash, template, label, phrase, start, end, coverage: the verified spans of votes()."""
    own = ["doc_id", "text_hash", "template", "label", "phrase", "t_size", "n_grams"]
    lines = found.where("at >= 0").groupBy(*own, "diagonal").agg(F.count_distinct("at").alias("votes"), F.min("matched").alias("matched"))
    exact = lines.where(F.col("phrase") & (F.col("votes") == F.col("n_grams")) & (F.size("matched") == F.col("t_size")))
    exact = exact.select("doc_id", "text_hash", "template", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("t_size")).alias("end"), F.lit(1.0).alias("coverage"))
    by = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    near = lines.where(~F.col("phrase")).withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > apart).cast("int"), F.lit(1)))
    near = near.withColumn("group", F.sum("new").over(by))
    near = near.groupBy(*own, "group").agg(F.array_distinct(F.flatten(F.collect_list("matched"))).alias("covered"), F.min(F.col("diagonal") + F.array_min("matched")).alias("start"), (F.max(F.col("diagonal") + F.array_max("matched")) + 1).alias("end"))
    near = near.withColumn("coverage", F.size("covered") / F.col("t_size")).where(F.col("coverage") >= least)
    return exact.unionByName(near.select("doc_id", "text_hash", "template", "label", "phrase", "start", "end", "coverage"))


def license_labels(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """The contract's digest: a row for each row of docs.

    score: 1 if a phrase stands in the text, else the best coverage of a license text found, else 0.
    """
    found = stored(votes(docs), "votes")  # a row per document and hit; texts are read once
    each = found.where("at = -1").groupBy("doc_id", "text_hash", "n_words").agg(F.count("*").alias("rows"))
    spot = spans(found, least)
    per = spot.groupBy("doc_id", "text_hash").agg(
        F.sum(F.col("phrase").cast("bigint")).alias("n_base"), F.min(F.when(F.col("phrase"), F.col("start"))).cast("bigint").alias("first_word"), F.max(F.when(F.col("phrase"), F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    )
    return each.join(per, [each.doc_id.eqNullSafe(per.doc_id), each.text_hash == per.text_hash], "left").select(
        each.doc_id, F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"),
    ).drop("row")
