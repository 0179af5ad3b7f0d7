"""Licence scans by diagonal voting of word k-grams, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelbook.llm.common import Query, table

#: Fixed phrases of the base scan: (label, words).
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Fixed opening words of public licences and of notices that name one: (label, text).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
GRAM = 3
REACH = 2
SHARE = 0.6
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BREAKS), lambda w: w != "")


def grams(tokens: Column, k: int) -> Column:
    """Each run of ``k`` words, space-joined; null for fewer words."""
    joined = F.transform(F.sequence(F.lit(0), F.size(tokens) - k), lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(k)]))
    return F.when(F.size(tokens) >= k, joined)


def places(tokens: Column, phrase: str) -> Column:
    """Starts of the phrase's words standing one after the other."""
    first, *rest = phrase.split()

    def here(w: Column, i: Column) -> Column:
        out = w == first
        for j, x in enumerate(rest, 1):
            out &= F.coalesce(F.get(tokens, i + j) == x, F.lit(False))
        return out

    marked = F.transform(tokens, lambda w, i: F.when(here(w, i), i))
    return F.filter(marked, lambda i: i.isNotNull())


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(hash, words, template, label, at, size): a row for each k-gram, as many as the templates' words."""
    rows = [(n, label, at, len(t) - k + 1, " ".join(t[at : at + k])) for n, (label, text) in enumerate(templates) for t in [text.split()] for at in range(len(t) - k + 1)]
    made = spark.createDataFrame(rows, "template int, label string, at int, size int, words string")
    return made.withColumn("hash", F.xxhash64("words"))


def diagonal_hits(rows: DataFrame, templates: list[tuple[str, str]], k: int = GRAM, reach: int = REACH, share: float = SHARE) -> DataFrame:
    """(row_key, label, first_word, last_word, coverage) of verified spans; ``rows`` has row_key and tokens.

    All rolling k-grams join the templates' k-grams by hash (the templates are a fixed
    list, so they are broadcast), words are compared, and votes are counted for each
    diagonal (place in the text less place in the template). Diagonals within ``reach``
    of each other merge, which bridges inserted and missing words; a span holds if the
    distinct template places it has are at least ``share`` of the template.
    """
    keyed = rows.select("row_key", grams(F.col("tokens"), k).alias("grams"))
    sought = F.broadcast(template_grams(rows.sparkSession, templates, k))
    votes = (
        keyed.select("row_key", F.posexplode_outer("grams").alias("pos", "gram"))
        .withColumn("hash", F.xxhash64("gram"))
        .join(sought, "hash")
        .where(F.col("gram") == F.col("words"))
        .groupBy("row_key", "template", "label", "size", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("at"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"))
    )
    order = W.partitionBy("row_key", "template").orderBy("diagonal")
    start = (F.col("diagonal") - F.lag("diagonal").over(order) <= reach).cast("int")
    joined = votes.withColumn("run", F.sum(1 - F.coalesce(start, F.lit(0))).over(order))
    spans = joined.groupBy("row_key", "template", "label", "size", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("found"), F.min("first_word").alias("first_word"), (F.max("last_word") + k - 1).alias("last_word")
    )
    return spans.withColumn("coverage", F.col("found") / F.col("size")).where(F.col("coverage") >= share).select("row_key", "label", "first_word", "last_word", "coverage")


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of ``docs``.

    Base places are exact runs of a phrase's words. ``labels`` adds those of verified
    template spans; both are the empty string where there are none. The score is 1 with
    a base place, else the best span's coverage, else 0. Null texts have no words; rows
    that repeat an id are told apart by their text.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), words(F.col("text")).alias("tokens"))
    starts = {label: places(F.col("tokens"), phrase) for label, phrase in phrases}
    found = rows.select("doc_id", "row_key", F.size("tokens").cast("long").alias("n_words"), *[s.alias(f"at_{label}") for label, s in starts.items()])
    every = F.concat(*[F.col(f"at_{label}") for label in starts])
    base = F.filter(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in starts]), lambda x: x.isNotNull())
    based = found.select(
        "doc_id", "row_key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(base).alias("base")
    )
    spans = diagonal_hits(rows, templates).groupBy("row_key").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    none = F.array().cast("array<string>")
    return based.join(spans, "row_key", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices in every whole text of ``documents``."""
    return scan(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {"op2_license_scan": op2_license_scan}
_GRAMS = ", ".join(str((n, label, at, len(t) - GRAM + 1, " ".join(t[at : at + GRAM]))) for n, (label, text) in enumerate(TEMPLATES) for t in [text.split()] for at in range(len(t) - GRAM + 1))
ORACLES = {
    "op2_license_scan": rf"""
        with rows as (select row_number() over () as k, doc_id, list_filter(str_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda x: x <> '') as w from documents),
        p(label, words) as (values {", ".join(str(x) for x in PHRASES)}),
        places as (select k, w, unnest(range(0, len(w))) as i from rows),
        base as (select k, label, i from places join p on w[i + 1 : i + len(str_split(words, ' '))] = str_split(words, ' ')),
        bases as (select k, count(*) as n, min(i) as a, max(i) as z, string_agg(distinct label, ',' order by label) as labels from base group by k),
        g(template, label, place, size, gram) as (values {_GRAMS}),
        votes as (select k, template, label, size, i - place as diagonal, list(distinct place) as found from places join g on array_to_string(w[i + 1 : i + {GRAM}], ' ') = gram group by all),
        steps as (select *, case when diagonal - lag(diagonal) over (partition by k, template order by diagonal) <= {REACH} then 0 else 1 end as fresh from votes),
        runs as (select *, sum(fresh) over (partition by k, template order by diagonal) as run from steps),
        spans as (select k, label, len(list_distinct(flatten(list(found)))) / size as coverage from runs group by k, template, label, size, run),
        good as (select * from spans where coverage >= {SHARE}),
        best as (select k, max(coverage) as coverage from good group by k),
        named as (select k, string_agg(distinct label, ',' order by label) as labels from (select k, label from good union all select k, label from base) group by k)
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, a::bigint as first_word, z::bigint as last_word, coalesce(bases.labels, '') as base_labels, coalesce(named.labels, '') as labels,
          case when n > 0 then 1.0 else coalesce(coverage, 0.0) end::double as score
        from rows left join bases using (k) left join best using (k) left join named using (k)"""
}
