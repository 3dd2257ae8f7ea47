"""License scans with a positional index of rare licence words, in DataFrame functions only.

Each licence template has postings for its anchors, the words of the template that the fewest
documents hold. All anchors in a file are looked up; every occurrence votes for the place where
the template would have to start, and anchors that agree on one start add up. A template
counts where enough of its anchors agree and its mandatory key phrase stands at its own place.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, read

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base scan and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening words of public licence notices, (label, template, mandatory key phrase).
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl-3", "gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("agpl-3", "gnu affero general public license version 3", "gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license v 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "unencumbered software released into the public domain"),
]
#: Anchors of a template, and the agreeing share that counts.
ANCHORS = 5
ENOUGH = 0.7


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def phrase(words: str) -> Column:
    return F.array(*[F.lit(w) for w in words.split()])


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many rows each word stands, over all of ``docs``; one row a word comes back."""
    own = F.array_intersect(words_of(lowered(F.col("text"))), F.array(*[F.lit(w) for w in vocabulary]))
    held = docs.select(F.explode(F.array_append(own, F.lit(""))).alias("word"))
    counts = {r[0]: r[1] for r in held.groupBy("word").count().collect()}
    return {w: counts.get(w, 0) for w in vocabulary}, counts.get("", 0)


def postings(frequencies: dict[str, int], rows: int) -> list[tuple[int, str, int, float]]:
    """(template, word, place, share of the template's weight) of each template's rarest words."""
    out = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = text.split()
        idf = {w: math.log((rows + 1) / (frequencies[w] + 1)) + 1e-3 for w in words}
        best = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:ANCHORS]
        total = sum(idf[words[i]] for i in best)
        out += [(t, words[i], i, idf[words[i]] / total) for i in sorted(best)]
    return out


def at(words: Column, start: Column, wanted: str) -> Column:
    """Whether the phrase's words stand in ``words`` from place ``start`` (from 0) on."""
    n = len(wanted.split())
    return (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, F.lit(n)) == phrase(wanted))


def base_hits(words: Column) -> Column:
    """(place, label) of every place where a base phrase stands; a place is tried at its rarest word."""

    def tried(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<place:int,label:string>")
        for text, label in BASE.items():
            own = text.split()
            key = max(range(len(own)), key=lambda k: (own[k] in ("mit", "apache", "nc"), k))
            out = F.when((w == own[key]) & at(words, i - key, text), F.struct(
                (i - key).cast("int").alias("place"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.filter(F.transform(words, tried), lambda h: h.isNotNull())


def scan(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Only texts that hold a word of some key phrase are cut into words; the others' words are
    counted. ``score`` is 1 where a base phrase stands, else the share of agreeing anchors of the
    best verified template, else 0. NULL and empty texts have no words and no labels. Rows are
    known by doc_id and text, so repeated rows get the same result and rows that only share a
    doc_id their own.
    """
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
    index = postings(*document_frequencies(docs, vocabulary))
    low = lowered(F.col("text"))
    gate = F.col("low").contains("cc") & F.col("low").contains("by") & F.col("low").contains("nc")
    for word in sorted({max(k.split(), key=len) for _, _, k in TEMPLATES if k != "cc by nc"}):
        gate = gate | F.col("low").contains(word)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), low.alias("low"), *also)
    rows = rows.withColumn("words", F.when(gate, words_of(F.col("low"))))
    n_words = F.when(F.col("words").isNotNull(), F.size("words")).otherwise(F.regexp_count("low", F.lit(WORD)))
    words = F.coalesce("words", F.array().cast("array<string>"))

    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(p).alias("p"), F.lit(s).alias("s"))
                      for t, w, p, s in index])
    anchors = sorted({w for _, w, _, _ in index})
    seen = F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchors), F.struct(w.alias("w"), i.alias("i")))),
                    lambda x: x.isNotNull())

    def verified(t: Column, start: Column) -> Column:
        out = F.lit(False)
        for n, (_, text, key) in enumerate(TEMPLATES):
            offset = len(text[:re.search(rf"\b{key}\b", text).start()].split())
            out = F.when(t == n, at(F.col("words"), start + offset, key)).otherwise(out)
        return out

    votes = F.flatten(F.transform("seen", lambda o: F.transform(
        F.filter(table, lambda p: p["w"] == o["w"]),
        lambda p: F.struct(p["t"].alias("t"), (o["i"] - p["p"]).alias("start"), p["p"].alias("p"), p["s"].alias("s")))))
    votes = F.filter(votes, lambda v: verified(v["t"], v["start"]))
    cut = rows.select("doc_id", "text_hash", n_words.cast("long").alias("n_words"), "words", base_hits(words).alias("base"),
                      seen.alias("seen"), *also)
    found = cut_lineage(cut.select("doc_id", "text_hash", "n_words", "base", votes.alias("votes"), *also))

    agreed = (found.select("doc_id", "text_hash", F.inline("votes"))
              .groupBy("doc_id", "text_hash", "t", "start", "p").agg(F.max("s").alias("s"))
              .groupBy("doc_id", "text_hash", "t", "start").agg(F.round(F.sum("s"), 6).alias("share")))
    label = F.element_at(F.array(*[F.lit(x) for x, _, _ in TEMPLATES]), (F.col("t") + 1).cast("int"))
    own_labels = agreed.filter(F.col("share") >= ENOUGH).groupBy(
        F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(
        F.collect_set(label).alias("own_labels"), F.least(F.max("share"), F.lit(1.0)).alias("share"))
    joined = found.join(own_labels, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    of_base = F.array_distinct(F.transform("base", lambda h: h["label"]))
    places = F.transform("base", lambda h: h["place"].cast("long"))
    both = F.array_union(of_base, F.coalesce("own_labels", F.array().cast("array<string>")))
    return joined.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), F.array_join(F.sort_array(of_base), ",").alias("base_labels"),
        F.array_join(F.sort_array(both), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), *also)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


QUERIES = {"op4_licences": op4_licences}
ORACLES: dict[str, str] = {}
