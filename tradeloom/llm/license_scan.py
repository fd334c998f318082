"""License scans by a positional rare-token index, in DataFrame functions only.

1. One pass over the texts cuts words and keeps, for each file, the positions of licence words (the words of templates and key phrases
   without function words), each with the few words around it, and the places of the base phrases, which must stand word
   by word.  The result is small and staged; the texts are not read again.
2. Document frequencies of the licence words come from all files; they give each word's IDF.
3. A file's licence words are looked up in the templates' postings, the rarest with the most weight.  Postings that agree on the
   relative position (position in file minus position in template) vote for a template; the share of the template's IDF mass that agrees is the
   score, and from LEAST_SCORE on the template is proposed.
4. Only proposed templates are verified: one of the template's mandatory key phrases must stand word by word in the file.  Phrases
   are rows of a table, so that the plan does not grow with the templates.

Defined results: null or empty text: no words, no labels, score 0.  Repeated rows and ids keep one result each.
Columns besides id and text are ignored, whatever their names.  Ties between labels keep all labels.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, staged, whole_text

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The contract's base phrases with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices of public licences and the key phrases of which one must stand.
TEMPLATES = {
    "agpl": ("under the terms of the gnu affero general public license", ["affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license"]),
    "artistic-2.0": ("licensed under the artistic license 2 0", ["artistic license"]),
    "boost": ("distributed under the boost software license version 1 0", ["boost software license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source"]),
    "cc-by-nc": ("licensed under a creative commons attribution noncommercial license cc by nc", ["cc by nc", "attribution noncommercial"]),
    "cc-by-sa": ("licensed under a creative commons attribution sharealike license cc by sa", ["cc by sa", "attribution sharealike"]),
    "cc0": ("the author has dedicated all copyright and related rights to this work to the public domain worldwide", ["dedicated all copyright and related"]),
    "cddl": ("subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    "epl-2.0": ("made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    "gfdl": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ["gnu free documentation license"]),
    "gpl": ("this program is free software you can redistribute it under the terms of the gnu general public license", ["gnu general public license"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    "lgpl": ("under the terms of the gnu lesser general public license", ["lesser general public license"]),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted"]),
    "mit-name": ("released under the mit license", ["mit license"]),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["without any express or implied warranty"]),
}
#: Labels of templates that name the same licence as another.
LABELS = {"mit-name": "mit"}
# Words too common to look a file up by.
FUNCTION_WORDS = frozenset("a all and any are as be by can copy for free has held in into is it made no not of on or person source terms the this to under use v will with without work you 0 1 2".split())
#: Share of a template's IDF mass that must agree on one relative position.
LEAST_SCORE = 0.6


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _anchor(phrase: list[str]) -> int:
    """The place in a phrase of the word that it is looked up by."""
    return min(range(len(phrase)), key=lambda k: (phrase[k] in FUNCTION_WORDS, k))


def _phrase_places(words: Column, hits: Column, phrase: list[str]) -> Column:
    """Starts (from 0) of the phrase, found at its least common word."""
    anchor = _anchor(phrase)
    wanted = F.array(*[F.lit(w) for w in phrase])
    at = F.transform(F.filter(hits, lambda h: h["word"] == phrase[anchor]), lambda h: h["pos"] - anchor)
    return F.filter(at, lambda i: (i >= 0) & (F.slice(words, F.greatest(i, F.lit(0)) + 1, len(phrase)) == wanted))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.named_struct(F.lit("pos"), i.cast("long"), F.lit("label"), F.lit(label)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE_PHRASES, templates: dict[str, tuple[str, list[str]]] = TEMPLATES) -> DataFrame:
    """(id, n_words, places array<struct<pos, label>>, base_labels, labels, score) for each row.

    places: all places of base phrases, in file order; base_labels, labels: distinct labels, sorted; score: the best template's, of those looked up.
    """
    spark = docs.sparkSession
    postings = [(name, word, k) for name, (text, _) in templates.items() for k, word in enumerate(text.split()) if word not in FUNCTION_WORDS]
    keys = [(name, p.split()) for name, (_, phrases) in templates.items() for p in phrases]
    vocabulary = sorted({w for _, w, _ in postings} | {w for p in [p.split() for p in base] + [p for _, p in keys] for w in p if w not in FUNCTION_WORDS})
    reach = max((len(p) for _, p in keys), default=1) - 1  # words beside a licence word that a key phrase may need

    words = docs.select(F.col(id_col).alias("id"), words_of(whole_text(text_col)).alias("words"))
    hit = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.named_struct(F.lit("pos"), i, F.lit("word"), w)))
    found = words.select("id", F.size("words").cast("long").alias("n_words"), "words", F.filter(hit, lambda h: h.isNotNull()).alias("hits"))
    none = F.expr("cast(array() as array<int>)")
    places = F.concat(*[_labelled(F.when(F.size("hits") > 0, _phrase_places(F.col("words"), F.col("hits"), p.split())).otherwise(none), label) for p, label in base.items()])
    first = lambda h: F.greatest(h["pos"] - reach, F.lit(0))
    around = F.transform("hits", lambda h: F.named_struct(F.lit("pos"), h["pos"], F.lit("word"), h["word"], F.lit("first"), first(h), F.lit("near"), F.slice("words", first(h) + 1, 2 * reach + 1)))
    rows = staged(found.select("id", "n_words", around.alias("hits"), F.array_sort(places).alias("places"), F.monotonically_increasing_id().alias("row")), "license-hits")

    df = {r["word"]: r["n"] for r in rows.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    n_docs = rows.count()
    idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
    mass = {name: sum(idf[w] for n, w, _ in postings if n == name) for name in templates}
    index = spark.createDataFrame([(name, word, k, idf[word] / mass[name]) for name, word, k in postings], "name string, word string, offset int, mass double")
    phrases = spark.createDataFrame([(name, p[_anchor(p)], _anchor(p), p, LABELS.get(name, name)) for name, p in keys], "name string, word string, anchor int, phrase array<string>, label string")

    seen = rows.where(F.size("hits") > 0).select("row", F.inline("hits"))
    votes = seen.select("row", "pos", "word").join(F.broadcast(index), "word")
    agreed = votes.groupBy("row", "name", (F.col("pos") - F.col("offset")).alias("shift")).agg(F.sum("mass").alias("score"))
    scored = staged(agreed.groupBy("row", "name").agg(F.round(F.max("score"), 6).alias("score")), "license-scores")
    proposed = scored.where(F.col("score") >= LEAST_SCORE).join(F.broadcast(phrases), "name")
    stands = F.slice("near", F.greatest(F.col("pos") - F.col("anchor") - F.col("first"), F.lit(0)) + 1, F.size("phrase")) == F.col("phrase")
    verified = seen.join(proposed, ["row", "word"]).where((F.col("pos") >= F.col("anchor")) & stands)
    own = verified.groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("own"))  # at most the templates' labels
    best = scored.groupBy("row").agg(F.max("score").alias("score"))

    out = rows.join(best, "row", "left").join(own, "row", "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("own", F.expr("cast(array() as array<string>)"))))
    return out.select(F.col("id").alias(id_col), "n_words", "places", base_labels.alias("base_labels"), labels.alias("labels"), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))).alias("score"))
