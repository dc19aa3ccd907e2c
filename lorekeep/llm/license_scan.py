"""License scans by a positional rare-token index. DataFrame functions only.

The index holds the telling words of licence notices with their places. The corpus
gives each word its IDF. A notice stands under its anchor, the highest-IDF word of its
mandatory phrase: no file has the notice without that word, so only a file's words that
are anchors are looked up. Each puts the notices under it at one place of the file. There
the notice's postings are intersected with the file's licence words around the anchor, by
relative position; the phrase has to be whole, and the words that match have to carry
enough of the notice's IDF. That part of the IDF is the score.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import save, text_or_empty

# Licence names, the wordings of their notices, and the phrase that a notice can't lack.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license"),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "as is basis without warranties or conditions"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "retain the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "licensed under the gnu general public license", "general public license"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
)
#: The part of a notice's IDF that has to be found at its place.
GATE = 0.5
# Words too common to be looked up.
COMMON = frozenset("a and any are as be for in is it of or that the to under with".split())
# The phrases that count as base places, and their labels.
BASE: tuple[tuple[tuple[str, ...], str], ...] = (
    (("cc", "by"), "cc-by"),
    (("general", "public", "license"), "gpl"),
    (("all", "rights", "reserved"), "reserved"),
)

#: Weights are whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _postings(templates=TEMPLATES) -> list[tuple[int, str, str, int, bool]]:
    """(number of the notice, word, label, place relative to its phrase's start, whether it is in the phrase)."""
    rows = []
    for number, (label, wording, phrase) in enumerate(templates):
        words, key = wording.split(), phrase.split()
        starts = [i for i in range(len(words)) if words[i : i + len(key)] == key]
        if len(starts) != 1:
            raise ValueError(f"{label}: its phrase must occur once in its wording")
        for i, w in enumerate(words):
            inside = starts[0] <= i < starts[0] + len(key)
            if inside or w not in COMMON:
                rows.append((number, w, label, i - starts[0], inside))
    return rows


def _notices(postings: list[tuple[int, str, str, int, bool]], weight: dict[str, int]) -> list[tuple]:
    """(anchor, its place, label, IDF of all words, words of the phrase, postings) of each notice.

    The anchor is the phrase's word of the highest IDF; ties go to the first by name, then by place.
    """
    notices = []
    for number in sorted({p[0] for p in postings}):
        own = [p[1:] for p in postings if p[0] == number]
        _, anchor, anchor_at = min((-weight[w], w, at) for w, _, at, inside in own if inside)
        posts = [(w, at, weight[w], inside) for w, _, at, inside in own]
        whole, length = sum(p[2] for p in posts), sum(p[3] for p in posts)
        notices.append((anchor, anchor_at, own[0][1], whole, length, posts))
    return notices


def _words(text_col: str) -> Column:
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.regexp_extract_all(F.translate(text_or_empty(text_col), upper, upper.lower()), F.lit(WORD), F.lit(0))


def licence_words(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(row, doc_id, n_words, hits): each file's licence words with place and base label, if one starts there."""
    index = sorted({w for _, w, *_ in _postings(templates)} | {w for words, _ in BASE for w in words})
    assert all(re.fullmatch(WORD, w) for w in index)

    def base_label(word: Column, i: Column) -> Column:
        case = None
        for words, label in BASE:
            here = word == words[0]
            for k, w in enumerate(words[1:], 1):
                here = here & F.get("words", i + k).eqNullSafe(F.lit(w))
            case = F.when(here, label) if case is None else case.when(here, label)
        return case

    def hit(word: Column, i: Column) -> Column:
        return F.when(
            word.isin(index), F.struct(i.alias("place"), word.alias("word"), base_label(word, i).alias("base"))
        )

    split = docs.select("doc_id", _words(text_col).alias("words"))
    found = F.filter(F.transform("words", hit), lambda h: h.isNotNull())
    return split.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.size("words").cast("long").alias("n_words"), found.alias("hits"),
    )


def scan(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, gate: float = GATE) -> DataFrame:
    """Scan every file: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    * Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
    * ``n_base`` counts all places of the base phrases; ``first_word`` and
      ``last_word`` are the smallest and largest start, null without any.
    * ``labels`` holds the base labels and those of all notices that were found: their
      phrase whole, and ``gate`` of their IDF at its place. ``score`` is the best of
      these notices' matched IDF share, 0 without any. Label lists are sorted, without repeats, comma-joined, and
      empty strings without any.
    * Null and empty texts have no words. Repeated rows, null ids and extra
      columns are as good as any. No rows give no rows.
    """
    spark = docs.sparkSession
    files = save(licence_words(docs, text_col, templates), "licence-words")
    postings = _postings(templates)

    words = F.array_distinct(F.transform("hits", lambda h: h["word"]))
    total = files.count()
    seen = dict(  # a row for each word of the index at most
        files.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1))).collect()
    )
    weight = {w: round((1 + math.log((1 + total) / (1 + seen.get(w, 0)))) * UNIT) for _, w, *_ in postings}
    index = _notices(postings, weight)
    anchors = sorted({n[0] for n in index})
    reach = max(abs(at - n[1]) for n in index for _, at, *_ in n[5])
    notices = F.broadcast(  # one row for each notice: fixed, whatever the corpus
        spark.createDataFrame(
            index,
            "anchor string, anchor_at int, label string, whole long, length int, "
            "posts array<struct<word: string, at: int, weight: long, inside: boolean>>",
        )
    )

    def rare(h: Column, j: Column) -> Column:
        # hits are in order of place, so all within reach are among as many hits before and after
        first = F.greatest(j - reach, F.lit(0))
        near = F.slice("hits", first + 1, j - first + reach + 1)
        pairs = F.transform(near, lambda x: F.struct((x["place"] - h["place"]).alias("at"), x["word"].alias("word")))
        return F.when(h["word"].isin(anchors), F.struct(h["word"].alias("word"), pairs.alias("near")))

    looked_up = files.select("row", F.explode(F.filter(F.transform("hits", rare), lambda r: r.isNotNull())).alias("rare"))
    shared = F.filter(
        "posts",
        lambda p: F.array_contains(
            F.col("rare.near"), F.struct((p["at"] - F.col("anchor_at")).alias("at"), p["word"].alias("word"))
        ),
    )
    votes = (
        looked_up.join(notices, F.col("rare.word") == F.col("anchor"))
        .select("row", "label", "whole", "length", shared.alias("shared"))
        .where(F.size(F.filter("shared", lambda p: p["inside"])) == F.col("length"))
        .withColumn("matched", F.aggregate("shared", F.lit(0).cast("long"), lambda n, p: n + p["weight"]))
        .where(F.col("matched") >= gate * F.col("whole"))
    )
    verified = votes.groupBy("row").agg(
        F.collect_set("label").alias("own"), F.max(F.col("matched") / F.col("whole")).alias("score")
    )
    base = F.filter("hits", lambda h: h["base"].isNotNull())
    based = files.select(
        "row", "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["place"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["place"])).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(base, lambda h: h["base"]))).alias("base_own"),
    )
    own = F.coalesce("own", F.array().cast("array<string>"))
    return based.join(verified, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base_own").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base_own", own))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
