"""Licence scans by a positional index of rare words. Built-in functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words of a notice that the limit of rarity must leave in the index, and the share of their weight a match needs.
ANCHORS, ENOUGH = 3, 0.6

# Phrases whose every place counts, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence texts and notices, the words of each that must stand there, the label.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction",
     "permission is hereby granted free of charge", "mit-text"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction including without limitation the"
     " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
     " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"
     " and this permission notice shall be included in all copies or substantial portions of the software the software is"
     " provided as is without warranty of any kind express or implied including but not limited to the warranties of"
     " merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright"
     " holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
     " arising from out of or in connection with the software or the use or other dealings in the software",
     "the above copyright notice and this permission notice shall be included in all copies", "mit-full"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the"
     " following conditions are met", "redistribution and use in source and binary forms", "bsd-text"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following"
     " disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
     " following disclaimer in the documentation and or other materials provided with the distribution",
     "redistributions in binary form must reproduce the above copyright notice", "bsd-conditions"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
     " derived from this software without specific prior written permission",
     "may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
     " license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by"
     " applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
     " without warranties or conditions of any kind either express or implied",
     "you may not use this file except in compliance with the license", "apache-2.0-notice"),
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
     " license as published by the free software foundation", "gnu general public license", "gpl-notice"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general"
     " public license as published by the free software foundation", "gnu lesser general public license", "lgpl-notice"),
    ("under the terms of the gnu affero general public license as published by the free software foundation",
     "gnu affero general public license", "agpl-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
     " granted provided that the above copyright notice and this permission notice appear in all copies",
     "with or without fee is hereby granted", "isc-full"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
     " granted", "permission to use copy modify", "isc-text"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable"
     " for any damages arising from the use of this software",
     "in no event will the authors be held liable for any damages", "zlib-text"),
    ("this is free and unencumbered software released into the public domain",
     "free and unencumbered software released into the public domain", "unlicense"),
    ("distributed under the boost software license version 1 0", "boost software license version 1 0", "bsl-1.0"),
    ("released under the mit license", "mit license", "mit-notice"),
    ("licensed under cc by nc 4 0", "cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc by 4 0", "cc-by-4.0"),
]


@dataclass(frozen=True)
class Template:
    words: list[str]
    key: list[str]
    label: str
    whole: bool


def templates() -> list[Template]:
    """The phrases, every word of which is mandatory, and the notices."""
    return [Template(p.split(), p.split(), name, True) for p, name in PHRASES.items()] + [
        Template(t.split(), k.split(), name, False) for t, k, name in NOTICES]


@dataclass(frozen=True)
class Index:
    """Postings (template, position, weight) of each licence word that is rare enough to be looked up, and the
    weight of all postings of each template.
    """

    templates: list[Template]
    postings: dict[str, list[tuple[int, int, float]]]
    needs: list[float]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(
        F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def build_index(docs: DataFrame, text: str = "text", anchors: int = ANCHORS, own: list[Template] | None = None) -> Index:
    """Document frequencies of all licence words over all texts, and the positional postings of the rare ones.

    The limit of rarity is the highest inverse document frequency that leaves every phrase its rarest word and every
    notice ``anchors`` of its words. So whatever a file holds whole, its highest-ranking licence words find. Only words of the
    templates, a fixed list and the caller's ``own``, are counted and collected.
    """
    known = templates() + (own or [])
    vocabulary = sorted({w for t in known for w in t.words})
    found = docs.select(F.explode(F.array_intersect(words_of(F.col(text)), F.lit(vocabulary))).alias("word"))
    frequency = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    total = docs.count()
    weight = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for w in vocabulary}
    ranked = [sorted((weight[w] for w in set(t.words)), reverse=True) for t in known]
    limit = min(r[0 if t.whole else min(anchors, len(r)) - 1] for t, r in zip(known, ranked, strict=True))
    postings: dict[str, list[tuple[int, int, float]]] = {}
    needs = [0.0] * len(known)
    for k, t in enumerate(known):
        for i, w in enumerate(t.words):
            if weight[w] >= limit:
                postings.setdefault(w, []).append((k, i, weight[w]))
                needs[k] += weight[w]
    return Index(known, postings, needs)


def _lookup(index: Index, word: Column) -> Column:
    """The postings of a word: an array of (template, position, weight)."""
    entries = []
    for w, own in sorted(index.postings.items()):
        listed = [F.struct(F.lit(k).alias("template"), F.lit(i).alias("position"), F.lit(v).alias("weight")) for k, i, v in own]
        entries += [F.lit(w), F.array(*listed)]
    return F.try_element_at(F.create_map(*entries), word)


def _intersected(index: Index, enough: float) -> Column:
    """(top, hits): the best share of weight, and all (template, start) that ``enough`` of the template's weight agrees on.

    Each place of a looked-up word gives, by its postings, the starts it implies. The votes are sorted and added up in
    one pass; a start is a hit from the vote on that makes it ``enough``.
    """
    votes = F.flatten(F.transform("_places", lambda p: F.transform(_lookup(index, F.get("_words", p)), lambda e: F.struct(
        e["template"].alias("template"), (p - e["position"]).alias("start"), e["weight"].alias("weight")))))
    zero = F.struct(
        F.lit(-1).alias("template"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"),
        F.array().cast("array<struct<template:int,start:int>>").alias("hits"))
    needs = F.lit(index.needs)

    def add(acc: Column, vote: Column) -> Column:
        same = (acc["template"] == vote["template"]) & (acc["start"] == vote["start"])
        before = F.when(same, acc["sum"]).otherwise(0.0)
        total, need = before + vote["weight"], F.get(needs, vote["template"])
        reached = (total / need >= enough) & ((before / need < enough) | ~same)
        hit = F.array(F.struct(vote["template"].alias("template"), vote["start"].alias("start")))
        return F.struct(
            vote["template"].alias("template"), vote["start"].alias("start"), total.alias("sum"),
            F.greatest(total / need, acc["top"]).alias("top"),
            F.when(reached, F.concat(acc["hits"], hit)).otherwise(acc["hits"]).alias("hits"))

    return F.aggregate(F.array_sort(votes), zero, add)


def scan(docs: DataFrame, index: Index, id_column: str = "doc_id", text: str = "text",
         enough: float = ENOUGH) -> DataFrame:
    """Return (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Each text looks up the places of
    its rarest licence words in the templates' positional postings; templates whose postings agree on a start with
    ``enough`` of their weight are verified there: the mandatory words must stand at their relative position. Every such
    start is tried; a phrase is mandatory as a whole, so all its places are counted. ``score`` is the best share of
    weight, 1 for a phrase. Null and empty texts have no words, null places, empty labels and score 0. Repeated rows and
    null ids are rows like others. Extra columns are ignored; no rows give no rows. No shuffle: all work is inside the row.
    """
    known = index.templates
    names, whole = F.lit([t.label for t in known]), F.lit([t.whole for t in known])
    keys = F.array(*[F.lit(t.key) for t in known])
    offsets = F.lit([next(i for i in range(len(t.words)) if t.words[i : i + len(t.key)] == t.key) for t in known])
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), words_of(F.col(text)).alias("_words"))
    n = F.size("_words")
    places = F.filter(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.get("_words", i).isin(sorted(index.postings)))
    # every step keeps the columns it reads, so that none is computed again inside a lambda
    rows = rows.select("*", n.cast("long").alias("n_words"), places.alias("_places"))
    rows = rows.select("*", F.when(F.size("_places") > 0, _intersected(index, enough)).alias("_met"))

    def stands(hit: Column) -> Column:
        at, key = hit["start"] + F.get(offsets, hit["template"]), F.get(keys, hit["template"])
        return F.when(at >= 0, F.slice("_words", at + 1, F.size(key)) == key).otherwise(F.lit(False))

    rows = rows.select("*", F.coalesce(
        F.filter("_met.hits", stands), F.array().cast("array<struct<template:int,start:int>>")).alias("_sure"))
    rows = rows.select("*", F.filter("_sure", lambda h: F.get(whole, h["template"])).alias("_base"))

    def joined(hits: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.get(names, h["template"])))), ",")

    starts = F.col("_base.start")
    return rows.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined("_base").alias("base_labels"), joined("_sure").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("_met.top", F.lit(0.0)))).alias("score"))
