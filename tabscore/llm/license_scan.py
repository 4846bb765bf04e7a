"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words are cut into blocks of 2 * STRIDE words, one starting at every multiple of STRIDE, so every
passage of up to STRIDE words lies whole in a block. A template is the set of its words. The join finds every
(block, template) with |block & template| >= threshold * |template|:

- tokens are ordered globally by how many documents hold them, rarest first (one aggregation over the corpus,
  whose result has at most one row for each word of the fixed template catalogue);
- prefix filter: a template's `size - need + 1` rarest tokens are its prefix; a block without one can't qualify;
- length filter: a block with fewer than `need` catalogue words can't qualify;
- positional filter: at the first shared token, what follows in either ordered list bounds the overlap;
- what is left is verified by the exact intersection.

The template side is a catalogue of fixed size, so its prefix index travels in the plan as literals and the
probe side is joined where it lies: rows of documents are never shuffled, and no key can be hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import ascii_lower, let

STRIDE = 64
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted one by one. Fixed values.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: label, threshold, text. Notices of public licenses. A user's own are a parameter of license_scan.
NOTICES = [
    ("agpl", 1.0, "gnu affero general public license"),
    ("apache-2.0", 1.0, "licensed under the apache license version 2 0"),
    ("apache-2.0", 0.8, "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses"),
    ("boost-1.0", 1.0, "boost software license version 1 0"),
    ("bsd", 0.8, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", 0.8, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc0-1.0", 0.8, "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc", 1.0, "licensed under cc by nc 4 0"),
    ("cc-by-sa", 1.0, "licensed under cc by sa 4 0"),
    ("epl-2.0", 0.8, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl-notice", 0.8, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", 1.0, "licensed under the gnu general public license version 3"),
    ("isc", 0.8, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", 1.0, "gnu lesser general public license"),
    ("mit", 1.0, "released under the mit license"),
    ("mit", 0.8, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl-2.0", 0.8, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", 0.8, "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", 0.8, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[str, ...]
    need: int
    base: bool

    @property
    def prefix_size(self) -> int:
        return len(self.tokens) - self.need + 1


def catalogue(notices: list[tuple[str, float, str]] = NOTICES) -> list[Template]:
    """Phrases need all their words in a block; their places are then verified word by word. Notices: label, threshold,
    and their words in lower case, parted by blanks."""
    made = [Template(k, tuple(dict.fromkeys(p.split())), len(set(p.split())), True) for k, p in PHRASES.items()]
    for label, share, text in notices:
        tokens = tuple(dict.fromkeys(text.split()))
        made.append(Template(label, tokens, -(-round(share * 100) * len(tokens) // 100), False))
    return made


def license_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def token_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Documents that hold each word of the catalogue: at most len(vocabulary) rows reach the driver."""
    held = F.array_distinct(F.filter(license_words(F.col(text)), lambda w: w.isin(vocabulary)))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in rows}


def license_scan(docs: DataFrame, text: str = "text", stride: int = STRIDE, notices: list[tuple[str, float, str]] = NOTICES) -> DataFrame:
    """docs with the columns n_words, matches (array of label, block, containment, base) and places (label, word).

    Null and empty texts have no words, matches or places. Rows are scored one by one, so repeated rows, ties and
    null ids need no rule; a column of docs with the name of a new one is replaced.
    """
    templates = catalogue(notices)
    vocabulary = sorted({w for t in templates for w in t.tokens})
    frequency = token_frequencies(docs, vocabulary, text)
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency[w], w)))}
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])

    entries, prefix_words = [], set()
    for t in templates:
        own = sorted(t.tokens, key=order.get)
        prefix_words.update(own[: t.prefix_size])
        ints = [F.array(*[F.lit(order[w]) for w in ws]) for ws in (own[: t.prefix_size], own)]
        entries.append(F.struct(F.lit(t.label).alias("label"), F.lit(t.need).alias("need"), F.lit(len(own)).alias("size"), ints[0].alias("prefix"), ints[1].alias("tokens"), F.lit(t.base).alias("base")))
    index = F.array(*entries)
    prefix_list = sorted(prefix_words)

    def candidate_blocks(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(prefix_list), i)), lambda i: i.isNotNull())
        return F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array((i / stride).cast("int"), F.greatest((i / stride).cast("int") - 1, F.lit(0))))))

    def qualifies(block: Column, t: Column) -> Column:
        first = F.array_min(F.array_intersect(block, t["prefix"]))
        left = F.least(t["size"] - F.array_position(t["tokens"], first), F.size(block) - F.array_position(block, first)) + 1
        return (F.size(block) >= t["need"]) & F.arrays_overlap(block, t["prefix"]) & (left >= t["need"]) & (F.size(F.array_intersect(block, t["tokens"])) >= t["need"])

    def matches(words: Column) -> Column:
        def of_block(b: Column) -> Column:
            tokens = F.filter(F.slice(words, b * stride + 1, F.lit(2 * stride)), lambda w: w.isin(vocabulary))
            ordered = F.array_sort(F.array_distinct(F.transform(tokens, lambda w: F.try_element_at(ranks, w))))
            return let(
                ordered,
                lambda block: F.transform(
                    F.filter(index, lambda t: qualifies(block, t)),
                    lambda t: F.struct(t["label"].alias("label"), b.alias("block"), (F.size(F.array_intersect(block, t["tokens"])) / t["size"]).alias("containment"), t["base"].alias("base")),
                ),
            )

        return F.flatten(F.transform(candidate_blocks(words), of_block))

    def places_of(label: str, words: Column, found: Column) -> Column:
        own = PHRASES[label].split()
        phrase = F.array(*[F.lit(w) for w in own])

        def starts(m: Column) -> Column:
            inside = F.sequence(m["block"] * stride, m["block"] * stride + 2 * stride - 1)
            return F.filter(inside, lambda p: F.slice(words, p + 1, F.lit(len(own))) == phrase)

        of_label = F.filter(found, lambda m: m["base"] & (m["label"] == label))
        return F.transform(F.array_distinct(F.flatten(F.transform(of_label, starts))), lambda p: F.struct(F.lit(label).alias("label"), p.cast("long").alias("word")))

    def places(words: Column, found: Column) -> Column:
        return F.concat(*[places_of(label, words, found) for label in PHRASES])

    some = F.arrays_overlap("_words", F.array(*[F.lit(w) for w in prefix_list]))
    kind = "array<struct<label:string,block:int,containment:double,base:boolean>>"
    out = docs.withColumn("_words", license_words(F.col(text)))
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("matches", F.when(some, let(F.col("_words"), matches)).otherwise(F.array().cast(kind)))
    empty = F.array().cast("array<struct<label:string,word:bigint>>")
    out = out.withColumn("places", F.when(F.size("matches") > 0, let(F.col("_words"), lambda w: places(w, F.col("matches")))).otherwise(empty))
    return out.drop("_words")


def labels_of(scanned: DataFrame) -> DataFrame:
    """The columns of the registered query, from what license_scan returns."""
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    own = F.filter("matches", lambda m: ~m["base"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform(own, lambda m: m["label"]))), ",").alias("labels"),
        F.coalesce(F.when(F.size("places") > 0, F.lit(1.0)), F.array_max(F.transform(own, lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )
