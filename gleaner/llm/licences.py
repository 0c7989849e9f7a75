"""Operator 6: licence scans by a positional rare-token index [native].

Texts are read once: the places of all licence words (those of the templates
and base phrases) become a narrow positional index, a row for each file. From
it come the inverse document frequencies over the whole corpus. Each template
is posted, with its position, under the rarest word of its mandatory key
phrase, which no place of it can lack. A file's occurrences of those words are
looked up, each giving a template and the one place where it would begin; there
the words of the template are intersected by relative position, and where
enough of their weight stands, and the mandatory key phrase stands in full, the
label is given. Entries are ordered by place, so what stands near an occurrence
lies in a short slice around it, and the work grows with the number of words.
All of it is in-row: column expressions only, no shuffle of files.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import materialise

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Wordings of public licences as (label, template, mandatory key phrase).
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright cc0 1 0", "cc0"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)
#: Share of a template's weight that has to stand in place.
LEAST_COVER = 0.75
#: What parts words: ASCII but letters and digits.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Letters beyond ASCII whose lower-case form holds an ASCII one; they make a word no licence word.
_FALSE_FRIENDS = "\u212A\u0130"


def vocabulary(templates=TEMPLATES) -> list[str]:
    """All licence words; a word's code is its place in the list."""
    return sorted({w for text in (*(t for _, t, _ in templates), *(p for p, _ in BASE)) for w in text.split()})


def positions(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, entries) for each row of `docs`: the positional index of licence words.

    An entry is a word's place, from 0, times the number of licence words, plus
    the word's code; entries are in order of place.
    """
    known = vocabulary(templates)
    plain = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("\u00E5")), _FALSE_FRIENDS, F.coalesce(F.col(text_col), F.lit("")))
    # Beyond ASCII any letter case is a word letter, and no licence word has one.
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array(F.split(F.lower(plain), _BREAK))).alias("words"))
    words = F.col("words")
    blank_front = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0)
    blank_end = F.when((F.size(words) > 1) & (F.get(words, F.size(words) - 1) == ""), 1).otherwise(0)
    codes = F.array(*map(F.lit, known))
    rows = rows.select("id", "words", blank_front.alias("front"), blank_end.alias("end"))
    entry = lambda w, i: F.when(w.isin(known), (i - F.col("front")).cast("long") * len(known) + F.array_position(codes, w) - 1)
    entries = F.filter(F.transform(words, entry), lambda e: e.isNotNull())
    n_words = (F.size(words) - F.col("front") - F.col("end")).cast("long")
    return rows.select("id", n_words.alias("n_words"), entries.alias("entries"))


def word_weights(index: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """The inverse document frequency, over all rows of an index, of each licence word.

    Counts are combined before the shuffle; a row for each licence word comes to the driver.
    """
    known = vocabulary(templates)
    codes = F.array_distinct(F.transform("entries", lambda e: F.pmod(e, F.lit(len(known))).cast("int")))
    found = index.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    df = {known[r.code]: r.n for r in found.collect()}
    n = index.count()
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in known}


def scan(index: DataFrame, weights: dict[str, float], templates=TEMPLATES, id_col: str = "doc_id", least_cover: float = LEAST_COVER) -> DataFrame:
    """(id_col, n_words, base, found) for each row of an index.

    `base` is an array of (label, start) of the base phrases' places, `found`
    an array of (label, start, cover) of template places; words count from 0.
    A template's place may begin before the text does, if enough of it stands.
    """
    known = vocabulary(templates)
    code = {w: i for i, w in enumerate(known)}
    size = len(known)
    # (words, offset of the posted word) of each template and base phrase, under the posted word.
    posted: dict[str, list[tuple[int, int]]] = {}
    keys = []
    for t, (_, text, key) in enumerate(templates):
        own, phrase = text.split(), key.split()
        k = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
        keys.append((k, phrase))
        p = min(range(k, k + len(phrase)), key=lambda p: (-weights[own[p]], p))
        posted.setdefault(own[p], []).append((t, p))
    based: dict[str, list[tuple[int, int]]] = {}
    for b, (phrase, _) in enumerate(BASE):
        own = phrase.split()
        p = min(range(len(own)), key=lambda p: (-weights[own[p]], p))
        based.setdefault(own[p], []).append((b, p))
    reach = max(len(text.split()) for text in (*(t for _, t, _ in templates), *(p for p, _ in BASE)))
    entries = F.col("entries")

    def occurrences(words: dict) -> Column:
        """The places in `entries` of looked-up words, each as (code, place of the word, the entries around it)."""
        codes = [code[w] for w in words]
        places = F.filter(F.transform(entries, lambda e, i: F.when(F.pmod(e, F.lit(size)).isin(codes), i)), lambda i: i.isNotNull())

        def occurrence(i: Column) -> Column:
            first = F.greatest(i - reach, F.lit(0))
            e = F.get(entries, i)
            return F.struct(
                F.pmod(e, F.lit(size)).cast("int").alias("code"), F.floor(e / size).cast("int").alias("at"),
                F.slice(entries, first + 1, F.lit(2 * reach + 1)).alias("near"),
            )

        return F.when(F.size(entries) > 0, F.transform(places, occurrence))

    def stands(x: Column, start: Column, i: int, word: str) -> Column:
        return F.array_contains(x["near"], (start + i).cast("long") * size + code[word])

    def all_stand(x: Column, start: Column, at: int, phrase: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [stands(x, start, at + i, w) for i, w in enumerate(phrase)])

    def places(x: Column, words: dict, made, kind: str) -> Column:
        """What `made` gives for the phrases posted under an occurrence's word; nulls are places that fail."""
        out = F.array().cast(f"array<{kind}>")
        for word, posts in sorted(words.items()):
            out = F.when(x["code"] == code[word], F.array(*(made(x, n, x["at"] - p) for n, p in posts))).otherwise(out)
        return out

    def base_place(x: Column, b: int, start: Column) -> Column:
        phrase, label = BASE[b]
        return F.when(all_stand(x, start, 0, phrase.split()), F.struct(F.lit(label).alias("label"), start.alias("start")))

    def template_place(x: Column, t: int, start: Column) -> Column:
        label, text, _ = templates[t]
        own = text.split()
        total = sum(weights[w] for w in own)
        parts = [F.when(stands(x, start, i, w), F.lit(weights[w] / total)).otherwise(F.lit(0.0)) for i, w in enumerate(own)]
        made = F.struct(F.lit(label).alias("label"), start.alias("start"), reduce(lambda a, b: a + b, parts).alias("cover"))
        return F.when(all_stand(x, start, *keys[t]), made)

    def gathered(words: dict, made, kind: str) -> Column:
        out = F.flatten(F.transform(occurrences(words), lambda x: places(x, words, made, kind)))
        return F.coalesce(F.filter(out, lambda x: x.isNotNull()), F.array().cast(f"array<{kind}>"))

    base = F.array_sort(gathered(based, base_place, "struct<label: string, start: int>"))
    found = gathered(posted, template_place, "struct<label: string, start: int, cover: double>")
    return index.select(F.col("id").alias(id_col), "n_words", base.alias("base"), F.filter(found, lambda x: x["cover"] >= least_cover).alias("found"))


def licences(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least_cover: float = LEAST_COVER) -> DataFrame:
    """(id_col, n_words, base, found) for each row of `docs` (see scan), by weights over all of them.

    Defined cases: a null or empty text, or one without words, has none; a text
    of any length is read whole and in time proportional to it, and its task
    holds its words; ids are passed through, null or repeated, a row for each
    row; an empty table gives no rows; templates tie on equal terms and all
    places are kept; other columns are not looked at.
    """
    index = materialise(positions(docs, templates, id_col, text_col), "licence_words")
    return scan(index, word_weights(index, templates), templates, id_col, least_cover)
