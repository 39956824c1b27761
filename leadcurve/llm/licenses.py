"""License scans: phrases, and an exact containment join of texts with license templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.work import Work
from leadcurve.sources.local import local_table

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java regular expressions of a word in a text whose A-Z are a-z, and of what parts words in any text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Phrases and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices as the licenses' own texts have them.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9
#: A notice may be spread over so many times the template's words, wherever lines end.
SPREAD = 4


def words_of(template: str) -> list[str]:
    """A template's distinct words, sorted."""
    return sorted(set(re.findall(WORD, template.translate(str.maketrans(CAPITALS, SMALL)))))


def _words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{CAPITALS}', '{SMALL}'), r'{WORD}', 0)"


def _literal(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _places() -> str:
    """Start and label of every phrase in ``words``."""
    cases = []
    for phrase, label in PHRASES.items():
        first, *rest = phrase.split()
        test = " and ".join([f"w = '{first}'", *(f"get(words, i + {k}) = '{word}'" for k, word in enumerate(rest, 1))])
        cases.append(f"when {test} then named_struct('at', cast(i as bigint), 'label', '{label}')")
    return f"filter(transform(words, (w, i) -> case {' '.join(cases)} end), x -> x is not null)"


def _any_of(words: list[str]) -> str:
    """A regular expression for one of these words as a whole word, A-Z as a-z."""
    edge = BETWEEN.replace("[", "[^", 1)
    return rf"(?i)(?<!{edge})(?:{'|'.join(words)})(?!{edge})"


def frequency_order(counted: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words by the number of documents that hold them, rarest first."""
    seen = {r.token: r["count"] for r in counted.select(F.explode("held").alias("token")).groupBy("token").count().collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def template_rows(order: list[str], templates, threshold: float) -> list[tuple]:
    """One row per template: number, label, words in the global order, words needed, words to look for.

    A block that holds ``need`` of n words misses n - need at most, so one of
    the first n - need + 1 is in it.
    """
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, (label, text) in enumerate(templates):
        words = sorted(words_of(text), key=rank.get)
        need = math.ceil(threshold * len(words) - 1e-9)
        rows.append((number, label, words, need, words[: len(words) - need + 1]))
    return rows


def _needs(templates, threshold: float) -> list[tuple[list[str], int]]:
    return [(words, math.ceil(threshold * len(words) - 1e-9)) for words in (words_of(text) for _, text in templates)]


def spans(templates) -> list[int]:
    """Words that a notice of each template may be spread over."""
    return [SPREAD * len(re.findall(WORD, text.translate(str.maketrans(CAPITALS, SMALL)))) for _, text in templates]


def block_matches(counted: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every block of text that holds ``threshold`` of a template's distinct words, with the containment.

    Rows: doc_id, text_key, at, label, containment. A block is a run of words,
    over any lines, as long as the template's times ``SPREAD``, that begins
    with one of its words; of blocks that overlap the first is named, with
    the highest containment among them. ``counted`` has held, the templates'
    words in each document, and spots, their places.

    Words are put in one order by document frequency, rarest first.
    Documents, as their words in that order, are joined with the templates'
    prefixes; a pair stays if the words from the match on, in document and
    template, suffice (length and place). Its blocks are then counted in full.
    """
    vocabulary = sorted({w for _, text in templates for w in words_of(text)})
    order = frequency_order(counted, vocabulary)
    rows = template_rows(order, templates, threshold)
    looked_for = sorted({w for r in rows for w in r[4]})
    listed = local_table(counted.sparkSession, "template int, label string, words array<string>, need int, prefix array<string>, span int", [(*r[:5], n) for r, n in zip(rows, spans(templates), strict=True)])
    prefixes = listed.selectExpr("template", "label", "words", "need", "span", "posexplode(prefix) as (place, token)")
    # array_intersect keeps the order of its first argument: the global one
    held = counted.where("size(spots) > 0").selectExpr("doc_id", "text_key", "spots", f"array_intersect({_literal(order)}, held) as held")
    tokens = held.selectExpr("*", "posexplode(held) as (at, token)").where(F.col("token").isin(looked_for))
    met = tokens.join(F.broadcast(prefixes), "token").where("least(size(words) - place, size(held) - at) + least(place, at) >= need")
    # a pair is counted at its first common word only
    first = met.where("token = get(filter(held, w -> array_contains(words, w)), 0)")
    own = first.selectExpr("doc_id", "text_key", "label", "words", "need", "span", "filter(spots, x -> array_contains(words, x.word)) as own").where("size(own) >= need")
    inside = "filter(slice(own, k + 1, span), y -> y.at < x.at + span)"
    hits = f"filter(transform(own, (x, k) -> named_struct('at', x.at, 'shared', size(array_distinct(transform({inside}, y -> y.word))))), x -> x.shared >= need)"
    starts = "filter(transform(hits, (x, k) -> case when k = 0 or x.at - get(hits, k - 1).at >= span then named_struct('at', x.at, 'shared', array_max(transform(filter(slice(hits, k + 1, span), y -> y.at < x.at + span), y -> y.shared))) end), x -> x is not null)"
    found = own.selectExpr("doc_id", "text_key", "label", "words", "span", f"{hits} as hits").selectExpr("doc_id", "text_key", "label", "words", f"explode({starts}) as x")
    return found.selectExpr("doc_id", "text_key", "cast(x.at as bigint) as at", "label", "x.shared / size(words) as containment").distinct()


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licenses of every whole text, one row per document.

    Columns: doc_id, n_words, places (start word and label of every phrase),
    base_labels and labels (distinct, sorted), matches (start word, label,
    containment of every block that meets a template, see
    ``block_matches``), score: the highest containment of a match, 1 for
    phrases without one, 0 for neither.

    Each text is read and cut into words once; places of templates' words are
    kept only for texts that hold enough of one. A null or empty text has no
    words. Rows alike in doc_id and text share their matches; a null doc_id
    is an id like others. Only doc_id and text are read. Templates are few
    and go to every task.
    """
    work = Work(docs.sparkSession, "licenses")
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    vocabulary = sorted({w for _, text in templates for w in words_of(text)})
    phrase = _any_of([f"{BETWEEN}+".join(p.split()) for p in PHRASES])
    enough = " or ".join(f"size(array_intersect(held, {_literal(words)})) >= {need}" for words, need in _needs(templates, threshold))
    spots = f"filter(transform(words, (w, i) -> named_struct('at', i, 'word', w)), x -> array_contains({_literal(vocabulary)}, x.word))"
    counted = (
        docs.selectExpr("doc_id", "xxhash64(text) as text_key", f"{_words('text')} as words", f"coalesce(text rlike r'{phrase}', false) as has_phrase")
        .selectExpr("*", f"array_intersect(words, {_literal(vocabulary)}) as held")
        .selectExpr("doc_id", "text_key", "cast(size(words) as bigint) as n_words", "held", f"case when has_phrase then {_places()} end as places", f"case when {enough} then {spots} end as spots")
    )
    counted = work.keep(counted, "counted")
    matches = block_matches(counted, templates, threshold)
    own = matches.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("at", "label", "containment"))).alias("matches"))
    own = own.withColumnRenamed("doc_id", "own_id").withColumnRenamed("text_key", "own_key")
    joined = counted.join(own, counted.doc_id.eqNullSafe(own.own_id) & (counted.text_key == own.own_key), "left")
    return joined.selectExpr(
        "doc_id",
        "n_words",
        "coalesce(places, array()) as places",
        "array_sort(array_distinct(transform(coalesce(places, array()), x -> x.label))) as base_labels",
        "array_sort(array_distinct(concat(transform(coalesce(places, array()), x -> x.label), transform(coalesce(matches, array()), x -> x.label)))) as labels",
        "coalesce(matches, array()) as matches",
        "coalesce(array_max(transform(matches, x -> x.containment)), case when size(places) > 0 then 1D else 0D end) as score",
    )
