"""Licence notices in files by a positional index of rare words, on built-in functions only.

Each template is the wording of a notice, with key phrases that have to stand in it. How many documents hold
each template word is counted over all of them. The `ANCHORS` words of a template that have the
highest inverse document frequency are its anchors, and the index holds, for each anchor, its places in the
template. A file's words that are in the index are looked up, from the rarest on. A place of a word in the
file less its place in a template is where the template would begin. Where all of its anchors but one at
most agree on that, the template is found, if each of its key phrases stands in the words that it covers
there, `SLACK` words more on either side. The score of a notice is the share of its template's words that
stand there.

Base phrases are searched by themselves, whatever the templates find.

Words are the longest runs of a-z, digits and all characters beyond ASCII, after A-Z are lower-cased. Places
count words from 0. Everything happens within a row but the counting, so nothing is shuffled save one number
for each word, task by task.

Edge cases: null and empty texts have no words and a score of 0; every row keeps its row, null and repeated
ids included; an empty table gives an empty result; a text is searched whole however long it is.
"""

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.frames import fresh, texts

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

ANCHORS, SLACK = 3, 2
#: The score of a file that has a base phrase and no whole notice.
NAMED = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return words_of(self.text)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


# The usual wording of licence notices.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
             "software and associated documentation files", ("permission is hereby granted free of charge",
                                                             "associated documentation files")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
             "or without fee is hereby granted", ("permission to use copy modify", "without fee")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
             "permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("bsd-2-clause", "Licensed under the BSD 2-Clause License", ("bsd 2 clause",)),
    Template("bsd-3-clause", "Licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2.0", "Licensed under the GNU General Public License, version 2",
             ("gnu general public license version 2",)),
    Template("gpl-3.0", "Licensed under the GNU General Public License, version 3",
             ("gnu general public license version 3",)),
    Template("gpl-or-later", "you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation",
             ("gnu general public license", "free software foundation")),
    Template("lgpl-2.1", "Licensed under the GNU Lesser General Public License, version 2.1",
             ("gnu lesser general public license version 2 1",)),
    Template("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3",
             ("gnu lesser general public license version 3",)),
    Template("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3",
             ("gnu affero general public license version 3",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
             "v. 2.0", ("mozilla public license v 2 0",)),
    Template("epl-2.0", "made available under the terms of the Eclipse Public License 2.0",
             ("eclipse public license 2 0",)),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0",
             ("boost software license version 1 0",)),
    Template("zlib", "Altered source versions must be plainly marked as such, and must not be "
             "misrepresented as being the original software", ("plainly marked as such",
                                                               "misrepresented as being")),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("free and unencumbered software", "public domain")),
    Template("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    Template("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", ("cc by nc nd 4 0",)),
    Template("cc-by-4.0", "Creative Commons Attribution 4.0 International License",
             ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License",
             ("creative commons attribution sharealike 4 0",)),
)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _texts(values) -> str:
    return f"array({', '.join(map(_text, values))})" if values else "cast(array() AS array<string>)"


def _lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def word_counts(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of rows of `docs(doc_id, text)`, and of those that hold each word of `vocabulary`."""
    held = (f"array_intersect({_texts(vocabulary)}, "
            f"regexp_extract_all({_lowered('text')}, {_text(WORD)}, 0))")
    # The empty text, which is no word, stands for the row itself.
    found = docs.select(F.explode(F.expr(f"array_append({held}, '')")).alias("word"))
    rows = found.groupBy("word").count().collect()  # as many as the vocabulary has words
    counts = {row["word"]: row["count"] for row in rows}
    return counts.pop("", 0), counts


@dataclass(frozen=True)
class Index:
    """Anchors by falling inverse document frequency, and the templates with the places of theirs."""

    anchors: list[str]
    templates: list[tuple[Template, dict[str, list[int]]]]


def built(templates: tuple[Template, ...], n_docs: int, counts: dict[str, int],
          anchors: int = ANCHORS) -> Index:
    """A word that no document holds cannot be looked up, so it is no anchor, and a template with such a
    word in a key phrase is nowhere. Equal frequencies go by the word."""
    def rarity(word: str) -> tuple[float, str]:
        return -math.log((n_docs + 1) / (counts[word] + 1)), word

    chosen = []
    for template in templates:
        words = template.words
        rare = sorted({w for w in words if counts.get(w)}, key=rarity)[:anchors]
        held = all(counts.get(w) for phrase in template.phrases for w in words_of(phrase))
        if held and len(rare) >= min(2, len(set(words))):
            chosen.append((template, {w: [i for i, x in enumerate(words) if x == w] for w in rare}))
    return Index(sorted({w for _, places in chosen for w in places}, key=rarity), chosen)


def _templates(index: Index) -> str:
    """The index as an SQL array: for each template its words, phrases and anchors with their places."""
    def one(template: Template, places: dict[str, list[int]]) -> str:
        anchors = ", ".join(f"named_struct('word', {_text(w)}, 'places', array({', '.join(map(str, p))}))"
                            for w, p in places.items())
        return (f"named_struct('label', {_text(template.label)}, 'words', {_texts(template.words)}, "
                f"'phrases', {_texts([f' {p} ' for p in template.phrases])}, 'anchors', array({anchors}))")

    return f"array({', '.join(one(*x) for x in index.templates)})"


_NOTICES = "array<struct<label:string,word:int,score:double>>"


def _notices(words: str, index: Index, slack: int) -> str:
    """SQL for the notices in an array of words, by templates and places."""
    if not index.templates:
        return f"cast(array() AS {_NOTICES})"
    # What the file holds of the index, the rarest first, and where.
    held = f"array_intersect({_texts(index.anchors)}, {words})"
    positions = (f"transform(h.held, w -> named_struct('word', w, 'at', "
                 f"filter(transform({words}, (x, i) -> CASE WHEN x = w THEN i END), i -> i IS NOT NULL)))")
    # For each anchor, where the template would begin.
    starts = ("transform(t.anchors, a -> coalesce(flatten(transform(a.places, p -> transform("
              "get(filter(f, q -> q.word = a.word), 0).at, i -> i - p))), cast(array() AS array<int>)))")
    # All but one at most have to agree: every anchor is left out once. Two have to agree at least.
    agreed = ("CASE WHEN size(s) < 3 THEN aggregate(s, s[0], (l, r) -> array_intersect(l, r)) ELSE "
              "array_distinct(flatten(transform(s, (_, i) -> aggregate(transform(filter(transform(s, "
              "(x, j) -> named_struct('x', x, 'j', j)), y -> y.j <> i), y -> y.x), "
              "CASE WHEN i = 0 THEN s[1] ELSE s[0] END, (l, r) -> array_intersect(l, r))))) END")
    window = (f"slice({words}, greatest(b - {slack}, 0) + 1, "
              f"greatest(b + size(t.words) + {slack} - greatest(b - {slack}, 0), 0))")
    places = (f"filter(transform(transform(array({starts}), s -> {agreed})[0], b -> "
              f"named_struct('b', b, 'w', {window})), c -> forall(t.phrases, "
              "p -> contains(concat(' ', array_join(c.w, ' '), ' '), p)))")
    found = (f"flatten(transform(filter({_templates(index)}, t -> size(array_intersect(transform("
             "t.anchors, a -> a.word), transform(f, q -> q.word))) >= greatest(1, size(t.anchors) - 1)), "
             f"t -> transform({places}, c -> named_struct('label', t.label, 'word', c.b, 'score', "
             "size(array_intersect(array_distinct(t.words), c.w)) / size(array_distinct(t.words))))))")
    return (f"transform(transform(array(named_struct('held', {held})), h -> {positions}), f -> "
            f"CASE WHEN size(f) = 0 THEN cast(array() AS {_NOTICES}) ELSE {found} END)[0]")


def _phrases(text: str, words: str, base: dict[str, str]) -> str:
    """SQL for all places where the words of a base phrase stand consecutively."""
    listed = [(words_of(phrase), label) for phrase, label in base.items()]
    literal = ", ".join(f"named_struct('words', {_texts(w)}, 'label', {_text(label)})"
                        for w, label in listed)
    none = "cast(array() AS array<struct<word:int,label:string>>)"
    # A text that holds no phrase's longest word need not be searched.
    hint = " OR ".join(sorted({f"contains({text}, {_text(max(w, key=len))})" for w, _ in listed}))
    first = _texts(sorted({w[0] for w, _ in listed}))
    starts = (f"filter(transform({words}, (x, i) -> CASE WHEN array_contains({first}, x) THEN i END), "
              "i -> i IS NOT NULL)")
    return (f"CASE WHEN {hint} THEN flatten(transform({starts}, i -> transform(filter(array({literal}), "
            f"p -> slice({words}, i + 1, size(p.words)) = p.words), "
            f"p -> named_struct('word', i, 'label', p.label)))) ELSE {none} END")


def with_licenses(df: DataFrame, index: Index, name: str, text_col: str = "text",
                  base: dict[str, str] = BASE, slack: int = SLACK) -> DataFrame:
    """`df` with `name`: `n_words`, the `base` places (word, label) and the `notices` (label, word where
    the template begins, score)."""
    lowered, words = fresh(df, "_lowered"), fresh(df, "_words")
    found = df.withColumn(lowered, F.expr(_lowered(f"coalesce(cast(`{text_col}` AS string), '')")))
    found = found.withColumn(words, F.expr(f"regexp_extract_all(`{lowered}`, {_text(WORD)}, 0)"))
    return found.withColumn(name, F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.expr(_phrases(f"`{lowered}`", f"`{words}`", base)).alias("base"),
        F.expr(_notices(f"`{words}`", index, slack)).alias("notices"))).drop(lowered, words)


def index_of(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text",
             anchors: int = ANCHORS) -> Index:
    """The index for the documents of `df`."""
    docs = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({w for t in templates for w in t.words})
    return built(templates, *word_counts(docs, vocabulary), anchors)


def scan_licenses(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """`doc_id, n_words, base, notices` of every row."""
    docs = texts(df, id_col, text_col)
    found = with_licenses(docs, index_of(docs, templates), "_found")
    return found.select("doc_id", "_found.n_words", "_found.base", "_found.notices")


def report(found: DataFrame) -> DataFrame:
    """`doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score` out of
    `scan_licenses`."""
    at = F.transform("base", lambda b: b["word"].cast("long"))
    base = F.transform("base", lambda b: b["label"])
    notices = F.transform("notices", lambda n: n["label"])

    def listed(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    best = F.array_max(F.transform("notices", lambda n: n["score"]))
    named = F.when(F.size("base") > 0, F.lit(NAMED)).otherwise(F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, notices)).alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), named).alias("score"))
