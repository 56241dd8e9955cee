"""License scans by an exact set-similarity join of text blocks with license templates.

A template is a short notice, as the set of its words.  Templates are put in
classes by their length; a text is cut into blocks of twice the class's words
that overlap by half, so every passage as long as a template lies whole in some
block.  A block holds a template if at least ``CONTAINMENT`` of the template's
words are in it.

1. Spark counts the templates' words over all documents.  Words are ordered by
   that count, rare ones first: one order for blocks and templates.
2. The templates are indexed by their prefixes: two sets that share ``least``
   words share one among the first ``size - least + 1`` of each.
3. A scan of the documents joins blocks with the index.  Blocks with fewer
   template words than any template needs go (length), only their prefixes are
   looked up (prefix), and a meeting goes if too few words are left behind it on
   either side (position).  What is left is counted exactly.

No filter can lose a pair, so the join is exact.  The index holds the words of
the templates alone and its size is checked; texts are not shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import text_of

#: Share of a template's words that a block must hold.
CONTAINMENT = 0.8
#: Words of the shortest class of templates.
SHORTEST_CLASS = 8
#: Words that all templates together may have: the index goes to every task.
MOST_WORDS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Phrases of the base scan with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices by which public licenses ask to be named, with labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "licensed under the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    """Words of a whole text; only A-Z are lower-cased."""
    return _WORD.findall(text.translate(_LOWER))


def class_of(n_words: int) -> int:
    """Words of a template's class: the power of two that holds it."""
    return max(SHORTEST_CLASS, 1 << max(0, n_words - 1).bit_length())


def least_common(size: int, share: float = CONTAINMENT) -> int:
    """Fewest common words: the smallest whole number that is at least ``share`` of the size (in thousandths, so that no rounding decides)."""
    return max(1, -(-size * round(1000 * share) // 1000))


@dataclass
class ClassIndex:
    """Templates of one class: their words by rank, and the postings of their prefixes."""

    words: int
    names: list[int]
    sets: list[np.ndarray]
    least: np.ndarray
    sizes: np.ndarray
    shortest: int
    starts: np.ndarray
    posted: np.ndarray
    places: np.ndarray


class Index:
    """Ranks of the templates' words (rare first), and an index for each class of templates."""

    def __init__(self, templates: list[list[str]], phrases: list[list[str]], counts: dict[str, int], share: float = CONTAINMENT) -> None:
        known = sorted({w for t in templates for w in t}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(known)}
        self.n_ranks = len(known)
        # words of phrases alone stand behind all that templates have
        for w in sorted({w for p in phrases for w in p} - set(known)):
            self.rank[w] = len(self.rank)
        self.phrases = [np.array([self.rank[w] for w in p]) for p in phrases]
        self.classes: list[ClassIndex] = []
        by_class: dict[int, list[int]] = {}
        for i, t in enumerate(templates):
            if t:
                by_class.setdefault(class_of(len(t)), []).append(i)
        for words, names in sorted(by_class.items()):
            sets = [np.unique([self.rank[w] for w in templates[i]]) for i in names]
            sizes = np.array([len(s) for s in sets])
            least = np.array([least_common(len(s), share) for s in sets])
            prefix = sorted((int(r), t, at) for t, s in enumerate(sets) for at, r in enumerate(s[: len(s) - least[t] + 1]))
            starts = np.searchsorted([r for r, _, _ in prefix], np.arange(self.n_ranks + 1))
            self.classes.append(ClassIndex(words, names, sets, least, sizes, int(least.min()), starts, np.array([t for _, t, _ in prefix]), np.array([at for _, _, at in prefix])))


def join_blocks(index: ClassIndex, ranks: np.ndarray, at: np.ndarray, n_ranks: int) -> list[tuple[int, int, int]]:
    """(block, template, common words) of all pairs that reach the threshold.

    ``ranks``, ``at``: the template words of a text and where they stand.  Block
    ``b`` holds words ``b * words`` to ``(b + 2) * words``.
    """
    width = np.int64(n_ranks)
    first = at // index.words
    keys = np.unique(np.concatenate([first * width + ranks, (first[first > 0] - 1) * width + ranks[first > 0]]))
    block, rank = keys // width, keys % width
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sizes = np.diff(np.r_[starts, len(block)])
    of = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(block)) - starts[of]
    # length: the block has as many words as some template needs; prefix: a later first meeting comes too late for all
    looked = np.flatnonzero((sizes[of] >= index.shortest) & (place <= sizes[of] - index.shortest))
    n = index.starts[rank[looked] + 1] - index.starts[rank[looked]]
    met = np.repeat(looked, n)
    posting = np.arange(len(met)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.starts[rank[looked]], n)
    template = index.posted[posting]
    # position: the words from here on, on either side, must be enough
    behind = np.minimum(index.sizes[template] - index.places[posting], sizes[of[met]] - place[met])
    enough = behind >= index.least[template]
    found = []
    for pair in np.unique(of[met[enough]] * len(index.names) + template[enough]):
        b, t = divmod(int(pair), len(index.names))
        common = len(np.intersect1d(rank[starts[b] : starts[b] + sizes[b]], index.sets[t], assume_unique=True))
        if common >= index.least[t]:
            found.append((int(block[starts[b]]), t, common))
    return found


def scan(index: Index, labels: list[str], text: str) -> dict:
    """Words, base places and links of one whole text."""
    get = index.rank.get
    ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
    places = []
    for p, phrase in enumerate(index.phrases):
        if len(ids) >= len(phrase):
            same = np.ones(len(ids) - len(phrase) + 1, bool)
            for i, r in enumerate(phrase):
                same &= ids[i : i + len(same)] == r
            places += [(int(x), p) for x in np.flatnonzero(same)]
    at = np.flatnonzero((ids >= 0) & (ids < index.n_ranks))
    ranks, links = ids[at], []
    for c in index.classes if len(at) else ():
        if (c.starts[ranks + 1] > c.starts[ranks]).any():
            for block, t, common in join_blocks(c, ranks, at, index.n_ranks):
                name, start = c.names[t], block * c.words
                links.append({"template": name, "label": labels[name], "first_word": start, "end_word": min(len(ids), start + 2 * c.words), "common": common, "containment": common / int(c.sizes[t])})
    return {"n_words": len(ids), "places": places, "links": links}


# --- as Spark jobs -----------------------------------------------------------


def word_counts(docs: DataFrame, words: set[str]) -> dict[str, int]:
    """How often each of ``words`` occurs in all texts; tasks fold their counts before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(filter(words.__contains__, words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    parts = docs.select(text_of().alias("text")).mapInArrow(run, "word string, n long")
    return {r["word"]: r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


LINK = "struct<template: int, label: string, first_word: long, end_word: long, common: int, containment: double>"
FOUND = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_links long, links array<{LINK}>"


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, share: float = CONTAINMENT, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_links, links of every document.

    ``links`` are all (block, template) pairs that reach the containment; a
    passage in the overlap of two blocks is in both.  ``score`` is the largest
    containment, 1 where a base phrase stands, 0 without either.  A null or
    empty text has no words and no links; very long texts are read whole, their
    blocks one after another; repeated rows each get their row, a null id stays
    null; an empty table gives none.  Other columns are not read.
    """
    labels = [label for label, _ in templates]
    notices, said = [words_of(t) for _, t in templates], [words_of(p) for p, _ in phrases]
    total = sum(map(len, notices))
    if total > MOST_WORDS:
        raise ValueError(f"templates have {total} words; one scan carries {MOST_WORDS}: give them in parts")
    index = Index(notices, said, word_counts(docs, {w for t in notices for w in t}), share)
    names = [label for _, label in phrases]
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {FOUND}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                seen = scan(index, labels, text)
                where, base = [x for x, _ in seen["places"]], {names[p] for _, p in seen["places"]}
                own = base | {link["label"] for link in seen["links"]}
                out.append({
                    "n_words": seen["n_words"], "n_base": len(where), "first_word": min(where, default=None), "last_word": max(where, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(own)),
                    "score": 1.0 if where else max((link["containment"] for link in seen["links"]), default=0.0), "n_links": len(seen["links"]), "links": seen["links"],
                })
            table = pa.Table.from_pylist(out, schema=_FOUND_ARROW)
            yield from table.add_column(0, "doc_id", pa.chunked_array([batch.column("doc_id")])).to_batches()

    return rows.mapInArrow(run, schema)


_LINK_ARROW = pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("common", pa.int32()), ("containment", pa.float64())])
_FOUND_ARROW = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_links", pa.int64()), ("links", pa.list_(_LINK_ARROW))])


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, share: float = CONTAINMENT) -> str:
    """The same rows by counting the common words of every block and every template."""
    sets = [(i, class_of(len(words_of(t))), sorted(set(words_of(t)))) for i, (_, t) in enumerate(templates)]
    tokens = ", ".join(f"({i}, {c}, {len(s)}, {least_common(len(s), share)}, '{templates[i][0]}', '{w}')" for i, c, s in sets for w in s)
    classes = ", ".join(f"({c})" for c in sorted({c for _, c, _ in sets}))
    said = " UNION ALL ".join("SELECT doc_id, '{}' AS label, pos FROM spoken WHERE {}".format(label, " AND ".join(f"w{i} = '{w}'" for i, w in enumerate(words_of(p)))) for p, label in phrases)
    most = max(len(words_of(p)) for p, _ in phrases)
    return f"""WITH texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS t FROM documents),
standing AS (SELECT doc_id, unnest(t) AS w0, unnest(range(len(t))) AS pos FROM texts),
spoken AS (SELECT *, {', '.join(f'lead(w0, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{i}' for i in range(1, most))} FROM standing),
places AS ({said}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
templates(template, class, size, least, label, word) AS (VALUES {tokens}),
classes(class) AS (VALUES {classes}),
known AS (SELECT doc_id, pos, w0 AS word, class FROM standing SEMI JOIN templates ON word = w0, classes),
blocks AS (SELECT DISTINCT doc_id, class, pos // class - back AS block, word FROM known, (VALUES (0), (1)) AS v(back) WHERE pos // class >= back),
links AS (SELECT doc_id, template, label, block, count(*) / size AS containment FROM blocks JOIN templates USING (class, word) GROUP BY doc_id, template, label, block, size, least HAVING count(*) >= least),
linked AS (SELECT doc_id, count(*) AS n_links, max(containment) AS best FROM links GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM links UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END::DOUBLE AS score, coalesce(n_links, 0)::BIGINT AS n_links
FROM texts LEFT JOIN base USING (doc_id) LEFT JOIN linked USING (doc_id) LEFT JOIN named USING (doc_id)"""
