"""License scans by an exact set-similarity join of text blocks with templates.

A template is a notice; a block is a run of words of a text, over line ends and
marks of comments alike, that begins with a word of the template and is 1 / ``CONTAINMENT`` times as long as it. Both are
sets of words. A block matches a template when it holds at least ``CONTAINMENT``
of its distinct words (all of them where it has less than ``SHORT``), all words that tell its license from others, none that names another
one (a notice of one license has most words of the next one's), and no negation stands in it or just before it.

Words are ordered by how many documents have them,
rarest first, counted over all documents. With t words
needed, a match has one of the first size - t + 1 words of the template
in that order (prefix filter), the text has at least t words of it (length filter), and around each
such word there are enough later words, in that order, on both sides (positional
filter). What passes is verified, so the join is exact.

The templates are a fixed list, so their prefix index is small whatever the
corpus; the join runs in the scan, without a shuffle, and no block is left out.

Base phrases are consecutive words of the whole text, found apart.

Defined results: a null text is empty, has no words and no label; equal blocks
each match; repeated rows get equal results; null ids are carried; an empty
table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import ALNUM, chunks, small_batches

CONTAINMENT = 0.8

#: Distinct words below which a template must be there whole: four of five words are no notice.
SHORT = 10

#: Words in a block, or among the BEFORE words before it, that deny it.
NEGATIONS = frozenset(b"not never cannot isn wasn aren".split())
BEFORE = 2

# Base phrases and their labels.
PHRASES: tuple[tuple[str, str], ...] = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# A notice, its label, the words that tell this license from others, and words that name another one.
TEMPLATES: tuple[tuple[str, str, str, str], ...] = (
    ("released under the MIT License", "mit", "", ""),
    ("licensed under the MIT License", "mit", "", ""),
    ("SPDX-License-Identifier: MIT", "mit", "", ""),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit", "", "accompanying"),
    ("licensed under the Apache License, Version 2.0", "apache-2", "", ""),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2", "", ""),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2", "", "cddl eupl educational"),
    ("CC BY 4.0", "cc-by", "", "nc sa nd"),
    ("CC BY-NC 4.0", "cc-by-nc", "", "sa nd"),
    ("CC BY-SA 4.0", "cc-by-sa", "", "nc"),
    ("CC BY-ND 4.0", "cc-by-nd", "", "nc"),
    ("CC BY-NC-SA 4.0", "cc-by-nc-sa", "", ""),
    ("Creative Commons Attribution 4.0 International License", "cc-by", "", "noncommercial sharealike noderivatives noderivs"),
    ("licensed under the Creative Commons Attribution-NonCommercial license", "cc-by-nc", "", "sharealike noderivatives noderivs"),
    ("licensed under the Creative Commons Attribution-ShareAlike license", "cc-by-sa", "", "noncommercial"),
    ("licensed under the Creative Commons Attribution-NonCommercial-ShareAlike license", "cc-by-nc-sa", "", ""),
    ("GNU General Public License version 3", "gpl-3", "", "lesser library affero"),
    ("GNU General Public License version 2", "gpl-2", "", "lesser library affero"),
    ("SPDX-License-Identifier: GPL-3.0", "gpl-3", "", ""),
    ("SPDX-License-Identifier: GPL-2.0", "gpl-2", "", ""),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl", "gnu general public", "lesser library affero"),
    ("GNU Lesser General Public License", "lgpl", "", ""),
    ("SPDX-License-Identifier: LGPL", "lgpl", "", ""),
    ("GNU Affero General Public License", "agpl", "", ""),
    ("SPDX-License-Identifier: AGPL", "agpl", "", ""),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd", "redistribution", ""),
    ("under the BSD License", "bsd", "", ""),
    ("BSD-3-Clause", "bsd", "", ""),
    ("BSD-2-Clause", "bsd", "", ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2", "mozilla public", ""),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2", "", ""),
)


def tokens(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def _template_sets() -> list[tuple[frozenset[bytes], str, frozenset[bytes], frozenset[bytes]]]:
    """Words, label, words that must be there and words that must not."""
    return [(frozenset(tokens(t.encode())), label, frozenset(needs.encode().split()), frozenset(bars.encode().split())) for t, label, needs, bars in TEMPLATES]


def document_frequencies(docs: DataFrame, text: str = "text") -> dict[bytes, int]:
    """In how many rows of docs each template word stands; as many rows as the templates have words."""
    vocabulary = NEGATIONS.union(*(words | bars for words, _, _, bars in _template_sets()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        for _, texts in chunks(batches):
            for t in texts:
                for word in vocabulary.intersection(tokens(t or b"")):
                    counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {bytes(r["word"]): r["n"] for r in found.collect()}


class TemplateIndex:
    """Templates with their words in global order, and by the words of their prefixes."""

    def __init__(self, frequencies: dict[bytes, int], containment: float = CONTAINMENT):
        self.rank = {w: i for i, w in enumerate(sorted(frequencies, key=lambda w: (frequencies[w], w)))}
        self.templates: list[tuple[list[int], int, str]] = []  # words in global order, how many are needed, label
        self.widths = [-int(-len(tokens(t.encode())) / containment // 1) for t, *_ in TEMPLATES]
        self.telling: list[tuple[frozenset[int], frozenset[int], frozenset[int]]] = []  # ranks of words that must be there, that must not, and of negations
        self.by_word: dict[int, list[tuple[int, int]]] = {}
        for words, label, needs, bars in _template_sets():
            self.telling.append(tuple(frozenset(self.rank[w] for w in x) for x in (needs, bars, NEGATIONS - words)))
            order = sorted(self.rank[w] for w in words)
            need = len(order) if len(order) < SHORT else -int(-containment * len(order) // 1)
            for position, r in enumerate(order[: len(order) - need + 1]):
                self.by_word.setdefault(r, []).append((len(self.templates), position))
            self.templates.append((order, need, label))
        names = {i: w for w, i in self.rank.items()}
        self.prefix_words = frozenset(names[r] for r in self.by_word)

    def match(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """First word, template and share of its words of every block of a text's words that matches."""
        if self.prefix_words.isdisjoint(words):
            return []
        places: dict[int, list[int]] = {}
        rank = self.rank
        for i, w in enumerate(words):
            r = rank.get(w)
            if r is not None:
                places.setdefault(r, []).append(i)
        around: dict[int, list[tuple[int, int]]] = {}  # template: prefix words of the text and their positions in it
        for r in self.by_word.keys() & places.keys():
            for t, position in self.by_word[r]:
                around.setdefault(t, []).append((r, position))
        return sorted(m for t, hits in around.items() for m in self._blocks(t, hits, places))

    def _blocks(self, t: int, hits: list[tuple[int, int]], places: dict[int, list[int]]) -> Iterator[tuple[int, int, float]]:
        (order, need, _), width, (needs, bars, denials) = self.templates[t], self.widths[t], self.telling[t]
        here = [r for r in order if r in places]
        if len(here) < need or not needs <= places.keys():
            return
        own = sorted((i, r) for r in here for i in places[r])
        at = [i for i, _ in own]
        starts: set[int] = set()
        for r, position in hits:
            for q in places[r]:
                a, b = bisect_left(at, q - width + 1), bisect_left(at, q + width)
                later = {x for _, x in own[a:b] if x > r}
                if 1 + min(len(order) - position - 1, len(later)) >= need:  # if r is the first word in common
                    starts.update(range(a, bisect_left(at, q + 1)))
        barred, denied = (sorted(i for r in x & places.keys() for i in places[r]) for x in (bars, denials))
        anywhere = lambda found, a, b: bisect_left(found, a) < bisect_left(found, b)
        for s in sorted(starts):
            first = at[s]
            inside = {r for _, r in own[s : bisect_left(at, first + width)]}
            if len(inside) >= need and needs <= inside and not anywhere(barred, first, first + width) and not anywhere(denied, first - BEFORE, first + width):
                yield first, t, len(inside) / len(order)


def _starts(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers where a phrase starts in words joined and framed by spaces."""
    out, at, words, before = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += joined.count(b" ", before, at)
        before = at
        out.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


def block_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """key, first_word (from 0), template (number), label and containment of every block that matches."""
    index = TemplateIndex(document_frequencies(docs, text), containment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            rows = [(i, first, t, index.templates[t][2], c) for i, x in enumerate(texts) for first, t, c in index.match(tokens(x or b""))]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array([r[j] for r in rows], kind) for j, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.string()), (4, pa.float64())))], ["key", "first_word", "template", "label", "containment"])

    plain = small_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(run, f"key {kind}, first_word long, template int, label string, containment double").withColumnRenamed("key", key)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs."""
    index = TemplateIndex(document_frequencies(docs, text), containment)
    phrases = [(p.encode(), label) for p, label in PHRASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            rows = []
            for t in texts:
                t = t or b""
                words = tokens(t)
                places, base, labels, score = [], set(), set(), 0.0
                joined = b" " + b" ".join(words) + b" "
                for phrase, label in phrases:
                    if at := _starts(joined, phrase):
                        places += at
                        base.add(label)
                        score = 1.0
                for _, template, share in index.match(words):
                    labels.add(index.templates[template][2])
                    score = max(score, share)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds))], ["key", *COLUMNS])

    plain = small_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(run, f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("key", key)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The whole result with literals of its own, and the join as a plain comparison of all blocks.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), phrases(p, n, label) AS (VALUES ('under the mit license', 4, 'mit'), ('apache license version 2', 4, 'apache-2'), ('cc by nc', 3, 'cc-by-nc')
), notices(n, notice, label, needs, bars) AS (VALUES
  (1, 'released under the mit license', 'mit', '', ''),
  (2, 'licensed under the mit license', 'mit', '', ''),
  (3, 'spdx license identifier mit', 'mit', '', ''),
  (4, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files', 'mit', '', 'accompanying'),
  (5, 'licensed under the apache license version 2 0', 'apache-2', '', ''),
  (6, 'spdx license identifier apache 2 0', 'apache-2', '', ''),
  (7, 'you may not use this file except in compliance with the license you may obtain a copy of the license at', 'apache-2', '', 'cddl eupl educational'),
  (8, 'cc by 4 0', 'cc-by', '', 'nc sa nd'),
  (9, 'cc by nc 4 0', 'cc-by-nc', '', 'sa nd'),
  (10, 'cc by sa 4 0', 'cc-by-sa', '', 'nc'),
  (11, 'cc by nd 4 0', 'cc-by-nd', '', 'nc'),
  (12, 'cc by nc sa 4 0', 'cc-by-nc-sa', '', ''),
  (13, 'creative commons attribution 4 0 international license', 'cc-by', '', 'noncommercial sharealike noderivatives noderivs'),
  (14, 'licensed under the creative commons attribution noncommercial license', 'cc-by-nc', '', 'sharealike noderivatives noderivs'),
  (15, 'licensed under the creative commons attribution sharealike license', 'cc-by-sa', '', 'noncommercial'),
  (16, 'licensed under the creative commons attribution noncommercial sharealike license', 'cc-by-nc-sa', '', ''),
  (17, 'gnu general public license version 3', 'gpl-3', '', 'lesser library affero'),
  (18, 'gnu general public license version 2', 'gpl-2', '', 'lesser library affero'),
  (19, 'spdx license identifier gpl 3 0', 'gpl-3', '', ''),
  (20, 'spdx license identifier gpl 2 0', 'gpl-2', '', ''),
  (21, 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license', 'gpl', 'gnu general public', 'lesser library affero'),
  (22, 'gnu lesser general public license', 'lgpl', '', ''),
  (23, 'spdx license identifier lgpl', 'lgpl', '', ''),
  (24, 'gnu affero general public license', 'agpl', '', ''),
  (25, 'spdx license identifier agpl', 'agpl', '', ''),
  (26, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'bsd', 'redistribution', ''),
  (27, 'under the bsd license', 'bsd', '', ''),
  (28, 'bsd 3 clause', 'bsd', '', ''),
  (29, 'bsd 2 clause', 'bsd', '', ''),
  (30, 'this source code form is subject to the terms of the mozilla public license v 2 0', 'mpl-2', 'mozilla public', ''),
  (31, 'spdx license identifier mpl 2 0', 'mpl-2', '', '')
), templates AS (
  SELECT n, label, ws, list_filter(string_split(needs, ' '), lambda x: x <> '') AS needs, list_filter(string_split(bars, ' '), lambda x: x <> '') AS bars,
    (5 * len(seq) + 3) // 4 AS width, CASE WHEN len(ws) < 10 THEN len(ws) ELSE (4 * len(ws) + 4) // 5 END AS need
  FROM (SELECT *, string_split(notice, ' ') AS seq, list_distinct(string_split(notice, ' ')) AS ws FROM notices)
), own AS (
  SELECT n, unnest(ws) AS word FROM templates
), denials AS (
  SELECT unnest(['not', 'never', 'cannot', 'isn', 'wasn', 'aren']) AS word
), p AS (
  SELECT doc_id, i, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d)
  WHERE word IN (SELECT word FROM own UNION SELECT unnest(bars) FROM templates UNION SELECT word FROM denials)
), likely AS (
  SELECT doc_id, n FROM (SELECT DISTINCT doc_id, word FROM p) JOIN own USING (word) JOIN templates USING (n) GROUP BY doc_id, n, need HAVING count(*) >= need
), blocks AS (
  SELECT doc_id, l.n, p.i AS first, width, ws, needs, bars, need, label FROM likely l JOIN p USING (doc_id) JOIN own ON own.n = l.n AND own.word = p.word JOIN templates t ON t.n = l.n
), m AS (
  SELECT b.doc_id, b.label, count(DISTINCT CASE WHEN p.i >= b.first AND list_contains(b.ws, p.word) THEN p.word END) / len(b.ws) AS c
  FROM blocks b JOIN p ON p.doc_id = b.doc_id AND p.i >= b.first - 2 AND p.i < b.first + b.width
  GROUP BY b.doc_id, b.n, b.first, b.label, b.ws, b.needs, b.bars, b.need
  HAVING count(DISTINCT CASE WHEN p.i >= b.first AND list_contains(b.ws, p.word) THEN p.word END) >= b.need
    AND (len(b.needs) = 0 OR list_has_all(list(p.word) FILTER (p.i >= b.first), b.needs)) AND count_if(p.i >= b.first AND list_contains(b.bars, p.word)) = 0
    AND count_if(p.word IN ('not', 'never', 'cannot', 'isn', 'wasn', 'aren') AND NOT list_contains(b.ws, p.word)) = 0
), place AS (
  SELECT doc_id, i - 1 AS i, label FROM (SELECT doc_id, w, p, n, label, unnest(range(1, len(w) - n + 2)) AS i FROM d, phrases WHERE contains(t, split_part(p, ' ', 1)) AND len(w) >= n)
  WHERE array_to_string(w[i:i + n - 1], ' ') = p
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY doc_id
), both_ AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM place) GROUP BY doc_id
), best AS (SELECT doc_id, max(c) AS c FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN both_ USING (doc_id) LEFT JOIN best USING (doc_id)
"""
