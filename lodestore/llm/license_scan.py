"""Licence texts found by a positional index over their rarest words.

The index holds, for each template, the places of its rarest words: the ``LOOKED_UP`` words of
highest IDF that it has, as counted over all documents. Those of every template are looked up in each
file, whatever else the file holds; their postings give relative positions (place in the file
less place in the template), and where enough of a template's rare words agree on one relative
position, give or take ``SLACK`` words, the template's mandatory phrases are verified around it.

The short phrases are templates too: the rarest word is looked up, and the other
words must stand at their exact relative positions.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import wordkit
from lodestore.llm.common import batch_of, id_text, map_arrow, read

# Short phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: (label, notice as it is commonly written, phrases that must stand in it). A label may have several; others can be given to Index.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted", "without restriction"),
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        ("apache license", "in compliance with the license"),
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("free software", "gnu general public license"),
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        ("free software", "gnu lesser general public license"),
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("free software", "gnu affero general public license"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "are permitted"),
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("endorse or promote products derived from this software",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee",),
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        ("mozilla public license",),
    ),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        ("software and accompanying documentation covered by this license",),
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        ("free and unencumbered software released into the public domain",),
    ),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        ("creative commons attribution 4 0",),
    ),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License. To view a copy of this license, visit http://creativecommons.org/licenses/by/3.0/",
        ("creative commons attribution 3 0",),
    ),
    (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        ("creative commons attribution sharealike",),
    ),
    (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        ("creative commons attribution noncommercial 4 0",),
    ),
    (
        "cc0",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
)
#: How many of a template's words are looked up, the rarest ones.
LOOKED_UP = 24
#: Share of a template's looked-up words that must agree on one relative position.
AGREEING = 0.5
#: Words that relative positions may drift within one template.
SLACK = 4


def words_of(text: str) -> list[str]:
    w = wordkit.split(pa.array([text]), wordkit.NON_ALNUM)
    return [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]


def _hashes(words: list[str]) -> np.ndarray:
    return wordkit.split(pa.array([" ".join(words)]), wordkit.NON_ALNUM).hashes()


class Index:
    """Templates and phrases over a vocabulary. Its size depends on the templates alone, which may be whole licence texts."""

    def __init__(self, templates: Sequence[tuple[str, str, Sequence[str]]] = TEMPLATES, phrases: dict = PHRASES):
        self.templates = [(label, words_of(text), [words_of(p) for p in keys]) for label, text, keys in templates]
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        every = [w for _, words, keys in self.templates for w in [*words, *(x for k in keys for x in k)]] + [w for words, _ in self.phrases for w in words]
        self.vocabulary = sorted(set(every))
        h = _hashes(self.vocabulary)
        order = np.argsort(h)
        self.hash, self.word_of = h[order], order  # sorted hashes and the words they stand for
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.seq = [(label, [number[w] for w in words], [[number[w] for w in k] for k in keys]) for label, words, keys in self.templates]
        self.phrase_seq = [([number[w] for w in words], label) for words, label in self.phrases]

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, or -1."""
        k = np.searchsorted(self.hash, h)
        k[k == len(self.hash)] = 0
        return np.where(self.hash[k] == h, self.word_of[k], -1)

    def rank(self, idf: np.ndarray) -> Postings:
        """The index once it is known which words are rare."""
        return Postings(self, idf)


class Postings:
    """For each template the places of its rarest words, and the rarest word of each phrase."""

    def __init__(self, index: Index, idf: np.ndarray):
        rarest = lambda seq: max(range(len(seq)), key=lambda j: (idf[seq[j]], -j))
        self.templates = []
        self.rare = np.zeros((len(index.seq), len(index.vocabulary)), dtype=bool)
        for t, (label, words, keys) in enumerate(index.seq):
            chosen = sorted(set(words), key=lambda w: (-idf[w], w))[:LOOKED_UP]
            self.rare[t, chosen] = True
            places = defaultdict(list)
            for at, w in enumerate(words):
                if self.rare[t, w]:
                    places[w].append(at)
            self.templates.append((label, len(words), len(chosen), dict(places), [(k, rarest(k)) for k in keys]))
        self.any = np.append(self.rare.any(axis=0), False)  # number -1 is no word
        self.need = np.array([max(3, math.ceil(AGREEING * c)) for _, _, c, _, _ in self.templates])
        self.phrases = [(seq, rarest(seq), label) for seq, label in index.phrase_seq]

    def find(self, number: np.ndarray) -> dict[str, float]:
        """Label -> share of the template's looked-up words in place, for the templates that ``number`` holds."""
        places = np.flatnonzero(self.any[number])
        held = self.rare[:, np.unique(number[places])].sum(axis=1)
        found: dict[str, float] = {}
        for t in np.flatnonzero(held >= self.need).tolist():
            label, n, c, at_of, keys = self.templates[t]
            own = places[self.rare[t, number[places]]]
            agreeing, low = _in_place(at_of, own.tolist(), number[own].tolist())
            part = number[max(0, low - SLACK) : max(0, low + n + 2 * SLACK)]
            if agreeing >= self.need[t] and all(len(_stands(k, part, anchor)) for k, anchor in keys):
                found[label] = max(found.get(label, 0.0), agreeing / c)
        return found


def word_counts(docs: DataFrame, index: Index) -> np.ndarray:
    """In how many documents each licence word stands. One row a licence word reaches the driver."""
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = wordkit.split(batch.column(1), wordkit.NON_ALNUM)
        number = index.look_up(w.hashes())
        hit = np.flatnonzero(number >= 0)
        pairs = np.unique(w.doc[hit] * len(index.vocabulary) + number[hit])
        n = np.bincount(pairs % len(index.vocabulary), minlength=len(index.vocabulary))
        some = np.flatnonzero(n)
        return batch_of(schema, some.astype(np.int32), n[some])

    rows = map_arrow(docs, one, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(index.vocabulary), dtype=np.int64)
    for r in rows:
        out[r["word"]] = r["n"]
    return out


def _stands(seq: list[int], number: np.ndarray, anchor: int) -> np.ndarray:
    """Starts of the places where ``seq`` stands; found from the places of its word ``anchor``."""
    start = np.flatnonzero(number == seq[anchor]) - anchor
    start = start[(start >= 0) & (start + len(seq) <= len(number))]
    for k, w in enumerate(seq):
        start = start[number[start + k] == w]
    return start


def _in_place(at_of: dict[int, list[int]], places: list[int], words: list[int]) -> tuple[int, int]:
    """The most words that agree on one relative position, and the least of their positions.

    ``at_of`` has the places of each word in the template, ``places`` and ``words`` those in the file.
    """
    agreed = sorted((at - pos, w) for at, w in zip(places, words) for pos in at_of[w])
    inside, low, best = Counter(), 0, (0, 0)
    for off, w in agreed:  # window over the relative positions
        inside[w] += 1
        while agreed[low][0] < off - SLACK:
            gone = agreed[low][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            low += 1
        if len(inside) > best[0]:
            best = (len(inside), agreed[low][0])
    return best


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of ``docs``.

    ``score`` is 1 where a phrase stands, else the best template's share of words in
    place, else 0. A null or empty text has no words, no labels (empty strings) and
    null places; a null id stays null; repeated rows are judged alike. An empty
    table gives no rows. Other columns are not looked at.
    """
    docs, index = id_text(docs, id_col, text_col), index or Index()
    counts = word_counts(docs, index)
    postings = index.rank(-np.log((counts + 1.0) / (counts.sum() + len(counts))))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = wordkit.split(batch.column(1), wordkit.NON_ALNUM)
        number, rows = index.look_up(w.hashes()), []
        starts, base = defaultdict(list), defaultdict(set)
        for seq, anchor, label in postings.phrases:
            at = _stands(seq, number, anchor)
            for d, x in zip(w.doc[at].tolist(), at.tolist()):
                if x + len(seq) <= w.first[d + 1]:
                    starts[d].append(x - int(w.first[d]))
                    base[d].add(label)
        # Only texts with three rare words or more can hold a template.
        some = np.bincount(w.doc[postings.any[number]], minlength=batch.num_rows) >= 3 if len(number) else np.zeros(batch.num_rows, bool)
        for d, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist())):
            more = postings.find(number[a:b]) if some[d] else {}
            at, own = starts[d], base[d]
            rows.append((b - a, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | more.keys())), 1.0 if own else max(more.values(), default=0.0)))
        return batch_of(schema, batch.column(0), *zip(*rows))

    return map_arrow(docs, one, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def _sql(index: Index) -> str:
    """The same in SQL: every step of the method, over all documents."""
    rows = lambda x: ", ".join(f"({', '.join(repr(v) for v in r)})" for r in x)
    many = list(enumerate(index.templates))
    templates = rows((t, at, w) for t, (_, words, _) in many for at, w in enumerate(words))
    lengths = rows((t, label, len(words), len(keys), min(LOOKED_UP, len(set(words)))) for t, (label, words, keys) in many)
    keys = rows((t, k, j, len(words), w) for t, (_, _, sets) in many for k, words in enumerate(sets) for j, w in enumerate(words))
    phrases = rows((label, k, j, len(words), w) for k, (words, label) in enumerate(index.phrases) for j, w in enumerate(words))
    return rf"""
WITH tw(t, pos, word) AS (VALUES {templates}),
tl(t, label, len, n_keys, c) AS (VALUES {lengths}),
kw(t, k, j, n, word) AS (VALUES {keys}),
pw(label, k, j, n, word) AS (VALUES {phrases}),
vocabulary AS (SELECT word FROM tw UNION SELECT word FROM kw UNION SELECT word FROM pw),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
v AS (SELECT * FROM x SEMI JOIN vocabulary USING (word)),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM vocabulary LEFT JOIN v USING (word) GROUP BY word),
rare AS (SELECT t, word FROM (SELECT DISTINCT t, word FROM tw) JOIN df USING (word) QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, word) <= {LOOKED_UP}),
cand AS (
  SELECT doc_id, t, any_value(c) AS c, greatest(3, ceil({AGREEING} * any_value(c))) AS need
  FROM (SELECT DISTINCT doc_id, word FROM v) JOIN rare USING (word) JOIN tl USING (t) GROUP BY doc_id, t HAVING count(*) >= greatest(3, ceil({AGREEING} * any_value(c)))),
agreed AS (SELECT DISTINCT doc_id, t, v.i - tw.pos AS off, word FROM v JOIN rare USING (word) JOIN tw USING (t, word) JOIN cand USING (doc_id, t)),
win AS (
  SELECT a.doc_id, a.t, a.off, count(DISTINCT b.word) AS agreeing, min(b.off) AS low
  FROM (SELECT DISTINCT doc_id, t, off FROM agreed) AS a JOIN agreed AS b ON a.doc_id = b.doc_id AND a.t = b.t AND b.off BETWEEN a.off - {SLACK} AND a.off GROUP BY ALL),
best AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY agreeing DESC, off) = 1),
key_at AS (SELECT doc_id, t, k, v.i - j AS start, any_value(n) AS n FROM v JOIN kw USING (word) GROUP BY doc_id, t, k, v.i - j HAVING count(*) = any_value(n)),
found AS (
  SELECT doc_id, any_value(label) AS label, agreeing / any_value(c) AS score
  FROM best JOIN cand USING (doc_id, t) JOIN tl USING (t, c) JOIN key_at USING (doc_id, t)
  WHERE agreeing >= need AND start >= greatest(0, low - {SLACK}) AND start + n <= greatest(0, low + len + {2 * SLACK})
  GROUP BY doc_id, t, agreeing HAVING count(DISTINCT k) = any_value(n_keys)),
phrase_at AS (SELECT doc_id, any_value(label) AS label, v.i - j AS start FROM v JOIN pw USING (word) GROUP BY doc_id, k, v.i - j HAVING count(*) = any_value(n)),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM phrase_at GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT doc_id, label, 1.0 AS score FROM phrase_at UNION ALL SELECT doc_id, label, score FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""


QUERIES = {"op9_license_scan": op9_license_scan}
SQL = {"op9_license_scan": _sql(Index())}
