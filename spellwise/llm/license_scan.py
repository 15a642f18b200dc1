"""Licence notices by a positional index of rare words.

Templates (short phrases and whole notices) are indexed word by word with their positions. The document frequency of every
index word is counted over the whole corpus. In a file, the templates' words with the highest IDF among those that the file
has are looked up first; each of their places, less its positions in the template, says where the template would begin.

A phrase stands where the beginnings of all its words agree (intersection of postings by relative position, rarest word
first). A notice stands where those of its rarest words agree up to SLACK words, every mandatory key phrase stands near its
own place, and the words found near theirs carry at least LEAST of the notice's IDF. Key phrases are looked up as phrases.

The corpus-wide counts have one row per index word, whatever the number of documents. Texts are read whole, in chunks that
end between words; only index words and their places are kept of them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rarest words of a notice that vote for where it begins, and the words by which places may be off.
ANCHORS, SLACK = 4, 6
#: Share of a notice's IDF that must be found in place.
LEAST = 0.6
#: Bytes of a text split into words at a time.
CHUNK = 1 << 20

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")

# Phrases whose places are always reported, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of well-known public notices (label, notice, mandatory key phrases).
NOTICES = [
    ("agpl", "GNU Affero General Public License", ["affero general public license"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at", ["apache license", "in compliance with the license"]),
    ("bsd", "Released under the BSD License", ["bsd license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met", ["source and binary forms", "following conditions are met"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     ["creative commons attribution noncommercial"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
     ["creative commons attribution sharealike"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
     ["extent possible under law", "copyright and related or neighboring rights"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation", ["redistribute it and or modify it", "general public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ["any purpose with or without fee"]),
    ("lgpl", "GNU Lesser General Public License", ["lesser general public license"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Licensed under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the Software), to deal in the Software without restriction", ["free of charge", "deal in the software without restriction"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]


def split(text: str) -> list[bytes]:
    return _WORDS.findall(text.encode().lower())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    #: (words of a key phrase, its place in the template)
    keys: tuple[tuple[tuple[bytes, ...], int], ...]


def templates(notices) -> list[Template]:
    """The notices; a key phrase's place is its first in the notice."""
    out = []
    for label, notice, keys in notices:
        words = tuple(split(notice))
        found = []
        for key in keys:
            k = tuple(split(key))
            places = [i for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k]
            if not places:
                raise ValueError(f"{key!r} is not in {notice!r}")
            found.append((k, places[0]))
        out.append(Template(label, words, tuple(found)))
    return out


def chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-case UTF-8 text, chunk by chunk."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        gap = _GAP.search(data, end) if end < len(data) else None
        end = gap.start() if gap else len(data)
        yield _WORDS.findall(data, at, end)
        at = end


class Index:
    """Postings of phrases and notices with the IDF of their words."""

    def __init__(self, phrases, notices, documents: int, frequency: dict[bytes, int]):
        self.phrases = [(tuple(split(p)), label) for p, label in phrases.items()]
        self.templates = templates(notices)
        self.positions = [
            {w: [i for i, x in enumerate(t.words) if x == w] for w in t.words} for t in self.templates
        ]  # postings of each template
        self.vocabulary = vocabulary(phrases, notices)
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1e-9 for w in self.vocabulary}

    def rarest(self, words) -> list[bytes]:
        return sorted(set(words), key=lambda w: (-self.idf[w], w))

    def read(self, text: str | None) -> tuple[int, dict[bytes, list[int]], dict[int, bytes]]:
        """(number of words, places of each index word, index word at each place)."""
        n, where, at = 0, {}, {}
        for words in chunks((text or "").encode("utf-8", "surrogatepass").lower()):
            for i, w in enumerate(words, n):
                if w in self.vocabulary:
                    where.setdefault(w, []).append(i)
                    at[i] = w
            n += len(words)
        return n, where, at

    def places(self, phrase, where, at) -> list[int]:
        """Where a phrase stands: beginnings that its rarest word names and all others share."""
        if any(w not in where for w in phrase):
            return []
        rare = self.rarest(phrase)[0]
        offset = phrase.index(rare)
        starts = (p - offset for p in where[rare])
        return [s for s in starts if s >= 0 and all(at.get(s + i) == w for i, w in enumerate(phrase))]

    def share(self, k: int, where, at) -> float:
        """The greatest share of notice k's IDF in place, 0 where its key phrases or rare words don't agree."""
        t, postings = self.templates[k], self.positions[k]
        keys = [(self.places(phrase, where, at), offset) for phrase, offset in t.keys]
        if not all(places for places, _ in keys):
            return 0.0
        anchors = self.rarest(w for w in postings if w in where)[:ANCHORS]
        begins = [sorted(p - q for p in where[a] for q in postings[a]) for a in anchors]
        whole = sum(self.idf[w] for w in t.words)
        best = 0.0
        for s in sorted(set(begins[0])):
            votes = sum(_near(b, s) for b in begins)
            if 2 * votes < len(begins) or not all(_near(places, s + offset) for places, offset in keys):
                continue
            found = sum(self.idf[w] for i, w in enumerate(t.words) if w in where and _near(where[w], s + i))
            best = max(best, found / whole)
        return best

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
        n, where, at = self.read(text)
        found = {label: places for phrase, label in self.phrases if (places := self.places(phrase, where, at))}
        starts = [s for places in found.values() for s in places]
        score, labels = (0.5 if starts else 0.0), set(found)
        if where:
            for k, t in enumerate(self.templates):
                share = self.share(k, where, at)
                if share >= LEAST:
                    labels.add(t.label)
                    score = max(score, 0.5 + 0.5 * min(share, 1.0))
        join = lambda x: ",".join(sorted(x))
        return n, len(starts), min(starts, default=None), max(starts, default=None), join(found), join(labels), score


def _near(places: list[int], at: int) -> bool:
    """Whether some of the sorted `places` lies within SLACK of `at`."""
    i = bisect_left(places, at - SLACK)
    return i < bisect_right(places, at + SLACK)


def vocabulary(phrases, notices) -> frozenset[bytes]:
    return frozenset(w for text in [*phrases, *(n for _, n, _ in notices)] for w in split(text))


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def frequencies(texts: DataFrame, words: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """(documents, documents with each of `words`) over all rows of `text`: one row per word and task, then one per word."""

    def count(batches):
        documents, has = 0, Counter()
        for batch in _texts(batches):
            for text in batch.column(0).to_pylist():
                documents += 1
                own = set()
                for chunk in chunks((text or "").encode("utf-8", "surrogatepass").lower()):
                    own |= words.intersection(chunk)
                has.update(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *(w.decode() for w in has)], pa.string()), pa.array([documents, *has.values()], pa.int64())], ["word", "n"]
        )

    rows = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found.pop(None, 0), {w.encode(): n for w, n in found.items()}


_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, notices=None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters and digits (any character beyond ASCII counts as one), A-Z in lower case. `n_base`,
    `first_word`, `last_word` and `base_labels` are of the phrases' places; `labels` has those and the notices' own, distinct,
    sorted and joined by commas. `score` is 0 without a label, 0.5 for a phrase alone, and 0.5 and half the share in place for
    the best notice. A null text counts as empty, repeated rows stay repeated, an empty table gives no row, other columns
    are not read.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    documents, frequency = frequencies(slim.select("text"), vocabulary(phrases, notices))
    index = Index(phrases, notices, documents, frequency)
    names = [c.split()[0] for c in _RESULT.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for batch in _texts(batches):
            found = list(zip(*map(index.scan, batch.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(found, types))], ["doc_id", *names]
            )

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {id_type}, {_RESULT}")
