"""License scans by a positional index of rare template words.

Templates are short licence notices with phrases that must stand in a file. The
index maps each template word to its templates and positions. A first pass counts
in how many documents each template word stands (at most the vocabulary of the
templates comes back), which gives the words' IDF. The second pass looks up each
file's licence words in falling order of IDF: every occurrence of one of a
template's ``anchors`` rarest words votes for a start of the template; at each
start voted for, the postings are intersected with the file by relative position.
The score is the IDF share of the template's words found in their place. A
template counts where its share reaches ``threshold`` and its key phrase stands
near. Both passes are row-local.

Words are runs without ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` after A-Z is
lower-cased. Defined results: null and empty texts have no words, no labels and
score 0; without documents the result is empty; repeated rows are scanned alike;
columns other than ``doc_id, text`` are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that give a label wherever their words stand in a row.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice, mandatory key phrase. The notices are the public wordings.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use"),
    ("cc-by-4.0", "This work is licensed under CC BY 4.0", "cc by 4"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal", "cc0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "general public license version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "general public license version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("lgpl", "This library is free software under the GNU Lesser General Public License", "lesser general public license"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "free of charge"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "public domain"),
)

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string"
)


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def _starts(hits: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand in a row."""
    rest = [set(hits.get(w, ())) for w in phrase[1:]]
    return [p for p in hits.get(phrase[0], ()) if all(p + k in at for k, at in enumerate(rest, 1))]


class Index:
    """Positional postings of the templates with the words' IDF."""

    def __init__(self, templates, idf: dict[bytes, float], anchors: int):
        self.templates = [(label, words(notice), words(phrase)) for label, notice, phrase in templates]
        self.idf = idf
        self.vocabulary = {w for _, notice, phrase in self.templates for w in notice + phrase}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.mass = []
        for t, (_, notice, _) in enumerate(self.templates):
            self.mass.append(math.fsum(idf[w] for w in notice))
            rare = sorted(set(notice), key=lambda w: (-idf[w], w))[:anchors]
            for p, w in enumerate(notice):
                if w in rare:
                    self.postings[w].append((t, p))

    def scan(self, hits: dict[bytes, list[int]], threshold: float) -> list[tuple[str, float, int]]:
        """Label, score and start of every template found, from the places of licence words."""
        places = {w: set(at) for w, at in hits.items()}
        seen, found = set(), []
        for w in sorted(hits, key=lambda w: (-self.idf[w], w)):
            for t, p in self.postings.get(w, ()):
                for at in hits[w]:
                    start = at - p
                    if (t, start) in seen:
                        continue
                    seen.add((t, start))
                    label, notice, phrase = self.templates[t]
                    share = math.fsum(self.idf[x] for k, x in enumerate(notice) if start + k in places.get(x, ())) / self.mass[t]
                    if share >= threshold:
                        near = {x: [q for q in hits.get(x, ()) if start - len(phrase) <= q <= start + len(notice) + len(phrase)] for x in set(phrase)}
                        if _starts(near, phrase):
                            found.append((label, share, start))
        return found


def document_frequency(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """All documents and, for each template word, those that hold it."""
    known = sorted(vocabulary)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = 0, Counter()
        for frame in frames:
            n += len(frame)
            for text in frame["text"]:
                seen.update(vocabulary.intersection(words(text)))
        yield pd.DataFrame({"word": [None, *[w.decode() for w in known if seen[w]]], "n": [n, *[seen[w] for w in known if seen[w]]]})

    rows = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: r["n"] for r in rows}
    return got.get(None, 0), {w: got.get(w.decode(), 0) for w in known}


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, anchors: int = 4) -> DataFrame:
    """One row of labels, places and score for each document.

    ``places`` lists ``label@start`` of the method's finds, in word numbers.
    """
    base = [(words(p), label) for p, label in BASE_PHRASES.items()]
    vocabulary = {w for p, _ in base for w in p} | {w for _, notice, phrase in templates for w in words(notice) + words(phrase)}
    n, df = document_frequency(docs, vocabulary)
    index = Index(templates, {w: math.log((n + 1) / (k + 1)) + 1 for w, k in df.items()}, anchors)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                split = words(text)
                hits: dict[bytes, list[int]] = defaultdict(list)
                for p, w in enumerate(split):
                    if w in vocabulary:
                        hits[w].append(p)
                own = [(p, label) for phrase, label in base for p in _starts(hits, phrase)]
                found = index.scan(hits, threshold)
                starts, labels = [p for p, _ in own], {label for _, label in own}
                rows.append((
                    doc_id, len(split), len(own), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                    ",".join(sorted(labels | {label for label, _, _ in found})),
                    min(1.0, max([*(s for _, s, _ in found), 1.0 if own else 0.0])),
                    ",".join(f"{label}@{p}" for label, _, p in sorted(found, key=lambda x: (x[2], x[0]))),
                ))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(scan, RESULT)
