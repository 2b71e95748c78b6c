"""License scans by a positional rare-token index (operator 5).

The templates are characteristic passages of licences, several of each, and the short notices by which files name them. A file looks up one word of every template: of those in its
mandatory key phrases the rarest by document frequency over all files, posted with its places in them. Wherever that word
stands the template is laid, at every start that would put it in its place: its words are compared by position, and it counts
if enough of them stand, with its key phrases whole. So every start that can count is tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.words import ALNUM, LOWER, Words, slices

#: label, text, key phrases (joined by |), whether every word must stand. The first three are the base phrases.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright and related"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "all rights reserved no part of this work may be reproduced or transmitted in any form without prior written permission", "all rights reserved"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "distributed on an as is basis"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "distributed in the hope that it will be useful"),
    ("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "provided as is without warranty of any kind"),
    # Notices: the phrase alone names the licence, so all of it must stand.
    ("mit", "the mit license", "the mit license"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    ("bsd", "bsd 2 clause license", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license", "bsd 3 clause license"),
    ("bsd", "the bsd license", "the bsd license"),
    ("isc", "the isc license", "the isc license"),
    ("gpl", "gnu general public license", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license", "gnu library general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "mozilla public license", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("bsl", "boost software license version 1 0", "boost software license version 1 0"),
    ("cc-by", "licensed under cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("public-domain", "released into the public domain", "released into the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
#: Fraction of a template's words that must stand; words by which it may be shifted; starts compared at once.
COVER, SLACK, STARTS = 0.75, 1, 4096


@dataclass
class Index:
    """words: sorted hashes of licence words; templates: (label, places in words, key phrases as ranges, exact)."""

    words: np.ndarray
    spelling: list[bytes]
    templates: list[tuple[str, np.ndarray, list[tuple[int, int]], bool]]


def hashed(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array(texts), ALNUM, LOWER)
    h = words.hashes()
    return [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def index(base=BASE, templates=TEMPLATES) -> Index:
    rows = [(label, text, text, True) for label, text in base] + [(label, text, keys, False) for label, text, keys in templates]
    spelled = sorted({w for _, text, _, _ in rows for w in text.split()})
    h = np.array([x[0] for x in hashed(spelled)])
    order = np.argsort(h)
    words = h[order]
    of = {spelled[i]: k for k, i in enumerate(order)}
    out = []
    for label, text, keys, exact in rows:
        own = text.split()
        ranges = []
        for key in keys.split("|"):
            part = key.split()
            at = next(i for i in range(len(own)) if own[i : i + len(part)] == part)
            ranges.append((at, at + len(part)))
        out.append((label, np.array([of[w] for w in own]), ranges, exact))
    return Index(words, [spelled[i].encode() for i in order], out)


def found_words(words: Words, h: np.ndarray, own: Index) -> np.ndarray:
    """For each word its place among licence words, or -1; equal hashes are checked by length."""
    i = np.minimum(np.searchsorted(own.words, h), len(own.words) - 1)
    i = np.where(own.words[i] == h, i, -1)
    same = np.array([len(s) for s in own.spelling])
    i[(i >= 0) & (same[i] != words.ends - words.starts)] = -1
    return i


def frequencies(own: Index):
    """mapInArrow function: text -> word (place in the index), n (documents of a task that have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(own.words), np.int64)
        for batch in slices(batches):
            words = Words(batch.column("text"), ALNUM, LOWER)
            which = found_words(words, words.hashes(), own)
            doc = np.repeat(np.arange(len(words.n)), words.n)
            has = which >= 0
            pairs = np.unique(doc[has] * len(n) + which[has])
            n += np.bincount(pairs % len(n), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["word", "n"])

    return run


def scanned(own: Index, df: np.ndarray):
    """mapInArrow function: doc_id, text -> the digest of each document."""
    rank = np.argsort(np.argsort(df, kind="stable"), kind="stable")  # 0: rarest
    # Each template's rarest key word, and one phrase's places of it: a start that counts has it there.
    anchors: list[tuple[int, int]] = []
    for _, template, keys, _ in own.templates:
        p = min((p for a, b in keys for p in range(a, b)), key=lambda p: rank[template[p]])
        anchors.append((int(template[p]), p))
    anchor_words = np.zeros(len(own.words) + 1, bool)
    anchor_words[[w for w, _ in anchors]] = True

    def document(which: np.ndarray) -> tuple[list[tuple[int, str]], dict[str, float]]:
        at = np.flatnonzero(anchor_words[which])
        mine = which[at]
        places: dict[int, np.ndarray] = {w: at[mine == w] for w in set(mine.tolist())}
        exact: set[tuple[int, int]] = set()
        scores: dict[str, float] = {}
        for t, (w, p) in enumerate(anchors):
            if w not in places:
                continue
            label, template, keys, whole = own.templates[t]
            size, found = len(template), places[w] - p
            if whole:
                for s in found[(found >= 0) & (found + size <= len(which))].tolist():
                    if (which[s : s + size] == template).all():
                        exact.add((s, t))
                continue
            begin = np.unique(np.concatenate([found - shift for shift in range(-SLACK, SLACK + 1)]))
            for i in range(0, len(begin), STARTS):
                good = np.zeros((len(begin[i : i + STARTS]), size), bool)
                phrases = np.zeros((len(keys), len(good)), bool)
                for shift in range(-SLACK, SLACK + 1):
                    place = begin[i : i + STARTS, None] + shift + np.arange(size)
                    inside = (place >= 0) & (place < len(which))
                    here = inside & (which[np.where(inside, place, 0)] == template)
                    good |= here
                    phrases |= [here[:, a:b].all(axis=1) for a, b in keys]  # a key phrase stands in one piece
                kept = (good.mean(axis=1) >= COVER) & phrases.all(axis=0)
                if kept.any():
                    scores[label] = max(scores.get(label, 0.0), float(good.mean(axis=1)[kept].max()))
        return sorted((s, own.templates[t][0]) for s, t in exact), scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"), ALNUM, LOWER)
            which = found_words(words, words.hashes(), own)
            rows = [document(which[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            base = [sorted({label for _, label in hits}) for hits, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(words.n.astype(np.int64)), pa.array([len(h) for h, _ in rows], pa.int64()),
                    pa.array([h[0][0] if h else None for h, _ in rows], pa.int64()), pa.array([h[-1][0] if h else None for h, _ in rows], pa.int64()),
                    pa.array([",".join(b) for b in base], pa.string()), pa.array([",".join(sorted({*b, *s})) for b, (_, s) in zip(base, rows, strict=True)], pa.string()),
                    pa.array([1.0 if h else max(s.values(), default=0.0) for h, s in rows], pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def licenses(docs: DataFrame, own: Index | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text).

    Null and empty texts have no words and no labels; texts are taken whole, a very long one as a slice of its own. Other
    columns are left alone, and no rows give no rows. n_base counts places of base phrases, each label by itself. score:
    1 with a base phrase, else the largest covered fraction of a template found, else 0. Repeated rows are scanned each.
    """
    own = own or index()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.select("text").mapInArrow(frequencies(own), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(own.words), np.int64)
    for r in counts:
        df[r.word] = r.n
    return texts.mapInArrow(scanned(own, df), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
