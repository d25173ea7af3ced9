"""Licence scans by a positional rare-token index over short licence notices."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Words, byte_class, shared_folder, slices, small_batches, stored
from siltstone.llm.quality_rules import STOP_WORDS

# Base phrases, and licence notices with the phrases that each must hold.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = (
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("agpl", "gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "without restriction including without limitation", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("zlib", "this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)

#: Looked-up words that must agree on a notice's place, at least.
AGREEING = 2

_SEPARATE = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_SEPARATE[65:91] = True  # capitals, which are lower-cased first
_COMMON = {w for line in STOP_WORDS.values() for w in line.split()}


def _hashes(words: list[str]) -> np.ndarray:
    return Words(pa.array([" ".join(words)], pa.string()), _SEPARATE).hash


class Vocabulary:
    """The words that scans look for: those of phrases, and those of notices that aren't function words."""

    def __init__(self, phrases: dict[str, str], notices: tuple):
        asked = {w for p in (*phrases, *(n[1] for n in notices)) for w in p.split()}
        self.words = sorted(asked | {w for n in notices for w in n[2].split() if w not in _COMMON})
        self.number = {w: k for k, w in enumerate(self.words)}
        hashes = _hashes(self.words)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are in the vocabulary, and their numbers."""
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == words.hash)
        return places, self.order[at[places]]


class Index:
    """Positional postings of the notices by word, and the words' inverse document frequencies over the corpus."""

    def __init__(self, vocabulary: Vocabulary, phrases: dict[str, str], notices: tuple, frequency: dict[int, int], documents: int):
        number = vocabulary.number
        self.idf = {k: math.log((documents + 1) / (frequency.get(k, 0) + 1)) for k in number.values()}
        self.phrases = [(tuple(number[w] for w in p.split()), label) for p, label in phrases.items()]
        self.notices, self.postings = [], {}
        for k, (label, key, text) in enumerate(notices):
            words = text.split()
            known = {at: number[w] for at, w in enumerate(words) if w in number}
            telling = {at: v for at, v in known.items() if words[at] not in _COMMON}
            self.notices.append((label, tuple(number[w] for w in key.split()), known, max(1, min(AGREEING, len(set(telling.values()))))))
            for at, v in telling.items():
                self.postings.setdefault(v, []).append((k, at))

    def places(self, there: dict[int, int]) -> Iterator[tuple[int, int]]:
        """(notice, place) pairs that enough of a file's words agree on, as its words of highest idf are looked up, one after another.

        The first word of a notice that is looked up proposes its places, further ones vote for them.
        """
        at: dict[int, list[int]] = {}
        for p, w in there.items():
            if w in self.postings:
                at.setdefault(w, []).append(p)
        votes: Counter = Counter()
        for w in sorted(at, key=lambda w: (-self.idf[w], w)):
            for k, q in self.postings[w]:
                least = self.notices[k][3]
                for p in at[w]:
                    votes[k, p - q] += 1
                    if votes[k, p - q] == least:
                        yield k, p - q

    def scan(self, at: list[int], words: list[int]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """Places of base phrases (count, first, last), base labels, all labels, and the best agreement."""
        there = dict(zip(at, words, strict=True))
        starts, base, score = [], set(), 0.0
        for phrase, label in self.phrases:
            own = [p for p, w in there.items() if w == phrase[0] and all(there.get(p + k) == v for k, v in enumerate(phrase))]
            if own:
                starts += own
                base.add(label)
        labels = set(base)
        for k, offset in self.places(there):
            label, key, known, _ = self.notices[k]
            span = range(offset, offset + max(known) + 1)
            if any(all(there.get(p + j) == v for j, v in enumerate(key)) for p in span if there.get(p) == key[0]):
                labels.add(label)
                score = max(score, sum(there.get(offset + q) == v for q, v in known.items()) / len(known))
        if base:
            score = max(score, 0.5)
        return len(starts), min(starts, default=None), max(starts, default=None), base, labels, score


HITS = "doc_id long, n_words long, at array<int>, words array<int>"


def _scan(vocabulary: Vocabulary):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column("text"), _SEPARATE)
                places, numbers = vocabulary.numbers(words)
                row = np.searchsorted(words.first, places, "right") - 1
                cuts = pa.array(np.searchsorted(places, words.first), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.ListArray.from_arrays(cuts, pa.array((places - words.first[row]).astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(numbers.astype(np.int32)))],
                    names=["doc_id", "n_words", "at", "words"],
                )

    return run


def scanned(documents: DataFrame, phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row.

    One pass over texts finds the places of licence words; their document frequencies are over all
    rows. Each file's licence words are looked up from the rarest on. Wherever two of them stand as far
    apart as in a notice, and its key phrase stands there too, the notice's label is added. score is the
    best share of a notice's words at their places (at least 0.5 with a base phrase, else 0 without).

    Null and empty texts have no words and no labels (empty strings). Repeated rows are scanned each;
    null ids stay null; other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    small_batches(spark)
    vocabulary = Vocabulary(phrases, notices)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = stored(rows.mapInArrow(_scan(vocabulary), HITS), shared_folder(spark, "licences") + "/hits")
    counts = hits.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count().collect()  # a row for a licence word
    index = spark.sparkContext.broadcast(Index(vocabulary, phrases, notices, {r["word"]: r["count"] for r in counts}, hits.count()))

    def label(batches):
        for batch in batches:
            found = [index.value.scan(a, w) for a, w in zip(batch.column("at").to_pylist(), batch.column("words").to_pylist(), strict=True)]
            joined = lambda k: pa.array([",".join(sorted(f[k])) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3)), joined(3), joined(4), pa.array([f[5] for f in found], pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return hits.mapInArrow(label, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
