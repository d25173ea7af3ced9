"""Packing as an exact round trip."""

import collections
import random
import unicodedata
import zlib

import numpy as np
import pytest

from siltstone.llm import packing, tokens
from siltstone.llm.queries import vocabulary
from siltstone.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_cached_ids_equal_the_tokenizer(tokenizer):
    encoder = Encoder(vocabulary())
    r = random.Random(3)
    parts = [*"abC É́ \t\n\r\x0b\x1c'12ß!?.,Σσ​﻿İ中 ̀", "<|endoftext|>", "'ll", "'re", "　", "\x85", "a.", "B,", "É.", "The.", "ſ", "ﬁ", "I'm"]
    composing = [chr(c) for c in range(0x80, 0x1E00) if unicodedata.normalize("NFC", chr(c).lower()) != chr(c).lower() or unicodedata.normalize("NFC", chr(c)) != chr(c)]
    parts += ["T̈", "W̊", "Ϊ́", "J̌", "H̱", "Aʾ", "क़.", "य़,", "གྷ.", "שּׁ,", "नी.", *composing]
    for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZΑΕΗΙΟΥΩΪΫАЕИОУЫЭ":  # capitals with marks that compose in lower case only
        for mark in range(0x300, 0x346):
            text = a + chr(mark) + r.choice(("", ".", ",", "b", "\u0301"))
            assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    for _ in range(3000):
        text = "".join(chr(r.choice((r.randrange(32, 0xD800), r.randrange(0xE000, 0x20000), r.randrange(32, 0x250)))) for _ in range(r.randint(1, 6))) + r.choice(("", ".", ","))
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    for _ in range(5000):
        text = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_cache_is_bounded_and_changes_nothing(tokenizer, prose, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PARTS", 20)
    monkeypatch.setattr(tokens, "NEW_PARTS", 10)
    encoder = Encoder(vocabulary())
    for k in range(30):
        text = prose(k, 80) + "  " + "x" * k + " " + prose(0, 40)
        assert np.frombuffer(next(encoder.encode([text, ""])), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder) <= 22 and len(encoder.new) <= 11 and len(encoder.old) <= 22


def checked(found, rows, tokenizer, window):
    """All ids in one piece each, sequences gapless; returns (sequences, padding, cut rests)."""
    pieces, sequences, left = collections.defaultdict(list), collections.defaultdict(list), collections.Counter()
    for r in found:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        left.update((i, int(k), zlib.crc32(ids[k : k + n].tobytes())) for k, n in ())
        own = sorted(pieces[i, len(ids)], key=lambda r: r.start)
        copies = sum(1 for j, u in rows if (j, u) == (i, t))
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at = {r.start for r in own}
        assert 0 in at and all(r.start + r.length in at or r.start + r.length == len(ids) for r in own)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return len(sequences), padding


def test_round_trip(documents, odd_rows, prose, tokenizer):
    r = random.Random(1)
    rows = [x[:2] for x in odd_rows] + [(100 + k, prose(k, r.randint(1, 900))) for k in range(150)] + [(400 + k, prose(7, 300)) for k in range(40)]
    found = packing.packed(documents(rows), vocabulary()).collect()
    sequences, padding = checked(found, rows, tokenizer, packing.WINDOW)
    assert padding < packing.WINDOW


def test_empty_table(documents):
    assert packing.packed(documents([(1, "x")]).limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "one length", "few lengths", "short"])
def test_plan_places_every_piece_once(kind):
    r = np.random.default_rng(4)
    window = 256
    lengths = {"uniform": r.integers(1, window, 5000), "one length": np.full(700, 150), "few lengths": r.choice([30, 100, 128, 226], 3000), "short": r.integers(1, 6, 2000)}[kind]
    histogram = np.bincount(lengths, minlength=window)
    rows, sequences = packing.plan(histogram)
    used, seen = np.zeros(sequences, int), collections.Counter()
    for n, first, end, sequence, offset, stream in rows:
        seen[int(n)] += int(end - first)
        for k in range(end - first):
            if stream < 0:
                used[sequence + k] += n
            else:
                at = int(stream + k * n)
                room = window - at % window
                used[sequence + at // window] += min(n, room)
                if n > room:
                    used[sequence + at // window + 1] += n - room
    assert (used <= window).all() and (used > 0).all()
    assert all(seen[n] == c for n, c in enumerate(histogram) if c)
    assert (window - used).sum() < window


def test_least_squares_is_non_negative_and_close():
    h = np.zeros(16, int)
    h[[4, 12, 8]] = (30, 30, 10)
    patterns = packing.combinations(h)
    x = packing.least_squares(h, patterns)
    made = np.zeros(16)
    for p, v in zip(patterns, x, strict=True):
        for n in p:
            made[n] += v
    assert (x >= 0).all() and np.abs(made - h).max() < 2
