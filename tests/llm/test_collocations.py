"""Phrase collocations against counting by hand, over shards and ranges of any size."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomlog.llm import collocations as c


def phrases_of(rows):
    """(counts by (lang, words), words by lang)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    return f, n


def by_hand(rows, least=30, top=2000, cover=80):
    f, n = phrases_of(rows)
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    covered = set()
    for (lang, w), a in often.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if 100 * a >= cover * f[lang, w[i : i + size]]:
                    covered.add((lang, w[i : i + size]))
    by_lang = {}
    for (lang, w), a in often.items():
        if (lang, w) not in covered:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, texts, least=4):
    rng = random.Random(seed)
    vocab = ["the", "of", "new", "York", "a\x01", "a", "ö", "日本", "x" * 100, "it's", "Über", "\x00"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(20)]
    fixed = ["new york city hall", "as well as", "The of the of the", "a b a b a"]
    rows = []
    for i in range(texts):
        words = []
        for _ in range(rng.randint(0, 40)):
            words.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocab))
            if rng.random() < 0.2:
                words[-1] += rng.choice([".", ",", " ;", "!\n", "\x0b", "?\r\n", "\t"])
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), "  ".join(words) if i % 2 else " ".join(words)))
    return [*rows, ("en", None), ("fr", ""), (None, " . "), ("es", "once")]


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, rank int, phrase string, n int")
    got = c.collocations(docs, **kw).drop("cut")
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("shard,size", [(2_000_000, 8 << 20), (200, 3000), (50, 700)])
def test_collocations_are_those_of_counting_by_hand(spark, monkeypatch, shard, size):
    """Whatever the shards, and however many prefix ranges phrases are spread over."""
    monkeypatch.setattr(c, "SHARD_WORDS", shard)
    monkeypatch.setattr(c, "RANGE_BYTES", size)
    monkeypatch.setattr(c, "SAMPLE_TEXTS", 2)
    monkeypatch.setattr(c, "SAMPLE_WINDOWS", 5)
    rows = corpus(shard, 200)
    want = by_hand(rows, least=6)
    assert len(want) > 60 and any(len(r[2].split(" ")) == 4 for r in want)
    assert found(spark, rows, least=6) == want


def test_top_and_ties(spark):
    rows = [("en", "b c. a b. c d. e f g. e f g")] * 30 + [("de", "a b")] * 29
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, rows, top=2) == by_hand(rows, top=2)


def test_one_phrase_makes_most_of_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(c, "SHARD_WORDS", 300)
    monkeypatch.setattr(c, "RANGE_BYTES", 2000)
    monkeypatch.setattr(c, "SAMPLE_TEXTS", 1)
    rows = [("en", "click here to read more click here to read more")] * 400 + corpus(3, 60)
    assert found(spark, rows, least=10) == by_hand(rows, least=10)


def test_long_texts_and_words(spark):
    rows = [("en", "the long text. " * 200_000 + "w" * 3_000_000), ("en", "the long text"), ("en", "no delimiter " * 100_000)]
    assert found(spark, rows) == by_hand(rows)


def test_empty_table_and_texts_without_phrases(spark):
    assert found(spark, []) == [] and found(spark, [(None, None), ("en", "")]) == []


def test_tries_survive_serialisation():
    rng = np.random.Generator(np.random.PCG64(4))
    ids = rng.integers(0, 9, size=3000).astype(np.uint32)
    rows, counts = c.merged(c.windows(ids), np.ones(int((ids > 0).sum()), dtype=np.int64))
    words = [b"", *[bytes([97 + i]) * i for i in range(1, 9)]]
    for a, b in ((0, len(rows)), (5, 6), (100, 900)):
        blob = c.encode(rows[a:b], counts[a:b], words)
        got, n, own = c.decode(blob)
        assert n.tolist() == counts[a:b].tolist()
        assert [[own[i] for i in r] for r in got.tolist()] == [[words[i] for i in r] for r in rows[a:b].tolist()]
        assert len(blob) < (b - a) * 40 + 200


def test_a_bound_falls_between_the_windows_below_and_above_it():
    words = [b"", b"b", b"d", b"f"]
    rows = np.array([[1, 0, 0, 0], [1, 2, 0, 0], [1, 2, 3, 3], [3, 1, 0, 0]], dtype=np.uint32)
    as_words = [tuple(words[i] for i in r) for r in rows.tolist()]
    for first in (b"a", b"b", b"c", b"f", b"g"):
        for rest in ((b"", b"", b""), (b"d", b"", b""), (b"d", b"e", b""), (b"d", b"f", b"g"), (b"z", b"", b"")):
            bound = (first, *rest)
            assert c.place(bound, rows, words) == sum(w < bound for w in as_words)


def test_parts_of_phrases_are_their_ancestors_whatever_the_partitions(spark):
    rng = random.Random(2)
    f, _ = phrases_of([("en", " ".join(rng.choice("abc") for _ in range(300)))])
    rows = spark.createDataFrame([("en", " ".join(w), len(w), a) for (_, w), a in f.items()], "lang string, phrase string, m int, a long")
    for back in (False, True):
        for r in c.with_parts(rows, "p", back).collect():
            w = tuple(r.phrase.split(" "))
            for d in (1, 2, 3):
                part = w[len(w) - d :] if back else w[:d]
                assert r[f"p{d}"] == (f["en", part] if d < len(w) else None)
