"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from treeline.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, w1 string, level int"


def plain(rows, least, wanted):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:wanted], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(spark, rows, **bounds):
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in collocations.phrases(docs, **bounds).collect())


def texts(seed, n, size):
    """Texts with set phrases, so that counts and scores repeat and longer phrases absorb shorter ones."""
    rng = random.Random(seed)
    phrases = ["red green blue dark", "Red green", "one two three", "two three", "a a a a", "ß É é"]
    plain_words = "red green blue dark one two three a b c é É ß   \x1c".split(" ")
    for _ in range(n):
        words = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(plain_words) for _ in range(size)]
        yield "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for w in words)


@pytest.mark.parametrize("wanted, first_goal", [(12, 1), (1000, 3)])
def test_same_as_plain_counts(spark, wanted, first_goal):
    rng = random.Random(wanted)
    rows = [(t, rng.choice(["en", "de", None, "und"])) for t in texts(wanted, 60, 25)]
    rows += [(None, "en"), ("", "fr"), (" \t ", "es"), ("..!", None), rows[0], rows[0]]
    bounds = {"least": 4, "wanted": wanted}
    assert mined(spark, rows, **bounds, first_goal=first_goal, batch=7) == plain(rows, **bounds)


def test_chunks_share_phrases_across_their_borders(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 5)
    rows = [(t, "en") for t in texts(3, 10, 30)]
    assert mined(spark, rows, least=3, wanted=50) == plain(rows, 3, 50)


def test_a_hash_that_two_words_share_is_replaced(spark, monkeypatch):
    real = collocations.word_parts

    def clashing(docs, seed):
        parts = real(docs, seed)
        return parts.withColumn("hash", parts["hash"] * 0) if seed == 0 else parts

    monkeypatch.setattr(collocations, "word_parts", clashing)
    rows = [(t, "en") for t in texts(4, 5, 20)]
    assert mined(spark, rows, least=3, wanted=10) == plain(rows, 3, 10)


def test_counts_beyond_64_bits(spark):
    row = spark.sql("select 9000000000000000000 a, 9000000000000000001 l, 9000000000000000003 r")
    expected = 2_000_000 * 9 * 10**18 // (18 * 10**18 + 4)
    assert row.select(collocations.score_of("a", "l", "r")).first()[0] == expected


def test_empty_table(spark):
    assert mined(spark, []) == []
