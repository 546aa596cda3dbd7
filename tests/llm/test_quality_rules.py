"""Measures and verdicts against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from treeline.llm import quality_rules as rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def texts():
    rng = random.Random(4)
    words = ["a", "bb", "Éç", "x|y", "#", "LOUD", "wow!!", " ", "🙂"]
    made = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(200)]
    made += ["\n".join(rng.choices(["same line here", "other", " ", ""], k=rng.randint(1, 9))) for _ in range(50)]
    block = " ".join(f"w{i}" for i in range(30))
    return made + [None, "", " \n\t", block, block + " " + block, (block + " ") * 300, "one " * 8, "one " * 9, "\x0b\x0cx\r\ny"]


def test_measures(spark):
    rows = [(i, t, -1) for i, t in enumerate(texts())] + [(0, texts()[0], -1), (None, "null id", -1)]
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert len(got) == len(rows)
    for r in got:
        measures = brute(r.text)
        assert tuple(r[c] for c in rules.MEASURES) == measures, r.text
        assert r.base_failed == (measures[0] < 20 or 100 * measures[4] > 30 * measures[0])
        assert not (r.base_failed and r.kept)


def test_cascade_keeps_what_every_rule_accepts_in_any_order(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    text = F.col("text")
    own = rules.base_rules(text) + rules.style_rules(text)
    order = rules.cascade_order(docs, own)
    assert sorted(r.name for r in order) == sorted(r.name for r in own)
    kept = {r.doc_id for r in rules.keep_good(docs).collect()}
    assert kept == {r.doc_id for r in docs.filter(rules.first_rejection(own).isNull()).collect()}
    assert kept == {r.doc_id for r in rules.judge(docs).filter("kept").collect()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rules.judge(docs).count() == rules.keep_good(docs).count() == 0
