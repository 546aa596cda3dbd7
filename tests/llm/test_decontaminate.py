"""Hits against a plain search of every window."""

import hashlib
import random
import re

import pytest

from treeline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = "doc_id long, text string, items_sha256 string"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, content in items:
        own = words_of(content)
        size = min(10, len(own))
        for i in range(len(own) - size + 1) if own else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    found |= {str(item)} if item is not None else set()
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def fixture():
    rng = random.Random(8)
    pool = ["Alpha", "beta", "Ünï", "7", "x-y", "gamma.", "DELTA", "漢字"]
    passage = lambda n: " ".join(rng.choices(pool, k=n))
    items = [(i, passage(n)) for i, n in enumerate([40, 12, 10, 9, 3, 25, 14])]
    items += [(10, ""), (11, None), (12, items[1][1]), (None, passage(15)), (13, "--")]
    docs = []
    for i in range(60):
        parts = [passage(rng.randint(0, 30))]
        if i % 2:
            text = rng.choice(items)[1] or ""
            cut = text.split(" ")
            parts.append(" ".join(cut[rng.randint(0, 3) :]).replace(" ", rng.choice([" ", "\n", ", "])))
        docs.append((i, " ".join(parts + [passage(5)]), "own"))
    return docs + [(60, None, "own"), (61, "", "own"), (0, docs[0][1], "own"), (1, docs[1][1], "own"), (None, items[0][1], "own")], items


@pytest.mark.parametrize("bound", [decontaminate.BOUND, 3000])
def test_scan(spark, bound):
    docs, items = fixture()
    table = spark.createDataFrame(docs, KINDS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(table, benchmark, bound=bound).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(r.text, items)
    kept = decontaminate.without_documents(table, benchmark, bound=bound).collect()
    assert sorted(repr(tuple(r)) for r in kept) == sorted(repr(d) for d in docs if not brute(d[1], items)[1])
    cleaned = {r.doc_id: r.text for r in decontaminate.without_spans(table, benchmark, bound=bound).collect()}
    for doc_id, text, _ in docs:
        n, hit, *_ = brute(text, items)
        assert len(words_of(cleaned[doc_id])) == n - hit
        assert hit or cleaned[doc_id] == text


def test_empty_tables(spark):
    docs, items = fixture()
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.scan(spark.createDataFrame(docs, KINDS), none).filter("contaminated").count()
    empty = spark.createDataFrame([], KINDS)
    assert decontaminate.scan(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_letters_whose_lower_case_depends_on_their_neighbours(spark):
    tail = " b c d e f g h i j k l"
    texts = ["ΟΔΟΣ.ΑΒΓ" + tail, "οδος ΑΣ ασ Σ σΣς" + tail, "İSTANBUL ǅ ẞ Kelvin" + tail, "ΑΣ ΒΣ. ΓΣ,ΔΣ ΕΣ ΖΣ ΗΣ ΘΣ ΙΣ ΚΣ"]
    items = list(enumerate(texts)) + [(9, "ΟΔΟς.ΑΒΓ" + tail)]
    docs = [(i, t, "") for i, t in enumerate(texts + [t + " und mehr" for t in texts])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.scan(spark.createDataFrame(docs, KINDS), benchmark).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(r.text, items)


def test_columns_with_clashing_names(spark):
    kinds = "doc_id long, text string, `key` string, items int, row string, row_key int, n_hit string, low string"
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "k", 2, "r", 3, "old", "l"), (2, "else", "k", 2, "r", 3, "old", "l")], kinds)
    benchmark = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(docs, benchmark).collect()}
    assert (got[1].n_hit, got[2].n_hit) == (10, 0) and got[1]["items"] == 2 and got[1].key == "k" and got[1].row_key == 3
    kept = decontaminate.without_documents(docs, benchmark).collect()
    assert [tuple(r) for r in kept] == [(2, "else", "k", 2, "r", 3, "old", "l")]
    cleaned = {r.doc_id: r for r in decontaminate.without_spans(docs, benchmark).collect()}
    assert cleaned[1].text.split() == [] and cleaned[2].text == "else" and cleaned[1]["items"] == 2


def test_keys_of_the_contaminated_are_broadcast_only_within_the_bound(spark, monkeypatch):
    docs, items = fixture()
    table, benchmark = spark.createDataFrame(docs, KINDS), spark.createDataFrame(items, "item_id long, text string")
    for size, wanted in ((128, True), (decontaminate.BOUND, False)):
        monkeypatch.setattr(decontaminate, "KEY_BYTES", size)
        plan = decontaminate.without_documents(table, benchmark)._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == wanted


def test_windows_are_hashed_from_codes_of_words(spark):
    from pyspark.sql import functions as F

    words = ["one", "two", "one", "two", "ö", "one", "two"]
    df = spark.createDataFrame([(words,), ([],)], "words array<string>")
    codes = decontaminate.word_codes(F.col("words"))
    rows = df.select(codes.alias("c"), decontaminate.window_hashes(codes, 2).alias("two"), decontaminate.window_hashes(codes, 9).alias("nine"))
    assert dict(rows.dtypes)["c"] == "array<bigint>"
    got, empty = rows.orderBy(F.size("c").desc()).collect()
    assert len(got.two) == 6 and len(set(got.two)) == 4 and got.two[0] == got.two[2] == got.two[5] and got.nine == [] == empty.two
