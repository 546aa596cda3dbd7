"""Stored search: posting blocks, vectors by pivots, and their upkeep, against full scans."""

import random

import pytest
from pyspark.sql import functions as F

from treeline.operators import rankedindex, retrieval, vectorstore
from treeline.sources.segments import Conflict, Segments

DOCS = "kind string, doc_id string, module_path string, part string, text string"
WORDS = [f"word{i}".replace("1", "a").replace("2", "b") for i in range(40)] + ["alpha", "beta", "gamma", "delta"]


def texts(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = "module" if i % 3 else "symbol"
        words = [rng.choice(WORDS[-4:]) if rng.random() < 0.1 + (i % 50 == 0) * 0.6 else f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(0, 60))]
        rows.append((kind, f"d{i:04d}", "m", "", " ".join(words)))
    rows.append(("module", "d0001", "m", "b", "alpha alpha part two"))
    rows.append(("other", "x", "m", "", "alpha"))
    return rows


def corpus_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def ranking(df):
    return sorted((r.kind, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


def everything(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = texts(1500)
    folder = str(tmp_path_factory.mktemp("index"))
    return rows, folder, rankedindex.refreshed_index(corpus_of(spark, rows), folder)


@pytest.mark.parametrize("query", [["alpha"], ["alpha", "beta", "alpha"], ["gamma", "delta", "nowhere"], ["part", "alpha"], ["nowhere"], []])
def test_blocks_give_the_ranking_of_a_full_scan(spark, built, query):
    rows, _, index = built
    assert ranking(index.bm25(query, 5)) == ranking(retrieval.bm25_topk(corpus_of(spark, rows), query, 5))


def test_blocks_are_skipped_and_texts_not_read(built):
    _, _, index = built
    report = index.block_report(["alpha", "beta"], 3).collect()
    assert sum(r.skipped for r in report) > 0 and all(r.blocks == r.opened + r.skipped for r in report)
    plan = index.bm25(["alpha"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan


def test_update_equals_a_rebuild_and_tokenizes_changes_only(spark, built, tmp_path, monkeypatch):
    rows, _, _ = built
    index = rankedindex.refreshed_index(corpus_of(spark, rows), str(tmp_path / "a"))
    assert index.update(corpus_of(spark, rows)).store.version == 1
    changed = [r for i, r in enumerate(rows) if i % 100 != 7]
    changed = [(*r[:4], r[4] + " alpha omega") if i % 100 == 3 else r for i, r in enumerate(changed)]
    changed += [("symbol", "new", "m", "", "beta beta"), ("symbol", "blank", "m", "", "")]
    seen = []
    real = rankedindex.term_rows
    monkeypatch.setattr(rankedindex, "term_rows", lambda df: seen.append(df.select("kind", "doc_id").distinct().count()) or real(df))
    updated = index.update(corpus_of(spark, changed))
    assert updated.store.version == 2 and seen == [len({r[1] for r in set(changed) - set(rows)})]
    fresh = rankedindex.refreshed_index(corpus_of(spark, changed), str(tmp_path / "b"))
    for one in (updated, updated.compacted()):
        assert everything(one.postings()) == everything(fresh.postings())
        assert everything(one.vocabulary()) == everything(fresh.vocabulary())
        assert everything(one.documents().drop("range", "print")) == everything(fresh.documents().drop("range", "print"))
        assert ranking(one.bm25(["alpha", "omega", "beta"], 4)) == ranking(fresh.bm25(["alpha", "omega", "beta"], 4))
    assert len(updated.store.segments) == 2
    assert index.documents().count() == fresh.documents().count() - 2 + len({r[1] for r in rows} - {r[1] for r in changed})


def test_frequent_words_with_negative_weights_open_everything(spark, tmp_path):
    rows = [("module", f"d{i}", "m", "", "same same other" if i % 2 else "same") for i in range(6)]
    index = rankedindex.refreshed_index(corpus_of(spark, rows), str(tmp_path))
    assert ranking(index.bm25(["same", "other"], 3)) == ranking(retrieval.bm25_topk(corpus_of(spark, rows), ["same", "other"], 3))


def vectors_of(spark, n, size, seed, start=0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    rows = []
    for i in range(n):
        center = rng.choice(centers)
        rows.append(("module" if i % 4 else "symbol", start + i, [c + rng.gauss(0, 0.05) for c in center]))
    rows += [("module", start + n + i, rows[0][2]) for i in range(3)]
    return spark.createDataFrame(rows, "kind string, doc_id long, embedding array<float>"), rows[1][2]


def distances(df):
    return sorted((r.kind, r["rank"], r.doc_id, r.distance) for r in df.collect())


@pytest.mark.parametrize("size", [3, 1024])
def test_pivots_give_the_nearest_of_a_full_scan(spark, tmp_path, size):
    vectors, query = vectors_of(spark, 400, size, size)
    index = vectorstore.build_vectors(vectors, str(tmp_path))
    for k in (1, 7, 300):
        assert distances(index.nearest(query, k)) == distances(retrieval.nearest(vectors, query, k))
    report = index.read_report(query, 5).collect()
    assert sum(r.computed for r in report) < sum(r.stored for r in report) == 403


def test_upserted_vectors_replace_those_of_their_key(spark, tmp_path):
    vectors, query = vectors_of(spark, 200, 4, 9)
    index = vectorstore.build_vectors(vectors, str(tmp_path))
    more, _ = vectors_of(spark, 60, 4, 10, start=150)
    merged = vectors.join(more, ["kind", "doc_id"], "left_anti").unionByName(more)
    updated = index.upsert(more)
    assert distances(updated.nearest(query, 9)) == distances(retrieval.nearest(merged, query, 9))
    assert distances(index.nearest(query, 9)) == distances(retrieval.nearest(vectors, query, 9))


def test_of_two_commits_from_one_version_one_is_refused(spark, tmp_path):
    store = Segments(spark, str(tmp_path / "s"), ["k"])
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    first = store.draft()
    first.put("t", rows)
    first = first.commit()
    one, two = first.draft(), first.draft()
    for draft, value in ((one, "x"), (two, "y")):
        draft.put("t", spark.createDataFrame([(1, value)], "k int, v string"))
        draft.put("gone", spark.createDataFrame([(1,)], "k int"))
    after = one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert everything(after.read("t")) == [(1, "x"), (2, "b")] == everything(first.refreshed().read("t"))
    assert everything(first.read("t")) == [(1, "a"), (2, "b")]
    assert everything(store.refreshed().read("t", merged=False).select("k", "v", "segment")) == [(1, "a", 0), (1, "x", 1), (2, "b", 0)]
    with pytest.raises(KeyError):
        after.read("nothing")


def test_empty_corpus(spark, tmp_path):
    index = rankedindex.refreshed_index(corpus_of(spark, []), str(tmp_path / "a"))
    assert index.bm25(["alpha"]).collect() == [] and index.block_report(["alpha"]).collect() == []
    later = index.update(corpus_of(spark, texts(20)))
    assert ranking(later.bm25(["alpha"])) == ranking(retrieval.bm25_topk(corpus_of(spark, texts(20)), ["alpha"]))
    nothing = spark.createDataFrame([], "kind string, doc_id long, embedding array<float>")
    assert vectorstore.build_vectors(nothing, str(tmp_path / "b")).nearest([0.0], 3).collect() == []


def test_terms_are_shuffled_for_their_blocks_only(spark, tmp_path):
    index = rankedindex.refreshed_index(corpus_of(spark, texts(200)), str(tmp_path))
    docs = spark.createDataFrame([("module", "d0001", 0)], "kind string, doc_id string, range long")

    def exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Exchange" in line]

    counted = exchanges(rankedindex.term_rows(rankedindex.placed_rows(corpus_of(spark, texts(200)), docs)))
    assert len(counted) == 2 and not any("token" in line for line in counted)
    terms = index.store.read("terms")
    dealt = exchanges(rankedindex.block_rows(terms))
    assert len(dealt) == 1 and "rangepartitioning(token" in dealt[0]
    # Documents without an id are counted but are in no block, as before.
    rows = [("module", None, "m", "", "alpha beta"), ("module", "a", "m", "", "alpha"), ("module", None, "m", "b", "alpha")]
    odd = rankedindex.refreshed_index(corpus_of(spark, rows), str(tmp_path / "odd"))
    assert everything(odd.vocabulary()) == [("module", "alpha", 2), ("module", "beta", 1)]
    assert [(r.doc_id, r.tf, r.dl) for r in odd.postings().collect()] == [("a", 1, 1)]
    assert sorted((r.doc_id or "", r.dl) for r in odd.documents().collect()) == [("", 0), ("a", 1)]
