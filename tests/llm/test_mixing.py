"""The mix against its contract, and its parts against plain loops."""

import random

import numpy as np
import pytest

from treeline.llm import mixing


def test_targets_reshare_what_is_above_the_limit():
    assert mixing.targets([]) == []
    assert mixing.targets([0, 0]) == [0.0, 0.0]
    assert mixing.targets([10, 1000, 1000]) == pytest.approx([20.0, 1996.6666667, 998.3333333])
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 100, 10_000]) for _ in range(rng.randint(1, 9))]
        got = mixing.targets(sizes)
        assert sum(got) == pytest.approx(1.5 * sum(sizes))
        assert all(t <= 2 * n + 1e-9 for t, n in zip(got, sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    order = mixing.Permutation(n, 3, 1)
    values = order(np.arange(n))
    assert sorted(values.tolist()) == list(range(n))
    assert all(order.place_of(int(v)) == i for i, v in enumerate(values[:200]))


def test_slots_hold_exactly_the_words():
    rng = random.Random(2)
    for trial in range(400):
        size = rng.randint(1, 2000)
        words = rng.randint(0, 2 * size)
        slots, last = mixing.slots_of(size, words, trial)
        blocks, total = -(-size // mixing.BLOCK), 0
        for j in range(slots):
            block = int(mixing.Permutation(blocks, trial, j // blocks)(np.array([j % blocks]))[0])
            whole = min(mixing.BLOCK, size - block * mixing.BLOCK)
            total += min(whole, last) if last and j == slots - 1 else whole
        assert total == words


def test_shards_share_out_the_totals():
    totals = np.array([5000, 0, 3, 1200])
    shards = -(-int(totals.sum()) // mixing.SHARD)
    seen = np.zeros_like(totals)
    for shard in range(shards):
        counts, before = mixing.shard_counts(totals, shards, shard)
        assert (before == seen).all()
        assert counts.sum() == min(mixing.SHARD, totals.sum() - shard * mixing.SHARD)
        seen += counts
    assert (seen == totals).all()


def test_halves_are_drawn_alike_at_every_size():
    rng = np.random.default_rng(8)
    for scale in (1, 1000, 10**9, 10**11, 10**15):
        counts = np.array([5, 0, 3, 90, 1]) * scale
        size = int(counts.sum())
        for n in (0, 1, size // 3, size - 1, size):
            left = mixing.halved(counts, n, rng)
            assert int(left.sum()) == n and (left >= 0).all() and (left <= counts).all()
            if scale >= 1000 and n == size // 3:
                assert np.allclose(left, counts / 3, atol=8 * np.sqrt(size))
    left = [int(mixing.halved(np.array([10**6, 10**6]), 10**6, rng)[0]) for _ in range(300)]
    assert 150 < np.std(left) < 600 and abs(np.mean(left) - 500_000) < 150


def test_shards_of_a_hundred_billion_slots():
    totals = np.array([6 * 10**10, 5 * 10**9, 35 * 10**9])
    shards = -(-int(totals.sum()) // mixing.SHARD)
    for shard in (0, shards // 2, shards - 1):
        counts, before = mixing.shard_counts(totals, shards, shard)
        assert counts.sum() == min(mixing.SHARD, int(totals.sum()) - shard * mixing.SHARD)
        assert before.sum() == shard * mixing.SHARD and (before + counts <= totals).all()


def plain_taken(spark, docs):
    """Words taken of every document by a plain run of all draws over the ledger."""
    placed, _ = mixing.mix(docs)
    rows = sorted(placed.collect(), key=lambda r: (r.source_no, r.first, r["size"]))
    sources = {r.source_no: (r.source_size, r.target) for r in rows}
    taken = dict.fromkeys(((r.source_no, r.bucket, r["rank"]) for r in rows), 0)
    for number, (size, target) in sources.items():
        words = min(round(target), 2 * size)
        slots, last = mixing.slots_of(size, words, number)
        blocks = -(-size // mixing.BLOCK)
        for nth in range(slots):
            block = int(mixing.Permutation(blocks, number, nth // blocks)(np.array([nth % blocks]))[0])
            start, end = block * mixing.BLOCK, block * mixing.BLOCK + (last if last and nth == slots - 1 else mixing.BLOCK)
            for r in rows:
                if r.source_no == number:
                    taken[number, r.bucket, r["rank"]] += max(0, min(end, r.first + r["size"]) - max(start, r.first))
    return sorted((r.doc_id is None, r.doc_id or 0, taken[r.source_no, r.bucket, r["rank"]]) for r in rows)


def test_taken_words_against_a_plain_run_of_the_draws(spark):
    docs = spark.createDataFrame(rows_of(random.Random(5))[300:], "doc_id long, text string, source string, size string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.taken) for r in mixing.taken_words(docs).collect())
    assert got == plain_taken(spark, docs)


def test_packed_blocks_hold_the_mix_in_its_order(spark):
    rows = rows_of(random.Random(6))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    blocks = mixing.packed_blocks(docs).collect()
    assert len({(b.shard, b.place) for b in blocks}) == len(blocks)
    assert all(b.n_words == len(b.text.split()) <= mixing.BLOCK for b in blocks)
    counts, taken = {}, {}
    for b in blocks:
        for word in b.text.split():
            counts[word] = counts.get(word, 0) + 1
    for r in mixing.mixed_documents(docs).collect():
        for word in r.text.split():
            taken[word] = taken.get(word, 0) + 1
    assert counts == taken
    for shard in {b.shard for b in blocks}:
        assert sorted(b.place for b in blocks if b.shard == shard) == list(range(sum(b.shard == shard for b in blocks)))


def test_columns_with_clashing_names(spark):
    rows = [(i, f"a b c d{i}", "s", "own", i, "x") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, spans int, `row` string")
    mixed = mixing.mixed_documents(docs).collect()
    assert mixed and mixed[0].__fields__ == docs.columns and all(r["_id"] == "own" and r.spans == r.doc_id for r in mixed)


def rows_of(rng):
    sources = ["b", "a", None, "é", "Z", "tiny"]
    rows = []
    for i in range(400):
        source = rng.choice(sources[:5])
        rows.append((i, " ".join(f"w{i}_{j}" for j in range(rng.choice([0, 1, 30, 300]))), source, "own"))
    return rows + [(900, "only five words are here", "tiny", "own"), (901, None, "a", "own"), (None, "no id", "b", "own"), rows[3], rows[3]]


def test_mix(spark):
    rows = rows_of(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.taken_words(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.taken_words(docs.repartition(7)).collect()))
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(t) for _, t, x, _ in rows if x == s) for s in names}
    wanted = dict(zip(names, mixing.targets([sizes[s] for s in names])))
    source = {r[0]: r[2] for r in rows}
    totals = dict.fromkeys(names, 0)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(wanted[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r["size"]
        totals[source[r.doc_id]] += r.taken
    assert all(abs(totals[s] - wanted[s]) <= 1 for s in names)
    mixed = mixing.mixed_documents(docs).collect()
    assert sum(size(r.text) for r in mixed) == sum(totals.values())
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).update((r[1] or "").split())
    assert all(set(r.text.split()) <= texts[r.doc_id] and r.source == source[r.doc_id] for r in mixed)
    assert mixed[0].__fields__ == ["doc_id", "text", "source", "size"]


def test_empty_tables(spark):
    kinds = "doc_id long, text string, source string"
    assert mixing.taken_words(spark.createDataFrame([], kinds)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], kinds)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], kinds)
    assert [(r.target, r.taken) for r in mixing.taken_words(blank).collect()] == [(0.0, 0)] * 2
