"""Fingerprints and groups against plain loops."""

import random

import xxhash

from treeline.llm import simhash
from treeline.llm.components import components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, prints):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {g: min((ids[i] for i in range(len(ids)) if group[i] == g and ids[i] is not None), default=None) for g in group}
    return [low[g] for g in group]


def brute_word_prints(text):
    words = set("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split())
    out = []
    for seed in (42, 43):
        hashes = [xxhash.xxh64_intdigest(w, seed) for w in words]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def brute_copies(texts):
    """A group number for each text: copies by shingles, or by words and, less strictly, shingles."""
    prints, words = [brute_print(t) for t in texts], [brute_word_prints(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            far = (prints[i] ^ prints[j]).bit_count()
            near = any((a ^ b).bit_count() <= 4 for a, b in zip(words[i], words[j]))
            if (far <= 4 or far <= 16 and near) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def changed(rng, text, share, pool):
    words = text.split()
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = rng.choice(pool)
    return " ".join(words)


def jaccard(a, b):
    one, two = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(one & two) / len(one | two)


def test_copies_against_plain_loops_and_their_recall(spark):
    rng = random.Random(11)
    pool = [f"word{i}" for i in range(3000)]
    originals = [" ".join(rng.choices(pool, k=rng.choice([60, 150, 400]))) for _ in range(70)]
    copies = [(i, changed(rng, t, share, pool)) for i, t in enumerate(originals) for share in (0.003, 0.01, 0.02)]
    texts = originals + [t for _, t in copies] + [None, "", "one", "one one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.doc_id: r.root for r in simhash.copy_groups(docs).collect()}
    groups = brute_copies(texts)
    found = {}
    for i, g in enumerate(groups):
        found.setdefault(g, set()).add(roots[i])
    assert all(len(r) == 1 for r in found.values()) and len(found) == len(set(roots.values()))
    near = [(i, len(originals) + k) for k, (i, t) in enumerate(copies) if jaccard(originals[i], t) >= 0.8]
    assert sum(roots[i] == roots[j] for i, j in near) >= 0.9 * len(near) > 100
    assert len({roots[i] for i in range(len(originals))}) == len(originals)


def test_groups(spark):
    rng = random.Random(6)
    pool = [f"Word{i}" for i in range(400)] + ["É", "x y"]
    texts = [" ".join(rng.choices(pool, k=rng.choice([0, 1, 3, 4, 5, 80, 300]))) for _ in range(60)]
    for base in texts[:20]:
        words = base.split()
        for _ in range(6):
            if words:
                copy = list(words)
                copy[rng.randrange(len(copy))] = rng.choice(pool)
                texts.append("  \n".join(copy))
    texts += [None, "", " \x0b\x0c", texts[5], texts[5]]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, texts[8], 0), (None, "lonely text of a null id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print int")
    got = simhash.near_groups(docs).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    want = zip([r[0] for r in rows], prints, brute_groups([r[0] for r in rows], prints))
    key = lambda r: repr(tuple(r))
    assert sorted(((r.doc_id, r.print & (1 << 64) - 1, r.component_id) for r in got), key=key) == sorted(want, key=key)
    kept = simhash.one_of_each(docs).collect()
    lowest = {}
    for (i, _, _), g in zip(rows, brute_copies([t for _, t, _ in rows])):
        lowest[g] = min((x for x in (lowest.get(g), i) if x is not None), default=None)
    assert sorted(map(repr, (r.doc_id for r in kept))) == sorted(map(repr, lowest.values()))
    assert kept[0].__fields__ == ["doc_id", "text", "print"]


def test_groups_without_ids_and_shared_ids_lose_no_text(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(50)) for w in ("red", "green", "blue"))
    rows = [(None, one), (None, one), (None, two), (7, three), (7, three), (7, two + " x"), (9, one + " y")]
    docs = spark.createDataFrame(rows + [(3, "far away text of a few words"), (3, None)], "doc_id long, text string")
    roots = {(r.doc_id, r.text_hash): r.root for r in simhash.copy_groups(docs).collect()}
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len(set(roots.values()))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept if r.text in (three, None)) == [(3, ""), (7, three)]
    only_null = spark.createDataFrame([(None, one), (None, two), (None, three)], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(only_null).collect()) == sorted([one, two, three])


def test_small_trees_find_every_link_of_a_dense_shard(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 500:
        value = rng.choice(list(values)) if rng.random() < 0.5 else base
        for _ in range(rng.randint(1, 4)):
            value ^= 1 << rng.randrange(64)
        values.add(value)
    values |= {rng.getrandbits(64) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "print long")
    found = {r.id: r.root for r in components(simhash.links(prints, 4, tree_nodes=50)).collect()}
    groups = brute_groups(signed, [v & (1 << 64) - 1 for v in signed])
    assert [found.get(v, v) for v in signed] == groups


def test_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (1399, 2000)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}, 2000: 1000}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(docs).count() == simhash.copy_groups(docs).count() == simhash.one_of_each(docs).count() == 0
