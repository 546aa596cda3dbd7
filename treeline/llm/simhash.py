"""SimHash fingerprints, and BK-trees that link those within a few differing bits.

Distinct fingerprints are cut into six pieces of their bits. Two that differ in at most four
bits agree in at least two pieces, so every pair of pieces with its bits names a shard in
which each linked pair meets. A shard's fingerprints form BK-trees of at most `TREE_NODES`
nodes: children are keyed by their integer distance to the parent, and a query follows only
the edges whose key lies within the radius of its own distance to the node. A shard of more
nodes becomes several trees, and each tree is sent to all parts of its own shard only, never
to all tasks, since all trees together grow with the data. A task returns a spanning forest of
the links it finds, so that no group yields all its pairs.

`near_groups` links fingerprints of shingles. `copy_groups` also finds copies with more changes:
a changed word moves four shingles but one word, so its trees hold fingerprints of the distinct
words (one for each seed of WORD_SEEDS, as each misses some pairs by chance), and a candidate is a
link only if the fingerprints of its shingles differ in at most CONFIRM bits, which texts that
merely share a vocabulary do not pass. `one_of_each` keeps one document of each such group.

Defined results
* A-Z lower-cased; words are runs of anything but ASCII blanks. Fewer words than a shingle:
  the whole sequence is the one shingle. No word or null text: fingerprint zero, linked like any.
* Null doc_ids have fingerprints and link others; a component of null ids only has a null id.
* Repeated rows each stay a row. Empty table: no row. Extra columns are ignored by
  `fingerprints`; `one_of_each` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import LOWER, UPPER, attach, written
from treeline.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
PIECES = 6
TREE_NODES = 4096
WORD_SEEDS = (42, 43)
CONFIRM = 16
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
SHARD = "piece_pair int, piece_bits long, tree int, part int"


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "replace").translate(LOWERED).split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    return majority(hashes)


def majority(hashes: list[int]) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def word_fingerprints(text: str | None, seeds: tuple[int, ...] = WORD_SEEDS) -> list[int]:
    """A fingerprint of the distinct words for each seed."""
    words = set((text or "").encode("utf-8", "replace").translate(LOWERED).split())
    return [majority([xxhash.xxh64_intdigest(w, seed) for w in words]) if words else 0 for seed in seeds]


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash and print (the 64 bits as a signed long) of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, width, seed) for t in batch.column(2).to_pylist()]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], signed], ["doc_id", "text_hash", "print"])

    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(sketch, "doc_id long, text_hash long, print long")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, print and words (fingerprints of the distinct words) of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            signed = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            words = np.array([word_fingerprints(t) for t in texts], np.uint64).reshape(len(texts), -1).view(np.int64)
            columns = [*batch.columns[:2], signed, pa.array(words.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "print", "words"])

    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(sketch, "doc_id long, text_hash long, print long, words array<long>")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


class Tree:
    """A BK-tree over integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = value
        at = self.root
        while at != value:
            edges = self.children.setdefault(at, {})
            at = edges.setdefault((at ^ value).bit_count(), value)

    def within(self, value: int, radius: int) -> Iterator[int]:
        ahead = [] if self.root is None else [self.root]
        while ahead:
            at = ahead.pop()
            distance = (at ^ value).bit_count()
            if distance <= radius:
                yield at
            for key, child in self.children.get(at, {}).items():
                if distance - radius <= key <= distance + radius:
                    ahead.append(child)


class Forest:
    """Union-find that tells which links join two groups."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while (up := self.parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            self.parent[y] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def tree_links(
    tree_values: list[tuple[int, int]], queries: list[tuple[int, int]] | None, radius: int, confirm: int
) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """A spanning forest of the links inside the tree, or between it and the queries.

    Values are pairs: the first entries stand in the tree, the second ones confirm what it finds.
    """
    tree, forest, links = Tree(), Forest(), []
    held: dict[int, list[tuple[int, int]]] = {}

    def meet(value: tuple[int, int]) -> None:
        for near in tree.within(value[0], radius):
            for other in held[near]:
                if (other[1] ^ value[1]).bit_count() <= confirm and forest.join(value, other):
                    links.append((value, other))

    for value in tree_values:
        if queries is None:
            meet(value)
        tree.add(value[0])
        held.setdefault(value[0], []).append(value)
    for value in queries or ():
        meet(value)
    return links


def shard_keys(print_: str, pieces: int) -> F.Column:
    """An array of (piece_pair, piece_bits), one for every two pieces."""
    edges = [round(64 * i / pieces) for i in range(pieces + 1)]
    piece = [
        F.shiftrightunsigned(F.col(print_), a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])
    ]
    keys = []
    for number, (i, j) in enumerate(combinations(range(pieces), 2)):
        bits = F.shiftleft(piece[i], edges[j + 1] - edges[j]).bitwiseOR(piece[j])
        keys.append(F.struct(F.lit(number).alias("piece_pair"), bits.alias("piece_bits")))
    return F.array(*keys)


def links(prints: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all within the radius.

    `prints` has one column, print, without repeats. Any radius up to 62 works: the number
    of pieces is the radius plus two.
    """
    pairs = confirmed_links(prints.select("print", F.lit(0).cast("long").alias("other")), radius, 0, tree_nodes)
    return pairs.select("u", "v")


def confirmed_links(prints: DataFrame, radius: int, confirm: int, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links (u, u_other, v, v_other) that connect all pairs within the radius by `print` and within
    `confirm` by `other`; `prints` has these two columns and no repeats."""
    pieces = radius + 2
    shards = prints.select("print", "other", F.explode(shard_keys("print", pieces)).alias("s")).select("print", "other", "s.*")
    shards = shards.withColumn("shard", F.xxhash64("piece_pair", "piece_bits"))
    sizes = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1")
    sizes = sizes.withColumn("trees", F.ceil(F.col("nodes") / tree_nodes).cast("int"))
    rows = attach(shards, sizes, "shard", "nodes", ["print", "other"]).filter("trees is not null")
    own = F.pmod(F.xxhash64("print", "other"), F.col("trees")).cast("int")
    # Tree `own` meets itself and, as a pair, every other part of its shard once.
    other = F.explode(F.sequence(F.lit(0), F.col("trees") - 1))
    rows = rows.select("shard", "print", "other", own.alias("own"), other.alias("also"))
    rows = rows.select(
        "shard", F.least("own", "also").alias("tree"), F.greatest("own", "also").alias("part"), "own", "print", "other"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(table):
                return
            cuts = np.flatnonzero((table[1:, :3] != table[:-1, :3]).any(axis=1)) + 1
            out: list[tuple[tuple[int, int], tuple[int, int]]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(table)]):
                if b - a > 1:
                    group = table[a:b]
                    values = list(zip(*((c & (1 << 64) - 1 for c in group[:, k].tolist()) for k in (4, 5))))
                    if group[0, 1] == group[0, 2]:
                        out += tree_links(values, None, radius, confirm)
                    else:
                        first = group[:, 3] == group[0, 1]
                        mine = [v for v, f in zip(values, first) if f]
                        out += tree_links(mine, [v for v, f in zip(values, first) if not f], radius, confirm)
            if out:
                pairs = np.array(out, np.uint64).reshape(len(out), 4).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs.T], ["u", "u_other", "v", "v_other"])

        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            table = np.concatenate([*held, table]) if held else table
            # The last group may go on in the next batch; no group is above two trees' nodes.
            last = int(np.flatnonzero((table[:, :3] == table[-1, :3]).all(axis=1))[0]) if len(table) else 0
            held = [table[last:]]
            yield from found(table[:last])
        if held:
            yield from found(held[0])

    keys = ["shard", "tree", "part"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "own", "print", "other")
    return rows.mapInArrow(search, "u long, u_other long, v long, v_other long")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, print, root (a fingerprint that names the component) and component_id
    (the smallest doc_id that links reach) of every row."""
    rows = written(fingerprints(docs), "fingerprints")
    nodes = rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "distinct-fingerprints")
    roots = components(links(nodes.select("print"), radius))
    named = nodes.join(roots, F.col("print") == F.col("id"), "left").withColumn("root", F.coalesce("root", "print"))
    named = written(named.select("print", "first", "copies", "root"), "roots")
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = attach(named, groups, "root", "members", ["print"]).select("print", "copies", "root", "component_id")
    return attach(rows, written(named, "groups"), "print", "copies", ["doc_id"])


def copy_groups(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """doc_id, text_hash and root (a number that names the group) of every row."""
    rows = written(sketches(docs), "sketches")
    nodes = written(rows.groupBy("print").agg(F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    found = links(nodes.select("print"), radius)
    for place in range(len(WORD_SEEDS)):
        pairs = rows.select(F.get("words", F.lit(place)).alias("print"), F.col("print").alias("other")).distinct()
        near = confirmed_links(pairs, radius, confirm)
        # The second entries are fingerprints of shingles, which stand for all their rows.
        found = found.unionByName(near.select(F.col("u_other").alias("u"), F.col("v_other").alias("v")))
    roots = components(found)
    named = nodes.join(roots, F.col("print") == F.col("id"), "left")
    named = written(named.select("print", "copies", F.coalesce("root", "print").alias("root")), "roots")
    return attach(rows.select("doc_id", "text_hash", "print"), named, "print", "copies", ["doc_id"])


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of copies: that with the smallest doc_id, then the smallest hash of its text.

    Null doc_ids come last, so a group of them keeps one row too. A doc_id that several texts
    share may stay once for each of their groups; equal rows fall to one.
    """
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    leaders = copy_groups(docs, radius).groupBy("root").agg(F.min(place).alias("at")).select("at.*")
    key = lambda: F.xxhash64("doc_id", "text_hash")
    chosen = leaders.select(key().alias("_chosen"), F.col("doc_id").alias("_leader"), F.col("text_hash").alias("_leader_hash"))
    rows = docs.withColumn("_row_hash", text_hash())
    rows = rows.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), "_row_hash"))
    same = (
        (F.col("_row") == F.col("_chosen"))
        & F.col("doc_id").eqNullSafe(F.col("_leader"))
        & (F.col("_row_hash") == F.col("_leader_hash"))
    )
    kept = rows.join(chosen, same, "left_semi")
    return kept.dropDuplicates(["_row", "doc_id"]).select(*docs.columns)
