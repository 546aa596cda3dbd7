"""Phrases whose parts come together more often than apart, by best-first growth.

A phrase of 2 to 4 words with a occurrences scores floor(2000000 a / (l + r)) for the worst way
to cut it in two parts, which occur l and r times. Counts and scores are per language.

Texts become chunks of word numbers once. All pairs of words are counted, then phrases grow to
the right from prefixes: whatever begins with a prefix occurs at most as often as the prefix, and
its first cut leaves the first word, so floor(2000000 f / (f(first word) + f)) bounds the score of
the prefix of f occurrences and of all that grows from it. The frontier is taken best bound first
in batches: a level is set for each language, every prefix whose bound reaches it is expanded, and
every phrase whose score reaches it gets its neighbours counted, which tell if a longer phrase
absorbs it. A language is settled when WANTED phrases that survive reach the level (all that tie
with the last reach it too) or when nothing is left below it; the others go on with a level that
admits twice as many pairs. Prefixes go to the tasks in broadcasts of BATCH at most; larger
frontiers take several passes.

Words stand as 64-bit hashes; the hash is checked to be one-to-one over all words of the corpus,
else another seed is taken, so counts are exact. Products are decimals beyond 64 bits.

Defined results
* Null language: `und`, together with rows that say so. Null, empty and wordless texts: no word.
* Repeated rows all count. Empty table: no row. Extra columns are ignored.
* Ties in score and count are ranked by the phrase in UTF-8 byte order.
* A language with fewer than WANTED surviving phrases returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import LOWER, UPPER, attach, process_store, written

LEAST = 30
LONGEST = 4
WANTED = 2000
#: A phrase is absorbed by a longer one of at least SHARE percent of its occurrences.
SHARE = 80
SCALE = 2_000_000
FIRST_GOAL = 3000
CHUNK = 1 << 19
TEXT_BYTES = 4 << 20
#: Rows of a batch that a task hands on at once.
ROWS = 1 << 16
BATCH = 500_000
#: Words listed to all tasks with their counts; with fewer frequent words, all others are rare.
LISTED = 1 << 20
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
TRANSLATED = bytes.maketrans(UPPER.encode() + BREAKS + b"\t", LOWER.encode() + b"\n" * len(BREAKS) + b" ")

PARTS = "lang string, own int, vocab array<long>, codes array<int>, word string, hash long, seen long"
ARROW_PARTS = pa.schema(
    [
        ("lang", pa.string()),
        ("own", pa.int32()),
        ("vocab", pa.list_(pa.int64())),
        ("codes", pa.list_(pa.int32())),
        ("word", pa.string()),
        ("hash", pa.int64()),
        ("seen", pa.int64()),
    ]
)
WORDS = ["w1", "w2", "w3", "w4"]


def word_array(data: list[bytes]) -> pa.DictionaryArray:
    """The words of translated texts in order; b"\\n" stands between pieces."""
    joined = b" \n ".join(data).replace(b"\n", b" \n ")
    split = pc.split_pattern(pa.array([joined], pa.large_binary()).cast(pa.large_string()), " ")
    return split.values.dictionary_encode()


def chunks(data: list[bytes], seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """Of every CHUNK words: their number, hashes of its vocabulary, codes (with three words more),
    the vocabulary and how often each of it stands among its own words."""
    found = word_array(data)
    words, codes = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)
    number = np.zeros(len(words), np.int64)
    names = [w for w in words if w not in ("", "\n")]
    number[np.array([w not in ("", "\n") for w in words], bool)] = np.arange(1, len(names) + 1)
    kept = np.array([w != "" for w in words], bool)
    codes = number[codes[kept[codes]]]
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), seed) for w in names], np.uint64).view(np.int64)
    for at in range(0, len(codes), CHUNK):
        own = min(CHUNK, len(codes) - at)
        used, local = np.unique(np.concatenate([[0], codes[at : at + CHUNK + LONGEST - 1]]), return_inverse=True)
        counts = np.bincount(local[1 : own + 1], minlength=len(used))[1:]
        yield own, hashes[used[1:] - 1], local[1:].astype(np.int32), [names[i - 1] for i in used[1:].tolist()], counts


def word_parts(docs: DataFrame, seed: int) -> DataFrame:
    """The texts as chunks of word numbers, and the word counts of each chunk, in one written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_PARTS)], schema=ARROW_PARTS)

        def made(lang: str, data: list[bytes]) -> Iterator[pa.RecordBatch]:
            for own, hashes, codes, names, counts in chunks(data, seed):
                yield batch_of([lang], [own], [hashes], [codes], [None], [None], [None])
                for at in range(0, len(names), ROWS):
                    part = slice(at, at + ROWS)
                    n = len(names[part])
                    yield batch_of([lang] * n, *([[None] * n] * 3), names[part], hashes[part], counts[part])

        held: dict[str, list[bytes]] = {}
        weight: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "replace").translate(TRANSLATED)
                held.setdefault(lang, []).append(data)
                weight[lang] = weight.get(lang, 0) + len(data)
                if weight[lang] > TEXT_BYTES:
                    yield from made(lang, held.pop(lang))
                    weight[lang] = 0
        for lang, data in held.items():
            yield from made(lang, data)

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    rows = rows.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    return written(rows.mapInArrow(run, PARTS), "word-parts")


def encoded(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, vocabulary): word numbers, and lang, word, hash, f of every word."""
    seed = 0
    while True:
        parts = word_parts(docs, seed)
        words = parts.filter("word is not null").groupBy("lang", "word", "hash").agg(F.sum("seen").alias("f"))
        words = written(words, "vocabulary")
        twice = words.groupBy("hash").agg(F.min("word").alias("one"), F.max("word").alias("other")).filter("one != other")
        if twice.limit(1).count() == 0:
            return parts.filter("codes is not null").select("lang", "own", "vocab", "codes"), words
        seed += 1


def arrays_of(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    for i, (lang, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        vocab, codes = batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()
        yield lang, own, vocab, codes.astype(np.int64)


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and how often each stands there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def pair_counts(texts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, a of all pairs of words that occur `least` times."""
    spark = texts.sparkSession
    # The most frequent words, LISTED at most; below the last of them nothing is known.
    listed = words.filter(F.col("f") >= least).select("hash", "f").orderBy(F.desc("f"), "hash").limit(LISTED).toPandas()
    known = np.unique(listed["hash"].to_numpy(np.int64))
    held = spark.sparkContext.broadcast(known if len(listed) < LISTED else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own, vocab, codes in arrays_of(batch):
                able = np.append(False, np.isin(vocab, held.value)) if held.value is not None else np.append(False, np.full(len(vocab), True))
                first, second = codes[:-1][:own], codes[1 : own + 1]
                both = able[first] & able[second]
                keys, n = tallied(first[both] * (len(vocab) + 1) + second[both])
                for at in range(0, len(keys), ROWS):
                    w1, w2 = np.divmod(keys[at : at + ROWS], len(vocab) + 1)
                    columns = [[lang] * len(w1), vocab[w1 - 1], vocab[w2 - 1], n[at : at + ROWS]]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["lang", "w1", "w2", "n"])

    found = texts.mapInArrow(run, "lang string, w1 long, w2 long, n long")
    return found.groupBy("lang", "w1", "w2").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def prepared(wanted: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, dict]:
    """For each language the sorted words, pairs and triples of the wanted prefixes."""
    out = {}
    for lang, (words, sides) in wanted.items():
        two = sides[:, 2] == 2
        names = np.unique(np.concatenate([words[:, 0], words[:, 1], words[~two, 2]]))
        at = np.searchsorted(names, words)
        pairs = at[:, 0] * len(names) + at[:, 1]
        pair_keys = np.unique(pairs)
        flags = np.zeros((len(pair_keys), 2), bool)
        flags[np.searchsorted(pair_keys, pairs[two])] = sides[two, :2] > 0
        triples = np.searchsorted(pair_keys, pairs[~two]) * len(names) + at[~two, 2]
        order = np.argsort(triples)
        out[lang] = {
            "names": names,
            "pairs": pair_keys,
            "pair_flags": flags,
            "triples": triples[order],
            "triple_flags": sides[~two, :2][order] > 0,
        }
    return out


def placed(keys: np.ndarray, sought: np.ndarray, able: np.ndarray) -> np.ndarray:
    """Where each able key stands in the sorted `sought`; -1 elsewhere."""
    out = np.full(len(keys), -1, np.int64)
    if len(sought) and able.any():
        some = keys[able]
        at = np.minimum(np.searchsorted(sought, some), len(sought) - 1)
        out[able] = np.where(sought[at] == some, at, -1)
    return out


def shifted(values: np.ndarray, by: int, fill: int) -> np.ndarray:
    return np.concatenate([values[by:], np.full(min(by, len(values)), fill, values.dtype)])


NEIGHBOURS = "lang string, n int, w1 long, w2 long, w3 long, is_right boolean, x long, a long"


def neighbour_counts(texts: DataFrame, prefixes: DataFrame, batch: int = BATCH) -> DataFrame:
    """How often each word stands next to the phrases (lang, n, w1, w2, w3, is_right, is_left).

    Rows: the phrase, the side, the word x beside it and the count, without zero counts.
    """
    spark = texts.sparkSession
    rounds = max(1, -(-prefixes.count() // batch))
    found = None
    for k in range(rounds):
        own = prefixes.filter(F.pmod(F.xxhash64("lang", "w1", "w2", "w3"), F.lit(rounds)) == k)
        table = own.select("lang", "n", "w1", "w2", "w3", "is_right", "is_left").toPandas()
        wanted = {
            lang: (part[["w1", "w2", "w3"]].to_numpy(np.int64), part[["is_right", "is_left", "n"]].to_numpy(np.int64))
            for lang, part in table.groupby("lang")
        }
        held = spark.sparkContext.broadcast(wanted)
        key = f"collocations-{held._jbroadcast.id()}"

        def run(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            store = process_store("collocations")
            if store.get("key") != key:
                store.update(key=key, sought=prepared(held.value))
            for rows in batches:
                for lang, own, vocab, codes in arrays_of(rows):
                    if lang in store["sought"]:
                        yield from beside(lang, own, vocab, codes, store["sought"][lang])

        part = texts.mapInArrow(run, NEIGHBOURS).groupBy("lang", "n", "w1", "w2", "w3", "is_right", "x")
        part = written(part.agg(F.sum("a").alias("a")), "neighbours")
        found = part if found is None else found.unionByName(part)
    return found


def beside(lang: str, own: int, vocab: np.ndarray, codes: np.ndarray, sought: dict) -> Iterator[pa.RecordBatch]:
    names, size = sought["names"], len(sought["names"])
    number = np.append(-1, placed(vocab, names, np.full(len(vocab), True)))
    at = number[codes]
    next_at = shifted(at, 1, -1)
    pair = placed(at * size + next_at, sought["pairs"], (at >= 0) & (next_at >= 0))
    third = shifted(at, 2, -1)
    triple = placed(pair * size + third, sought["triples"], (pair >= 0) & (third >= 0))
    for n, found, flags in ((2, pair, sought["pair_flags"]), (3, triple, sought["triple_flags"])):
        for right in (True, False):
            # A count belongs to the chunk that owns the first word of phrase and neighbour.
            phrase = found[:own] if right else shifted(found, 1, -1)[:own]
            word = shifted(codes, n, 0)[:own] if right else codes[:own]
            hit = (phrase >= 0) & (word > 0)
            hit[hit] = flags[phrase[hit], 0 if right else 1]
            keys, counts = tallied(phrase[hit] * (len(vocab) + 1) + word[hit])
            if not len(keys):
                continue
            which, word = np.divmod(keys, len(vocab) + 1)
            if n == 3:
                which, last = np.divmod(sought["triples"][which], size)
                w3 = pa.array(names[last])
            else:
                w3 = pa.array(np.zeros(len(which), np.int64))
            one, two = np.divmod(sought["pairs"][which], size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(keys), pa.string()),
                    pa.array(np.full(len(keys), n, np.int32)),
                    pa.array(names[one]),
                    pa.array(names[two]),
                    w3,
                    pa.array(np.full(len(keys), right)),
                    pa.array(vocab[word - 1]),
                    pa.array(counts, pa.int64()),
                ],
                ["lang", "n", "w1", "w2", "w3", "is_right", "x", "a"],
            )


def score_of(a: str, left: str, right: str) -> Column:
    """floor(2000000 a / (left + right)) in decimals."""
    number = lambda c: f"cast({c} as decimal(20, 0))"
    return F.expr(f"(cast({SCALE} as decimal(7, 0)) * {number(a)}) div ({number(left)} + {number(right)})")


def cut(k: int, left: str, right: str, a: str = "a") -> Column:
    """A way to cut: its score, number and parts, so that the least is the one that counts."""
    return F.struct(
        score_of(a, left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")
    )


def with_count(rows: DataFrame, counts: DataFrame, on: list[str], keys: list[str], name: str, how: str = "inner") -> DataFrame:
    """Join the count of the phrase in the columns `on` (of `rows`) as column `name`."""
    other = counts.select(F.col("lang").alias("_lang"), *(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.col(counts.columns[-1]).alias(name))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{i}") for i, c in enumerate(on)], F.col("lang") == F.col("_lang"))
    return rows.join(other, same, how).drop("_lang", *(f"_{i}" for i in range(len(keys))))


class Growth:
    """The phrases known so far and the prefixes expanded; all tables are written ones."""

    def __init__(self, texts: DataFrame, words: DataFrame, least: int, batch: int) -> None:
        self.texts, self.least, self.batch = texts, least, batch
        self.later: DataFrame | None = None
        self.words = written(words.filter(F.col("f") >= least).select("lang", "hash", "f"), "frequent-words")
        pairs = written(pair_counts(texts, words, least), "pair-counts")
        # A frequent word starts or ends many pairs: its count meets them spread.
        for end in ("w1", "w2"):
            name = f"f_{end}"
            ends = pairs.groupBy("lang", end).agg(F.count(F.lit(1)).alias("rows"))
            ends = with_count(ends, self.words, [end], ["hash"], name)
            pairs = attach(pairs, ends, ["lang", end], "rows", ["w1", "w2"])
        best = cut(1, "f_w1", "f_w2")
        pairs = pairs.select("lang", "w1", "w2", "a", "f_w1", best.alias("cut"), score_of("a", "f_w1", "a").alias("bound"))
        self.pairs = written(pairs, "pairs")
        none = "lang string, n int, w1 long, w2 long, w3 long, w4 long, a long, f_w1 long, cut struct<score:bigint,k:int,l:bigint,r:bigint>, bound bigint"
        spark = texts.sparkSession
        self.triples = spark.createDataFrame([], none)
        self.quads = spark.createDataFrame([], none)
        self.seen = spark.createDataFrame([], "lang string, n int, w1 long, w2 long, w3 long, is_right boolean")
        self.most = spark.createDataFrame([], "lang string, n int, w1 long, w2 long, w3 long, most long")

    def count_beside(self, right: DataFrame | None, left: DataFrame | None) -> DataFrame:
        """Neighbours of phrases (lang, n, w1, w2, w3) that were not counted before; remembers them."""
        key = ["lang", "n", "w1", "w2", "w3"]
        sides = [d.select(*key).withColumn("is_right", F.lit(s)) for d, s in ((right, True), (left, False)) if d is not None]
        asked = reduce(DataFrame.unionByName, sides).distinct()
        asked = written(asked.join(self.seen, [*key, "is_right"], "left_anti"), "asked")
        self.seen = written(self.seen.unionByName(asked), "seen")
        flag = lambda side: F.max(F.col("is_right") == side)
        prefixes = asked.groupBy(*key).agg(flag(True).alias("is_right"), flag(False).alias("is_left"))
        found = neighbour_counts(self.texts, prefixes, self.batch)
        most = found.groupBy(*key).agg(F.max("a").alias("most"))
        both = self.most.unionByName(most).groupBy(*key).agg(F.max("most").alias("most"))
        self.most = written(both, "most")
        return found.filter(F.col("is_right") & (F.col("a") >= self.least))

    def add_triples(self, grown: DataFrame) -> None:
        rows = grown.filter("n = 2").select("lang", F.lit(3).alias("n"), "w1", "w2", F.col("x").alias("w3"), F.lit(0).cast("long").alias("w4"), "a")
        rows = with_count(rows, self.pairs.select("lang", "w1", "w2", "f_w1"), ["w1", "w2"], ["w1", "w2"], "f_w1")
        rows = with_count(rows, self.pairs.select("lang", "w1", "w2", "a"), ["w1", "w2"], ["w1", "w2"], "f_12")
        rows = with_count(rows, self.pairs.select("lang", "w1", "w2", "a"), ["w2", "w3"], ["w1", "w2"], "f_23")
        rows = with_count(rows, self.words, ["w3"], ["hash"], "f_3")
        best = F.least(cut(1, "f_w1", "f_23"), cut(2, "f_12", "f_3"))
        rows = rows.withColumns({"cut": best, "bound": score_of("a", "f_w1", "a")})
        self.triples = written(self.triples.unionByName(rows.select(*self.triples.columns)), "triples")

    def quads_of(self, grown: DataFrame) -> DataFrame:
        """Phrases of four words with all but their first cut, whose right part is maybe unknown."""
        rows = grown.filter("n = 3").select("lang", F.lit(4).alias("n"), "w1", "w2", "w3", F.col("x").alias("w4"), "a")
        rows = with_count(rows, self.triples.select("lang", *WORDS[:3], "f_w1"), WORDS[:3], WORDS[:3], "f_w1")
        rows = with_count(rows, self.triples.select("lang", *WORDS[:3], "a"), WORDS[:3], WORDS[:3], "f_123")
        rows = with_count(rows, self.pairs.select("lang", "w1", "w2", "a"), ["w1", "w2"], ["w1", "w2"], "f_12")
        rows = with_count(rows, self.pairs.select("lang", "w1", "w2", "a"), ["w3", "w4"], ["w1", "w2"], "f_34")
        rows = with_count(rows, self.words, ["w4"], ["hash"], "f_4")
        rows = rows.withColumn("later", F.least(cut(2, "f_12", "f_34"), cut(3, "f_123", "f_4")))
        return written(rows.select("lang", "n", *WORDS, "a", "f_w1", "later"), "four-words")

    def reach(self, level: DataFrame) -> None:
        """Expand and score everything whose bound or score reaches its language's level."""
        at = lambda rows, what: rows.join(level, "lang").filter(F.col(what) >= F.col("level"))
        pairs = self.pairs.withColumns({"n": F.lit(2), "w3": F.lit(0).cast("long")})
        grown = self.count_beside(at(pairs, "bound"), at(pairs, "cut.score"))
        self.add_triples(grown)
        grown = self.count_beside(at(self.triples, "bound"), at(self.triples, "cut.score"))
        quads = self.quads_of(grown)
        # The right part of the first cut is a phrase of three words; its first two are expanded if they were not.
        able = quads.withColumn("hope", F.least(F.col("later.score"), score_of("a", "f_w1", "a")))
        if self.later is not None:
            able = able.unionByName(self.later.withColumn("hope", F.least(F.col("later.score"), score_of("a", "f_w1", "a"))))
        rests = at(able, "hope").select("lang", F.lit(2).alias("n"), F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.lit(0).cast("long").alias("w3"))
        self.add_triples(self.count_beside(rests, None))
        # What stays without its right part cannot reach the level and comes again with a lower one.
        counts = self.triples.select("lang", *WORDS[:3], "a")
        rows = with_count(quads, counts, WORDS[1:], WORDS[:3], "f_234", "left")
        waiting = rows.filter("f_234 is null").select("lang", "n", *WORDS, "a", "f_w1", "later")
        if self.later is not None:
            old = with_count(self.later, counts, WORDS[1:], WORDS[:3], "f_234", "left")
            rows, waiting = rows.unionByName(old), waiting.unionByName(old.filter("f_234 is null").select(*waiting.columns))
        rows = rows.filter("f_234 is not null").withColumn("cut", F.least(cut(1, "f_w1", "f_234"), F.col("later")))
        rows = rows.withColumn("bound", F.col("cut.score"))
        self.quads = written(self.quads.unionByName(rows.select(*self.quads.columns)), "quads")
        self.later = written(waiting, "waiting")

    def survivors(self, level: DataFrame) -> DataFrame:
        """Phrases whose score reaches the level and that no longer phrase absorbs."""
        keys = ["lang", "n", "w1", "w2", "w3"]
        pairs = self.pairs.withColumns({"n": F.lit(2), "w3": F.lit(0).cast("long"), "w4": F.lit(0).cast("long")})
        columns = ["lang", "n", *WORDS, "a", "cut"]
        short = pairs.select(*columns).unionByName(self.triples.select(*columns)).join(level, "lang").filter("cut.score >= level")
        short = short.join(self.most, keys, "left")
        number = lambda c: F.col(c).cast("decimal(20,0)")
        absorbed = (F.col("most") >= self.least) & (100 * number("most") >= SHARE * number("a"))
        short = short.filter(~F.coalesce(absorbed, F.lit(False)))
        long = self.quads.join(level, "lang").filter("cut.score >= level")
        return short.select(*columns).unionByName(long.select(*columns))


def levels(pairs: DataFrame, goals: DataFrame) -> DataFrame:
    """lang, goal, level: the score of the goal-th best pair of each language, 0 if it has fewer."""
    best = Window.partitionBy("lang").orderBy(F.desc("score"))
    most = goals.agg(F.max("goal")).first()[0] or 0
    ranked = pairs.select("lang", F.col("cut.score").alias("score")).withColumn("nth", F.row_number().over(best))
    ranked = ranked.filter(F.col("nth") <= most).join(goals, "lang").filter("nth = goal")
    named = goals.join(ranked.select("lang", "score"), "lang", "left")
    return named.select("lang", "goal", F.coalesce("score", F.lit(0).cast("long")).alias("level"))


def phrases(
    docs: DataFrame, least: int = LEAST, wanted: int = WANTED, first_goal: int = FIRST_GOAL, batch: int = BATCH
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    texts, words = encoded(docs)
    growth = Growth(texts, words, least, batch)
    goals = growth.pairs.select("lang").distinct().withColumn("goal", F.lit(first_goal).cast("long"))
    goals = written(goals, "goals")
    done: list[DataFrame] = []
    while goals.limit(1).count():
        level = written(levels(growth.pairs, goals), "levels")
        growth.reach(level.select("lang", "level"))
        found = written(growth.survivors(level.select("lang", "level")), "survivors")
        sizes = found.groupBy("lang").count()
        state = level.join(sizes, "lang", "left").withColumn("settled", (F.col("level") == 0) | (F.coalesce("count", F.lit(0)) >= wanted))
        state = written(state, "state")
        done.append(found.join(state.filter("settled").select("lang"), "lang", "left_semi"))
        goals = written(state.filter("not settled").select("lang", (F.col("goal") * 2).alias("goal")), "goals")
    if not done:
        done.append(growth.survivors(docs.sparkSession.createDataFrame([], "lang string, level long")))
    rows = reduce(DataFrame.unionByName, done)
    # Only what scores at least like the last wanted one needs its words spelled out.
    first = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
    rows = rows.withColumn("at_most", F.rank().over(first)).filter(F.col("at_most") <= wanted).drop("at_most")
    rows = written(rows, "best-phrases")
    names = words.filter(F.col("f") >= least).select("lang", F.col("hash"), "word")
    listed = rows.select("lang", "n", *WORDS, F.posexplode(F.array(*WORDS)).alias("place", "hash")).filter("place < n")
    spelled = listed.join(names, ["lang", "hash"]).groupBy("lang", *WORDS).agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
    rows = rows.join(spelled, ["lang", *WORDS]).withColumn("phrase", F.array_join("words.word", " "))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(ranked).cast("long")).filter(F.col("rank") <= wanted).drop("n")
    return rows.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
