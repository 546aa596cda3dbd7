"""Reference facts: where symbol names occur outside their definitions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.paths import suffix
from treeline.functions.text import RETURN_ONLY, split_lines, strip
from treeline.functions.tokens import WORD_RUN, word_runs
from treeline.operators.attribution import with_module
from treeline.operators.distributed import first_per_key, top_ranked

#: Characters of names in one automaton; each takes some 60 bytes in a task.
PACK_CHARS = 1 << 20
HIT = "name string, file string, line int, position int"
#: Words that are sorted by file and name at a time, those of the last file whole.
PACK_WORDS = 1 << 18
SPOTS = "name string, module_path string, file string, spots array<long>"


def source_files(definitions: DataFrame) -> DataFrame:
    """Files worth scanning: those a definition names, with a source suffix."""
    return definitions.select("file").distinct().filter(suffix(F.col("file")).isin(*settings.C_SUFFIXES))


def _context(line):
    return F.substring(strip(line), 1, settings.CONTEXT_CHARS)


def word_hits(files: DataFrame, names: DataFrame) -> DataFrame:
    """Occurrences of names made of word characters: name, file, line, position in the line.

    Words meet the names in a single shuffle. No size is assumed: adaptive execution
    broadcasts the names only if they measure small, and otherwise splits the
    partition of a very frequent word over several tasks.
    """
    lines = files.select("file", F.posexplode(split_lines(F.col("text"), RETURN_ONLY)).alias("_i", "_line"))
    words = lines.select(
        "file", (F.col("_i") + 1).alias("line"), F.posexplode(word_runs(F.col("_line"))).alias("position", "name")
    )
    return words.join(names.select("name").distinct(), "name")


def literal_hits(files: DataFrame, names: list[str]) -> DataFrame:
    """Occurrences of names that hold other characters (`~Foo`, `operator =`).

    The list is the caller's: each name becomes one bounded pattern of the scan.
    """
    lines = files.select("file", F.posexplode(split_lines(F.col("text"), RETURN_ONLY)).alias("_i", "_line"))
    counts = [
        F.struct(
            F.lit(name).alias("name"),
            F.regexp_count(
                "_line", F.lit(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])")
            ).alias("times"),
        )
        for name in names
    ]
    return (
        lines.select(
            "file", (F.col("_i") + 1).alias("line"),
            F.explode(F.filter(F.array(*counts), lambda h: h["times"] > 0)).alias("h"),
        )
        .select(
            F.col("h.name").alias("name"), "file", "line",
            F.explode(F.sequence(F.lit(0), F.col("h.times") - 1)).alias("position"),
        )
    )


def special_hits(files: DataFrame, names: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """Occurrences of any number of names that hold other characters: name, file, line, position.

    One automaton over all names (Aho and Corasick's, with failure links) finds them in one walk
    over each line, whatever their number; occurrences inside longer words are dropped. Names
    are dealt into packs of about `pack_chars` characters, which bounds what a task holds: a pack is
    broadcast and becomes an automaton once a task. Files are read where they lie, never joined.
    """
    named = names.select("name").distinct().filter("name <> ''")
    total = named.agg(F.sum(F.length("name"))).head()[0] or 0
    packs = -(-total // pack_chars)
    lines = files.select("file", split_lines(F.col("text"), RETURN_ONLY).alias("lines"))
    found = None
    for pack in range(packs):
        own = [r["name"] for r in named.filter(F.pmod(F.xxhash64("name"), F.lit(packs)) == pack).collect()]
        hits = _walked(lines, own)
        found = hits if found is None else found.unionByName(hits)
    return files.sparkSession.createDataFrame([], HIT) if found is None else found


def _walked(lines: DataFrame, names: list[str]) -> DataFrame:
    held = lines.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in held.value:
            automaton.add_word(name, name)
        if held.value:
            automaton.make_automaton()
        word = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
        for batch in batches:
            out: list[tuple[str, str, int, int]] = []
            for file, texts in zip(*(c.to_pylist() for c in batch.columns)):
                for number, line in enumerate(texts or (), 1):
                    seen: dict[str, tuple[int, int]] = {}
                    for last, name in automaton.iter(line) if held.value else ():
                        start, end = last + 1 - len(name), last + 1
                        free, times = seen.get(name, (0, 0))
                        if start < free or line[start - 1 : start] in word or line[end : end + 1] in word:
                            continue
                        seen[name] = (end, times + 1)
                        out.append((name, file, number, times))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["name", "file", "line", "position"])

    return lines.mapInArrow(run, HIT)


def symbol_hits(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """Occurrences of all defined names, plain words and others."""
    plain = F.col("name").rlike("^[A-Za-z0-9_]+$")
    return word_hits(files, definitions.filter(plain)).select("name", "file", "line", "position").unionByName(
        special_hits(files, definitions.filter(~plain))
    )


def _spots(files: DataFrame) -> DataFrame:
    """Each word of each file once, with its places outside its definition lines: name, module_path, file, spots.

    files: file, module_path, text, defined (array of name and line). A spot is line << 32 | position.
    """
    text = F.array_join(split_lines(F.col("text"), RETURN_ONLY), "\n").cast("binary")
    # In bytes: words are ASCII, and what is not UTF-8 does no harm.
    rows = files.filter("text IS NOT NULL").select("file", "module_path", text.alias("text"), "defined")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(WORD_RUN.encode()).findall
        for batch in batches:
            found, sizes, files = [], [], []
            for row, text in enumerate(batch.column("text")):
                for line in text.as_py().split(b"\n"):
                    some = words(line)
                    found += some
                    sizes.append(len(some))
                files.append((row, len(sizes)))
                if len(found) >= PACK_WORDS:
                    yield _packed(batch, files, sizes, found)
                    found, sizes, files = [], [], []
            if found:
                yield _packed(batch, files, sizes, found)

    return rows.mapInArrow(run, SPOTS)


def _packed(batch: pa.RecordBatch, files: list[tuple[int, int]], sizes: list[int], found: list[bytes]) -> pa.RecordBatch:
    """Words of some rows of a batch by row and word. files: row and lines up to its end; sizes: words of each line."""
    rows, ends = (np.array(c, dtype=np.int64) for c in zip(*files))
    starts = np.concatenate([[0], ends[:-1]])
    coded = pa.array(found, pa.binary()).dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    of_file = np.repeat(np.arange(len(rows)), ends - starts)
    line = np.repeat(np.arange(len(sizes)), sizes)
    file = of_file[line]
    before = np.cumsum(sizes) - sizes
    spot = ((line - starts[file] + 1) << 32) | (np.arange(len(code)) - before[line])
    # Definitions as line and word; those of words or lines that the file has not are left out.
    defined = batch.column("defined").take(pa.array(rows))
    own = defined.flatten()
    if len(own):
        at = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(defined), 0).to_numpy())
        word = pc.fill_null(pc.index_in(own.field("name").cast(pa.binary()), names), -1).to_numpy().astype(np.int64)
        place = own.field("line").to_numpy().astype(np.int64) - 1
        real = (word >= 0) & (place >= 0) & (place < (ends - starts)[at])
        taken = (starts[at] + place)[real] * len(names) + word[real]
        keep = ~np.isin(line * len(names) + code, taken)
        code, file, spot = code[keep], file[keep], spot[keep]
    key = file * len(names) + code
    order = np.argsort(key, kind="stable")
    key, spot = key[order], spot[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    row = pa.array(rows[key[first] // len(names)])
    offsets = pa.array(np.append(first, len(key)).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        names.take(pa.array(key[first] % len(names))).cast(pa.string()),
        batch.column("module_path").take(row),
        batch.column("file").take(row),
        pa.ListArray.from_arrays(offsets, pa.array(spot, pa.int64())),
    ], ["name", "module_path", "file", "spots"])


def word_facts(files: DataFrame, definitions: DataFrame, cards: DataFrame) -> DataFrame:
    """`reference_facts` of names made of word characters.

    Files meet their module and their own definitions whole, once; what must travel to the names
    is one row per file and word, not one per occurrence. The names are hashed, so these rows
    need no sorting; those of a very frequent word are split over several tasks.
    """
    own = definitions.filter("file IS NOT NULL AND name IS NOT NULL AND line IS NOT NULL").groupBy("file").agg(
        F.collect_set(F.struct("name", F.col("line").cast("int").alias("line"))).alias("defined")
    )
    placed = with_module(files.select("file", "text"), files.select("file"), cards).join(own, "file", "left")
    names = definitions.select("name").distinct().hint("shuffle_hash")
    met = _spots(placed).join(names, "name", "left_semi")
    spot = met.select("name", "module_path", "file", F.explode("spots").alias("_spot"))
    return spot.select(
        "name", "module_path", "file", F.shiftright("_spot", 32).cast("int").alias("line"),
        F.col("_spot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("position"),
    )


def reference_facts(
    files: DataFrame, definitions: DataFrame, cards: DataFrame, hits: DataFrame | None = None
) -> DataFrame:
    """One row per occurrence outside a definition line: name, module_path, file, line, position.

    Words of the files unless `hits` (as of `symbol_hits`) are given.
    """
    if hits is None:
        return word_facts(files, definitions, cards)
    # Written as an outer join: the optimizer would push an anti join below the name
    # match and shuffle every word of the corpus for it.
    defined = definitions.select("name", "file", "line", F.lit(True).alias("_defined"))
    outside = hits.join(defined, ["name", "file", "line"], "left").filter("_defined IS NULL")
    return with_module(outside, files.select("file"), cards).select(
        "name", "module_path", "file", "line", "position"
    )


def with_context(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Add the trimmed source line to facts (a few samples, or all of them)."""
    lines = files.select("file", split_lines(F.col("text"), RETURN_ONLY).alias("_lines"))
    return facts.join(lines, "file").withColumn("context", _context(F.get("_lines", F.col("line") - 1))).drop("_lines")


def reference_summary(facts: DataFrame) -> DataFrame:
    """Per name: ref_count and the number of distinct non-empty modules."""
    by_module = module_counts(facts)
    return by_module.groupBy("name").agg(
        F.sum("refs").alias("ref_count"),
        F.count_if(F.col("module_path").isNotNull() & (F.col("module_path") != "")).alias("module_count"),
    )


def module_counts(facts: DataFrame) -> DataFrame:
    """References per name and module; the flat form of the per-symbol module list."""
    return facts.groupBy("name", "module_path").agg(F.count(F.lit(1)).alias("refs"))


def top_referenced(facts: DataFrame, n: int = settings.TOP_NAMES) -> DataFrame:
    """The most referenced names: rank, name, ref_count, module_count."""
    return top_ranked(reference_summary(facts), [F.col("ref_count").desc(), F.col("name").asc()], n)


def sample_references(facts: DataFrame, n: int = settings.SAMPLE_REFS) -> DataFrame:
    """The first references of each name in (file, line) order."""
    order = [F.col("file").asc(), F.col("line").asc(), F.col("position").asc()]
    return first_per_key(facts, ["name"], order, n)


def unreferenced(definitions: DataFrame, facts: DataFrame) -> DataFrame:
    """Defined names nobody refers to."""
    return definitions.select("name").distinct().join(facts.select("name").distinct(), "name", "left_anti")
