"""Token ids in files of independently coded blocks (see rans.py).

A folder holds `table.freq` (the shared frequencies, little-endian uint32) and one file a task,
in ascending order of doc_id. A file is a row of blocks; each is the length of its index, the
index (zlib: document ids, null marks, id counts) and the coded ids of its whole documents.
The manifest table names every block: file, place, number of ids, and ids before it overall.

Defined results
* Null and empty texts give the end id alone. Null doc_ids come first; rows of one doc_id are
  ordered by a hash of their ids, then by the ids, so equal rows are interchangeable.
* Empty table: no block, no row. Extra columns are ignored. Whole texts are always coded.
* A damaged block fails its checksum and stops the read with an error.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm import rans
from treeline.llm.common import new_folder, process_store, written

BLOCK_IDS = 1 << 20
STEMS, WORDS = 800_000, 200_000
LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
BLOCK = "file_no int, path string, block int, offset long, bytes long, n_ids long"
DOCUMENT = "doc_id long, first long, n_tokens long, ids_crc32 long, ids binary"


class WordCoder:
    """Ids of whole texts for a tokenizer that drops white space.

    Such a tokenizer treats each blank-separated word alone, so words are coded once and
    remembered (up to a bound, then forgotten; whole words from their second time on). Plain letters with ASCII punctuation behind
    them go to the library's model directly; everything else through all of its steps.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        store = process_store(path)
        if not store:
            store |= {"lib": Tokenizer.from_file(path), "words": {}, "stems": {}}
        self.lib, self.words, self.stems = store["lib"], store["words"], store["stems"]
        self.kind = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def stem(self, letters: str) -> bytes:
        low = letters.lower()
        if (got := self.stems.get(low)) is None:
            pieces = [low] if low.isascii() else [p for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(low)]
            got = self.packed([t.id for p in pieces for t in self.lib.model.tokenize(p)])
            if len(self.stems) >= STEMS:
                self.stems.clear()
            self.stems[low] = got
        return got

    def word(self, word: str) -> bytes:
        plain = LETTERS.fullmatch(word)
        again = not plain or plain[1].lower() in self.stems
        if plain and not plain[2]:
            got = self.stem(word)
        elif plain:
            got = self.stem(plain[1]) + (self.words.get(plain[2]) or self.word(plain[2]))
        else:
            got = self.packed(self.lib.encode(word, add_special_tokens=False).ids)
        if again and len(word) < 100:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = got
        return got

    def text(self, text: str) -> bytes:
        known = self.words.get
        return b"".join([known(w) or self.word(w) for w in text.replace("\n", " ").split(" ") if w])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and packed ids (with the end id) of every row."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(tokenizer)
        end = coder.packed([end_id])
        for batch in batches:
            packed = [coder.text(t or "") + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(code, "doc_id long, ids binary")


def frequencies(tokens: DataFrame, size: int, kind: str) -> rans.Table:
    """The frequency table of all ids; the driver gets one row for each id in use."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used), "n": pa.array(total[used])})

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in rows.collect():
        counts[row.id] = row.n
    return rans.Table.fit(counts)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files and return the (written) manifest."""
    coder = WordCoder(tokenizer)
    kind, size = coder.kind, coder.lib.get_vocab_size()
    tokens = written(tokenized(docs, tokenizer, end_id), "token-ids")
    table = frequencies(tokens, size, kind)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/table.freq") as out:
        out.write(table.freq.astype("<u4").tobytes())
    held = docs.sparkSession.sparkContext.broadcast(table)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.rans"
        place, root = fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        offset, out, names, pieces, n = 0, None, [], [], 0
        width = np.dtype(kind).itemsize

        def flush() -> None:
            nonlocal out, offset, names, pieces, n
            if out is None:
                out = place.open_output_stream(f"{root}/{name}")
            lengths = np.array([len(p) // width for p in pieces], "<u8").tobytes()
            ids = np.array([i or 0 for i in names], "<i8").tobytes()
            index = zlib.compress(ids + np.array([i is None for i in names], "u1").tobytes() + lengths)
            block = rans.encode(np.frombuffer(b"".join(pieces), kind), held.value)
            data = struct.pack("<II", len(index), len(names)) + index + block
            out.write(data)
            rows.append((part, f"{folder}/{name}", len(rows), offset, len(data), n))
            offset, names, pieces, n = offset + len(data), [], [], 0

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(doc_id)
                pieces.append(ids)
                n += len(ids) // width
                if n >= BLOCK_IDS:
                    flush()
        if names:
            flush()
        if out is not None:
            out.close()
        if rows:
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["file_no", "path", "block", "offset", "bytes", "n_ids"])

    order = ["doc_id", "h", "ids"]
    ranged = tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange("doc_id", "h").sortWithinPartitions(*order)
    blocks = written(ranged.select("doc_id", "ids").mapInArrow(write, BLOCK), "token-blocks")
    # One row a file meets in one task here, far fewer than blocks or documents.
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("all"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("file_first"))
    inside = Window.partitionBy("file_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    blocks = blocks.withColumn("in_file", first).join(files, "file_no")
    return blocks.withColumn("first", F.col("file_first") + F.col("in_file")).drop("in_file", "file_first")


def read_block(store, path: str, offset: int, size: int, table: rans.Table, symbols: np.ndarray):
    """Document ids (None for null), id counts, and the coded block."""
    with store.open_input_file(path) as file:
        file.seek(offset)
        data = file.read(size)
    packed, n = struct.unpack_from("<II", data)
    index = zlib.decompress(data[8 : 8 + packed])
    ids, nulls = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
    names = [None if z else int(i) for i, z in zip(ids, nulls)]
    return names, np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64), rans.Block(data[8 + packed :], table, symbols)


def load_table(folder: str) -> rans.Table:
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/table.freq") as file:
        return rans.Table.of(np.frombuffer(file.read(), "<u4"))


def read_tokens(blocks: DataFrame, folder: str, keep_ids: bool = True) -> DataFrame:
    """A row for each document in the files: its place, number, checksum and (if kept) ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_table(folder)
        symbols = table.symbols()
        for batch in batches:
            for path, offset, size, first in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = fs.FileSystem.from_uri(path)
                names, counts, block = read_block(store, place, offset, size, table, symbols)
                data = block.ids().astype("<u4").tobytes()
                ends = np.cumsum(counts)
                pieces = [data[4 * (e - c) : 4 * e] for c, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(names, pa.int64()),
                        "first": pa.array(first + ends - counts, pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                        "ids": pa.array(pieces if keep_ids else [None] * len(pieces), pa.binary()),
                    }
                )

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.select("path", "offset", "bytes", "first").repartition(tasks, "path", "offset")
    return rows.mapInArrow(read, DOCUMENT)


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents as token files in the shared folder, then read the files back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id), folder, keep_ids=False)
