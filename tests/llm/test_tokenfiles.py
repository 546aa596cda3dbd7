"""Token files against the library's ids of whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from treeline.llm import rans, tokenfiles
from treeline.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "",
    None,
    "   ",
    "Don't  stop, l'DÉJÀ vu!!! I'M e.g. 3.14 ÀÉÎõ ſ K İstanbul ΣΑΣ straße x\u00a0y",
    "a<|endoftext|>b <|startoftext|>",
    "e\u0301te\u0301 \u0301x re\u0301sume\u0301.\tnew\r\nline\x0bv\x1c\u2003em",
    "#hash ## $$$ %%%word&&& |pipe| __x__ a_b 'tis 'S 's o'd",
    "日本語 テキスト 한국어 🙂🙂 🙂a",
    "word " * 3000 + "Ünïcödé" * 40,
]


def test_words_give_the_library_s_ids():
    lib, coder, rng = Tokenizer.from_file(PATH), tokenfiles.WordCoder(PATH), random.Random(5)
    alphabet = "abzAZéÉßñ0123 \n\t.,'-_!#&<>|~ıİſ\u0301\u2028\u00a0Ωσς漢🙂"
    texts = [t for t in TEXTS if t] + ["".join(rng.choices(alphabet, k=60)) for _ in range(3000)]
    for text in texts:
        got = np.frombuffer(coder.text(text), coder.kind).tolist()
        assert got == lib.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 1023, 1025, 70_000])
def test_blocks_decode_whole_and_by_stretches(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 500).astype(np.uint16)
    table = rans.Table.fit(np.bincount(ids, minlength=500))
    data = rans.encode(ids, table, lanes=64, stride=8)
    block = rans.Block(data, table, table.symbols())
    assert np.array_equal(block.ids(), ids)
    if n > 64 * 8:
        assert np.array_equal(block.stretch(1), ids[512:1024])
        assert n < 60_000 or len(data) < 2 * n
        broken = bytearray(data)
        broken[-3] ^= 1
        with pytest.raises(ValueError):
            rans.Block(bytes(broken), table, table.symbols()).ids()


def test_files_round_trip(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 1000, t, "x") for i, t in enumerate(TEXTS * 5)] + [(None, "no id", "x"), (3, "twice", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string").repartition(4)
    folder = new_folder(spark, "tokens")
    got = tokenfiles.read_tokens(tokenfiles.write_tokens(docs, folder, PATH, 2), folder).collect()
    encoded = lambda t: lib.encode(t or "", add_special_tokens=False).ids + [2]
    want = sorted((i is not None, i or 0, encoded(t)) for i, t, _ in rows)
    got.sort(key=lambda r: r["first"])
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    assert sorted((r.doc_id is not None, r.doc_id or 0, x) for r, x in zip(got, ids)) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    place = 0
    for row, x in zip(got, ids):
        assert (row["first"], row.n_tokens) == (place, len(x))
        assert row.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes())
        place += len(x)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.token_files(docs, PATH, 2).count() == 0
