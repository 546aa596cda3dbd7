"""Archives written and read back, at every split size."""

import gzip
import hashlib
import io

from treeline.llm import warc

ROWS = [
    (5, "http://a/", "x" * 100),
    (3, "http://b/", "x" * 100),
    (9, None, "x" * 100),
    (4, "u\r\nv", "y" * 99),
    (6, "u", "y" * 99),
    (7, "u", None),
    (8, "u", ""),
    (None, "u", "é" * 60),
    (1, "u", "é" * 60),
    (1, "u", "é" * 60),
    (2, "u", "long " * 200_000),
]


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = first[html or ""] if len(data) >= 100 and page != first[html or ""] else None
        kind = "response" if refers is None else "revisit"
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), kind, refers))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame(
        [r + ("n",) for r in ROWS], "page_id long, url string, html string, payload_digest string"
    )
    files = warc.archive(spark, pages)
    for size in (37, 1000, 8 << 20):
        rows = warc.read_warc(files, size).collect()
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
        assert sorted(got, key=repr) == expected(ROWS)
    texts = {r.page_id: r.payload for r in rows if r.record_type == "response" and r.page_id in (2, 4, 7)}
    assert texts == {2: b"long " * 200_000, 4: b"y" * 99, 7: b""}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.archive(spark, pages)).count() == 0


def test_ranges_own_what_starts_inside_and_skip_what_is_no_record():
    parts = [gzip.compress(warc.record(i, "u", b"a" * i, hashlib.sha256(b"a" * i).hexdigest(), None)) for i in range(9)]
    parts.insert(3, gzip.compress(b"not a record"))
    parts.insert(5, b"\x1f\x8b\x08 noise \x1f\x8b\x08")
    data = b"".join(parts) + parts[0][:40]
    for width in (1, 7, 100, len(data)):
        ids = [
            headers["warc-record-id"]
            for start in range(0, len(data), width)
            for _, headers, _ in warc.members(warc.Bytes(io.BytesIO(data)), start, min(len(data), start + width))
        ]
        assert ids == [f"<urn:page:{i}>" for i in range(9)]
