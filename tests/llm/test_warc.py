"""Archives written, read back, broken on purpose, and read by hand."""

import glob
import gzip
import hashlib

from gatelake.llm import warc
from gatelake.session import work_dir

BREAKS = "x" * 150 + "\r\n\r\n\r\n\r\r\n"


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page), page)
    out = set()
    for page, _, html in rows:
        data = (html or "").encode()
        keeper = first.get(html)
        again = keeper is not None and keeper != page
        out.add((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return out


def test_round_trip(spark):
    rows = [(1, "u", None), (2, None, ""), (4, "u\n v", BREAKS), (3, "u", BREAKS), (None, "u", BREAKS), (None, "u", "only here " * 20),
            (7, "é", "é\r\n\r\n" * 40_000), (8, "é", "é\r\n\r\n" * 40_000), (9, "a", "small"), (10, "a", "small"), (9, "a", "small"),
            (11, "b", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n" * 10), (12, "b", "y" * 70_000)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, record_type string, segment int")
    found = warc.round_trip(pages.repartition(3))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()]
    assert set(got) == expected(rows) and len(got) == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_and_segments(spark):
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    path = work_dir(spark, "archive")
    warc.write(spark.createDataFrame([(1, "http://a", text), (2, "http://b", "short")], "page_id long, url string, html string"),
               path, segment_bytes=1000, chunk_bytes=77)
    parts = warc.records(spark, path, segmented=True).orderBy("segment").collect()
    assert len(parts) > 10 and len({p.origin_id for p in parts}) == 1 and parts[-1].total == sum(len(p.content) for p in parts)
    assert {(r.page_id, bytes(r.content).decode()) for r in warc.responses(spark, path).collect()} == {(1, text), (2, "short")}
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.gz"))
    assert data.count(b"WARC/1.1\r\n") == len(parts) + 1 and data.endswith(b"\r\n\r\n")


def test_gaps_and_broken_framing_give_no_payload(spark):
    path = work_dir(spark, "archive")
    warc.write(spark.createDataFrame([(1, "u", "z" * 5000)], "page_id long, url string, html string"), path, segment_bytes=1000)
    lines = spark.read.option("lineSep", "\r\n\r\n").text(path).collect()
    lost, seen = work_dir(spark, "archive"), 0
    values = [r.value for r in lines]
    second = next(i for i, v in enumerate(values) if "WARC-Segment-Number: 2" in v)
    spark.createDataFrame([(v,) for v in values[:second] + values[second + 2:]], "value string").coalesce(1).write.option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").text(lost)
    assert [r.content for r in warc.responses(spark, lost).collect()] == [None] and seen == 0
    assert warc._dechunked(b"5\r\nabc\r\n0\r\n\r\n") is None and warc._dechunked(b"zz\r\n") is None
    assert warc._dechunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_repeated_rows_each_give_a_record_and_a_row(spark):
    long = "<p>" + "text " * 3000
    rows = [(1, long), (1, long), (2, long), (3, "s"), (3, "s"), (4, None), (None, "x" * 200)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows], "page_id long, url string, html string")
    found = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(pages, segment_bytes=4000).collect())
    assert found == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None),
                     (3, "response", None), (4, "response", None)]
