"""WARC archives of pages: writing with revisits, segments and chunked framing, and reading them back.

An archive is a set of text files in WARC 1.1, written by Spark's own writer with the record separator as its line
separator, and gzipped, so that no file is split. The reader streams the pieces between separators and joins them to
records by their Content-Length; it holds one record at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm.common import bounded_broadcast, keep, small_batches, work_dir

SEPARATOR = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = ("type string, record_id string, origin_id string, segment long, total long, page_id long, uri string, "
           "refers_to string, content binary")
_BATCH_BYTES = 8 << 20


def record_id(page_id: int | None, digest: str) -> str:
    return uuid.UUID(bytes=hashlib.sha256(f"{page_id}:{digest}".encode()).digest()[:16]).urn


def _chunked(payload: bytes, chunk: int) -> bytes:
    parts = []
    for at in range(0, len(payload), chunk):
        piece = payload[at:at + chunk]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _dechunked(body: bytes) -> bytes | None:
    """The payload of chunked framing, or None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            return None
        parts.append(body[at:at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None, segment_bytes: int,
                 chunk_bytes: int, date: str) -> Iterator[bytes]:
    """The records of one page: a revisit, one response, or a response and its continuations."""
    own = record_id(page_id, digest)
    uri = None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    fields = [("WARC-Record-ID", f"<{own}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-ID", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if keeper is not None and keeper != page_id:
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", _PROFILE),
                       ("WARC-Refers-To", f"<{record_id(keeper, digest)}>"), kind], http)
        return
    block = http + _chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *fields, kind], block)
        return
    count = -(-len(block) // segment_bytes)
    yield _record([("WARC-Type", "response"), *fields, kind, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for n in range(2, count + 1):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id(n, own)}>"), ("WARC-Date", date),
                       ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", n),
                       ("WARC-Segment-Total-Length", len(block) if n == count else None)],
                      block[(n - 1) * segment_bytes:n * segment_bytes])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_revisit_bytes: int = 100, segment_bytes: int = 1 << 15, chunk_bytes: int = 1 << 12,
          date: str = "2026-01-01T00:00:00Z") -> None:
    """Write the archive of a page table to a folder that does not exist yet.

    Payloads of ``min_revisit_bytes`` or more that are equal are stored once, by the smallest id; the others revisit
    it. A null payload is empty, a null url is left out, a page with a null id revisits a named page if there is one.
    Rows that repeat both id and payload give equal records. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keepers = (rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest")
               .agg(F.min("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper"))
    keepers, _ = keep(keepers, "equal-payloads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for values in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, url, payload, digest, keeper = (v.as_py() for v in values)
                for record in page_records(page_id, url, payload, digest, keeper, segment_bytes, chunk_bytes, date):
                    out.append(record)
                    size += len(record)
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
    (small_batches(rows).join(bounded_broadcast(keepers, wide=True), "digest", "left").select("page_id", "url", "payload", "digest", "keeper")
     .mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR.decode()).option("compression", "gzip").text(path))


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records in a stream of the bytes between separators.

    A block may hold separators, and line breaks at its end shift the one behind it. So a block is taken by its length
    from the pieces with separators put back, and line breaks before the next record are skipped.
    """
    rest = b""
    while True:
        rest = rest.lstrip(b"\r\n")
        while not rest:
            piece = next(pieces, None)
            if piece is None:
                return
            rest = piece.lstrip(b"\r\n")
        head, found, rest = rest.partition(SEPARATOR)
        fields = _parsed(head)
        length = int(fields["content-length"])
        parts = [rest if found else next(pieces, b"")]
        have = len(parts[0])
        while have < length:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError(f"record {fields.get('warc-record-id')} ends after {have} of {length} bytes")
            parts.append(piece)
            have += len(SEPARATOR) + len(piece)
        data = SEPARATOR.join(parts)
        rest = data[length:]
        yield fields, data[:length]


def records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """Every record of an archive: its fields and its block; or only those that are (or are not) parts of a segmented one.

    ``origin_id`` is the id under which the segments of one record meet, its own id for the first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[bytes]:
            for batch in batches:
                for value in batch.column(0):
                    yield value.as_py()
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist(rows, schema)
            rows.clear()
            return done
        for fields, block in _records(pieces()):
            number = fields.get("warc-segment-number")
            if segmented is not None and segmented != (number is not None):
                continue
            own = fields["warc-record-id"].strip("<>")
            rows.append({
                "type": fields["warc-type"], "record_id": own,
                "origin_id": fields.get("warc-segment-origin-id", own).strip("<>"),
                "segment": None if number is None else int(number),
                "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None,
                "page_id": int(fields["page-id"]) if "page-id" in fields else None, "uri": fields.get("warc-target-uri"),
                "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                "content": block})
            size += len(block)
            if size >= _BATCH_BYTES:
                yield flush()
                size = 0
        yield flush()
    schema = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int64()),
                        ("total", pa.int64()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to", pa.string()),
                        ("content", pa.binary())])
    lines = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, _RECORD)


def _payloads(blocks: DataFrame) -> DataFrame:
    """The block column ``content`` replaced by the decoded payload; null where length or framing is wrong."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            out = []
            for value in batch.column(names.index("content")):
                block = value.as_py()
                head, cut, body = (block or b"").partition(SEPARATOR)
                if block is None or not cut:
                    out.append(None)
                else:
                    out.append(_dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body)
            yield pa.RecordBatch.from_arrays([batch.column(n) if n != "content" else pa.array(out, pa.binary())
                                              for n in names], names=names)
    return blocks.mapInArrow(run, blocks.schema)


def responses(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, uri, content): every response with its whole payload.

    Segments meet under their origin's id, in order of their number; a record whose numbers have a gap or whose length
    is not the declared total has a null payload, and so has broken chunk framing. Equal records, as repeated rows of a page
    table give them, come out as often as their first segment stands in the archive.
    """
    single = records(spark, path, segmented=False).where("type = 'response'").select("record_id", "page_id", "uri", "content")
    parts = records(spark, path, segmented=True).groupBy("origin_id").agg(
        F.max("page_id").alias("page_id"), F.max("uri").alias("uri"), F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("segment", "content"))).alias("parts"), F.count_if(F.col("segment") == 1).alias("copies"))
    last = F.element_at("parts", -1)["segment"]
    # One joining pass over the parts, which are those of a single page.
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["content"])), ""))
    whole = F.when((last == F.size("parts")) & (F.octet_length(whole) == F.col("total")), whole)
    joined = parts.select(F.col("origin_id").alias("record_id"), "page_id", "uri", whole.alias("content"),
                          F.explode(F.array_repeat(F.lit(0), F.greatest("copies", F.lit(1)).cast("int"))).alias("_")).drop("_")
    return _payloads(single.unionByName(joined))


def page_table(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page in an archive.

    A revisit has size and digest of the payload it refers to. Every record gives a row, equal ones too.
    """
    found = responses(spark, path).select("record_id", "page_id", F.octet_length("content").cast("long").alias("payload_bytes"),
                                          F.sha2("content", 256).alias("payload_digest"))
    stored, _ = keep(found, "responses")
    again, _ = keep(records(spark, path, segmented=False).where("type = 'revisit'")
                    .select("record_id", "page_id", "refers_to"), "revisits")
    target = stored.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("kept"), "payload_bytes",
                           "payload_digest").distinct()
    revisits = again.join(target, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("kept").alias("refers_to"))
    return stored.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                         F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Archive a page table in the shared folder and read it back as ``page_table``; an empty table gives no rows."""
    path = work_dir(pages.sparkSession, "warc")
    write(pages, path, **how)
    return page_table(pages.sparkSession, path)
