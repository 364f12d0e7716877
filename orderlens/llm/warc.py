"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing: a page is an HTTP response with chunked transfer framing. A block longer than a segment
becomes a first record and continuation records. A page whose payload another page has is a revisit.
Reading: records are parsed file by file; continuation records are grouped by their origin's
identifier, ordered by segment number, checked against the total length and decoded.

Archives go through Spark's own text writer (a record is a row, the end of a record its line end) and
binary reader, so they can be in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.llm.store import Scratch

#: Bytes of a record's block at most; what is longer is segmented.
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: With SEGMENT_BYTES this bounds an archive file (64 MB before compression), which is read whole.
RECORDS_PER_FILE = 4000
#: Smaller payloads are always written.
LEAST_REVISIT_BYTES = 1000
#: The table of repeated payloads is broadcast up to this many rows (about 100 bytes each) and joined by
#: a shuffle beyond.
MOST_BROADCAST_ROWS = 100_000
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken or cut off."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_id(*parts: object) -> str:
    """The same for the same page: a row that is repeated gives the same records again."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, first_url: str | None,
                 segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of a page, without the final line ends; ``first`` is the page that a revisit refers to."""
    sha = hashlib.sha1(payload)
    own = record_id(page_id, url, sha.hexdigest())
    target = (url or "").encode("unicode_escape").decode().replace(" ", "%20") or None
    common = [("WARC-Record-ID", own), ("WARC-Date", "2026-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Page-ID", page_id),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha.digest()).decode()), ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", record_id(first, first_url, sha.hexdigest()))], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    pieces = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(own, n)), ("WARC-Date", "2026-01-01T00:00:00Z"),
                       ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n),
                       ("WARC-Segment-Total-Length", len(block) if n == len(pieces) else None)], piece)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of the records of an archive, compressed or not."""
    data = gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, segment_bytes: int = SEGMENT_BYTES,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a WARC record (and its continuations) for each row of ``pages`` (page_id, url, html).

    Of the rows whose equal payloads have LEAST_REVISIT_BYTES at least, those with the largest page_id
    (of equal ids the largest url) are responses, the others revisits. A null html is an empty payload;
    a null page_id comes before all others.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha1(html.cast("binary")).alias("digest"))
    chosen = F.struct("page_id", "url")
    repeated = scratch.write(rows.where(F.col("n") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(
        F.max(chosen).alias("first"), F.count("*").alias("c")).where("c > 1").select(F.col("digest").alias("_digest"), "first"), "repeated")
    if repeated.count() <= MOST_BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = rows.join(repeated, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(chosen)
    joined = joined.select("page_id", "url", "html", revisit.alias("revisit"), F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                page, url, text, again, first, first_url = (c[i].as_py() for c in batch.columns)
                for r in page_records(page, url, text.encode(), first if again else None, first_url, segment_bytes):
                    out.append(r)
                    size += len(r)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (joined.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.mode("overwrite").option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(folder))


_PARSED = "record_id string, type string, page_id string, refers_to string, origin string, segment int, total long, digest string, payload binary, block binary"


def read_archives(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """page_id, record_id, type, refers_to, digest (of the header), complete, payload: a row for each
    response and revisit record in the archives under ``folder``.

    A segmented record is complete when its segments are numbered 1, 2, ... without gaps, the last names
    the total length, the lengths add up to it, and the chunks decode; else its payload is null. Equal
    records that occur again are read back as often as they occur.
    """
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARSED.split(", ")]
        types = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            for archive in batch.column("content"):
                out, size = [], 0
                for f, block in parse(archive.as_py()):
                    segment = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    whole = segment is None and f["warc-type"] == "response"
                    own = f.get("warc-record-id")
                    out.append((own, f["warc-type"], f.get("warc-page-id"), f.get("warc-refers-to"), f.get("warc-segment-origin-id", own), segment,
                                int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                                f.get("warc-payload-digest"), payload_of(block) if whole else None, block if segment is not None else None))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                parts = row["parts"]
                block = b"".join(p["block"] for p in parts)
                payload = None
                if [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block):
                    try:
                        payload = payload_of(block)
                    except ValueError:
                        pass
                yield pa.RecordBatch.from_arrays([pa.array([row["record_id"]]), pa.array([row["page_id"]], pa.string()), pa.array([row["digest"]], pa.string()),
                                                  pa.array([payload], pa.binary()), pa.array([row["times"]])], ["record_id", "page_id", "digest", "payload", "times"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    records = scratch.write(files.mapInArrow(parsed, _PARSED), "records")
    whole = records.where("segment is null and type in ('response', 'revisit')").select(
        "page_id", "record_id", "type", "refers_to", "digest", (F.col("payload").isNotNull() | (F.col("type") == "revisit")).alias("complete"), "payload")
    segments = (records.where("segment is not null").groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("segment", "total", "block"))).alias("parts"),
        F.max(F.when(F.col("segment") == 1, F.col("page_id"))).alias("page_id"), F.max("digest").alias("digest"),
        F.sum(F.when(F.col("segment") == 1, 1).otherwise(0)).alias("times")).withColumnRenamed("origin", "record_id"))
    whole_again = (segments.mapInArrow(joined, "record_id string, page_id string, digest string, payload binary, times long")
                   .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).where("times > 0")
                   .select("page_id", "record_id", F.lit("response").alias("type"), F.lit(None).cast("string").alias("refers_to"), "digest",
                           F.col("payload").isNotNull().alias("complete"), "payload"))
    return whole.unionByName(whole_again)


def round_trip(pages: DataFrame, scratch: Scratch | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each row of ``pages``, all taken
    from the archives that were written and read back.

    Digests are of decoded payloads; a revisit has those of the response it refers to. Null urls and ids
    are kept, null html is an empty payload, repeated rows come back as often, rows with the same id and
    payload but another url are told apart, an empty table gives no rows, other columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    write_archives(pages, f"{scratch.root}/archives", scratch, segment_bytes)
    got = read_archives(pages.sparkSession, f"{scratch.root}/archives", scratch)
    kind = pages.schema["page_id"].dataType.simpleString()
    got = scratch.write(got.select(F.col("page_id").cast(kind).alias("page_id"), "record_id", "type", "refers_to", F.octet_length("payload").cast("long").alias("n"),
                                   F.sha1("payload").alias("sha")), "read")
    responses = got.where("type = 'response'")
    answer = (responses.where(F.col("n") >= LEAST_REVISIT_BYTES).groupBy("record_id").agg(F.max("page_id").alias("_page"), F.max("n").alias("_n"), F.max("sha").alias("_sha"))
              .withColumnRenamed("record_id", "_id"))
    answer = scratch.write(answer.join(got.where("refers_to is not null").select(F.col("refers_to").alias("_id")), "_id", "left_semi"), "answers")
    again = got.where("type = 'revisit'").join(answer, F.col("refers_to") == F.col("_id"), "left")
    return (responses.select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"),
                             F.lit(None).cast(kind).alias("refers_to"))
            .unionByName(again.select("page_id", F.col("_n").alias("payload_bytes"), F.col("_sha").alias("payload_digest"), F.col("type").alias("record_type"),
                                      F.col("_page").alias("refers_to"))))
