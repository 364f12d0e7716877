import gzip
import hashlib

from orderlens.llm.store import Scratch
from orderlens.llm.warc import END, chunked, page_records, parse, payload_of, read_archives, round_trip, unchunked


def test_chunks():
    for payload in (b"", b"x", b"\r\n0\r\n\r\n" * 3000):
        assert unchunked(chunked(payload, 7)) == payload


def want(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and len(payload) >= 1000]
        first = max((p for p in same if p is not None), default=None)
        again = bool(same) and page != first
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    big, odd = "é" * 9000 + "\r\n\r\nWARC/1.1\r\n", "日本\r\n0\r\n\r\n" * 900
    rows = [(1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "short"), (4, "u", "short"), (5, "http://a/5", big), (6, "http://a/ 6\r\nX: y", big), (7, "http://a/7", odd),
            (8, "u8", odd + "!"), (8, "u8", odd + "!"), (9, "u9", "x" * 999), (10, "u10", "x" * 999), (11, "u11", "x" * 1000), (12, "u12", "x" * 1000), (None, "u13", "x" * 1000),
            (14, "http://long", "L" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    for segment in (500, 16 << 10):
        got = sorted((tuple(r) for r in round_trip(df, segment_bytes=segment).collect()), key=str)
        assert got == want(rows)
    assert round_trip(df.limit(0)).count() == 0


def test_damage_is_seen(spark):
    """A record whose segments are incomplete, and one whose total length is wrong, have no payload."""
    scratch = Scratch(spark, "test")
    whole, missing, wrong = (list(page_records(i, f"u{i}", b"p%d" % i * 500, None, None, 300)) for i in (1, 2, 3))
    wrong[-1] = wrong[-1].replace(b"Segment-Total-Length: ", b"Segment-Total-Length: 9")
    records = [*whole[::-1], *missing[:1], *missing[2:], *wrong]
    spark.createDataFrame([(r.decode(),) for r in records], "value string").write.option("lineSep", END).option("compression", "gzip").text(f"{scratch.root}/a")
    got = {r.page_id: r for r in read_archives(spark, f"{scratch.root}/a", scratch).collect()}
    assert bytes(got["1"].payload) == b"p1" * 500 and got["1"].complete
    assert got["2"].payload is None and not got["2"].complete and got["3"].payload is None and not got["3"].complete
    archive = gzip.compress(b"".join(r + END.encode() for r in whole))
    assert payload_of(b"".join(block for _, block in parse(archive))) == b"p1" * 500
