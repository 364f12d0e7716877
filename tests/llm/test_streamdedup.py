"""Streaming exact deduplication against a plain grouping by full text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from orderlens.llm.queries import QUERIES
from orderlens.llm.store import Scratch
from orderlens.llm.streamdedup import StreamingDedup, exact_dedup

from .conftest import ODD_ROWS, SF

weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))  # noqa: E731  256 digests: most hits differ


def brute(rows):
    """Sorted (doc_id, keep_id, group_size) of each row, and the kept (doc_id, text), one a group."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return (sorted(((i, last[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str),
            sorted(((last[t], hashlib.sha256(t.encode()).hexdigest()) for t in groups), key=str))


def check(result, rows):
    got = result.select("doc_id", "keep_id", "group_size", "kept").collect()
    want, keep = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    assert sorted((str(r.doc_id) for r in got if r.kept)) == sorted(str(k[0]) for k in keep)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def put(make_docs, rows, path, mode="append", files=2):
    make_docs(rows).repartition(files).write.mode(mode).parquet(path)


@pytest.mark.parametrize("digest", [None, weak], ids=["sha256", "weak"])
def test_odd_rows(spark, make_docs, tmp_path, digest):
    put(make_docs, ODD_ROWS, f"{tmp_path}/docs")
    scratch = Scratch(spark, "test")
    got = exact_dedup(spark, f"{tmp_path}/docs", scratch, **({"digest": digest} if digest else {}))
    check(got, ODD_ROWS)
    if not digest:
        want, _ = brute(ODD_ROWS)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got.collect()), key=str) == want


@pytest.mark.parametrize("digest", [None, weak], ids=["sha256", "weak"])
def test_state_goes_on_over_batches_and_calls(spark, make_docs, tmp_path, digest):
    path, store = f"{tmp_path}/docs", f"{tmp_path}/store"
    rows = [(i, f"text {i % 70}") for i in range(400)]
    make = lambda: StreamingDedup(spark, path, store, files_per_batch=1, **({"digest": digest} if digest else {}))
    put(make_docs, rows, path, files=3)
    first = make()
    first.ingest()
    check(first.result(), rows)
    # a third of all rows share a text; larger and smaller ids, an id twice, ids without a number
    more = [(1000 + i, "text 5" if i % 3 else f"new {i}") for i in range(300)] + [(-3, "text 6"), (1003, "text 7"), (None, "text 8"), (None, "only null")]
    put(make_docs, more, path, files=2)
    again = make()  # a new process: all it knows lies in the store
    again.ingest()
    check(again.result(), rows + more)
    batches = [p.name for p in (tmp_path / "store" / "changes").iterdir()]
    assert len(batches) > 2
    again.ingest()  # nothing new
    check(again.result(), rows + more)


def test_state_is_on_disk_and_the_session_setting_stays(spark, make_docs, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    put(make_docs, [(1, "a"), (2, "a")], f"{tmp_path}/docs")
    dedup = StreamingDedup(spark, f"{tmp_path}/docs", f"{tmp_path}/store")
    dedup.ingest()
    assert spark.conf.get(key, None) == before
    entry, = dedup.state().collect()
    assert entry.n == 2 and entry.last.doc_id == 2 and entry.last.file.endswith(".parquet")
    kept = [p.name for p in (tmp_path / "store" / "checkpoint-state" / "state").rglob("*")]
    assert any(n.endswith((".changelog", ".zip")) for n in kept)


def test_empty_table_and_clashing_metadata_column(spark, make_docs, tmp_path):
    put(make_docs, [], f"{tmp_path}/none")
    assert exact_dedup(spark, f"{tmp_path}/none").collect() == []
    rows = [(1, "a"), (2, "a"), (3, "b")]
    make_docs(rows).withColumn("_metadata", F.lit("x")).withColumn("bucket", F.lit("y")).withColumn("file", F.lit("z")).write.parquet(f"{tmp_path}/clash")
    check(exact_dedup(spark, f"{tmp_path}/clash"), rows)


def test_query_on_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op11_streaming_exact_dedup"](spark, SF)
    want, _ = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=str) == want
    check(got, rows)
