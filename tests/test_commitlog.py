"""Several writers on one store: an order for all commits, no half of one, no stale one."""

import datetime as dt
import threading

import pytest

from orderlens.sources.commitlog import CommitConflict, CommitLog
from orderlens.sources.fs import create_if_absent, list_entries, read_text


@pytest.fixture()
def log(spark, tmp_path):
    return CommitLog(spark, f"{tmp_path}/a store")


def put(log, n, *tables, reads=()):
    t = log.begin(reads)
    for name in tables or ("t",):
        t.write(log.spark.range(n), name)
    return t


def size(log, table="t", at=None):
    return log.read(table, at).count()


def test_two_writers_in_one_second(log):
    a, b = put(log, 1), put(log, 2)
    assert a.id[:15] <= b.id[:15] and a.id != b.id
    assert (b.commit(), a.commit()) == (1, 2)
    assert size(log) == 1 and size(log, at=1) == 2 and [n for n, _ in log.history("t")] == [1, 2]


def test_many_writers_at_once(log):
    """All of them get a number of their own, and nobody's commit is lost."""
    ready = [put(log, i, f"t{i}", "shared") for i in range(8)]
    numbers, gate = [], threading.Barrier(8)

    def commit(t):
        gate.wait()
        numbers.append(t.commit())

    threads = [threading.Thread(target=commit, args=(t,)) for t in ready]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(numbers) == list(range(1, 9)) == log.numbers()
    assert {t for t in log.entry(8)["tables"]} == {"shared", *[f"t{i}" for i in range(8)]}
    assert [size(log, f"t{i}") for i in range(8)] == list(range(8))
    last = log.entry(8)["tables"]["shared"]
    assert last == next(t.id for t in ready if t.written[0] == log.entry(8)["changed"][1])


def test_tables_appear_together(log):
    t = put(log, 3, "a", "b")
    with pytest.raises(FileNotFoundError):
        log.read("a")
    t.commit()
    assert size(log, "a") == size(log, "b") == 3
    u = put(log, 4, "a")
    assert size(log, "a") == 3
    u.commit()
    assert (size(log, "a"), size(log, "b"), size(log, "a", 1)) == (4, 3, 3)


def test_stale_input_is_a_conflict(log):
    put(log, 3, "a").commit()
    t = log.begin()
    t.write(t.read("a").limit(1), "derived")
    put(log, 9, "other").commit()  # another table: no conflict
    u = log.begin()
    u.write(u.read("a"), "derived2")
    assert t.commit() == 3
    put(log, 5, "a").commit()
    with pytest.raises(CommitConflict, match="a"):
        u.commit()
    u.abort()
    assert list_entries(log.spark, f"{log.store}/derived2") == []
    with pytest.raises(CommitConflict):
        t2 = log.begin(["a"])
        put(log, 6, "a").commit()
        t2.commit()


def test_retry_empty_and_drop(log):
    t = log.begin()
    t.write(log.spark.range(5), "t")
    t.write(log.spark.range(7).where("id < 0"), "t")  # a job that ran again, with no rows
    t.commit()
    assert log.read("t").columns == ["id"] and size(log) == 0
    d = log.begin()
    d.drop("t")
    d.commit()
    with pytest.raises(FileNotFoundError):
        log.read("t")
    assert size(log, at=1) == 0
    for bad in ("", "_log", "a/b", ".x"):
        with pytest.raises(ValueError):
            t.write(log.spark.range(1), bad)


def test_prune(log):
    for n in range(1, 5):
        put(log, n, "t").commit()
    put(log, 1, "u").commit()
    dead = put(log, 99, "t")  # never commits
    assert log.prune(keep=2) == [] and log.numbers() == [4, 5]  # young folders stay
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=2)
    removed = log.prune(keep=2, now=later)
    assert len(removed) == 4 and any(dead.id in r for r in removed)
    assert size(log) == 4 and size(log, "u") == 1
    assert put(log, 6, "t").commit() == 6
    with pytest.raises(ValueError):
        log.prune(keep=0)


def test_create_if_absent(spark, tmp_path):
    path = f"{tmp_path}/x y/f"
    assert create_if_absent(spark, path, "one") and not create_if_absent(spark, path, "two")
    assert read_text(spark, path) == "one" and [n for n, _ in list_entries(spark, f"{tmp_path}/x y") if not n.endswith(".crc")] == ["f"]


def test_create_if_absent_by_rename(spark, tmp_path):
    """A file system that is not the local one: a mount of it under another scheme."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logtest.link./m", f"file://{tmp_path}")
    path = "viewfs://logtest/m/d/f"
    assert create_if_absent(spark, path, "one") and not create_if_absent(spark, path, "two")
    assert read_text(spark, path) == "one"
