"""Periodic runs against plain comparison of all words with those q before, for every q."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from orderlens.llm import periodic
from orderlens.llm.periodic import COVER, Lce, V, find_runs, periodic_runs
from orderlens.llm.queries import QUERIES

from .conftest import ODD_ROWS, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """(start, length, period) of all runs, by definition."""
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    n, found = len(x), {}
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([False], x[:-q] == x[q:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            length = int(b - a) + q
            if length >= max(6, 4 * q):
                found.setdefault((int(a), length), q)  # periods ascend: the first is the least
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(words):
    runs = brute_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return runs, best, " ".join(w for i, w in enumerate(words) if i not in drop)


def test_cover():
    assert len(COVER) * (len(COVER) - 1) == V - 1
    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=130), st.integers(1, 9), st.integers(0, 60))
def test_lce(x, p, n):
    x = np.array((x + x[-p:] * n)[:400], np.int64)
    if len(x) < 2:
        return
    i, j = np.triu_indices(len(x), 1)
    pick = np.linspace(0, len(i) - 1, min(len(i), 400)).astype(int)
    i, j = i[pick], j[pick]
    want = [next((k for k in range(len(x) - b) if x[a + k] != x[b + k]), len(x) - b) for a, b in zip(i, j, strict=True)]
    assert Lce(x).query(i, j).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 12)), max_size=6), max_size=4), st.integers(20, 1 << 20))
def test_runs(texts, step):
    texts = [[w for block, times in t for w in block * times] for t in texts]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    before, periodic.GRID_STEP = periodic.GRID_STEP, step
    try:
        got = find_runs(np.array([w for t in texts for w in t], np.int64), off)
    finally:
        periodic.GRID_STEP = before
    want = [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]
    assert list(zip(*(c.tolist() for c in got), strict=True)) == want


def test_long_and_nested_runs():
    rng = np.random.default_rng(5)
    inner = [0, 1] * 6 + [2]
    texts = [[7] * 5, [7] * 6, list(rng.integers(0, 9, 700)) * 5, (inner * 5 + list(rng.integers(0, 50, 40))) * 4, list(range(3000)), [1] * 4000]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    got = find_runs(np.concatenate([np.array(t, np.int64) for t in texts]), off)
    assert list(zip(*(c.tolist() for c in got), strict=True)) == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]


def test_a_hash_that_meets_is_told_apart(monkeypatch):
    real, seeds = periodic.span_sums, []

    def first_time_equal(words, size):
        seeds.append(1)
        return real(words, size) * np.uint64(len(seeds) > 1)

    monkeypatch.setattr(periodic, "span_sums", first_time_equal)
    x = np.arange(200) % 17
    assert Lce(x).query(np.array([0, 3]), np.array([17, 5])).tolist() == [183, 0] and len(seeds) == 2


def test_odd_rows(spark, make_docs):
    rows = [*ODD_ROWS, (15, "a b " * 9 + "c"), (15, "a b " * 9 + "c"), (None, "x\t" * 8), (16, "Aa aa " * 4), (17, ("é " * 3 + "q\n") * 50_000)]
    got = periodic_runs(make_docs(rows)).collect()
    huge = (11, 14, 17)
    want = [(d, *brute(WORD.findall(t or ""))) for d, t in rows if d not in huge]
    short = [(r.doc_id, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in got if r.doc_id not in huge]
    assert sorted(short, key=str) == sorted(want, key=str)
    assert all(not r.runs and r.best is None and len(r.collapsed.split()) >= 30_000 for r in got if r.doc_id in (11, 14))
    long = next(r for r in got if r.doc_id == 17)
    assert tuple(long.best) == (0, 200_000, 4) and long.collapsed == "é é é q" and len(long.runs) == 1
    assert periodic_runs(make_docs([])).collect() == []


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("sf", [SF])
def test_query_on_a_whole_table(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        runs, best, collapsed = brute(planted(r.doc_id, WORD.findall(r.text or "")))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[r.doc_id] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                          *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, collapsed)))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, sf).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert got == want and any(w[0] for w in want.values())
