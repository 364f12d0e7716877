"""Runs of periodically repeated words, found with longest common extensions from a difference cover.

A run of period q repeats its words q apart and is at least four periods long, so three neighbouring points
of the grid 0, q, 2q, ... of its text lie in it and agree with the point after them. The grids of all periods
are walked together (n ln n points, as harmonic sums go); where three neighbours agree, the longest common
extension (LCE) to the right and to the left of two points q apart gives the whole run.

An LCE query first compares a few words, until both sides reach positions of a sample: those whose number
modulo V lies in a difference cover, so that for any two positions some shift below V takes both into the
sample. Only the sampled suffixes are sorted, by blocks of V words: one naming round for the blocks, then
doublings. The extension is then the range minimum (sparse table) of their neighbours' common block counts,
and again a few words within the block that differs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from orderlens.llm.suffixes import span_sums
from orderlens.llm.words import mix, text_chunks

#: A perfect difference set: every number modulo V is the difference of two members.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
_D = len(COVER)
_IN_COVER = np.full(V, -1)
_IN_COVER[list(COVER)] = np.arange(_D)
#: Least shift that takes positions with these remainders into the cover.
_SHIFT = np.array([[next(d for d in range(V) if _IN_COVER[(a + d) % V] >= 0 and _IN_COVER[(b + d) % V] >= 0) for b in range(V)] for a in range(V)])

#: A run has this many periods, and this many words.
PERIODS, SHORTEST = 4, 6
#: Grid points looked at a time, and bytes of text worked on at a time: bound the working arrays.
GRID_STEP, PART_BYTES = 1 << 20, 1 << 20


class Lce:
    """Longest common extensions between positions of one sequence of non-negative numbers."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x = np.concatenate((x.astype(np.int64), -1 - np.arange(2 * V)))  # the end differs from everything
        turn = np.arange(-(-(n + V) // V)) * V
        self.at = (turn[:, None] + np.array(COVER)).ravel()
        self.at = self.at[self.at < n + V]
        m = len(self.at)
        names = [self._blocks()]
        while names[-1].max(initial=-1) < m - 1:
            step = _D << (len(names) - 1)
            after = np.zeros(m, np.int64)
            after[:max(m - step, 0)] = names[-1][step:] + 1
            names.append(self._named(names[-1] * (m + 1) + after))
        self.rank = names[-1]
        order = np.argsort(self.rank)
        a, b = order[:-1], order[1:]
        common = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(names) - 2, -1, -1):
            inside = np.maximum(a, b) < m
            equal = inside & (names[k][np.where(inside, a, 0)] == names[k][np.where(inside, b, 0)])
            common += equal.astype(np.int64) << k
            a, b = a + equal * (_D << k), b + equal * (_D << k)
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            half = 1 << (len(self.table) - 1)
            low = self.table[-1]
            self.table.append(np.minimum(low[:-half], low[half:]))

    @staticmethod
    def _named(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(new) - 1
        return out

    def _blocks(self) -> np.ndarray:
        """Names of the blocks at the sampled positions: equal exactly for equal blocks. Blocks are told apart
        by hash, and neighbours of one hash are compared; should two differ, the next seed is tried."""
        for seed in range(1 << 20):
            with np.errstate(over="ignore"):
                h = span_sums(mix(self.x.view(np.uint64) + np.uint64(seed)), V)[self.at]
            order = np.argsort(h, kind="stable")
            p, q = self.at[order][:-1], self.at[order][1:]
            same = h[order][:-1] == h[order][1:]
            p, q = p[same], q[same]
            if all((self.x[p + k] == self.x[q + k]).all() for k in range(V)):
                return self._named(h)
        raise RuntimeError("no seed tells the blocks apart")

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on, up to ``most`` (at most V) of them."""
        out = np.zeros(len(i), np.int64)
        alive = np.arange(len(i))
        for t in range(V):
            alive = alive[most[alive] > t]
            alive = alive[self.x[i[alive] + t] == self.x[j[alive] + t]]
            if not len(alive):
                break
            out[alive] = t + 1
        return out

    def query(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of positions i < j <= n: how many words agree from them on."""
        shift = _SHIFT[i % V, j % V]
        out = self._compare(i, j, shift)
        on = np.flatnonzero(out == shift)
        a, b = i[on] + shift[on], j[on] + shift[on]
        ra, rb = (self.rank[p // V * _D + _IN_COVER[p % V]] for p in (a, b))
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        width = (high - low).astype(np.int64)
        level = np.frexp(width)[1] - 1
        blocks = np.zeros(len(on), np.int64)
        for k, row in enumerate(self.table):
            of = level == k
            blocks[of] = np.minimum(row[low[of]], row[high[of] - (1 << k)])
        a, b = a + V * blocks, b + V * blocks
        out[on] += V * blocks + self._compare(a, b, np.full(len(on), V))
        return out


def _grid(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, position) where x agrees at three neighbouring grid points with the next one: of every
    stretch of such points each third, so that no run is passed over."""
    counts = np.diff(off)
    most = np.where(counts >= SHORTEST, counts // PERIODS, 0)
    first = np.cumsum(most) - most
    total = int(most.sum())
    found = [(np.zeros(0, np.int64),) * 3]
    a = 0
    while a < total:
        # the (text, period) pairs that come next, up to GRID_STEP points
        pair = np.arange(a, min(total, a + GRID_STEP))
        text = np.searchsorted(first, pair, "right") - 1
        period = pair - first[text] + 1
        points = (counts[text] - 1) // period
        take = max(1, int(np.searchsorted(np.cumsum(points), GRID_STEP, "right")))
        a += take
        text, period, points = text[:take], period[:take], points[:take]
        begin = np.cumsum(points) - points
        of = np.repeat(np.arange(take), points)
        k = np.arange(len(of)) - begin[of]
        q = period[of]
        at = off[text][of] + k * q
        equal = x[at] == x[at + q]
        place = np.arange(len(of))
        stretch = np.where(equal, 0, place + 1)
        stretch[begin] = np.where(equal[begin], begin, begin + 1)
        stretch = np.maximum.accumulate(stretch)
        third = equal & ((place - stretch) % 3 == 2)
        found.append((text[of[third]], q[third], at[third]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def find_runs(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start within the text, length, period) of every run of the texts ``x[off[i]:off[i + 1]]``,
    ordered by text, start and period."""
    text, q, at = _grid(x, off)
    none = (np.zeros(0, np.int64),) * 4
    if not len(text):
        return none
    # only texts with a candidate are sorted
    some = np.unique(text)
    sizes = np.diff(off)[some]
    start = np.cumsum(sizes) - sizes
    part = np.concatenate([x[off[t]:off[t + 1]] for t in some])
    own = np.searchsorted(some, text)
    at = at - off[text] + start[own]
    n = len(part)
    right = np.minimum(Lce(part).query(at, at + q), (start + sizes)[own] - at - q)
    left = np.minimum(Lce(part[::-1]).query(n - at - q, n - at), at - start[own])
    begin, length = at - left - start[own], left + q + right
    keep = length >= np.maximum(SHORTEST, PERIODS * q)
    text, begin, length, q = text[keep], begin[keep], length[keep], q[keep]
    # a run is found for its multiples as well, from several points: the least period of a stretch is its own
    order = np.lexsort((q, length, begin, text))
    text, begin, length, q = text[order], begin[order], length[order], q[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    text, begin, length, q = text[new], begin[new], length[new], q[new]
    order = np.lexsort((q, begin, text))
    return text[order], begin[order], length[order], q[order]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and where each text's begin."""
    split = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), "[ \t\n\x0b\x0c\r]+")
    flat, bounds = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), before[bounds - bounds[0]]


#: Given the doc_ids and word counts of some texts: (text, new order of its words) for those to be rearranged.
Rearrange = Callable[[list, np.ndarray], list[tuple[int, np.ndarray]]]

SPAN = "struct<start: long, length: long, period: long>"
RUNS = f"doc_id long, runs array<{SPAN}>, best {SPAN}, collapsed string"
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _part(doc_ids: pa.Array, texts: pa.Array, rearrange: Rearrange | None) -> pa.RecordBatch:
    words, off = _words(texts)
    n = len(off) - 1
    if rearrange is not None:
        order = np.arange(len(words))
        for i, places in rearrange(doc_ids.to_pylist(), np.diff(off)):
            order[off[i]:off[i + 1]] = off[i] + places
        words = words.take(pa.array(order))
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    text, start, length, period = find_runs(ids, off)
    of = np.searchsorted(text, np.arange(n + 1))
    best = [None] * n
    for i in np.unique(text):
        r = range(of[i], of[i + 1])
        k = min(r, key=lambda k: (-Fraction(int(length[k]), int(period[k])), start[k], period[k]))
        best[i] = {"start": int(start[k]), "length": int(length[k]), "period": int(period[k])}
    # words after the first period of a run go
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, off[text] + start + period, 1)
    np.add.at(edge, off[text] + start + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(keep)))[off]
    kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep)))
    spans = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], fields=list(_SPAN))
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(of, pa.int32()), spans), pa.array(best, _SPAN),
                                       pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())], ["doc_id", "runs", "best", "collapsed"])


def periodic_runs(docs: DataFrame, rearrange: Rearrange | None = None) -> DataFrame:
    """doc_id, runs, best, collapsed for each row of ``docs`` (doc_id, text).

    Words are runs of non-space bytes, numbered from 0. A run is a stretch of words with smallest period q, of
    at least four periods and six words, that neither neighbour extends with that period; ``runs`` lists them by
    start and period. ``best`` is the one of most periods (exact fraction; ties: smallest start, then period),
    null without runs. ``collapsed`` is the text without the words that some run holds after its first period,
    joined by single spaces. ``rearrange`` may reorder a text's words before.

    Null and empty texts have no runs and an empty collapsed text; rows are judged one by one, so repeated rows
    and null ids do not matter; texts are read whole, whatever their length (working memory follows the longest);
    an empty table gives no rows; other columns are ignored. doc_id must be a whole number.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text", PART_BYTES):
                yield _part(part.column("doc_id"), part.column("text"), rearrange)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, RUNS)
