"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are searched inside long documents. Documents are partitioned by size, and each size
class has MinHash sketches with a number of bins in proportion to its size, so that a shingle of an item
keeps a constant chance to be the minimum of its bin however long the document is. An item is a candidate
when any of its bin minima is the document's minimum too; candidates are verified by exact containment of
shingles. The number of sketches follows from the smallest item so that a contained item is missed with
a probability below MISS.

Items go to the tasks in blocks of a bounded number; every block is compared with all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orderlens.llm.words import Words, mix, shingle_hashes, text_chunks, unique

SHINGLE_WORDS = 5
PERCENT = 80
#: Items in a block, which bounds what is broadcast at once.
ITEM_BLOCK = 20_000
MISS = 1e-12
#: Least chance that a shared shingle is the minimum of its bin in both sketches, at two bins or more
#: for each shingle of either side.
SURVIVES = 0.6
#: Bin minima a worker keeps; beyond that they are computed again.
CACHE_BYTES = 32 << 20
#: Items whose shingle counts are within a power of two share their number of sketches.
MAX_CLASS = 40


def sketches_for(size: int, percent: int = PERCENT) -> int:
    shared = max(1, math.ceil(percent * size / 100))
    return max(1, math.ceil(math.log(MISS) / (shared * math.log(1 - SURVIVES))))


def size_class(n: np.ndarray) -> np.ndarray:
    """c with 2^(c-1) < n <= 2^c."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def seeded(h: np.ndarray, r: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64))


def bin_minima(h: np.ndarray, off: np.ndarray, classes: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, value) of the bin minima of sketch r of each set: a set of class c has 2^(c+1) bins,
    and a value's bin is its leading bits. Only bins that hold a value take memory."""
    values, owner = seeded(h, r), np.repeat(np.arange(len(off) - 1), np.diff(off))
    first = np.concatenate(([0], np.cumsum(np.int64(1) << (classes + 1))))
    slot = first[owner] + (values >> (np.uint64(63) - classes.astype(np.uint64)[owner])).astype(np.int64)
    order = np.argsort(slot)
    slot = slot[order]
    run = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else order
    return owner[order[run]], np.minimum.reduceat(values[order], run) if len(run) else values


class ItemBlock:
    """Shingles of a block of items and, by sketch and class of documents, their bin minima. A document's class
    is that of its size, and more where ``percent`` lets it be much smaller than an item."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.sets, self.percent = sets, percent
        # a document may be smaller than an item it holds enough of: the smaller the percentage, the more bins
        self.more = max(0, math.ceil(math.log2(PERCENT / percent)))
        self.group = [max(0, int(size_class(np.array([len(s)]))[0])) for s in sets]
        self.sketches = {g: sketches_for((1 << g >> 1) + 1 if g else 1, percent) for g in set(self.group)}
        self.by_class: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def minima(self, r: int, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted values, the items they belong to, and a table of leading bits to rule most others out."""
        if (r, c) not in self.by_class:
            if sum(v.nbytes + i.nbytes + t.nbytes for v, i, t in self.by_class.values()) > CACHE_BYTES:
                self.by_class.clear()
            take = [i for i, s in enumerate(self.sets) if self.sketches[self.group[i]] > r and self.percent * len(s) <= 100 << c - self.more]
            parts = [self.sets[i] for i in take]
            off = np.concatenate(([0], np.cumsum([len(s) for s in parts], dtype=np.int64)))
            # the same bins as the documents of the class
            owner, values = bin_minima(np.concatenate(parts) if parts else np.zeros(0, np.uint64), off, np.full(len(parts), c), r)
            order = np.argsort(values, kind="stable")
            table = np.zeros(1 << 16, bool)
            table[values >> np.uint64(48)] = True
            self.by_class[r, c] = values[order], np.array(take, np.int64)[owner[order]], table
        return self.by_class[r, c]

    def candidates(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows (set, item) whose sketches meet."""
        classes = size_class(np.diff(off)) + self.more
        found = [np.zeros((0, 2), np.int64)]
        for r in range(max(self.sketches.values(), default=0)):
            owner, values = bin_minima(h, off, classes, r)
            of_class = classes[owner]
            for c in np.unique(classes[np.diff(off) > 0]):
                wanted, items, table = self.minima(r, int(c))
                if not len(wanted):
                    continue
                at = np.flatnonzero((of_class == c) & table[values >> np.uint64(48)])
                lo, hi = np.searchsorted(wanted, values[at], "left"), np.searchsorted(wanted, values[at], "right")
                n = hi - lo
                where = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.stack((np.repeat(owner[at], n), items[where]), axis=1))
        return np.unique(np.concatenate(found), axis=0)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts)
    return shingle_hashes(w.hashes(), w.off, SHINGLE_WORDS)


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, item_block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: a row for each row of ``docs`` (doc_id, text) and each of
    ``items`` (item_id, text) of whose distinct five-word shingles the document holds ``percent`` at least.

    Words have A-Z lower-cased. Texts with fewer than five words have their whole sequence as one shingle,
    which only an equally short text can hold; empty and null texts hold nothing and are in nothing.
    Repeated rows and ids on either side give repeated rows, null ids are passed on, texts of any length
    are read whole, empty tables on either side give no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-items.count() // item_block))
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("b"))
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        rows = dealt.where(F.col("b") == b).collect()  # a block of items, not of documents
        h, off = shingle_sets(pa.array([r.text for r in rows], pa.string()))
        sets = [unique(h[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]
        used = [i for i, s in enumerate(sets) if len(s)]
        shared = spark.sparkContext.broadcast(([rows[i].item_id for i in used], ItemBlock([sets[i] for i in used], percent)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, block = shared.value
            for batch in batches:
                for part in text_chunks(batch, "text"):
                    h, off = shingle_sets(part.column("text"))
                    hits, last, own = [], -1, h[:0]
                    for d, i in block.candidates(h, off):
                        if d != last:
                            last, own = d, unique(h[off[d]:off[d + 1]])
                        item = block.sets[i]
                        at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                        n = int((own[at] == item).sum())
                        if 100 * n >= percent * len(item):
                            hits.append((d, i, len(item), n))
                    d, i, size, n = (np.array(x, np.int64) for x in (zip(*hits, strict=True) if hits else ([], [], [], [])))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array([ids[k] for k in i], part_type), pa.array(size), pa.array(n)],
                                                     ["doc_id", "item_id", "n_item", "n_shared"])

        part_type = to_arrow_type(items.schema["item_id"].dataType)
        found = docs.select("doc_id", "text").mapInArrow(search, f"doc_id {doc_kind}, item_id {item_kind}, n_item long, n_shared long")
        out = found if out is None else out.unionByName(found)
    return out
