"""Repeated passages by sparse suffix arrays.

Of all suffixes of the corpus only those that start with a minimiser are kept: the least HEAD-word hash
of every MATCH-word window. Two equal windows have the same minimiser, so a passage that repeats shares a
kept suffix. Suffixes whose head occurs once are dropped; of the rest, the windows around them are sorted
into runs of equal neighbours. A match extends to the left and right as far as neighbouring windows
match too: the repeated part of a document is the union of its windows that occur elsewhere.

Heads and windows are matched by hash blocks, windows by that of their minimiser. Around a short phrase
that very many documents share, the windows differ and have one minimiser: such minimisers are counted, and
their windows go by their own hash, which spreads them evenly; equal windows still meet. Before that each task matches
what repeats within it and sends one copy on, so a passage that a third of all documents share costs a row
a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.store import Scratch
from orderlens.llm.words import BASE, BASE_INVERSE, Words, give_back, mix, powers, text_chunks, unique

#: Words of the shortest repeated passage, and of the head by which suffixes are selected. Any window of
#: MATCH words holds WINDOW heads, of which the least is its minimiser.
MATCH, HEAD = 50, 10
WINDOW = MATCH - HEAD + 1
#: Entries in a hash block.
BLOCK = 1 << 19
#: Suffixes with one head of which the windows, WINDOW each at most, still fit into a block.
HOT = BLOCK // WINDOW
#: Text that a task matches within itself before it sends anything on.
LOCAL_BYTES = 2 << 20


def span_sums(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` words from each position on, as far as that many follow."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(words * powers(BASE, n), dtype=np.uint64)))
        return mix((sums[size:] - sums[:n - size + 1]) * powers(BASE_INVERSE, n)[:n - size + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours from each position on."""
    if len(x) < width:
        return x[:0]
    have, low = 1, x
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:len(x) - width + 1], low[width - have:])


#: Low bits of a head's hash that give way to its position, so that the leftmost of equal heads is least.
PLACE_MASK = np.uint64((1 << 22) - 1)


def windows(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words; then for each MATCH-word window: text, start word within the text, the minimiser's
    hash and its place among all words, hash."""
    w = Words(texts)
    h = w.hashes()
    heads, whole = span_sums(h, HEAD), span_sums(h, MATCH)
    least = sliding_min((heads & ~PLACE_MASK) | (np.arange(len(heads), dtype=np.uint64) & PLACE_MASK), WINDOW)
    count = np.maximum(w.counts - MATCH + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = w.off[doc] + start
    place = at + ((least[at] - at.astype(np.uint64)) & PLACE_MASK).astype(np.int64)
    return w, doc, start, heads[place], place, whole[at]


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Borders of runs of equal neighbours."""
    new = np.ones(len(keys[0]) + 1, bool)
    if len(keys[0]):
        new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new) if len(keys[0]) else np.zeros(1, np.int64)


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(_long(values), kind))


def _by_block(block: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    order = np.argsort(block, kind="stable")
    block = block[order]
    cuts = _cuts(block)
    return block[cuts[:-1]], cuts, [c[order] for c in columns]


HEADS = "block long, row long, head array<long>, rows array<long>, counts array<int>"


def _heads(blocks: int):
    """Of each part of a task: heads by block, one row for each head; heads that occur in it twice, by row."""
    names = [x.split()[0] for x in HEADS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text", LOCAL_BYTES):
                row = part.column("row").to_numpy()
                _, doc, _, least, place, _ = windows(part.column("text"))
                if not len(doc):
                    continue
                # a minimiser that stays through neighbouring windows is one suffix
                first = np.ones(len(doc), bool)
                first[1:] = place[1:] != place[:-1]
                head, owner = least[first], row[doc[first]]
                order = np.lexsort((owner, head))
                head, owner = head[order], owner[order]
                cuts = _cuts(head)
                several = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
                one = cuts[:-1]
                block, at, (h, r, n) = _by_block((mix(head[one]) % np.uint64(blocks)).astype(np.int64), head[one], owner[one], np.diff(cuts).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.nulls(len(block), pa.int64()), _lists(h, at), _lists(r, at), _lists(n, at, pa.int32())], names)
                if several.any():
                    own, at, (h,) = _by_block(owner[several], head[several])
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.array(own), _lists(h, at), pa.nulls(len(own), pa.list_(pa.int64())), pa.nulls(len(own), pa.list_(pa.int32()))], names)
    return run


def _flat(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(n).chunks]) for n in names]


def _common_heads(table: pa.Table) -> pa.Table:
    give_back()
    head, row = _flat(table, "head", "rows")
    order = np.lexsort((row, head))
    head, row = head[order], row[order]
    cuts = _cuts(head)
    keep = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    own, at, (h,) = _by_block(row[keep], head[keep])
    return pa.table({"row": pa.array(own), "head": _lists(h, at)})


def _hot_heads(most: int):
    """Heads that more than ``most`` suffixes start with."""
    def run(table: pa.Table) -> pa.Table:
        head, n = _flat(table, "head", "counts")
        order = np.argsort(head, kind="stable")
        head, n = head[order], n[order].astype(np.int64)
        cuts = _cuts(head)[:-1]
        total = np.add.reduceat(n, cuts) if len(n) else n
        return pa.table({"head": head[cuts[:len(total)]][total > most]})
    return run


WINDOWS = "block long, row long, doc long, hash array<long>, rows array<long>, docs array<long>, starts array<int>, later array<boolean>"
FOUND = "row long, starts array<int>, later array<boolean>"


def _settle(hash_, doc, row, start):
    """Sorts windows by hash and place; which are in a run of several, and which are not its first."""
    order = np.lexsort((start, row, doc, hash_))
    hash_, doc, row, start = hash_[order], doc[order], row[order], start[order]
    fresh = np.ones(len(hash_), bool)  # equal rows are one document
    fresh[1:] = (hash_[1:] != hash_[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1])
    hash_, doc, row, start = hash_[fresh], doc[fresh], row[fresh], start[fresh]
    cuts = _cuts(hash_)
    length = np.diff(cuts)
    first = np.zeros(len(hash_), bool)
    first[cuts[:-1]] = True
    return hash_, doc, row, start, np.repeat(length > 1, length), ~first


def _found(row, start, later) -> tuple[np.ndarray, pa.Array, pa.Array]:
    own, at, (s, x) = _by_block(row, start, later)
    return own, _lists(s, at, pa.int32()), _lists(x, at, pa.bool_())


def _windows(blocks: int, hot):
    """Windows whose minimiser another suffix has too, one of each in a part of a task, by block of the
    minimiser, or of the window's own hash if the minimiser is in ``hot``; and those that the part itself
    repeats, by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in WINDOWS.split(", ")]
        for batch in batches:
            for part in text_chunks(batch, "text", LOCAL_BYTES):
                ids, order_of = part.column("row").to_numpy(), part.column("place").to_numpy()
                _, doc, start, least, _, whole = windows(part.column("text"))
                heads = part.column("heads")
                wanted = heads.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                of = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(heads).to_numpy(zero_copy_only=False))
                with np.errstate(over="ignore"):
                    salt = lambda d: mix(d.astype(np.uint64) + np.uint64(1))
                    keep = np.isin(least + salt(doc), wanted + salt(of))
                doc, start, least, whole = doc[keep], start[keep].astype(np.int32), least[keep], whole[keep]
                if not len(doc):
                    continue
                with np.errstate(over="ignore"):
                    block = (mix(np.where(np.isin(least, hot.value), whole, least)) % np.uint64(blocks)).astype(np.int64)
                # equal windows have equal minimisers: the block can be looked up by the window's hash
                by_hash = np.argsort(whole, kind="stable")
                h, d, r, s, several, later = _settle(whole, order_of[doc], ids[doc], start)
                b = block[by_hash][np.searchsorted(whole[by_hash], h)]
                one = ~later
                key, at, (hh, rr, dd, ss) = _by_block(b[one], h[one], r[one], d[one], s[one])
                k = len(key)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), _lists(hh, at), _lists(rr, at), _lists(dd, at),
                                                  _lists(ss, at, pa.int32()), pa.nulls(k, pa.list_(pa.bool_()))], names)
                if several.any():
                    own, starts, flags = _found(r[several], s[several], later[several])
                    k = len(own)
                    nulls = [pa.nulls(k, pa.list_(pa.int64()))] * 3
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(own), pa.nulls(k, pa.int64()), *nulls, starts, flags], names)
    return run


def _common_windows(table: pa.Table) -> pa.Table:
    give_back()
    hash_, row, doc, start = _flat(table, "hash", "rows", "docs", "starts")
    _, _, row, start, several, later = _settle(hash_, doc, row, start)
    own, starts, flags = _found(row[several], start[several], later[several])
    return pa.table({"row": pa.array(own), "starts": starts, "later": flags})


def _union(starts: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges covered by the windows with these starts."""
    if not len(starts):
        return []
    s = unique(starts)
    gap = np.flatnonzero(s[1:] > s[:-1] + MATCH)
    return [(int(a), int(b) + MATCH) for a, b in zip(s[np.append(0, gap + 1)], s[np.append(gap, len(s) - 1)], strict=True)]


SPANS = "row long, repeated array<struct<start: long, stop: long>>, later array<struct<start: long, stop: long>>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            starts = batch.column("starts")[i].values.to_numpy()
            later = batch.column("later")[i].values.to_numpy(zero_copy_only=False).astype(bool)
            out.append([[{"start": a, "stop": b} for a, b in _union(x)] for x in (starts, starts[later])])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], kind)], ["row", "repeated", "later"])


def row_key():
    """Rows with equal id and text are one document."""
    return F.xxhash64("doc_id", "text")


def repeated_passages(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """row, repeated, later for each document of ``docs`` (doc_id, text) of which a passage of MATCH words
    or more also occurs elsewhere, in another document or another place of it (overlapping places included).

    ``repeated`` lists the word ranges (from 0, end excluded) covered by MATCH-word windows that occur
    twice or more, ``later`` those covered by occurrences other than the first, in the order of doc_id (null
    last) and place. ``row`` is row_key(). Words are runs of non-space bytes, A-Z lower-cased.

    Null and empty texts and those shorter than MATCH words have no row; rows with equal id and text are
    one document, equal texts with different ids repeat each other; texts of any length are read whole; an
    empty table gives no rows; other columns are ignored. doc_id must be a whole number.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffixes")
    docs = docs.select(row_key().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("place"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (6 * WINDOW // 2) // BLOCK + 1)
    flat = lambda df, *cols: df.groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in cols])
    heads = scratch.write(docs.select("row", "text").mapInArrow(_heads(blocks), HEADS), "heads")
    common = heads.where("block is not null").groupBy("block").applyInArrow(_common_heads, "row long, head array<long>")
    kept = flat(common.unionByName(heads.where("block is null").select("row", "head")), "head")
    kept = scratch.write(kept.select("row", F.array_distinct("head").alias("heads")), "kept")
    often = heads.where("block is not null").groupBy("block").applyInArrow(_hot_heads(HOT), "head long").collect()  # few: HOT suffixes each
    hot = spark.sparkContext.broadcast(np.array([r.head for r in often], np.int64).view(np.uint64))
    # a kept suffix is the minimiser of WINDOW / 2 windows on average
    several = (kept.agg(F.sum(F.size("heads")).alias("n")).first().n or 0) * WINDOW // 2
    around = scratch.write(docs.join(kept, "row").mapInArrow(_windows(max(blocks, several // BLOCK + 1), hot), WINDOWS), "windows")
    again = around.where("block is not null").groupBy("block").applyInArrow(_common_windows, FOUND)
    found = flat(again.unionByName(around.where("block is null").select("row", "starts", "later")), "starts", "later")
    return scratch.write(found.mapInArrow(_spans, SPANS), "spans")


def cut_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the ``later`` word ranges of ``spans`` cut out of their texts, with the space that
    follows them; a document of which no word is left goes, others keep all their columns."""
    names = docs.columns
    at = names.index("text")
    row, later = ("_" * (1 + max(len(n) for n in names)) + n for n in ("row", "later"))  # names that docs has not

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ranges = batch.column(later).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for i in [i for i, x in enumerate(ranges) if x]:
                raw = texts[i].encode()
                w = Words(pa.array([texts[i]]))
                stop = np.append(w.starts, len(raw))
                out, last = [], 0
                for x in ranges[i]:
                    out.append(raw[last:w.starts[x["start"]]])
                    last = stop[x["stop"]]
                text = b"".join([*out, raw[last:]]).decode()
                texts[i] = text
                keep[i] = bool(text.strip(" \t\n\v\f\r"))
            columns = [pa.array(texts, batch.column("text").type) if n == at else batch.column(c) for n, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    marked = docs.withColumn(row, row_key()).join(spans.where("size(later) > 0").select(F.col("row").alias(row), F.col("later").alias(later)), row, "left")
    return marked.drop(row).mapInArrow(cut, docs.schema)
