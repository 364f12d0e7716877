"""Jaccard join of documents by shared word n-grams, as a blocked sparse matrix product.

The rows of the incidence matrix are the distinct n-gram sets (documents with equal sets are one row),
its columns the n-grams. A pair of rows is a link when its entry in the product of the matrix with its
transpose, the overlap, reaches the bound that both sizes and the similarity give.

1. Columns are pruned first: a row keeps only the n-grams that come first in an order that puts common
   ones last, as many as a link cannot avoid sharing. Overlaps accumulate over these columns, block of
   columns by block; pairs whose accumulated count plus all that may still follow stays below the bound
   are discarded. What remains falls into small clusters of rows. Two kept columns of each row, the least
   in two other orders, are its keys. Rows that agree in a key meet in that column's block, which puts them
   into one cluster, so no block counts their pairs: most near copies cost a row or two, however many
   columns they share and however many blocks these are in.
2. The rows of a cluster are cut into blocks, and each pair of blocks that sizes allow is multiplied
   exactly, over all columns, in one task.

Every step is exact: no link between different sets is lost and none is added. Columns that very many
rows keep are not multiplied in step 1 but put their rows into one cluster, and clusters of any size are
spread over tasks by blocks, so neither a common n-gram nor a large group of near copies meets in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.components import connected_components
from orderlens.llm.store import Scratch
from orderlens.llm.suffixes import row_key
from orderlens.llm.words import Words, give_back, mix, shingle_hashes, text_chunks, unique

#: Text of which n-grams are counted together before the counts are shuffled.
COUNTED_BYTES = 8 << 20
#: N-grams whose hash is below this, which are all that come first, are counted; those in this many sets or
#: more are common and come last. Both, and the length of the list of common ones, which is broadcast,
#: only affect the order of columns, never the result.
COUNTED_BELOW, COMMON, MOST_COMMON = np.uint64(1 << 62), 16, 1 << 20
#: Kept n-grams in a block of columns.
COLUMN_BLOCK = 1 << 20
#: A column with more rows only clusters them.
WIDE_COLUMN = 64
#: The orders in which a row's least kept columns are its keys, and the bits of a column's hash that name it
#: and choose its block: columns that share a name share a block, so rows of equal keys always meet.
KEY_ORDERS, NAME = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), np.uint64((1 << 32) - 1)
#: Rows and n-grams in a block of rows.
BLOCK_ROWS, BLOCK_NGRAMS = 256, 1 << 19


def least_overlap(percent: int, a, b):
    """The smallest overlap at which sets of sizes a and b link: overlap * 100 >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and where each text's begin."""
    w = Words(texts)
    h, off = shingle_hashes(w.hashes(), w.off, n)
    sets = [unique(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    return (np.concatenate(sets) if sets else h), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set (0 for empty ones)."""
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64)))
        size = np.diff(off).astype(np.uint64)
        return np.where(size > 0, mix((sums[off[1:]] - sums[off[:-1]]) + size * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))


def _list_array(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _ngrams(n: int, blocks: int):
    """Rows (doc_id, key, size, sig) of documents, and rows (block, grams, counts) of counted n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        seen = 0
        names = ["doc_id", "key", "size", "sig", "block", "grams", "counts"]

        def counted(kind):
            h = np.sort(np.concatenate(pending))
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
            gram, count = h[at[:-1]], np.diff(at).astype(np.int32)
            block = (mix(gram) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            block = block[order]
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else np.zeros(1, np.int64)
            k = len(cuts) - 1
            return pa.RecordBatch.from_arrays([pa.nulls(k, kind), *[pa.nulls(k, pa.int64())] * 3, pa.array(block[cuts[:-1]]),
                                               _list_array(_as_long(gram[order]), cuts, pa.int64()), _list_array(count[order], cuts, pa.int32())], names)

        for batch in batches:
            kind = batch.column("doc_id").type
            for part in text_chunks(batch, "text"):
                h, off = ngram_sets(part.column("text"), n)
                sig, size = signatures(h, off), np.diff(off)
                k = len(size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(size), pa.array(_as_long(sig), mask=size == 0), pa.nulls(k, pa.int64()),
                                                  pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32()))], names)
                # a set that repeats here counts once
                first = np.isin(np.arange(k), np.unique(sig, return_index=True)[1])
                pending.append(h[np.repeat(first, size) & (h < COUNTED_BELOW)])
                seen += part.nbytes
                if seen >= COUNTED_BYTES:
                    yield counted(kind)
                    pending, seen = [], 0
        if pending:
            yield counted(kind)
    return run


def _common(table: pa.Table) -> pa.Table:
    give_back()
    gram, count = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(k).chunks]) for k in ("grams", "counts"))
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    total = np.add.reduceat(count[order].astype(np.int64), first)
    often = total >= COMMON
    return pa.table({"gram": gram[first][often], "sets": total[often]})


def _row_keys(gram: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each kept n-gram of rows that lie one after the other, the names of its row's two keys in one number."""
    start = np.cumsum(length) - length
    keys = np.zeros(len(length), np.uint64)
    for order in KEY_ORDERS:
        place = mix(gram ^ order)
        least = place == np.repeat(np.minimum.reduceat(place, start), length)
        keys = keys << np.uint64(32) | mix(gram[least]) & NAME
    return np.repeat(keys, length)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows agree in neither key."""
    return ((a ^ b) >> np.uint64(32) > 0) & ((a ^ b) & NAME > 0)


def _kept_columns(n: int, percent: int, common, blocks: int):
    """Rows (block, gram, sig, size, at, last, keys): the kept n-grams of each distinct set, by block of columns;
    ``last`` is the place in the order of columns of the last one that the set keeps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = common.value
        for batch in batches:
            for part in text_chunks(batch, "text"):
                h, off = ngram_sets(part.column("text"), n)
                sig = signatures(h, off)
                _, first = np.unique(sig, return_index=True)
                first = first[np.diff(off)[first] > 0]
                is_common = np.zeros(len(h), bool)
                if len(heavy) and len(h):
                    i = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    is_common = heavy[i] == h
                grams, sigs, sizes, ats, lasts = [], [], [], [], []
                for d in first:
                    s, c = h[off[d]:off[d + 1]], is_common[off[d]:off[d + 1]]
                    size = len(s)
                    keep = size - -(-percent * size // 100) + 1
                    last = int(max(0, keep - (size - c.sum())))  # common columns kept
                    s = np.concatenate((s[~c], s[c]))[:keep]
                    lasts.append(np.full(len(s), (s[-1] >> np.uint64(2)) | np.uint64((last > 0) << 62)))
                    grams.append(s)
                    sigs.append(np.full(len(s), sig[d]))
                    sizes.append(np.full(len(s), size, np.int32))
                    ats.append(np.arange(len(s), dtype=np.int32))
                if not grams:
                    continue
                g, s, z, a, e = map(np.concatenate, (grams, sigs, sizes, ats, lasts))
                k = _row_keys(g, np.array([len(x) for x in grams]))
                block = ((mix(g) & NAME) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                block = block[order]
                cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), _list_array(_as_long(g[order]), cuts, pa.int64()), _list_array(_as_long(s[order]), cuts, pa.int64()),
                                                  _list_array(z[order], cuts, pa.int32()), _list_array(a[order], cuts, pa.int32()), _list_array(_as_long(e[order]), cuts, pa.int64()),
                                                  _list_array(_as_long(k[order]), cuts, pa.int64())],
                                                 ["block", "gram", "sig", "size", "at", "last", "keys"])
    return run


def _accumulate(percent: int):
    """Partial products of a block of columns: (a, b, shared, after, need), shared 0 for rows that a wide
    column or a key puts into one cluster. Pairs that agree in a key are not counted: the block that has the
    key as a column clusters them.

    ``after`` bounds what columns may add to the overlap beyond all shared ones that are kept: no more than
    either row has after this one, and no more than the row whose kept columns end first has in all after
    them, as up to there both rows have been compared. ``need`` is the least overlap of a link."""
    def run(table: pa.Table) -> pa.Table:
        give_back()
        gram, sig, size, at, last, keys = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(k).chunks])
                                           for k in ("gram", "sig", "size", "at", "last", "keys"))
        order = np.lexsort((sig, size, gram))
        gram, sig, size, at, last, keys = gram[order], sig[order], size[order].astype(np.int64), at[order].astype(np.int64), last[order], keys[order].view(np.uint64)
        fresh = np.ones(len(gram), bool)  # the same set from several tasks
        fresh[1:] = (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])
        gram, sig, size, at, last, keys = gram[fresh], sig[fresh], size[fresh], at[fresh], last[fresh], keys[fresh]
        unseen = -(-percent * size // 100) - 1
        cuts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True])))
        length = np.diff(cuts)
        out = []
        wide = np.zeros(len(gram), bool)
        for s, e in zip(cuts[:-1][length > WIDE_COLUMN], cuts[1:][length > WIDE_COLUMN], strict=True):
            wide[s:e - 1] = True
        i = np.flatnonzero(wide)
        i = i[_apart(keys[i], keys[i + 1])]
        together = [(i, i + 1)]
        name = mix(gram.view(np.uint64)) & NAME
        for key in (keys >> np.uint64(32), keys & NAME):
            i = np.flatnonzero(key == name)
            i = i[np.lexsort((sig[i], size[i], name[i]))]
            i, j = i[:-1], i[1:]
            same = (name[i] == name[j]) & (sig[i] != sig[j])
            together.append((i[same], j[same]))
        i, j = map(np.concatenate, zip(*together, strict=True))
        ok = 100 * size[i] >= percent * size[j]
        i, j = i[ok], j[ok]
        if len(i):
            zero = np.zeros(len(i), np.int64)
            out.append((np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j]), zero, zero, zero))
        # all pairs at the same distance in their column together
        stop = np.repeat(np.where((length > 1) & (length <= WIDE_COLUMN), cuts[1:], 0), length)
        for step in range(1, min(WIDE_COLUMN, int(length.max(initial=0)))):
            i = np.flatnonzero(np.arange(len(gram)) + step < stop)
            if not len(i):
                break
            j = i + step
            ok = (100 * size[i] >= percent * size[j]) & _apart(keys[i], keys[j])
            i, j = i[ok], j[ok]
            after, need = np.minimum(size[i] - at[i], size[j] - at[j]) - 1, least_overlap(percent, size[i], size[j])
            ok = 1 + np.minimum(at[i], at[j]) + after >= need
            i, j, after, need = i[ok], j[ok], after[ok], need[ok]
            if len(i):
                # what kept columns add is counted in ``shared``: the rest of both rows bounds the rest
                rest = np.where(last[i] <= last[j], unseen[i], unseen[j])
                swap = sig[i] > sig[j]
                out.append((np.where(swap, sig[j], sig[i]), np.where(swap, sig[i], sig[j]), np.ones(len(i), np.int64), np.minimum(after, rest), need))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        if len(cols[0]):
            order = np.lexsort((cols[1], cols[0]))
            cols = [c[order] for c in cols]
            start = np.flatnonzero(np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))))
            shared = np.where(np.minimum.reduceat(cols[2], start) == 0, 0, np.add.reduceat(cols[2], start))
            cols = [cols[0][start], cols[1][start], shared, np.minimum.reduceat(cols[3], start), cols[4][start]]
        return pa.table(dict(zip(("a", "b", "shared", "after", "need"), cols, strict=True)))
    return run


def overlaps(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """The product of the sets' incidence matrix with its transpose, over slices of its columns."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    h, rows = h[order], rows[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    rows, column = rows[shared], column[shared]
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
    out = np.zeros((len(sets), len(sets)), np.float64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, (c, c + columns))
        x = np.zeros((len(sets), columns), np.float32)
        x[rows[lo:hi], column[lo:hi] - c] = 1
        out += x @ x.T
    out[np.diag_indices(len(sets))] = [len(s) for s in sets]
    return out.astype(np.int64)


def _links(n: int, percent: int):
    """Exact product of a pair of blocks: for each row with a link in it (sig, to, links): a row it is
    connected with here, and the documents it is linked with."""
    def run(table: pa.Table) -> pa.Table:
        give_back()
        texts = pa.chunked_array(table.column("text").chunks, pa.string()).combine_chunks()
        h, off = ngram_sets(texts, n)
        found = _as_long(signatures(h, off))
        want, root, side, copies = (table.column(k).to_numpy() for k in ("sig", "root", "side", "copies"))
        good = np.flatnonzero(found == want)
        good = good[np.unique(np.stack((want[good], side[good])), axis=1, return_index=True)[1]] if len(good) else good
        good = good[np.lexsort((want[good], root[good]))]
        sig_out, to_out, links_out = [], [], []
        for group in np.split(good, np.flatnonzero(root[good][1:] != root[good][:-1]) + 1):
            if len(group) < 2:
                continue
            overlap = overlaps([h[off[d]:off[d + 1]] for d in group])
            size = np.diag(overlap)
            linked = (100 + percent) * overlap >= percent * (size[:, None] + size[None, :])
            s = side[group]
            if (s > 0).any():  # two blocks: what is inside one is another task's
                linked &= s[:, None] != s[None, :]
            np.fill_diagonal(linked, False)
            label = np.arange(len(group))
            while True:
                low = np.minimum(label, np.where(linked, label[None, :], len(group)).min(axis=1))
                low = low[low]
                if (low == label).all():
                    break
                label = low
            some = linked.any(axis=1)
            sig_out.append(want[group][some])
            to_out.append(want[group][label[some]])
            links_out.append((linked * copies[group][None, :]).sum(axis=1)[some])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"sig": np.concatenate(sig_out or empty), "to": np.concatenate(to_out or empty), "links": np.concatenate(links_out or empty)})
    return run


def _units(clusters: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``clusters`` (sig, root, size, ...) with one row for each task (unit, side) that a row goes to.

    Clusters that fit into a block are packed together. Others are cut by size into bands, of which only
    neighbours can hold links, and bands by hash into blocks; a task gets two blocks, or one twice.
    """
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(-np.log(percent / 100))).cast("long")
    rows = scratch.write(clusters.withColumn("band", band), "banded")
    fits = lambda n, g: F.ceil(F.greatest(n / BLOCK_ROWS, g / BLOCK_NGRAMS)).cast("long")
    bands = rows.groupBy("root", "band").agg(F.count("*").alias("n"), F.sum("size").alias("g"))
    totals = bands.groupBy("root").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).where(fits(F.col("n"), F.col("g")) <= 1)
    small = scratch.write(totals.select("root", "n", "g"), "small")
    packed = small.agg(F.max(F.lit(1)), fits(F.sum("n"), F.sum("g")).alias("k")).first().k or 1
    ones = (rows.join(small.select("root"), "root", "left_semi")
            .withColumn("unit", F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(2 * packed)))).withColumn("side", F.lit(0)))
    blocks = scratch.write(bands.join(small.select("root"), "root", "left_anti").select("root", "band", fits(F.col("n"), F.col("g")).alias("k")), "blocks")
    near = lambda d, name: blocks.select("root", (F.col("band") - d).alias("band"), F.col("k").alias(name))
    plan = blocks.join(near(1, "k_up"), ["root", "band"], "left").join(near(-1, "k_down"), ["root", "band"], "left").withColumnRenamed("k", "k_own")
    large = rows.join(plan, ["root", "band"])
    mine = F.pmod(F.xxhash64("sig"), F.col("k_own"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    upto = lambda c: F.when(count(c) > 0, F.sequence(F.lit(0).cast("long"), count(c) - 1)).otherwise(F.array().cast("array<long>"))
    name = lambda *p: F.concat_ws(":", *p)
    tasks = F.concat(
        F.transform(upto("k_own"), lambda j: F.struct(
            name(F.lit("o"), F.col("root"), F.col("band"), F.least(F.col("mine"), j), F.greatest(F.col("mine"), j)).alias("unit"),
            F.when(F.col("mine") == j, 0).when(F.col("mine") < j, 1).otherwise(2).alias("side"))),
        F.transform(upto("k_up"), lambda j: F.struct(name(F.lit("u"), F.col("root"), F.col("band"), F.col("mine"), j).alias("unit"), F.lit(1).alias("side"))),
        F.transform(upto("k_down"), lambda j: F.struct(name(F.lit("u"), F.col("root"), F.col("band") - 1, j, F.col("mine")).alias("unit"), F.lit(2).alias("side"))))
    spread = (large.withColumn("mine", mine).withColumn("_t", F.explode(tasks))
              .withColumn("unit", F.col("_t.unit")).withColumn("side", F.col("_t.side")))
    return ones.select(*clusters.columns, "unit", "side").unionByName(spread.select(*clusters.columns, "unit", "side"))


def ngram_jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of ``docs`` (doc_id, text).

    Words are runs of non-space bytes, A-Z lower-cased; the set of a text with fewer than ``n`` words is
    its whole sequence; documents link when 100 * intersection >= percent * union. component_id is the
    smallest doc_id reachable by links, itself included; n_links the other rows it is linked with.

    Texts without words, empty and null ones have an empty set, no links and their own id. Repeated rows
    and ids are rows of their own (equal sets link). Rows with a null id link as all others do; component_id
    is null where no id is reachable. Texts of any length are read whole; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    docs = docs.select("doc_id", row_key().alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    first = scratch.write(docs.mapInArrow(_ngrams(n, max(least, text // 24 // COLUMN_BLOCK + 1)),
                                          f"doc_id {kind}, key long, size long, sig long, block long, grams array<long>, counts array<int>"), "first")
    rows = first.where("block is null").select("doc_id", "key", "size", "sig")
    about = rows.agg(F.count("*").alias("n"), F.sum("size").alias("grams")).first()
    often = (first.where("block is not null").select("block", "grams", "counts").groupBy("block").applyInArrow(_common, "gram long, sets long")
             .orderBy(F.desc("sets"), "gram").limit(MOST_COMMON))
    common = spark.sparkContext.broadcast(np.sort(np.array([r.gram for r in often.collect()], np.int64).view(np.uint64)))
    kept = int((about.grams or 0) * (1 - percent / 100)) + about.n
    blocks = kept // COLUMN_BLOCK + 1  # few: a pair's overlaps are added up in a block before they are shuffled
    columns = docs.mapInArrow(_kept_columns(n, percent, common, blocks), "block long, gram array<long>, sig array<long>, size array<int>, at array<int>, last array<long>, keys array<long>")
    partial = columns.groupBy("block").applyInArrow(_accumulate(percent), "a long, b long, shared long, after long, need long")
    pairs = (partial.groupBy("a", "b").agg(F.min("shared").alias("least"), F.sum("shared").alias("shared"), F.min("after").alias("after"), F.max("need").alias("need"))
             .where((F.col("least") == 0) | (F.col("shared") + F.col("after") >= F.col("need"))).select("a", "b"))
    clusters = connected_components(pairs, scratch, "clusters")
    sets = scratch.write(rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.first("size").alias("size"), F.count("*").alias("copies")), "sets")
    members = clusters.withColumnRenamed("id", "sig").join(sets.drop("first_id"), "sig")
    units = scratch.write(_units(members, percent, scratch), "units")
    wanted = units.groupBy("key").agg(F.collect_list(F.struct("unit", "side", "sig", "root", "copies")).alias("to"))
    # texts are always shuffled to their tasks, at any size of the other side
    carriers = docs.select("key", "text").join(scratch.write(wanted, "wanted").hint("merge"), "key").dropDuplicates(["key"])
    work = carriers.select("text", F.explode("to").alias("t")).select("t.*", "text")
    found = scratch.write(work.groupBy("unit").applyInArrow(_links(n, percent), "sig long, to long, links long"), "links")
    parts = connected_components(found.select(F.col("sig").alias("a"), F.col("to").alias("b")), scratch, "linked")
    named = parts.withColumnRenamed("id", "sig").join(sets.select("sig", "first_id"), "sig", "left")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("smallest"))
    degree = found.groupBy("sig").agg(F.sum("links").alias("links"))
    of_set = (sets.join(parts.withColumnRenamed("id", "sig").join(smallest, "root").select("sig", "smallest"), "sig", "left").join(degree, "sig", "left")
              .select("sig", F.coalesce("smallest", "first_id").alias("smallest"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    of_set = scratch.write(of_set, "of-set")
    return (rows.join(of_set, "sig", "left")
            .select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links")))
