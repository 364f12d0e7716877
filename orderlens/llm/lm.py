"""Language-model scoring: subword lattice likelihood of documents.

The vocabulary's scores weight all segmentations of a word; their probabilities are added up in the word's
lattice. What the corpus teaches is gathered over all training documents: the count of every word, and from
these the expected uses of the pieces, which re-estimate the vocabulary's weights.

The work is shared by distinct words. Each task codes its documents as numbers of its own distinct words
(a chunk). Words go to hash blocks, where counts are added up and each distinct word's lattice is computed
once; count and probability go back to the chunks, which add up their documents' scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.labels import crc_remainder
from orderlens.llm.lattice import Lattice, read_vocabulary
from orderlens.llm.store import Scratch
from orderlens.llm.words import Words, text_chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Text of a chunk, distinct words in a hash block (about), words in a row of the vocabulary table.
CHUNK_BYTES, BLOCK_WORDS, ROW_WORDS = 12 << 20, 1 << 19, 1 << 16
#: Pieces' worth of weight that the vocabulary's own scores have against the corpus.
PRIOR = 10_000.0
LOG10 = np.log(10)

CHUNKS = ("chunk long, block long, base long, hash array<long>, n array<int>, size binary, spelt binary, "
          "doc_id {id}, held array<boolean>, tokens array<long>, cut array<int>, code binary, times binary")


def planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as four planes of bytes: mostly small numbers compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def gather(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of some spans, one after the other."""
    first = np.cumsum(sizes) - sizes
    return buf[np.repeat(starts - first, sizes) + np.arange(sizes.sum())]


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (h % np.uint64(blocks)).astype(np.int64)


def _code(blocks: int):
    """A row for each chunk and block with the chunk's distinct words in it, ordered by hash, and a row for
    each chunk with its documents as numbers of those words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for batch in batches:
            kind = batch.column("doc_id").type
            for part in text_chunks(batch, "text", CHUNK_BYTES):
                chunk = uuid.uuid4().int >> 65
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                w = Words(part.column("text"))
                h, doc = w.hashes(), w.doc_of_word()
                order = np.lexsort((h, _block_of(h, blocks)))
                h = h[order]
                new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
                code = np.empty(len(h), np.int64)
                code[order] = np.cumsum(new) - 1
                words, one = h[new], order[new]
                trained = np.bincount(code[~held[doc]], minlength=len(words))
                block = _block_of(words, blocks)
                cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(words) else np.zeros(1, int)
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    starts, sizes = w.starts[one[lo:hi]], (w.ends - w.starts)[one[lo:hi]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([chunk]), pa.array([int(block[lo])]), pa.array([int(lo)]), _list(words[lo:hi].view(np.int64), pa.int64()), _list(trained[lo:hi], pa.int32()),
                        pa.array([planes(sizes)], pa.binary()), pa.array([gather(w.buf, starts, sizes).tobytes()], pa.binary()),
                        pa.nulls(1, pa.list_(kind)), pa.nulls(1, pa.list_(pa.bool_())), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int32())),
                        pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names)
                key = np.sort((doc << 32) | code)
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
                times = np.diff(np.append(first, len(key)))
                own, code = key[first] >> 32, key[first] & 0xFFFFFFFF
                step = np.diff(code, prepend=0)
                step[np.concatenate(([True], own[1:] != own[:-1]))[:len(own)]] = code[np.concatenate(([True], own[1:] != own[:-1]))[:len(own)]]
                cut = np.searchsorted(own, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int32())),
                    pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id")),
                    _list(held, pa.bool_()), _list(w.counts, pa.int64()), _list(cut, pa.int32()), pa.array([planes(step)], pa.binary()), pa.array([planes(times)], pa.binary())], names)
    return run


VOCAB = "block long, hash array<long>, n array<long>, size binary, spelt binary"


def _merge(table: pa.Table) -> pa.Table:
    """The distinct words of a block with their training counts, in rows of ROW_WORDS."""
    flat = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table.column(c).chunks])
    h, n = flat("hash").view(np.uint64), flat("n").astype(np.int64)
    sizes = np.concatenate([unplanes(x) for x in table.column("size").to_pylist()])
    spelt = np.frombuffer(b"".join(table.column("spelt").to_pylist()), np.uint8)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    total, one = np.add.reduceat(n[order], first), order[first]
    rows = []
    for i in range(0, len(one), ROW_WORDS):
        take = one[i:i + ROW_WORDS]
        rows.append((h[take].view(np.int64), total[i:i + ROW_WORDS], planes(sizes[take]), gather(spelt, starts[take], sizes[take]).tobytes()))
    return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int64()), "hash": pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                     "n": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "size": pa.array([r[2] for r in rows], pa.binary()), "spelt": pa.array([r[3] for r in rows], pa.binary())})


def _offsets(size: bytes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(unplanes(size))))


def _expect(shared):
    """(piece, uses): expected uses of the pieces in the training words of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        total = np.zeros(len(lattice.pieces))
        for batch in batches:
            for i in range(batch.num_rows):
                n, sizes = batch.column("n")[i].values.to_numpy(), unplanes(batch.column("size")[i].as_py())
                buf, known = np.frombuffer(batch.column("spelt")[i].as_py(), np.uint8), n > 0
                sub = gather(buf, (np.cumsum(sizes) - sizes)[known], sizes[known])
                total += lattice.score(sub, np.concatenate(([0], np.cumsum(sizes[known]))), n[known].astype(float))[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])
    return run


REPLY = "chunk long, base long, n array<long>, logp array<double>"


def _answer(chunks: pa.Table, vocabulary: pa.Table, shared) -> pa.Table:
    """For the words of each chunk in a block: training count and log probability, in the words' order."""
    lattice = Lattice(*shared.value)
    hashes, counts, logps = [], [], []
    for i in range(vocabulary.num_rows):
        hashes.append(vocabulary.column("hash")[i].values.to_numpy().view(np.uint64))
        counts.append(vocabulary.column("n")[i].values.to_numpy())
        logps.append(lattice.score(np.frombuffer(vocabulary.column("spelt")[i].as_py(), np.uint8), _offsets(vocabulary.column("size")[i].as_py()))[0])
    h, n, z = (np.concatenate(x) if x else np.zeros(0) for x in (hashes, counts, logps))
    order = np.argsort(h, kind="stable")
    h, n, z = h[order], n[order], z[order]
    at = [np.searchsorted(h, chunks.column("hash")[i].values.to_numpy().view(np.uint64)) for i in range(chunks.num_rows)]
    return pa.table({"chunk": chunks.column("chunk"), "base": chunks.column("base"), "n": pa.array([n[i] for i in at], pa.list_(pa.int64())),
                     "logp": pa.array([z[i] for i in at], pa.list_(pa.float64()))})


def _sum(documents: pa.Table, replies: pa.Table, base_log, end_n: int, end_logp: float) -> pa.Table:
    """Scores of the documents of a chunk."""
    count = lambda c: [replies.column(c)[i].values.to_numpy() for i in np.argsort(replies.column("base").to_numpy())]
    n, z = (np.concatenate(x) if x else np.zeros(0) for x in (count("n"), count("logp")))
    out = []
    for i in range(documents.num_rows):
        cut = documents.column("cut")[i].values.to_numpy().astype(np.int64)
        docs = len(cut) - 1
        own, times = np.repeat(np.arange(docs), np.diff(cut)), unplanes(documents.column("times")[i].as_py())
        step = unplanes(documents.column("code")[i].as_py())
        total = np.cumsum(step)
        before = np.repeat(np.concatenate(([0], total))[cut[:-1]], np.diff(cut))
        code = total - before
        add = lambda x: np.bincount(own, times * x, minlength=docs)  # noqa: B023, E731
        tokens = documents.column("tokens")[i].values.to_numpy()
        out.append(pa.table({
            "doc_id": documents.column("doc_id")[i].values, "held_out": documents.column("held")[i].values, "n_tokens": tokens + 1,
            "n_known": add(n[code] > 0).astype(np.int64) + int(end_n > 0), "base_score": add(base_log(n[code])) + float(base_log(np.array([end_n]))[0]),
            "score": (add(z[code]) + end_logp) / LOG10}))
    return pa.concat_tables(out)


def lattice_scores(docs: DataFrame, vocabulary: str = VOCABULARY, modulus: int = 5, remainder: int = 1,
                   scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Tokens are words (runs of non-space bytes, A-Z lower-cased), then one end. The model learns from the rows
    whose crc32 of the id leaves another remainder than ``remainder``. base_score is the sum over tokens of
    log10((c + 0.5) / (N + 0.5 * (V + 1))) with a token's training count c, all training tokens N and distinct
    ones V. score is log10 of the probability of the text under the lattice model: each word the sum over all
    its segmentations into pieces, the end a piece of its own.

    Null and empty texts are one end. Texts and words of any length are read whole; repeated rows count
    again and get equal scores; a row with a null id is not held out; an empty table gives no rows; with no
    training rows N and V are 0 and the pieces keep the vocabulary's weights; other columns are ignored.
    ``vocabulary`` is read on the driver and broadcast (some ten thousand pieces).
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lattice")
    held = F.coalesce(crc_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 20 // BLOCK_WORDS + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = scratch.write(rows.mapInArrow(_code(blocks), CHUNKS.format(id=f"array<{kind}>")), "chunks")
    words = coded.where("block is not null")
    vocab = scratch.write(words.select("block", "hash", "n", "size", "spelt").groupBy("block").applyInArrow(_merge, VOCAB), "vocabulary")
    seen = vocab.select(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
                        F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + (x > 0).cast("long")).alias("v")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    ends = (coded.where("block is null").select(F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + (~x).cast("long")).alias("n")).agg(F.sum("n").alias("n")).first().n) or 0
    n_all, n_distinct = (seen.n or 0) + ends, (seen.v or 0) + (ends > 0)
    pieces, logp = read_vocabulary(vocabulary)
    uses = np.zeros(len(pieces))
    expected = vocab.mapInArrow(_expect(spark.sparkContext.broadcast((pieces, logp))), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    for r in expected.collect():  # a row for each piece of the vocabulary
        uses[r.piece] = r.uses
    whole = uses.sum() + PRIOR + ends + 1
    learnt = spark.sparkContext.broadcast((pieces, np.log((uses + PRIOR * np.exp(logp)) / whole)))
    end_logp = float(np.log((ends + 1) / whole))
    base_log = lambda c: np.log10((c + 0.5) / (n_all + 0.5 * (n_distinct + 1)))
    replies = scratch.write(words.select("block", "chunk", "base", "hash").groupBy("block").cogroup(vocab.groupBy("block")).applyInArrow(
        lambda a, b: _answer(a, b, learnt), REPLY), "replies")
    scored = (coded.where("block is null").select("chunk", "doc_id", "held", "tokens", "cut", "code", "times").groupBy("chunk").cogroup(replies.groupBy("chunk"))
              .applyInArrow(lambda a, b: _sum(a, b, base_log, ends, end_logp), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))
