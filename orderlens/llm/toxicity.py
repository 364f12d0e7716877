"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Each coordinate has its own learning rate and an L1 penalty, so most weights stay exactly zero and
the model that is broadcast for scoring is a short sorted list of (feature, weight).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.labels import crc_remainder, training_rows
from orderlens.llm.store import Scratch
from orderlens.llm.textstats import HEAD
from orderlens.llm.words import PLACE, Words, mix, span_hashes, text_chunks, unique

#: Hash space of the features; the model cannot have more weights than this.
BITS = 20
#: Labelled documents the model is fitted on, at most.
MOST_TRAINING_ROWS = 20_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 0.1
PASSES = 5
#: Characters of the word beginnings that are features besides the words.
STEMS = (3, 4, 5, 6, 7)
BORDER = np.zeros(256, bool)
BORDER[list(b".,;:!?\"'()[]{}<>*#$%&|-_")] = True


def features(texts: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, one after the other, and where each text's begin.

    Words are lower-cased (A-Z) with punctuation at either end taken off. Features are the words, their
    first STEMS characters where they are longer (a word n-gram over stems, which joins the forms of a
    word), pairs of neighbours, and pairs with a word between. ``used`` marks the features of interest.
    """
    w = Words(texts)
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(8):
        ends -= BORDER[w.buf[ends - 1]] & (ends - starts > 1)
        starts += BORDER[w.buf[starts]] & (ends - starts > 1)
    h, doc = span_hashes(w.buf, starts, ends), w.doc_of_word()
    found: list[np.ndarray] = []

    def add(owner: np.ndarray, hashes: np.ndarray) -> None:
        x = hashes >> np.uint64(64 - BITS)
        if used is not None:
            keep = used[x]
            owner, x = owner[keep], x[keep]
        found.append((owner.astype(np.uint64) << np.uint64(BITS)) | x)

    add(doc, h)
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            same = doc[gap:] == doc[:-gap]
            add(doc[gap:][same], mix(h[:-gap][same] * PLACE[gap] + h[gap:][same] * PLACE[gap + 8]))
        chars = np.append(np.flatnonzero(HEAD[w.buf]), len(w.buf))
        first = np.searchsorted(chars, starts)
        for size in STEMS:
            stop = chars[np.minimum(first + size, len(chars) - 1)]
            longer = stop < ends
            add(doc[longer], mix(span_hashes(w.buf, starts[longer], stop[longer]) + np.uint64(size)))
    key = unique(np.concatenate(found))
    off = np.searchsorted(key >> np.uint64(BITS), np.arange(len(w.off)))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), off


def ftrl(docs: list[np.ndarray], y: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights (dense) and bias after ``passes`` over the documents' feature lists, in their order."""
    z, n, w = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    for _ in range(passes):
        for x, label in zip(docs, y, strict=True):
            p = 1.0 / (1.0 + np.exp(-np.clip(bias + w[x].sum(), -35, 35)))
            g = p - label
            if abs(g) < 1e-4:
                continue
            g2 = g * g
            old = n[x]
            new = old + g2
            z[x] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w[x]
            n[x] = new
            zx = z[x]
            w[x] = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(new)) / ALPHA + L2))
            s = (np.sqrt(nb + g2) - np.sqrt(nb)) / ALPHA
            zb, nb = zb + g - s * bias, nb + g2
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, held_out, scratch: Scratch, label: str = "toxic",
        most_rows: int = MOST_TRAINING_ROWS) -> DataFrame:
    """(feature, weight) rows of the fitted model, feature -1 for the bias; only weights that are not 0.

    FTRL is sequential: the bounded sample goes through one task, ordered by a hash of the id, so the
    model is the same in every run. Without labels of both kinds there are no weights but the bias.
    """
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, y = [], []
        for batch in batches:
            for part in text_chunks(batch, "text"):
                x, off = features(part.column("text"))
                x = x.astype(np.int32)
                lists += [x[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
                y.append(part.column("y").to_numpy(zero_copy_only=False))
        if not lists:
            return
        w, bias = ftrl(lists, np.concatenate(y).astype(float))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], ["feature", "weight"])

    rows = scratch.write(training_rows(docs, labels, label, held_out, most_rows), "sample")
    one = rows.coalesce(1).sortWithinPartitions("order", "doc_id", F.xxhash64("text"))  # whatever the shuffle settings
    return scratch.write(one.select("text", "y").mapInArrow(train, "feature long, weight double"), "weights")


def score(docs: DataFrame, model: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``name``, the probability that the text is toxic; a null text is empty
    and an empty text gets the bias alone. The model has at most 2^BITS weights."""
    weights = model.collect()
    at = np.array([r.feature for r in weights if r.feature >= 0], np.int64)
    value = np.array([r.weight for r in weights if r.feature >= 0], float)
    bias = sum(r.weight for r in weights if r.feature < 0)
    shared = docs.sparkSession.sparkContext.broadcast((at, value, bias))
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, bias = shared.value
        w = np.zeros(1 << BITS)
        w[at] = value
        used = w != 0
        for batch in batches:
            scores = []
            for part in text_chunks(batch, "text"):
                x, off = features(part.column("text"), used)
                sums = np.bincount(np.repeat(np.arange(len(off) - 1), np.diff(off)), w[x], minlength=len(off) - 1)
                scores.append(1.0 / (1.0 + np.exp(-np.clip(bias + sums, -35, 35))))
            out = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], [*keep, name])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(apply, schema)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0,
             scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (other columns are ignored).

    Labels are read only for ids whose crc32 leaves another remainder than ``remainder``. Null, empty
    and very long texts get a score; repeated rows get equal scores; a null id is not held out and
    never trains; an empty table gives no rows; without usable labels every score is 0.5.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    held = F.coalesce(crc_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False))
    model = fit(docs, labels, held, scratch)
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
