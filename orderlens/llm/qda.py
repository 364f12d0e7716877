"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Both classes get a mean and a covariance shrunk towards a scaled identity. The moments are sums over
all training rows, added up by Spark; only the class sums (a few hundred numbers) reach the driver,
which factors each covariance once. Scoring takes the difference of the Mahalanobis log densities
from the broadcast Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.labels import crc_remainder
from orderlens.llm.store import Scratch
from orderlens.llm.textstats import measure
from orderlens.llm.words import text_chunks

#: Weight of the scaled identity in a class covariance.
SHRINKAGE = 0.05
#: Added to the diagonal: a statistic that never varies in a class still has a finite density.
FLOOR = 1e-4
DIM = 13


def statistics(texts: pa.Array) -> np.ndarray:
    """Transformed statistics, a row for each text: logs of sizes, square roots of shares (which
    spread the low end), all finite for empty texts too."""
    m = measure(texts)
    words, chars, lines = (np.maximum(m[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    share = lambda k, of: np.sqrt(np.minimum(m[k] / of, 1.0))
    return np.stack([
        np.log1p(m["n_words"]) / 4, np.log(chars / words) / 2, share("n_symbols", chars), share("n_upper", chars),
        share("n_digits", chars), share("n_stops", words), share("n_shouts", words), share("n_dup_lines", lines),
        share("n_repeat_words", words), share("n_runs", words), share("n_distinct_words", words),
        share("n_symbol_words", words), share("n_short_lines", lines)], axis=1)


def measure_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics ``x`` of each row of ``docs``."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(part.column("text")) for part in text_chunks(batch, "text")]
            flat = np.concatenate(x).ravel() if x else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * DIM, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measured, f"doc_id {kind}, x array<double>")


def moments(stats: DataFrame, labels: DataFrame, held_out, label: str) -> list[tuple[int, float, np.ndarray, np.ndarray]]:
    """(class, rows, mean, covariance) from all labelled rows of ``stats`` (see measure_rows) that are not held out.

    Labels other than 0 and 1, null labels and null ids are not used; an id's repeated labels count as
    1 if one is 1."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
             .where(~held_out).groupBy("doc_id").agg(F.max("y").alias("y")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros((DIM + 1, DIM + 1)), 1: np.zeros((DIM + 1, DIM + 1))}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, DIM)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
            for c in total:
                total[c] += x[y == c].T @ x[y == c]
        i, j = np.divmod(np.arange((DIM + 1) ** 2), DIM + 1)
        for c, t in total.items():
            if t[0, 0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), c)), pa.array(i), pa.array(j), pa.array(t.ravel())], ["y", "i", "j", "v"])

    cells = stats.where("doc_id is not null").join(known, "doc_id").select("x", "y").mapInArrow(sums, "y long, i long, j long, v double")
    out = []
    got = cells.groupBy("y", "i", "j").agg(F.sum("v").alias("v")).collect()  # 2 classes x (DIM + 1)^2 cells
    for c in (0, 1):
        t = np.zeros((DIM + 1, DIM + 1))
        for r in got:
            if r.y == c:
                t[r.i, r.j] = r.v
        if t[0, 0]:
            mean = t[0, 1:] / t[0, 0]
            out.append((c, t[0, 0], mean, t[1:, 1:] / t[0, 0] - np.outer(mean, mean)))
    return out


def factors(classes: list[tuple[int, float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> dict[int, tuple]:
    """By class: log prior, mean, inverse Cholesky factor and log determinant of the shrunk covariance."""
    rows = sum(n for _, n, _, _ in classes)
    out = {}
    for c, n, mean, cov in classes:
        cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / DIM * np.eye(DIM) + FLOOR * np.eye(DIM)
        low = np.linalg.cholesky(cov)
        out[c] = (np.log(n / rows), mean, np.linalg.inv(low), 2 * np.log(np.diag(low)).sum())
    return out


def log_odds(x: np.ndarray, by_class: dict[int, tuple]) -> np.ndarray:
    """Log density ratio of class 1 to class 0, priors included; 0 unless both classes are known."""
    if len(by_class) < 2:
        return np.zeros(len(x))
    density = {c: prior - 0.5 * (logdet + np.square((x - mean) @ inverse.T).sum(axis=1))
               for c, (prior, mean, inverse, logdet) in by_class.items()}
    return density[1] - density[0]


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, label: str = "quality",
            scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (other columns are ignored).

    Labels are read only for ids whose crc32 leaves another remainder than ``remainder``. The score is
    the posterior probability of label 1. Null and empty texts are scored as texts without words; texts
    of any length are read whole; repeated rows get equal scores; a null id is not held out and never
    trains; an empty table gives no rows; without labels of both classes every score is 0.5.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    held = F.coalesce(crc_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False))
    stats = scratch.write(measure_rows(docs), "statistics")  # a few numbers a text, measured once
    shared = docs.sparkSession.sparkContext.broadcast(factors(moments(stats, labels, held, label)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = log_odds(batch.column("x").flatten().to_numpy().reshape(-1, DIM), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (stats.mapInArrow(apply, f"doc_id {kind}, score double")
            .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
