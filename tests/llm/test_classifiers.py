import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orderlens.llm import qda, toxicity
from orderlens.llm.labels import training_rows

from .conftest import ODD_ROWS, SF, SF1


def accuracy(spark, scored, label):
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    hit = [r.predicted for r in rows if r[label] == 1]
    clean = [r.predicted for r in rows if r[label] == 0]
    return len(rows), np.mean(hit), np.mean(clean)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    n, caught, false = accuracy(spark, toxicity.toxicity(docs, labels), "toxic")
    assert n > 700 and caught > 0.8 and false < 0.01


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    n, good, junk = accuracy(spark, qda.quality(docs, labels), "quality")
    assert n > 1000 and good > 0.98 and junk < 0.05


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    docs = [np.unique(np.concatenate((rng.integers(100, 5000, 40), [7] if i % 5 == 0 else [8]))) for i in range(600)]
    w, bias = toxicity.ftrl(docs, np.array([i % 5 == 0 for i in range(600)], float))
    assert w[7] > 0 > bias and (w != 0).sum() < 600
    assert all((bias + w[x].sum() > 0) == (i % 5 == 0) for i, x in enumerate(docs))


def plain_ftrl(docs, y, passes):
    """FTRL-proximal coordinate by coordinate, in plain Python: as published, weights from z and n when they are used."""
    z, n = {}, {}
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        zi, free = z.get(i, 0.0), i == "bias"
        if not free and abs(zi) <= l1:
            return 0.0
        shrunk = zi if free else zi - math.copysign(l1, zi)
        return -shrunk / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + (0 if free else l2))

    for _ in range(passes):
        for x, label in zip(docs, y, strict=True):
            used = [*x, "bias"]
            w = {i: weight(i) for i in used}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
            g = p - label
            if abs(g) < 1e-4:
                continue
            for i in used:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_plain_coordinates():
    rng = np.random.default_rng(3)
    docs = [np.unique(np.concatenate((rng.integers(50, 400, 25), [rng.integers(5) + 10 * (i % 3 == 0)]))) for i in range(300)]
    y = np.array([(i % 3 == 0) ^ (rng.random() < 0.05) for i in range(300)], float)
    w, bias = toxicity.ftrl(docs, y, 3)
    want = plain_ftrl([x.tolist() for x in docs], y, 3)
    assert abs(bias - want.pop("bias")) < 1e-9
    assert np.allclose(w[list(want)], list(want.values()), atol=1e-9) and (w != 0).sum() == sum(v != 0 for v in want.values()) > 5


def test_the_sample_is_bounded_in_rows(spark, make_docs):
    """One id with very many texts does not go whole into the training task."""
    docs = make_docs([(1, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 30)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, "toxic", F.lit(False), 40)
    assert rows.count() == 40
    assert training_rows(docs, labels, "toxic", F.lit(False), 10_000).count() == 528


def plain_quality(docs, labels):
    """Means, covariances, shrinkage and posterior with numpy on the whole table: (doc_id, score)."""
    kinds = {}
    for i, q in labels:
        if i is not None and q in (0, 1):
            kinds[i] = max(q, kinds.get(i, 0))
    x = qda.statistics(pa.array([t for _, t in docs], pa.string()))
    train = [i is not None and i in kinds and zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in docs]
    density = []
    for c in (1, 0):
        mine = np.array([t and kinds[i] == c for t, (i, _) in zip(train, docs, strict=True)])
        mean, cov = x[mine].mean(0), np.cov(x[mine].T, bias=True)
        cov = (1 - qda.SHRINKAGE) * cov + (qda.SHRINKAGE * np.trace(cov) / qda.DIM + qda.FLOOR) * np.eye(qda.DIM)
        away = x - mean
        density.append(np.log(mine.sum() / sum(train)) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,ij->i", away, np.linalg.solve(cov, away.T).T)))
    return 1 / (1 + np.exp(-np.clip(density[0] - density[1], -700, 700)))


def test_quality_equals_numpy_on_a_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = plain_quality(rows, [(r.doc_id, r.quality) for r in labels.collect()])
    got = sorted((r.doc_id, r.score) for r in qda.quality(docs, labels).collect())
    assert [g[0] for g in got] == [r[0] for r in rows] and np.allclose([g[1] for g in got], want, atol=1e-6)


def test_features():
    x, off = toxicity.features(pa.array(["Bad! bad (bad)", None, "bad"]))
    assert off[1] == off[2] and set(x[off[2]:off[3]]) < set(x[off[0]:off[1]])


def test_log_density():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(500, qda.DIM))
    b = rng.normal(1, 2, size=(300, qda.DIM))
    f = qda.factors([(0, 300, b.mean(0), np.cov(b.T)), (1, 500, a.mean(0), np.cov(a.T))])
    x = rng.normal(size=(5, qda.DIM))

    def density(c, mean, cov):
        cov = (1 - qda.SHRINKAGE) * cov + (qda.SHRINKAGE * np.trace(cov) / qda.DIM + qda.FLOOR) * np.eye(qda.DIM)
        return [np.log(c) - 0.5 * (np.linalg.slogdet(cov)[1] + (v - mean) @ np.linalg.solve(cov, v - mean)) for v in x]

    want = np.array(density(500 / 800, a.mean(0), np.cov(a.T))) - density(300 / 800, b.mean(0), np.cov(b.T))
    assert np.allclose(qda.log_odds(x, f), want)


def odd_labels(spark):
    rows = [(1, 1, 0), (4, 0, 1), (4, 0, 0), (8, None, None), (None, 1, 1), (9, 7, 0), (11, 1, 1), (99, 1, 1)]
    return spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, quality int, toxic int, text string")


def test_odd_rows_and_empty(spark, make_docs):
    docs, labels = make_docs(ODD_ROWS), odd_labels(spark)
    for f, modulus, remainder in ((toxicity.toxicity, 5, 0), (qda.quality, 3, 1)):
        got = f(docs, labels).collect()
        assert len(got) == len(ODD_ROWS)
        for r in got:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert {r.score for r in f(docs, labels.limit(0)).collect()} == {0.5}
        assert f(make_docs([]), labels).count() == 0
