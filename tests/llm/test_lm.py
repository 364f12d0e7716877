import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from orderlens.llm.lattice import GROUP, Lattice, read_vocabulary
from orderlens.llm.lm import PRIOR, VOCABULARY, lattice_scores, planes, unplanes

from .conftest import ODD_ROWS, SF


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(VOCABULARY)


def brute_words(pieces, logp):
    at = {x: p for x, p in zip(pieces, logp, strict=True)}
    longest = max(map(len, pieces))

    @cache
    def rest(s):
        return float(np.logaddexp.reduce([at[s[:k]] + rest(s[k:]) for k in range(1, min(len(s), longest) + 1) if s[:k] in at])) if s else 0.0
    return rest, at


def score(lattice, words, weight=None):
    buf = np.frombuffer(b"".join(words), np.uint8)
    return lattice.score(buf, np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64))), weight)


def test_lattice(vocabulary):
    lattice, (rest, at) = Lattice(*vocabulary), brute_words(*vocabulary)
    words = [w.encode() for w in ("the", "thandble", "Éréier", "idiot.", "日本語", "x" * 90, "a", "\U0001f600")] + [b""]
    z, uses = score(lattice, words, np.ones(len(words)))
    assert np.allclose(z, [rest(b" " + w) for w in words])
    # expected uses are the derivative of the log probabilities by the logs of the pieces' weights
    for piece in (b"th", b" th", b"er", b"x"):
        i = vocabulary[0].index(piece)
        more = vocabulary[1].copy()
        more[i] += 1e-6
        assert abs((score(Lattice(vocabulary[0], more), words)[0].sum() - z.sum()) / 1e-6 - uses[i]) < 1e-3
    assert abs(np.exp(vocabulary[1]).sum() - 1) < 1e-9


def test_very_long_word(vocabulary):
    lattice = Lattice(*vocabulary)
    word = b"therein" * 900
    spelt = np.frombuffer(b" " + word, np.uint8)
    assert abs(lattice._long(spelt) - score(lattice, [word])[0][0]) < 1e-6
    assert score(lattice, [b"q" * (GROUP + 5), b"the"])[0][0] < -1000


def test_uses_of_long_words(vocabulary, monkeypatch):
    """Words beyond GROUP teach the pieces' weights as all others do."""
    lattice = Lattice(*vocabulary)
    words, weight = [b"therein" * 60, b"the", b"handle" * 50 + b"q"], np.array([2.0, 1.0, 3.0])
    z, uses = score(lattice, words, weight)
    monkeypatch.setattr("orderlens.llm.lattice.GROUP", 128)
    long_z, long_uses = score(lattice, words, weight)
    assert np.allclose(long_z, z) and np.allclose(long_uses, uses) and uses.sum() > 100


def test_planes():
    x = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert (unplanes(planes(x)) == x).all()


def check(docs, rows):
    got = lattice_scores(docs).collect()
    tokens = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter()
    for d, w in tokens:
        if not held(d):
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    want = sorted(str((d, held(d), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n)) for d, w in tokens)
    assert sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)) for r in got) == want
    base = sorted(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None]) for _, w in tokens)
    assert np.allclose(sorted(r.base_score for r in got), base)
    return got, tokens, c


def test_sample_table(spark, vocabulary):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got, tokens, c = check(docs, [(r.doc_id, r.text) for r in docs.collect()])
    words = [w for w in c if w is not None]
    uses = score(Lattice(*vocabulary), words, np.array([float(c[w]) for w in words]))[1]
    whole = uses.sum() + PRIOR + c[None] + 1
    rest, _ = brute_words(vocabulary[0], np.log((uses + PRIOR * np.exp(vocabulary[1])) / whole))
    by = {r.doc_id: r.score for r in got}
    for d, w in tokens[:40]:
        assert abs(by[d] * math.log(10) - sum(rest(b" " + x) for x in w) - math.log((c[None] + 1) / whole)) < 1e-5


def test_odd_rows(make_docs):
    got, _, _ = check(make_docs(ODD_ROWS), ODD_ROWS)
    assert all(r.score < 0 for r in got) and len({r.score for r in got if r.n_tokens == 1}) == 1


def test_empty(make_docs):
    assert lattice_scores(make_docs([])).count() == 0
    assert [(r.train_tokens, r.n_known) for r in lattice_scores(make_docs([(1, "a")] if zlib.crc32(b"1") % 5 == 1 else [(2, None)])).collect()][0][1] in (0, 1)
