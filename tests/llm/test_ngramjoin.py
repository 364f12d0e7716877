import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from orderlens.llm import ngramjoin
from orderlens.llm.ngramjoin import ngram_jaccard_join

from .conftest import ODD_ROWS
from .test_words import WORD, lowered


def brute(rows, n, percent):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(lowered(text))
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (doc, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None), len(links[i])))
    return out


def check(make_docs, rows, n=4, percent=85):
    got = [tuple(r) for r in ngram_jaccard_join(make_docs(rows), n, percent).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, n, percent), key=key)


def edited(rng, words, share):
    return " ".join(rng.choice(["q", "r", "s", "t", "u"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_matches_brute_force(make_docs, n, percent):
    rng = random.Random(n)
    rows, common = [], [f"c{i}" for i in range(30)]
    for d in range(12):
        base = [f"b{d}x{i}" for i in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 9)):
            text = edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))
            rows.append((len(rows) * 3 % 101, (" ".join(common) + " " if rng.random() < 0.5 else "") + text))
    check(make_docs, rows, n, percent)


def test_large_group_of_near_copies(make_docs):
    """More rows than a wide column and a block of rows hold, around the threshold."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(70)]
    rows = [(1000 - i, edited(rng, base, 0.015)) for i in range(420)] + [(2000 + i, " ".join(base)) for i in range(300)]
    rows += [(5000 + i, edited(rng, [f"v{i % 3}y{k}" for k in range(40)], 0.03)) for i in range(60)]
    check(make_docs, rows)


def test_odd_rows(make_docs):
    check(make_docs, [r for r in ODD_ROWS if r[0] not in (11, 14)])
    got = {r.doc_id: r for r in ngram_jaccard_join(make_docs(ODD_ROWS)).collect() if r.doc_id in (11, 14)}
    assert got[11].component_id == got[14].component_id == 11 and got[11].n_links == 1


def test_empty(make_docs):
    assert ngram_jaccard_join(make_docs([])).count() == 0


def test_bridge_without_an_id(make_docs):
    """The only row of its set has no id, and two others are linked through it alone."""
    words = [f"w{i}" for i in range(103)]
    a, bridge, b = (" ".join(words[i:i + 97]) for i in (0, 3, 6))
    rows = [(7, a), (None, bridge), (3, b), (20, "other words altogether")]
    assert sorted((c, n) for *_, c, n in brute(rows, 4, 92)) == [(3, 1), (3, 1), (3, 2), (20, 0)]
    check(make_docs, rows, 4, 92)
    check(make_docs, [*rows, *rows, (None, a + " x"), (None, None), (None, "p q r s t"), (None, "p q r s t"), (3, "p q r s t u")], 4, 92)


def near_copies(rng, groups, copies, words=300, share=0.004):
    bases = [[f"g{g}w{i}" for i in range(words)] for g in range(groups)]
    return [(g * copies + c, edited(rng, base, share)) for g, base in enumerate(bases) for c in range(copies)]


def partial_rows(rows, blocks, percent=80):
    """Rows of the partial products of all blocks of columns."""
    text = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows])], ["text"])
    kept = pa.Table.from_batches(ngramjoin._kept_columns(5, percent, SimpleNamespace(value=np.zeros(0, np.uint64)), blocks)(iter([text])))
    block = kept.column("block").to_numpy()
    return sum(ngramjoin._accumulate(percent)(kept.filter(pa.array(block == b))).num_rows for b in np.unique(block))


@pytest.mark.parametrize("blocks", [2, 50, 200])
def test_near_copies_cost_a_few_partial_rows_each(blocks):
    """Near copies share most columns, so each pair of them was a row in every block: 64,181 rows for 50 blocks."""
    rows = near_copies(random.Random(3), groups=4, copies=40)
    assert partial_rows(rows, blocks) <= 5 * len(rows)


@pytest.mark.parametrize("block", [64, 1000])
def test_matches_brute_force_over_many_blocks(make_docs, monkeypatch, block):
    """Keys and counted pairs come from different blocks of columns; groups are wider and narrower than a wide column."""
    monkeypatch.setattr(ngramjoin, "COLUMN_BLOCK", block)
    rng = random.Random(block)
    rows = near_copies(rng, 3, 12, 60, 0.02) + near_copies(rng, 2, 5, 25, 0.03)
    rows += [(r[0] + 900, f"{r[1]} {' '.join(f't{r[0]}x{i}' for i in range(rng.randrange(14)))}") for r in near_copies(rng, 1, 90, 80, 0.005)]
    check(make_docs, [(i, text) for i, (_, text) in enumerate(rows)], 5, 80)


def test_names_of_columns_may_collide(make_docs, monkeypatch):
    """Columns of equal names share a block: rows of equal key names still meet there."""
    monkeypatch.setattr(ngramjoin, "mix", lambda h, mix=ngramjoin.mix: mix(h) & np.uint64(0xFFFFFFFF00000007) if h.dtype == np.uint64 else mix(h))
    rows = near_copies(random.Random(5), 3, 8, 60, 0.01)
    texts = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows])], ["text"])
    kept = pa.Table.from_batches(ngramjoin._kept_columns(5, 80, SimpleNamespace(value=np.zeros(0, np.uint64)), 5)(iter([texts])))
    block = kept.column("block").to_numpy()
    parts = [ngramjoin._accumulate(80)(kept.filter(pa.array(block == b))) for b in np.unique(block)]
    joined = {}
    find = lambda x: x if joined.get(x, x) == x else find(joined[x])
    for a, b in {(r["a"], r["b"]) for p in parts for r in p.to_pylist()}:
        joined[find(a)] = find(b)
    h, off = ngramjoin.ngram_sets(pa.array([r[1] for r in rows]), 5)
    sig = ngramjoin.signatures(h, off).view(np.int64)
    sets = [set(h[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            assert 100 * len(a & b) < 80 * len(a | b) or find(sig[i]) == find(sig[j])
