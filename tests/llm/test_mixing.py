import numpy as np

from orderlens.llm.mixing import _feistel, block_texts, mix_sources, words_taken

from .conftest import ODD_ROWS
from .test_words import WORD


def targets(sizes, weights, total, most):
    """Shares by weight of what is left, again and again, capping whatever exceeds its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), total * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share >= most * sizes[s]}
        if not over:
            return out | {s: weight[s] * share for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(make_docs, rows, **options):
    docs = make_docs(rows)
    got_rows, slots, pieces = mix_sources(docs, **options)
    taken = words_taken(got_rows, slots, pieces).collect()
    sizes = {}
    for r in rows:
        source = r[2] if len(r) > 2 else "s"
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(r[1] or ""))
    want = targets(sizes, (3, 1, 2), 1.5, 2)
    assert len(taken) == len(rows)
    for source in sizes:
        mine = [r for r in taken if r.source == source]
        assert all(r.source_size == sizes[source] and abs(r.target - want[source]) <= 1e-6 * max(1, want[source]) for r in mine)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[source]) <= 0.1 * want[source] + 2 * options.get("block_words", 128)
    return docs, slots, pieces, taken


def test_targets_and_blocks(make_docs):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rng.integers(0, 200))), s) for i, s in enumerate(rng.choice(["a", "b", "B", "é", None], 300, p=[0.5, 0.2, 0.2, 0.05, 0.05]))]
    docs, slots, pieces, taken = check(make_docs, rows, block_words=16, shard_slots=500)
    again = words_taken(*mix_sources(docs.repartition(7), block_words=16, shard_slots=500)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, taken)) == sorted(map(key, again))
    texts = block_texts(slots, pieces, docs).collect()
    words = [w for t in texts for w in t.text.split(" ")]
    assert len(words) == sum(r.taken for r in taken) and max(len(t.text.split(" ")) for t in texts) == 16
    per_doc = {r.doc_id: r.taken for r in taken}
    assert {i: sum(w.startswith(f"w{i}x") for w in words) for i in (3, 50, 200)} == {i: per_doc[i] for i in (3, 50, 200)}
    shards = {}
    for t in texts:
        shards[t.shard] = shards.get(t.shard, 0) + 1
    assert all(n <= 500 for s, n in shards.items()) and len(shards) > 1


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5):
            got = _feistel(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got) == list(range(n))
    big = _feistel(np.arange(1000), np.full(1000, 1000), np.full(1000, 9, np.uint64))
    assert (big != np.arange(1000)).mean() > 0.9


def test_odd_rows(make_docs):
    check(make_docs, [(r[0], r[1], ("x", "y", None)[i % 3]) for i, r in enumerate(ODD_ROWS)])


def test_empty(make_docs):
    rows, slots, pieces = mix_sources(make_docs([]))
    assert words_taken(rows, slots, pieces).count() == 0 and slots.count() == 0
    rows, slots, pieces = mix_sources(make_docs([(1, None), (2, " ")]))
    assert [r.taken for r in words_taken(rows, slots, pieces).collect()] == [0, 0]
