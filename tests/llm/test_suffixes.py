import random
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from orderlens.llm.suffixes import _windows, cut_passages, repeated_passages, row_key, windows

from .conftest import ODD_ROWS
from .test_words import lowered


def brute(rows):
    seen, repeated, later = defaultdict(list), defaultdict(set), defaultdict(set)
    for doc, text in sorted({(r[0], r[1]) for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0])):
        w = lowered(text).encode().split()
        for i in range(len(w) - 49):
            seen[tuple(w[i:i + 50])].append(((doc, text), i))
    for places in seen.values():
        for k, (doc, i) in enumerate(places if len(places) > 1 else []):
            repeated[doc].update(range(i, i + 50))
            if k:
                later[doc].update(range(i, i + 50))
    return {d: (repeated[d], later[d]) for d in repeated}


def check(make_docs, rows):
    docs = make_docs([r[:2] for r in rows])
    found = repeated_passages(docs)
    words = lambda x: {i for s in x for i in range(s.start, s.stop)}
    keyed = docs.select("doc_id", "text", row_key().alias("key_of_row")).distinct()
    got = {(r.doc_id, r.text): (words(r.repeated), words(r.later)) for r in keyed.join(found, keyed.key_of_row == found.row).collect()}
    assert got == brute(rows)
    return docs, found


def test_matches_brute_force(make_docs):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    passages = [[word() for _ in range(rng.choice([48, 49, 50, 51, 60, 130]))] for _ in range(12)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [word() for _ in range(rng.randrange(0, 60))]
            text += rng.choice(passages)
        if d % 9 == 0:
            text += text[:70]
        if d % 13 == 0:
            text += ["again", "and"] * 60
        rows.append((d * 7 % 61, "  ".join(text)))
    rows += [(500 + i, rows[i][1]) for i in range(5)] + rows[:2] + [(700, "x " * 55), (701, "x " * 49)]
    check(make_docs, rows)


def test_cut(make_docs):
    one = " ".join(f"p{i}" for i in range(60))
    rows = [(2, f"before\n{one} after"), (1, f"start {one.upper()}  tail"), (3, one), (4, "clean text"), (5, None), (6, "")]
    docs, found = check(make_docs, rows)
    kept = {r.doc_id: r for r in cut_passages(docs, found).collect()}
    assert {d: r.text for d, r in kept.items()} == {1: rows[1][1], 2: "before\nafter", 4: "clean text", 5: None, 6: ""}
    assert kept[2].sig == "x" and list(kept[2].asDict()) == docs.columns


def test_odd_rows(make_docs):
    check(make_docs, ODD_ROWS)


def test_empty(make_docs):
    assert repeated_passages(make_docs([])).count() == 0


def around_a_phrase(n):
    """Texts that share 30 words, less than a passage, with other words around them."""
    footer = " ".join(f"f{i}" for i in range(30))
    return [(d, " ".join(f"a{d}x{i}" for i in range(25)) + f" {footer} " + " ".join(f"b{d}x{i}" for i in range(25))) for d in range(n)]


def test_windows_around_a_common_phrase_are_spread():
    texts = pa.array([t for _, t in around_a_phrase(400)])
    _, doc, _, least, _, _ = windows(texts)
    head, n = np.unique(least, return_counts=True)
    hot = head[n > 399].view(np.int64).tolist()
    assert hot
    k = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(k)), pa.array(range(k)), texts, pa.array([hot] * k)], ["row", "place", "text", "heads"])
    sizes = np.zeros(16, int)
    for out in _windows(16, SimpleNamespace(value=np.array(hot, np.int64).view(np.uint64)))([batch]):
        for block, hashes in zip(out.column("block").to_pylist(), out.column("hash").to_pylist(), strict=True):
            sizes[block] += len(hashes)
    assert sizes.sum() >= 400 and sizes.max() < 2 * sizes.mean()


def test_common_phrase_matches_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr("orderlens.llm.suffixes.HOT", 5)
    rows = around_a_phrase(40)
    check(make_docs, [*rows, (100, rows[3][1] + " more"), (101, "before " + rows[5][1])])
