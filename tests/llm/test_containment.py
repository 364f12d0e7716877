import random
import tracemalloc

import numpy as np
import pytest

from orderlens.llm.containment import ItemBlock, contained_items, sketches_for
from orderlens.llm.words import unique

from .conftest import ODD_ROWS
from .test_words import WORD, lowered


def shingles(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, items, percent=80):
    sets = [(i, shingles(t)) for i, t in items]
    return sorted(((d, i, len(s), len(s & x)) for d, t in docs for x in [shingles(t)] for i, s in sets if s and 100 * len(s & x) >= percent * len(s)), key=str)


def check(spark, make_docs, docs, items, **options):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in contained_items(make_docs(docs), table, **options).collect()), key=str)
    assert got == brute(docs, items, options.get("percent", 80))
    return got


def test_matches_brute_force(spark, make_docs):
    rng = random.Random(5)
    word = lambda: "k" + str(rng.randrange(5000))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 80])))) for i in range(60)] + [(7, None), (8, "")]
    docs = []
    for d in range(150):
        text = [word() for _ in range(rng.choice([0, 3, 50, 4000]))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1] or ""
            item = [word() if rng.random() < rng.choice([0, 0, 0.02, 0.2]) else w for w in item.split()]
            at = rng.randrange(len(text) + 1)
            text[at:at] = item
        docs.append((d, " ".join(text).upper() if d % 5 == 0 else " ".join(text)))
    assert len(check(spark, make_docs, docs, items)) > 30
    check(spark, make_docs, docs[:40], items, item_block=9)


@pytest.mark.parametrize("percent", [20, 50, 100])
def test_other_percentages(spark, make_docs, percent):
    """Down to documents that are a fifth of an item."""
    rng = random.Random(percent)
    items = [(i, " ".join(f"k{rng.randrange(3000)}" for _ in range(rng.choice([1, 4, 9, 30, 104, 400])))) for i in range(40)]
    docs = []
    for d in range(160):
        words = rng.choice(items)[1].split()
        n = max(1, int(len(words) * rng.choice([0.15, 0.25, 0.3, 0.5, 0.55, 0.9, 1])))
        at = rng.randrange(len(words) - n + 1)
        docs.append((d, " ".join([f"z{d}x{j}" for j in range(rng.choice([0, 0, 2, 300]))] + words[at:at + n])))
    assert len(check(spark, make_docs, docs, items, percent=percent)) > 15


def test_ids_of_any_type(spark, make_docs):
    import decimal

    docs = make_docs([(1, "a b c d e f g h i j")])
    for kind, value in (("short", 3), ("double", 2.5), ("decimal(10,2)", decimal.Decimal("7.25")), ("string", "x"), ("struct<a: int, b: string>", (1, "y"))):
        items = spark.createDataFrame([(value, "b c d e f g h i")], f"item_id {kind}, text string")
        row, = contained_items(docs, items).collect()
        assert (tuple(row.item_id) if isinstance(value, tuple) else row.item_id) == value


def test_odd_rows(spark, make_docs):
    check(spark, make_docs, ODD_ROWS, [(1, "c d e f g h i"), (1, "c d e f g h i"), (None, "one"), (3, "du du du du du du"), (4, None)])


def test_empty(spark, make_docs):
    check(spark, make_docs, [], [(1, "a b c d e f")])
    check(spark, make_docs, ODD_ROWS[:8], [])


def test_small_items_get_more_sketches():
    assert sketches_for(1) > sketches_for(10) > sketches_for(100) == 1


def test_memory_follows_shingles_and_not_bins():
    """200 items against one document of 200,000 shingles: dense bins took 0.8 GB."""
    rng = np.random.default_rng(2)
    sets = [unique(rng.integers(0, 2**63, 40, dtype=np.uint64)) for _ in range(200)]
    text = np.concatenate([rng.integers(0, 2**63, 200_000, dtype=np.uint64), *sets[:50]])
    tracemalloc.start()
    found = ItemBlock(sets).candidates(text, np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.tolist() == [[0, i] for i in range(50)] and peak < 100 << 20
