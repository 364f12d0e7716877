import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from orderlens.llm.components import connected_components
from orderlens.llm.store import Scratch
from orderlens.llm.words import Words, shingle_hashes, text_chunks, unique

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b Z,日", max_size=40)), max_size=8))
def test_words_are_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        got = [w.text(k).decode() for k in range(w.off[i], w.off[i + 1])]
        assert got == WORD.findall(lowered(t))


def test_hashes_depend_on_the_word_alone():
    a = Words(pa.array(["x yy zzz", None, "yy " * 400_000, "q" * 600_000 + " yy"]))
    h = a.hashes()
    assert len({int(x) for x in h[a.off[2]:a.off[3]]} | {int(h[1]), int(h[-1])}) == 1
    assert len(unique(h)) == 4
    assert (Words(pa.array(["pad", "x yy"]).slice(1)).hashes() == h[:2]).all()


def test_shingles():
    w = Words(pa.array(["a b c d e", "a b", "", "b c d e", "a b c d"]))
    h, off = shingle_hashes(w.hashes(), w.off, 4)
    assert list(np.diff(off)) == [2, 1, 0, 1, 1]
    assert h[0] == h[4] and h[1] == h[3] and h[2] != h[0]


def test_chunks_cover_the_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["text"])
    parts = list(text_chunks(batch, "text", 12))
    assert sum(p.num_rows for p in parts) == 5 and [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1200)]
    edges = [*chain, *star, (5, 5), (None, 3), (200, 201), (201, 200), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.root for r in connected_components(df, Scratch(spark, "test"), "c").collect()}
    want = [set(range(100, 161)), {7, *range(1000, 1200)}, {5}, {200, 201}]
    assert set(got) == set().union(*want)
    assert len({got[next(iter(s))] for s in want}) == len(want)
    assert all(len({got[x] for x in s}) == 1 and got[min(s)] in s for s in want)
    empty = connected_components(df.limit(0), Scratch(spark, "test"), "e")
    assert empty.columns == ["id", "root"] and empty.count() == 0
