"""Tokenizer alignment against whole-text encoding and plain sets of end positions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from orderlens.llm import crosstok
from orderlens.llm.crosstok import TOKENIZERS, align, align_tokenizers, load
from orderlens.llm.queries import QUERIES

from .conftest import ODD_ROWS, SF


@pytest.fixture(scope="module")
def loaded():
    return load(tuple(open(f"{TOKENIZERS}/{f}", "rb").read() for f in (crosstok.FILE_A, crosstok.FILE_B)))


def brute(rows, tokenizers):
    """By definition: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), whole texts encoded at once."""
    out, links = [], []
    for doc_id, text in rows:
        spaced = f" {text}".encode()
        a = tokenizers.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = tokenizers.b.encode(text, num_threads=1) if text else []
        if any(b"".join(table[i] for i in ids) != spaced for table, ids in ((tokenizers.bytes_a, a), (tokenizers.bytes_b, b))):
            a, b = [], []
        ends_a, ends_b = (np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in ((a, tokenizers.bytes_a), (b, tokenizers.bytes_b)))
        at_a, at_b = dict(zip(ends_a, a, strict=True)), dict(zip(ends_b, b, strict=True))
        common = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for e, i in zip(ends, ids, strict=True) if low < e <= high) for ends, ids in ((ends_a, a), (ends_b, b))) if len(a) < 3000 else "")
            low = high
        out.append((doc_id, len(a), len(b), len(common), ";".join(groups)))
        links.append([(at_a[e], at_b[e]) for e in common])
    count = Counter(x for ls in links for x in ls)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(d, na, nb, ng, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), g) for (d, na, nb, ng, g), ls in zip(out, links, strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.booleans(), st.booleans()), max_size=200))
def test_align(steps):
    ends = np.cumsum([s for s, _, _ in steps] + [1])
    a = np.array([e for e, (_, x, y) in zip(ends, steps, strict=False) if x or not y] + [ends[-1]], np.int64)
    b = np.array([e for e, (_, x, y) in zip(ends, steps, strict=False) if y or not x] + [ends[-1]], np.int64)
    at_a, at_b = align(a, b)
    assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_align_long_stretches():
    a = np.arange(1, 100_001)
    b = np.delete(a, np.arange(5, 99_990, 12_345))
    at_a, at_b = align(a, b)
    assert a[at_a].tolist() == b.tolist() and at_b.tolist() == list(range(len(b)))
    assert [x.tolist() for x in align(a[:0], a[:0])] == [[], []]


def test_tokens(loaded):
    t, table = loaded
    assert t.bytes_a[t.a.token_to_id("Ġ")] == b" " and t.bytes_b[t.b.piece_to_id("<0x0A>")] == b"\n"
    assert all(len(x) for i, x in enumerate(t.bytes_b) if not t.b.is_control(i) and not t.b.is_unknown(i)) and all(t.bytes_a)
    assert len(table.keys) < 1_000_000


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="ab Zé ñ.,'s\t\n  ▁日́😀<|/>09  ", max_size=60))
def test_segments_encode_as_the_whole(loaded, text):
    t, _ = loaded
    raw = np.frombuffer(f" {text}".encode(), np.uint8)
    start = [0, *crosstok.cuts(raw).tolist(), len(raw)]
    parts = [raw[a:b].tobytes().decode() for a, b in zip(start[:-1], start[1:], strict=True)]
    a, b = t.encode(parts)
    assert sum(a, []) == t.a.encode(f" {text}", add_special_tokens=False).ids
    assert not text or sum(b, []) == t.b.encode(text)


ODD = [*ODD_ROWS, (20, "a <|endoftext|> b <s> </s> <unk> <0x41>"), (21, "x▁y"), (22, "    z"), (23, "  two  spaces  "), (24, "nul\x00 é 日本 😀")]


@pytest.mark.parametrize("sizes", [None, (300, 64)], ids=["whole", "small parts"])
def test_odd_rows(spark, make_docs, loaded, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(crosstok, "ENCODE_BYTES", sizes[0])
        monkeypatch.setattr(crosstok, "ALIGN_BYTES", sizes[1])
    rows = [r for r in ODD if r[0] not in (11, 14)] if sizes else ODD
    got = align_tokenizers(make_docs(rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: str(r[:7]))
    want = sorted(brute(rows, loaded[0]), key=lambda r: str(r[:7]))
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(g[7] == w[7] for g, w in zip(got, want, strict=True) if g[1] < 3000)
    assert dict((r[0], r[1]) for r in got)[21] == 0 and dict((r[0], r[1]) for r in got)[20] > 0
    assert align_tokenizers(make_docs([])).collect() == []


def test_query_on_a_whole_table(spark, loaded):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_cross_tokenizer_alignment"](spark, SF).collect())
    want = sorted(brute(rows, loaded[0]))
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(g[7] == (hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "") for g, w in zip(got, want, strict=True) if w[1] < 3000)
    assert sum(r[1] > 0 for r in want) > len(want) / 2
