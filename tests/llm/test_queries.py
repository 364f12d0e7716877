"""The registered queries against their oracle SQL, and the pipeline against brute force."""

import pytest

from orderlens.llm.queries import ORACLE_SQL, QUERIES
from tools.oracle_check import compare, duckdb_con

from .conftest import SF
from .test_containment import shingles
from .test_mixing import targets
from .test_ngramjoin import brute as brute_join
from .test_suffixes import brute as brute_repeats


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_oracle(spark, name):
    result = compare(spark, name, QUERIES[name], ORACLE_SQL[name], SF, duckdb_con(SF))
    assert result["ok"], result["problems"]


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))


def test_pipeline(spark):
    import corpus_pipeline as p

    scratch = p.Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        frames.append(scratch.write(stage(spark, frames[-1], SF), str(k)))
    text = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames[:5]]
    assert all(f.columns == columns for f in frames[:5])
    # toxicity: labelled documents are told apart, the rest stays whole
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert text[1].items() <= text[0].items()
    assert all((d in text[1]) == (toxic[d] == 0) for d in text[0] if d in toxic)
    # near copies: one of each component
    joined = brute_join(list(text[1].items()), 5, 80)
    assert set(text[2]) == {c for _, _, c, _ in joined} and text[2].items() <= text[1].items()
    # repeats: later occurrences are cut, words and order of the rest stay
    repeats = {d: later for (d, _), (_, later) in brute_repeats(list(text[2].items())).items()}
    for d, t in text[2].items():
        left = [w for i, w in enumerate(t.encode().split()) if i not in repeats.get(d, ())]
        assert text[3].get(d, "").encode().split() == left and (d in text[3]) == bool(left or not repeats.get(d))
    # benchmark: whoever holds an item goes
    items = [s for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (s := shingles(r.text))]
    assert set(text[4]) == {d for d, t in text[3].items() if not any(100 * len(s & shingles(t)) >= 80 * len(s) for s in items)}
    # mixture
    mixed = frames[5].collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = {}
    for d, t in text[4].items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(t.encode().split())
    want = targets(sizes, (3, 1, 2), 1.5, 2)
    for s in sizes:
        mine = [r for r in mixed if r.source == s]
        assert all(0 < r.taken <= 2 * r.size and abs(r.target - want[s]) < 1e-6 * want[s] + 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 0.1 * want[s] + 256
    assert p.run(spark, SF).count() == len(mixed)


def test_pipeline_rows_with_null_and_repeated_ids(spark, make_docs):
    import corpus_pipeline as p

    text = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    a, b, d, e = (text(c) for c in "abde")
    rows = [(3, a), (5, a), (5, b), (None, a + " end"), (None, d), (None, d), (None, d + " end"), (7, e), (7, e), (None, e), (8, None), (8, ""), (None, None), (None, " ")]
    kept = p.drop_near_copies(spark, make_docs(rows), SF)
    assert kept.columns == make_docs(rows).columns
    got = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    null = [t for i, t in got if i is None and t and t.strip()]
    assert sorted((x for x in got if x[0] is not None), key=str) == sorted([(3, a), (5, b), (7, e), (8, None), (8, "")], key=str)
    assert len(null) == 1 and null[0] in (d, d + " end")
    assert sorted((t for i, t in got if i is None and t not in null), key=str) == [" ", None] and len(got) == 8
    for order in (rows[::-1], rows[5:] + rows[:5]):
        assert sorted(p.drop_near_copies(spark, make_docs(order), SF).collect(), key=str) == sorted(kept.collect(), key=str)

    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 9)
    rows = [(None, f"{a} {item} {b}"), (None, a), (5, f"{b} {item}"), (5, b), (6, None), (None, None)]
    left = [(r.doc_id, r.text) for r in p.drop_contaminated(spark, make_docs(rows), SF).collect()]
    assert sorted(left, key=str) == sorted([(None, a), (5, b), (6, None), (None, None)], key=str)
