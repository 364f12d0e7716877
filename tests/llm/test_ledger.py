import re

from orderlens.llm.ledger import BASE, POLICIES, RULES, ablations, apply_policy, mask_of, quality_ledger

from .conftest import ODD_ROWS
from .test_words import WORD

ROWS = [*ODD_ROWS, (20, "a b\nc d\na b\n\na b \nc d"), (21, "a a a a b a a a a"), (22, "SHOUT!! LOUD!! " * 40), (23, "w### x$$$ " * 40), (24, "x | y | " * 60),
        (25, " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(80))), (26, "line one\r\nline one\r\n" * 30)]


def brute(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    counts = {}
    for x in windows:
        counts[x] = counts.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "n_lines": len(lines), "n_chars": len(text or ""), "n_runs": sum(a == b for a, b in zip(w, w[1:])), "n_distinct_words": len(set(w))}


def test_measurements_and_policies(make_docs):
    got = apply_policy(quality_ledger(make_docs(ROWS))).collect()
    want = sorted((str((r[0], brute(r[1]))) for r in ROWS))
    assert sorted(str((r.doc_id, {k: r[k] for k in brute("")})) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.failed == 0)
        assert bool(r.failed & mask_of(BASE)) == r.base_failed
    kept = {r.doc_id for r in got if r.kept}
    assert 25 in kept and not kept & {1, 2, 13, 22, 23, 24}


def test_ablations(make_docs):
    ledger = quality_ledger(make_docs(ROWS)).cache()
    masks = [r.failed for r in ledger.collect()]
    for version in POLICIES:
        policy = mask_of(POLICIES[version])
        got = {r.rule: (r.n_failed, r.n_only, r.n_rejected) for r in ablations(ledger, version).collect()}
        assert got == {n: (sum(bool(m & mask_of([n])) for m in masks), sum(m & policy == mask_of([n]) for m in masks), sum(bool(m & policy) for m in masks))
                       for n in POLICIES[version]}
    assert [r.n_failed for r in ablations(ledger.limit(0)).collect()] == [0] * len(RULES)


def test_empty(make_docs):
    assert quality_ledger(make_docs([])).count() == 0
