"""Per-document counts that the quality operators measure, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from orderlens.llm.words import IS_SPACE, Words, mix, shingle_hashes, span_hashes


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


SYMBOL = _bytes("#*$%&|<>")
UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _bytes("0123456789")
STOP = _bytes(".,;:!?")
SHOUT = _bytes("!?")
#: A byte that starts a code point.
HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])

#: What measure() returns, all whole numbers.
MEASURES = ("n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_upper", "n_digits", "n_stops", "n_shouts",
            "n_lines", "n_dup_lines", "n_repeat_words", "n_runs", "n_distinct_words", "n_symbol_words", "n_short_lines")


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[off[1:]] - sums[off[:-1]]


def _equal_earlier(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether an earlier item of the same document is equal, and whether any other is."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    earlier, other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:]] = same
    other[order[1:]] |= same
    other[order[:-1]] |= same
    return earlier, other


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The MEASURES of each text; a null text counts as empty.

    n_lines, n_dup_lines: lines (split at \\n) with a word, and those equal to an earlier line;
    n_repeat_words: words in 3-word windows that the text holds twice or more, the first included;
    n_runs: words equal to the word before; n_symbol_words: words whose last byte is a symbol or !.
    """
    w = Words(texts, lower=False)
    buf, n = w.buf, len(w.off) - 1
    out = {"n_bytes": np.diff(w.byte_off), "n_words": w.counts}
    for name, table in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_stops", STOP), ("n_shouts", SHOUT), ("n_chars", HEAD)):
        out[name] = _per_text(table[buf], w.byte_off)
    out["word_chars"] = _per_text(HEAD[buf] & ~IS_SPACE[buf], w.byte_off)
    doc, hashes = w.doc_of_word(), w.hashes()
    # lines: spans between newlines and text borders
    cut = np.flatnonzero(buf == 0x0A)
    line_start = np.union1d(np.concatenate(([0], cut + 1)), w.byte_off)
    line_start = line_start[line_start < len(buf)]
    line_end = np.append(line_start[1:], len(buf))
    line_end = line_end - ((line_end > line_start) & (buf[np.maximum(line_end, 1) - 1] == 0x0A)) if len(buf) else line_end
    words_in = np.searchsorted(w.starts, line_end) - np.searchsorted(w.starts, line_start)
    with_word = words_in > 0
    line_start, line_end, words_in = line_start[with_word], line_end[with_word], words_in[with_word]
    line_doc = np.searchsorted(w.byte_off, line_start, "right") - 1
    earlier, _ = _equal_earlier(line_doc, span_hashes(buf, line_start, line_end))
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[earlier], minlength=n)
    out["n_short_lines"] = np.bincount(line_doc[words_in <= 2], minlength=n)
    # three-word windows, of texts with three words at least
    shingles, off = shingle_hashes(hashes, w.off, 3)
    window_doc = np.repeat(np.arange(n), np.diff(off))
    _, twice = _equal_earlier(window_doc, shingles)
    first = np.arange(len(shingles)) - off[window_doc] + w.off[window_doc]
    covered = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        covered[first[twice] + k] = True
    out["n_repeat_words"] = _per_text(covered[:len(hashes)], w.off)
    run = np.zeros(len(hashes), bool)
    run[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out["n_runs"] = _per_text(run, w.off)
    seen, _ = _equal_earlier(doc, mix(hashes))
    out["n_distinct_words"] = _per_text(~seen, w.off)
    last = buf[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    out["n_symbol_words"] = _per_text((SYMBOL | _bytes("!"))[last], w.off)
    return {k: np.asarray(out[k], np.int64) for k in MEASURES}
