"""Segmentation lattices of words over a vocabulary of pieces with log probabilities.

A word is its UTF-8 bytes after a space, the mark of a word's beginning. An edge of its lattice is a piece
that spells the bytes between two positions; every single byte is a piece (byte fallback), so there always
is a path. The probability of a word is the sum over all paths, by forward recursion in log space, for
many words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from orderlens.llm.words import BASE, BASE_INVERSE, BYTE_CODE, powers

#: Bytes of words whose lattices are built together.
GROUP = 1 << 17
_UP, _DOWN = powers(BASE, GROUP + 1), powers(BASE_INVERSE, GROUP + 1)


def read_vocabulary(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and log probabilities of a sentencepiece vocabulary.

    Scores that are log probabilities (a unigram vocabulary) are taken as they are. Merge ranks (scores
    -1, -2, ...) become the log probabilities of Zipf's law at that rank. A byte piece has the least weight
    of all; pieces of the same spelling are one. The weights are scaled to add up to 1.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    score = np.array([model.get_score(i) for i in ids], float)
    if (score == np.round(score)).all():  # ranks
        score = np.where(score < -1e6, -np.inf, -np.log(np.maximum(-score, 1) + 1))
    weight: dict[bytes, float] = {}
    for i, s in zip(ids, score, strict=True):
        spelling = model.id_to_piece(i).replace("▁", " ").encode()
        if spelling and b" " not in spelling[1:] and np.isfinite(s):
            weight[spelling] = weight.get(spelling, 0.0) + np.exp(s)
    least = min(weight.values(), default=1.0)
    for b in range(256):
        weight[bytes([b])] = weight.get(bytes([b]), 0.0) + least
    pieces = sorted(weight)
    p = np.array([weight[x] for x in pieces])
    return pieces, np.log(p / p.sum())


class Lattice:
    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.asarray(logp, float)
        self.longest = max(map(len, pieces))
        self.by_length = {}
        with np.errstate(over="ignore"):
            for size in sorted({len(x) for x in pieces}):
                at = np.array([i for i, x in enumerate(pieces) if len(x) == size])
                spelt = np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(-1, size)
                key = (BYTE_CODE[spelt] * _UP[:size]).sum(axis=1, dtype=np.uint64)
                order = np.argsort(key)
                table = np.zeros(1 << 16, bool)
                table[key >> np.uint64(48)] = True
                self.by_length[size] = key[order], at[order], table

    def _edges(self, buf: np.ndarray, word: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of the pieces spelt in buf[start:stop], positions in buf, none across words."""
        part = buf[start:stop]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        out = []
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_CODE[part] * _UP[:n], dtype=np.uint64, out=sums[1:])
            for size, (key, at, table) in self.by_length.items():
                if size > n:
                    break
                got = (sums[size:] - sums[:n - size + 1]) * _DOWN[:n - size + 1]
                i = np.flatnonzero(table[got >> np.uint64(48)] & (word[start:stop - size + 1] == word[start + size - 1:stop]))
                j = np.minimum(np.searchsorted(key, got[i]), len(key) - 1)
                hit = key[j] == got[i]
                out.append((i[hit] + start, i[hit] + start + size, at[j[hit]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _groups(self, sizes: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(sizes, kind="stable")
        total = np.cumsum(sizes[order])
        i = 0
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + GROUP, "right")))
            yield order[i:j]
            i = j

    def _long(self, spelt: np.ndarray, weight: float = 0.0, uses: np.ndarray | None = None) -> float:
        """Log probability of one word of any length: slices of its lattice, a few positions kept. With a
        weight, the expected uses of its pieces are added to ``uses``, by slices from the right."""
        alpha = np.full(len(spelt) + 1, -np.inf)
        alpha[0] = 0.0
        one = np.zeros(len(spelt), np.int8)
        for at in range(0, len(spelt), GROUP // 2):
            stop = min(len(spelt), at + GROUP // 2)
            a, b, piece = self._edges(spelt, one, max(0, at - self.longest), stop)
            use = b > at
            a, b, piece = a[use], b[use], piece[use]
            order = np.argsort(b, kind="stable")
            a, b, v = a[order], b[order], self.logp[piece[order]]
            cuts = np.searchsorted(b, np.arange(at + 1, stop + 2))
            for k in range(at + 1, stop + 1):
                lo, hi = cuts[k - at - 1], cuts[k - at]
                x = alpha[a[lo:hi]] + v[lo:hi]
                top = x.max()
                alpha[k] = top + np.log(np.exp(x - top).sum())
        if weight > 0:
            beta = np.full(len(spelt) + 1, -np.inf)
            beta[-1] = 0.0
            for at in reversed(range(0, len(spelt), GROUP // 2)):
                stop = min(len(spelt), at + GROUP // 2)
                a, b, piece = self._edges(spelt, one, at, min(len(spelt), stop + self.longest))
                use = a < stop
                a, b, piece = a[use], b[use], piece[use]
                order = np.argsort(a, kind="stable")
                a, b, piece = a[order], b[order], piece[order]
                v = self.logp[piece]
                cuts = np.searchsorted(a, np.arange(at, stop + 1))
                for k in range(stop - 1, at - 1, -1):
                    lo, hi = cuts[k - at], cuts[k - at + 1]
                    x = beta[b[lo:hi]] + v[lo:hi]
                    top = x.max()
                    beta[k] = top + np.log(np.exp(x - top).sum())
                uses += np.bincount(piece, np.exp(alpha[a] + v + beta[b] - alpha[-1]) * weight, minlength=len(uses))
        return float(alpha[-1])

    def score(self, buf: np.ndarray, off: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each word (word i is buf[off[i]:off[i + 1]]) and, with weights, the
        expected uses of each piece over all paths."""
        sizes = np.diff(off) + 1
        out, uses = np.zeros(len(sizes)), np.zeros(len(self.pieces))
        for group in self._groups(sizes):
            n = sizes[group]
            first = np.cumsum(n) - n
            spelt = np.full(n.sum(), 0x20, np.uint8)
            within = np.arange(n.sum()) - np.repeat(first, n)
            fill = within > 0
            spelt[fill] = buf[(np.repeat(off[group], n) + within - 1)[fill]]
            if n.sum() > GROUP:
                out[group[0]] = self._long(spelt, 0.0 if weight is None else float(weight[group[0]]), uses)
                continue
            word = np.repeat(np.arange(len(group)), n)
            a, b, piece = self._edges(spelt, word, 0, len(spelt))
            w = word[a]
            node, last = first + np.arange(len(group)), first + n + np.arange(len(group))
            alpha = np.full(n.sum() + len(group), -np.inf)
            alpha[node] = 0.0
            v = self.logp[piece]
            self._recur(alpha, a + w, b + w, b - first[w], v)
            z = alpha[last]
            out[group] = z
            if weight is not None and (weight[group] > 0).any():
                beta = np.full(len(alpha), -np.inf)
                beta[last] = 0.0
                self._recur(beta, b + w, a + w, (first + n)[w] - a, v)
                share = np.exp(alpha[a + w] + v + beta[b + w] - z[w]) * weight[group][w]
                uses += np.bincount(piece, share, minlength=len(uses))
        return out, uses

    @staticmethod
    def _recur(alpha: np.ndarray, source: np.ndarray, target: np.ndarray, step: np.ndarray, v: np.ndarray) -> None:
        """alpha[target] = log sum exp(alpha[source] + v), in the order of step."""
        order = np.lexsort((target, step))
        source, target, step, v = source[order], target[order], step[order], v[order]
        cuts = np.searchsorted(step, np.arange(1, (step[-1] if len(step) else 0) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            t = target[lo:hi]
            runs = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            alpha[t[runs]] = np.logaddexp.reduceat(alpha[source[lo:hi]] + v[lo:hi], runs)
