"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the bytes of one text at different places. Where both end a token, the text falls into
groups of tokens that cover the same bytes. The end positions of both are ascending arrays. While tokens go
one to one, the arrays agree along a diagonal: the index of the one is that of the other plus a shift.
Exponential probing compares ever longer slices at the current shift and so jumps over such stretches; where
a slice differs, the last doubling is halved down to the first difference. There the two arrays are merged
token by token until they end together again, which closes an irregular group and updates the shift.

Only pairs of which one token's bytes end the other's can end together. Both vocabularies are fixed, so these
pairs can be listed before any text is read (PairTable): their corpus-wide counts are one array of bounded
size, whatever the corpus, and may be broadcast.

A text is encoded by its segments: it is cut at single spaces between visible characters, where neither
tokenizer can join anything (the vocabularies are checked for that). Each distinct segment of a part is
encoded once, and no call sees a text longer than its longest stretch without such a space.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.store import Scratch
from orderlens.llm.words import text_chunks

#: Where the vocabulary files lie, unless the caller says otherwise. The driver reads them through Spark.
TOKENIZERS = os.environ.get("ORDERLENS_TOKENIZERS", "/opt/tokenizers")
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text of which the distinct segments are encoded together, and text that is aligned together.
ENCODE_BYTES, ALIGN_BYTES = 8 << 20, 1 << 20
#: First length of a probe.
PROBE = 4

SPACE_MARK = "▁"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one character: visible Latin-1 characters as themselves, the
    other bytes, in order, as the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, from the bytes of their files, and the bytes of their tokens by id."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True  # their strings within a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        chars = _byte_of_char()
        vocab = self.a.get_vocab()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = token.encode() if token in special else bytes(chars[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
                        else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece goes on after a space within it: texts cannot be cut at spaces")
        kind = json.loads(self.a.to_str())["pre_tokenizer"]
        if kind["type"] != "ByteLevel" or not kind["use_regex"] or kind["add_prefix_space"]:
            raise ValueError("the byte-level tokenizer must split words before their space")

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each segment; a segment starts with a space, which the second tokenizer adds by itself."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        return a, self.b.encode([s[1:] for s in segments], num_threads=1)


class PairTable:
    """All (a, b) of which one token's bytes end the other's, ascending by b and a: the pairs that can occur."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.n_a = len(bytes_a)
        by_a, by_b = {}, {}
        for i, t in enumerate(bytes_a):
            by_a.setdefault(t, []).append(i)
        for i, t in enumerate(bytes_b):
            by_b.setdefault(t, []).append(i)
        keys = set()
        for t, ids in by_a.items():
            for k in range(len(t)):
                keys.update(b * self.n_a + a for b in by_b.get(t[k:], ()) for a in ids)
        for t, ids in by_b.items():
            for k in range(len(t)):
                keys.update(b * self.n_a + a for a in by_a.get(t[k:], ()) for b in ids)
        self.keys = np.array(sorted(keys), np.int64)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, b.astype(np.int64) * self.n_a + a)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Whether each pair has the highest count of its b."""
        b = self.keys // self.n_a
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        return counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(b))))


_LOADED: dict[str, tuple[Tokenizers, PairTable]] = {}


def load(files: tuple[bytes, bytes]) -> tuple[Tokenizers, PairTable]:
    """The tokenizers and their pairs, once a process."""
    key = hashlib.sha256(files[0] + files[1]).hexdigest()
    if key not in _LOADED:
        t = Tokenizers(*files)
        _LOADED[key] = t, PairTable(t.bytes_a, t.bytes_b)
    return _LOADED[key]


# -- segments ------------------------------------------------------------------------------------------

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_TWO_BYTES = np.zeros(256, bool)  # first bytes of two-byte characters beyond U+00BF: none is a space
_TWO_BYTES[0xC3:0xE0] = True


def cuts(buf: np.ndarray) -> np.ndarray:
    """Places of spaces with a visible ASCII or two-byte character on both sides."""
    at = np.flatnonzero(buf == 0x20)
    at = at[(at > 1) & (at < len(buf) - 1)]
    before, after = buf[at - 1], buf[at + 1]
    return at[(_VISIBLE[before] | ((before & 0xC0 == 0x80) & _TWO_BYTES[buf[at - 2]])) & (_VISIBLE[after] | _TWO_BYTES[after])]


# -- alignment -----------------------------------------------------------------------------------------

def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into each) of the tokens that end together, ascending. Both arrays ascend strictly and end
    with the same value."""
    size = 8
    bytes_a, bytes_b = (np.ascontiguousarray(e, np.int64).tobytes() for e in (ends_a, ends_b))
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    n_a, n_b = len(list_a), len(list_b)
    starts, lengths, shifts = [], [], []  # one-to-one stretches, single closing tokens of irregular groups too
    i = j = 0
    while i < n_a and j < n_b:
        # a one-to-one stretch: probe at the current shift
        begin, step = i, PROBE
        while True:
            step = min(step, n_a - i, n_b - j)
            if step == 0 or bytes_a[i * size:(i + step) * size] != bytes_b[j * size:(j + step) * size]:
                break
            i, j, step = i + step, j + step, 2 * step
        while step > 1:  # the slice of this length differs: take what agrees, by halves
            half = step // 2
            if bytes_a[i * size:(i + half) * size] == bytes_b[j * size:(j + half) * size]:
                i, j, step = i + half, j + half, step - half
            else:
                step = half
        if i > begin:
            starts.append(begin)
            lengths.append(i - begin)
            shifts.append(j - i)
        if i >= n_a or j >= n_b:
            break
        # an irregular group: go on by the smaller end until both are equal
        x, y = list_a[i], list_b[j]
        while x != y:
            if x < y:
                i += 1
                x = list_a[i]
            else:
                j += 1
                y = list_b[j]
        starts.append(i)
        lengths.append(1)
        shifts.append(j - i)
        i, j = i + 1, j + 1
    lengths = np.array(lengths, np.int64)
    first = np.cumsum(lengths) - lengths
    at_a = np.repeat(np.array(starts, np.int64) - first, lengths) + np.arange(lengths.sum())
    return at_a, at_a + np.repeat(np.array(shifts, np.int64), lengths)


class Vocabulary:
    """Arrays over token ids that the alignment reads."""

    def __init__(self, tokenizers: Tokenizers):
        self.size = [np.array([len(t) for t in b], np.int64) for b in (tokenizers.bytes_a, tokenizers.bytes_b)]
        self.spelt = [pa.array(b, pa.large_binary()) for b in (tokenizers.bytes_a, tokenizers.bytes_b)]
        most = max(map(len, self.size))
        #: The digits of an id with what follows it: nothing, a comma, a bar, a semicolon.
        self.most, self.digits = most, pa.array([f"{i}{mark}".encode() for mark in ("", ",", "|", ";") for i in range(most)], pa.large_binary())


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-null large strings or binaries, and where each begins."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _ragged(values: np.ndarray, off: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``take`` of a ragged array, one after the other, and their sizes."""
    sizes = off[take + 1] - off[take]
    first = np.cumsum(sizes) - sizes
    return values[np.repeat(off[take] - first, sizes) + np.arange(sizes.sum())], sizes


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return np.fromiter((i for x in lists for i in x), np.int32, int(off[-1])), off


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, uses array<int>"


def _align_texts(doc_ids: pa.Array, texts: pa.Array, codes: np.ndarray, n_segments: np.ndarray, known, vocabulary: Vocabulary,
                 table: PairTable, digest: bool) -> pa.RecordBatch:
    """Aligns texts (each with its space in front, or empty) whose segments are ``codes`` into ``known``."""
    n = len(texts)
    raw, off = _buffer(texts)
    seg_off = np.concatenate(([0], np.cumsum(n_segments)))
    ids, per = [], []
    fits = np.diff(off) > 0
    for k in range(2):
        token, sizes = _ragged(*known[k], codes)
        token_off = np.concatenate(([0], np.cumsum(sizes)))[seg_off]
        spelt, _ = _buffer(vocabulary.spelt[k].take(pa.array(token)))
        length = _sums(vocabulary.size[k][token], token_off)
        if len(spelt) == len(raw) and np.array_equal(length, np.diff(off)) and np.array_equal(spelt, raw):
            pass
        else:
            at = np.concatenate(([0], np.cumsum(length)))
            fits &= np.array([length[i] == off[i + 1] - off[i] and np.array_equal(spelt[at[i]:at[i + 1]], raw[off[i]:off[i + 1]]) for i in range(n)], bool)
        ids.append(token)
        per.append(token_off)
    # the tokens of texts that both tokenizers give back
    for k in range(2):
        sizes = np.diff(per[k])
        ids[k] = ids[k][np.repeat(fits, sizes)]
        per[k] = np.concatenate(([0], np.cumsum(np.where(fits, sizes, 0))))
    ends = [np.cumsum(vocabulary.size[k][ids[k]]) for k in range(2)]
    at_a, at_b = align(*ends)
    groups = np.searchsorted(at_a, per[0])
    # a1,a2|b1;a3|b2,b3: the tokens of each group, a's first, each with the mark behind it
    group_a, group_b = np.searchsorted(at_a, np.arange(len(ids[0]))), np.searchsorted(at_b, np.arange(len(ids[1])))
    before_a, before_b = np.concatenate(([-1], at_a)), np.concatenate(([-1], at_b))
    out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    last_a, last_b = np.zeros(len(ids[0]), bool), np.zeros(len(ids[1]), bool)
    last_a[at_a], last_b[at_b] = True, True
    final_b = np.zeros(len(ids[1]), bool)
    final_b[per[1][1:][fits] - 1] = True
    out[np.arange(len(ids[0])) + before_b[group_a] + 1] = ids[0] + vocabulary.most * np.where(last_a, 2, 1)
    out[np.arange(len(ids[1])) + before_a[group_b + 1] + 1] = ids[1] + vocabulary.most * np.where(last_b, np.where(final_b, 0, 3), 1)
    marked = vocabulary.digits.take(pa.array(out))
    spelt, mark_off = _buffer(marked)
    text_off = mark_off[per[0] + per[1]]
    if digest:
        raw_bytes = spelt.tobytes()
        written = [hashlib.sha256(raw_bytes[a:b]).hexdigest() if ok else "" for a, b, ok in zip(text_off[:-1].tolist(), text_off[1:].tolist(), fits.tolist(), strict=True)]
    else:
        written = [spelt[a:b].tobytes().decode() for a, b in zip(text_off[:-1].tolist(), text_off[1:].tolist(), strict=True)]
    # linked pairs of each text, with how often
    pair = table.index(ids[0][at_a], ids[1][at_b])
    owner = np.repeat(np.arange(n), np.diff(groups))
    key = np.sort(owner * len(table.keys) + pair)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    uses = np.diff(np.append(new, len(key)))
    pair_off = np.searchsorted(key[new], np.arange(n + 1) * len(table.keys))
    lists = [pa.ListArray.from_arrays(pa.array(pair_off, pa.int32()), pa.array(x, pa.int32())) for x in (key[new] % len(table.keys), uses)]
    counts = [pa.array(x, pa.int64()) for x in (np.diff(per[0]), np.diff(per[1]), np.diff(groups), np.diff(groups))]
    return pa.RecordBatch.from_arrays([doc_ids, *counts, pa.array(written, pa.string()), *lists], [c.split()[0] for c in ALIGNED.split(", ")])


def _aligner(files, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, table = load(files.value)
        vocabulary = Vocabulary(tokenizers)
        for batch in batches:
            for part in text_chunks(batch, "text", ENCODE_BYTES):
                doc_ids, texts = part.column("doc_id"), pc.fill_null(part.column("text"), "").cast(pa.large_string())
                nothing, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
                texts = pc.if_else(pc.equal(texts, nothing), texts, pc.binary_join_element_wise(nothing, texts, space))
                raw, off = _buffer(texts)
                # segments: from one cut to the next, and from the beginning of each text that is not empty
                start = np.union1d(cuts(raw), off[:-1][np.diff(off) > 0])
                per_text = np.searchsorted(start, off)
                bounds = pa.py_buffer(np.append(start, len(raw)).astype(np.int64).tobytes())
                segments = pa.Array.from_buffers(pa.large_string(), len(start), [None, bounds, pa.py_buffer(raw.tobytes())]).dictionary_encode()
                known = [_flat(x) for x in tokenizers.encode(segments.dictionary.to_pylist())]
                codes = segments.indices.to_numpy(zero_copy_only=False)
                i = 0
                while i < len(texts):
                    j = max(i + 1, int(np.searchsorted(off, off[i] + ALIGN_BYTES, "right")) - 1)
                    yield _align_texts(doc_ids[i:j], texts[i:j], codes[per_text[i]:per_text[j]], np.diff(per_text[i:j + 1]), known, vocabulary, table, digest)
                    i = j
    return run


def _pair_counts(n_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            pairs, uses = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "uses"))
            total += np.bincount(pairs, uses, n_pairs).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["pair", "n"])
    return run


def read_files(spark, path: str = TOKENIZERS) -> tuple[bytes, bytes]:
    """The two vocabulary files, read through Spark: the folder may lie on any file system."""
    def read(name: str) -> bytes:
        return bytes(spark.read.format("binaryFile").load(f"{path.rstrip('/')}/{name}").select("content").first().content)
    return read(FILE_A), read(FILE_B)


def align_tokenizers(docs: DataFrame, path: str = TOKENIZERS, scratch: Scratch | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups for each row of ``docs`` (doc_id, text):
    the alignment of byte-level tokens (a) and subword pieces (b) of space + text.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3`` (with ``digest``, the SHA-256 of that, which spares moving it).
    A link is a pair of tokens that end together; every token has at least one byte, so each group has one link,
    of its last tokens. ``n_best`` counts the links whose pair has the highest corpus-wide count of its b's pairs,
    ties included, ``count_sum`` adds up their pairs' counts.

    Null and empty texts, and those that one of the tokenizers does not give back byte by byte, have no tokens:
    zeros and an empty ``groups``. Rows are read one by one: repeated rows count twice, null ids do not matter.
    Texts are read whole; working memory follows the longest. An empty table gives no rows; other columns are
    ignored. doc_id must be a whole number.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "tokenizers")
    files = spark.sparkContext.broadcast(read_files(spark, path))
    n_pairs = len(load(files.value)[1].keys)
    aligned = scratch.write(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_aligner(files, digest), ALIGNED), "aligned")
    # at most one row for each pair that the vocabularies allow: bounded, whatever the corpus
    counted = aligned.select("pairs", "uses").mapInArrow(_pair_counts(n_pairs), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_pairs, np.int64)
    counts[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    shared = spark.sparkContext.broadcast((counts, load(files.value)[1].best(counts)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            pairs, uses = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "uses"))
            off = batch.column("pairs").offsets.to_numpy().astype(np.int64)
            off = off - off[0]
            columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_sums(uses * best[pairs], off)), pa.array(_sums(uses * count[pairs], off)), batch.column("groups")],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return aligned.mapInArrow(weigh, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
