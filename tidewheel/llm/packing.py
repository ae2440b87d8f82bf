"""Packing token ids into windows by non-negative least squares over shallow length combinations.

Documents are tokenized once.  Whole windows are cut off the front; what remains of a document is one piece
shorter than a window.  The histogram of those lengths (at most window - 1 numbers, whatever the corpus) goes to the
driver, which enumerates combinations of up to DEPTH lengths that fill the window exactly, solves for repeat counts
against the histogram by NNLS, rounds down, and packs the residual lengths greedily, largest first, best fit.  The
plan's size depends on the window only.  Pieces find their place by rank within their length: ranks come from counts
per block of documents, so no length, however common, is gathered into one task.

A sequence of total length L is padded to the window unless L is a power of two.  Null text: the document is just
its end id.  Empty input: no pieces.  Rows with equal doc_id are packed as separate documents.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, stash

WINDOW = 1024
END_ID = 0
DEPTH = 3
#: Combinations given to NNLS: all pairs, then triples led by the commonest lengths.  More would round down to nothing more often.
MOST_COMBINATIONS = 1500
BLOCK_DOCS = 4_096
RUN = 500
#: Fixed value: how byte-level BPE divides a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, block long"


class ByteTokenizer:
    """Byte-level BPE ids as little-endian uint32 bytes, equal to those of the tokenizers library.

    Where the vocabulary file is plain byte-level BPE with ids in merge order, a rank-based encoder of the same ids
    does the work in less than half the time.  Texts with a special token's string or a run of 2 * RUN characters without (or of
    only) white space, on which that encoder can take quadratic time, and all texts under other vocabularies, go to the
    tokenizers library itself.
    """

    def __init__(self, path: str):
        self.path, self._model, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special)
        ranks = _ranks(spec, special)
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @property
    def model(self):
        """The library's tokenizer, loaded for the first text that needs it."""
        if self._model is None:
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(self.path)
        return self._model

    def apart(self, text: str) -> bool:
        """Whether a text goes to the library: each run of 2 * RUN characters holds a whole aligned block of RUN."""
        blocks = (text[k : k + RUN] for k in range(0, len(text) - RUN + 1, RUN))
        return any(x in text for x in self.special) or any(" " not in b or b.isspace() for b in blocks)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            found = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            found = [self.model.encode(t, add_special_tokens=False).ids if self.apart(t) else self.fast(t) for t in texts]
        return [np.asarray(ids, dtype="<u4").tobytes() for ids in found]


def _ranks(spec: dict, special: set[str]) -> dict[bytes, int] | None:
    """Token bytes to ids, if ids alone decide which merge comes first and the pre-tokenizer is the byte-level one."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    vocab = model["vocab"]
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        return None
    # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}


_CODERS: dict[str, ByteTokenizer] = {}


def coder_of(path: str) -> ByteTokenizer:
    """One per Python worker, for all tasks that the worker runs."""
    if path not in _CODERS:
        _CODERS[path] = ByteTokenizer(path)
    return _CODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Tokenize and cut: one row per piece; block names BLOCK_DOCS documents read by one task, for later ranks.

    Blocks depend on how the input is read, not on its values, so equal rows spread too; write the pieces before using them.
    """

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = coder_of(vocabulary or default_vocabulary())
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        first, seen = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 512):
                part = texts[at : at + 512]
                for doc, ids in zip(batch.column(0)[at : at + 512].to_pylist(), coder.encode(part), strict=True):
                    block = first + seen // BLOCK_DOCS
                    seen += 1
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        cut = ids[4 * start : 4 * (start + window)]
                        rows.append((doc, start, len(cut) // 4, zlib.crc32(cut), total, block))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6,
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block"],
            )
        batch = rows = texts = None
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b|, x >= 0, by cyclic coordinate descent on the normal equations."""
    gram, x = a.T @ a, np.zeros(a.shape[1])
    grad = -(a.T @ b).astype(float)
    diag = gram.diagonal()
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(x)):
            step = max(-x[j], -grad[j] / diag[j])
            if step:
                x[j] += step
                grad += step * gram[:, j]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return x


def combinations(lengths: list[int], window: int, depth: int, most: int = MOST_COMBINATIONS) -> list[tuple[int, ...]]:
    """Multisets of up to depth lengths that add up to the window exactly; the pairs first, then triples led by common lengths."""
    have, found = set(lengths), []
    found += [(a, window - a) for a in sorted(have) if a >= window - a and window - a in have]
    if depth >= 3:
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                c = window - a - b
                if c in have and 0 < c <= min(a, b):
                    found.append(tuple(sorted((a, b, c), reverse=True)))
                    if len(found) >= most:
                        return list(dict.fromkeys(found))
    return list(dict.fromkeys(found))


def plan(histogram: dict[int, int], window: int = WINDOW, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) so that each length is used exactly as often as the histogram says."""
    left = Counter({k: v for k, v in histogram.items() if v})
    if not left:
        return []
    common = sorted(left, key=lambda k: (-left[k], k))
    choices = combinations(common, window, depth)
    made: list[tuple[tuple[int, ...], int]] = []
    if choices:
        row = {k: i for i, k in enumerate(common)}
        a = np.zeros((len(row), len(choices)))
        for j, combo in enumerate(choices):
            for k in combo:
                a[row[k], j] += 1
        want = np.array([left[k] for k in common], float)
        scale = max(1.0, want.mean())
        times = np.floor(nnls(a, want / scale) * scale + 1e-9).astype(int)
        for combo, n in sorted(zip(choices, times, strict=True), key=lambda x: -x[1]):
            n = min([int(n), *(left[k] // combo.count(k) for k in set(combo))])
            if n > 0:
                made.append((combo, n))
                for k in combo:
                    left[k] -= n
    while left := +left:  # greedy: the longest first, then whatever fits best, repeated while the lengths last
        combo, room, spare = [], window, Counter(left)
        while fit := max((k for k, v in spare.items() if v and k <= room), default=0):
            combo.append(fit)
            spare[fit] -= 1
            room -= fit
        n = min(left[k] // combo.count(k) for k in set(combo))
        made.append((tuple(combo), n))
        for k in combo:
            left[k] -= n
    return made


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every id in exactly one piece."""
    cut = stash(pieces(docs, vocabulary, window))
    counts = stash(cut.groupBy("block", "length").agg(F.count("*").alias("n")))
    # At most window rows: the histogram of lengths; whole windows are sequences of their own.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(window, 0)
    made = plan(histogram, window, depth)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first rank, first sequence, offset, how many)
    used: Counter = Counter()
    sequence = whole
    for combo, n in made:
        at = 0
        for k in combo:
            slots.setdefault(k, []).append((used[k], sequence, at, n))
            used[k] += n
            at += k
        sequence += n
    slots[window] = [(0, 0, 0, whole)]
    # Ranks: the block's first rank of each length, then the row's place in its block.
    before = counts.selectExpr("block", "length", "sum(n) over (partition by length order by block) - n as first")
    table = {k: np.array(v, dtype=np.int64).reshape(-1, 4) for k, v in slots.items()}

    def place(key, own: pa.Table, first: pa.Table) -> pa.Table:
        begin = dict(zip(first.column("length").to_pylist(), first.column("first").to_pylist(), strict=True))
        own = own.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = own.column("length").to_numpy()
        sequence_id, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            rank = begin[int(k)] + np.arange(len(at))
            entry = np.searchsorted(table[int(k)][:, 0], rank, side="right") - 1
            row = table[int(k)][entry]
            sequence_id[at], offset[at] = row[:, 1] + rank - row[:, 0], row[:, 2]
        own = own.drop_columns(["block"])
        return own.append_column("sequence_id", pa.array(sequence_id)).append_column("offset", pa.array(offset))

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return cut.groupBy("block").cogroup(before.groupBy("block")).applyInArrow(place, out)


def padding(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: ids, sequences and padding ids of a packing."""
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    waste = F.when(F.bit_count("used") == 1, 0).otherwise(window - F.col("used"))
    return full.agg(F.sum("used").alias("ids"), F.count("*").alias("sequences"), F.sum(waste).alias("padding"))
