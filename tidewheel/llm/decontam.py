"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts are sequences of lower-cased words.  A CGK random walk copies a window into a string three times as long, staying
or stepping on by a random bit per (step, symbol), so that windows at a small edit distance agree in most places of
their embeddings.  Each walk samples PLACES places; an item and an item-sized window with equal samples are a candidate,
and an exact semi-global edit distance over words decides: at most (1 - SIMILARITY) of the item's words.  The number of
walks is the least that reaches RECALL on altered items of the benchmark itself (`Finder.calibrate`).

Windows with too few words of the items of their size, or without a run of RUN words of some item where so few edits
must leave one, can't be within that distance and are not embedded; this filter loses nothing.  Items are held in memory in parts of at most PART_CHARS characters; more items mean more passes.

Null or empty texts and items match nothing, nor do items without an id; a null doc_id is kept as it is.  Empty tables give
empty results.  Every row is scanned whole and alone, so copies, repeated rows and hot sources are harmless, and very long
texts cost their length.  Items that share an id count as one, the most similar text of which is reported; of equally
good places the earliest is.  Other columns are ignored, whatever their names; `drop_leaky` passes them on.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

SIMILARITY = 0.8
#: Share of items found that were altered by all the edits allowed; the number of walks follows from it.
RECALL = 0.97
PLACES = 3
MOST_REPEATS = 64
TRIED = 128
RUN = 3
PART_CHARS = 4_000_000
BATCH_WORDS = 400_000
_WORD = re.compile(r"\w+")
_KEY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _column_scores(item: list[int], region: list[int], anchored: bool) -> list[int]:
    """Edits between the item and the best stretch that ends after 0, 1, ... words of the region; anchored: that starts at its first word.

    Myers' bit-parallel columns, one integer of the item's length per word of the region.
    """
    n, at = len(item), {}
    for i, x in enumerate(item):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score, out = full, 0, n, [n]
    for y in region:
        eq = at.get(y, 0)
        diagonal = (((eq & up) + up) ^ up) | eq
        vertical = eq | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        score += (right & last > 0) - (left & last > 0)
        right, left = (right << 1) | anchored, left << 1
        up, down = (left | ~(vertical | right)) & full, right & vertical & full
        out.append(score)
    return out


def infix_distance(item: list[int], region: list[int]) -> tuple[int, int, int]:
    """Least edits between the item and any stretch of the region, with that stretch's start and end (earliest end, then earliest start)."""
    scores = _column_scores(item, region, False)
    least = min(scores)
    end = scores.index(least)
    back = _column_scores(item[::-1], region[:end][::-1], True)
    length = max(k for k, x in enumerate(back) if x == least)
    return least, end - length, end


class Finder:
    """Finds leaked items in texts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL, places: int = PLACES, seed: int = 11):
        cut = [(i, words_of(t)) for i, t in items]
        self.vocab: dict[str, int] = {}
        for _, ws in cut:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.items = [(i, [self.vocab[w] for w in ws]) for i, ws in cut if ws]
        self.loss = 1 - similarity
        rng = np.random.default_rng(seed)
        longest = max((len(x) for _, x in self.items), default=1)
        self.salt = rng.integers(1, 2**63, (MOST_REPEATS, 3 * longest), dtype=np.uint64) | np.uint64(1)
        self.sizes: dict[int, list[int]] = {}
        for k, (_, x) in enumerate(self.items):
            self.sizes.setdefault(len(x), []).append(k)
        self.samples = {n: [np.sort(rng.choice(max(places, 2 * n), places, replace=False)) for _ in range(MOST_REPEATS)] for n in self.sizes}
        self.repeats = self.calibrate(recall, rng)
        self.item_runs = {n: np.unique(np.concatenate([self.runs(np.array(self.items[k][1], np.int64)) for k in of])) for n, of in self.sizes.items()}
        self.run_table = np.zeros(1 << 20, bool)
        for keys in self.item_runs.values():
            self.run_table[keys >> np.uint64(44)] = True
        self.whole = any(not self.by_runs(n) for n in self.sizes)  # some items can match without a common run
        self.known, self.buckets = {}, {}
        for n, of in self.sizes.items():
            self.known[n] = np.zeros(len(self.vocab) + 1, bool)
            self.known[n][[s for k in of for s in self.items[k][1]]] = True
            flat = np.array([s for k in of for s in self.items[k][1]], np.int64)
            for r in range(self.repeats):
                begin = np.arange(len(of)) * n
                keys = self.embed(flat, begin, begin + n, n, r)
                order = np.argsort(keys, kind="stable")
                self.buckets[n, r] = (keys[order], np.array(of)[order])

    def slack(self, n: int) -> int:
        """Edits allowed in an item of n words."""
        return int(self.loss * n + 1e-9)

    def by_runs(self, n: int) -> bool:
        """Whether RUN words on end of an item must stay after that many edits."""
        slack = self.slack(n)
        return n >= RUN and -(-(n - slack) // (slack + 1)) >= RUN

    def calibrate(self, recall: float, rng: np.random.Generator) -> int:
        """The fewest walks that find the share `recall` of items altered by all the edits allowed, tried on items of this benchmark."""
        rows = [self.items[k][1] for k in rng.permutation(len(self.items))[:TRIED] if self.slack(len(self.items[k][1]))]
        first = []
        for item in rows:
            n, slack = len(item), self.slack(len(item))
            for _ in range(max(1, TRIED // len(rows))):
                text = list(item)
                for _ in range(slack):
                    at, kind = int(rng.integers(len(text))), int(rng.integers(3))
                    text[at : at + (kind != 0)] = [0] if kind < 2 else []
                text = np.array([0] * slack + text + [0] * (n + slack))
                begin = np.arange(2 * slack + 1)
                own = np.array(item)
                one, zero = np.array([n]), np.array([0])
                hit = (r for r in range(MOST_REPEATS) if (self.embed(text, begin, begin + n, n, r) == self.embed(own, zero, one, n, r)[0]).any())
                first.append(next(hit, MOST_REPEATS) + 1)
        return min(MOST_REPEATS, int(np.ceil(np.quantile(first, recall, method="higher")))) if first else 1

    def embed(self, ids: np.ndarray, starts: np.ndarray, stop: np.ndarray, n: int, r: int) -> np.ndarray:
        """A hash of the sampled places of the windows' embeddings; past its end a window reads symbol 0.  The walk's bits are hashes of (step, symbol)."""
        at = starts.copy()
        key = np.zeros(len(starts), np.uint64)
        wanted = set(self.samples[n][r].tolist())
        for j in range(max(wanted) + 1):
            symbol = np.where(at < stop, ids[np.minimum(at, len(ids) - 1)], 0).astype(np.uint64) + np.uint64(1)
            if j in wanted:
                key = (key + symbol) * _KEY
                key ^= key >> np.uint64(31)
            bit = symbol * self.salt[r, j]
            at += ((bit ^ (bit >> np.uint64(29))) * _KEY >> np.uint64(63)).astype(np.int64)
        return key

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item_id, first word, end word, edits, item words): the best place per text and item."""
        out, at = [], 0
        while at < len(texts):
            part, size = [], 0
            while at + len(part) < len(texts) and (not part or size < BATCH_WORDS):
                part.append(words_of(texts[at + len(part)]))
                size += len(part[-1])
            lens = np.array([len(w) for w in part])
            ids = np.fromiter(map(self.vocab.get, chain.from_iterable(part), repeat(0)), np.int32, int(lens.sum()))
            begin = np.cumsum(lens) - lens
            some = np.arange(len(part))
            if not self.whole:  # only texts with a run of some item
                hits = np.flatnonzero(self.run_table[self.runs(ids) >> np.uint64(44)])
                some = np.unique(np.searchsorted(begin, hits, side="right") - 1)
            for i, *rest in self._find([ids[begin[k] : begin[k] + lens[k]] for k in some]):
                out.append((at + int(some[i]), *rest))
            at += len(part)
        return out

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """A hash of the RUN words from each place on."""
        key = np.zeros(max(0, len(ids) - RUN + 1), np.uint64)
        for k in range(RUN):
            key = (key + ids[k : k + len(key)].astype(np.uint64)) * _KEY
        return key

    def _find(self, cut: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
        if not self.items or not cut:
            return []
        gap = max(self.sizes)  # unknown words between texts, so that no window spans two
        lens = np.array([len(w) for w in cut])
        starts = np.cumsum(lens + gap) - lens - gap
        ends = starts + lens
        ids = np.zeros(int(ends[-1]) + gap, np.int32)
        for begin, w in zip(starts, cut, strict=True):
            ids[begin : begin + len(w)] = w
        run = self.runs(ids)
        maybe = np.flatnonzero(self.run_table[run >> np.uint64(44)])
        run = run[maybe]
        candidates: dict[tuple[int, int], set[int]] = {}
        sums = np.zeros(len(ids) + 1, np.int32)
        for n in self.sizes:
            if self.by_runs(n):
                own = self.item_runs[n]
                hits = maybe[own[np.minimum(np.searchsorted(own, run), len(own) - 1)] == run]
                reach = np.zeros(len(ids) + 1, np.int32)  # +1 where a window starts to hold a shared run, -1 after the last such start
                np.add.at(reach, np.maximum(hits - (n - RUN), 0), 1)
                np.add.at(reach, hits + 1, -1)
                ok = np.flatnonzero(np.cumsum(reach)[: len(ids) - n + 1] > 0)
            else:
                ok = np.arange(len(ids) - n + 1)
            if not len(ok):
                continue
            np.cumsum(self.known[n][ids], out=sums[1:])
            ok = ok[sums[ok + n] - sums[ok] >= n - self.slack(n)]
            for r in range(self.repeats if len(ok) else 0):
                keys = self.embed(ids, ok, ok + n, n, r)
                known, of = self.buckets[n, r]
                lo, hi = np.searchsorted(known, keys), np.searchsorted(known, keys, side="right")
                for i in np.flatnonzero(hi > lo):
                    text = int(np.searchsorted(starts, ok[i], side="right")) - 1
                    for k in of[lo[i] : hi[i]].tolist():
                        candidates.setdefault((text, k), set()).add(int(ok[i]))
        best: dict[tuple[int, int], tuple] = {}
        for (text, k), places in candidates.items():
            base, stop = int(starts[text]), int(ends[text])
            item_id, item = self.items[k]
            n, slack = len(item), self.slack(len(item))
            places = sorted(places)
            first = 0
            for i, start in enumerate(places):  # places that overlap make one region
                if i + 1 < len(places) and places[i + 1] - start <= n:
                    continue
                lo, hi = max(base, places[first] - slack), min(stop, start + n + slack)
                first = i + 1
                edits, a, b = infix_distance(item, ids[lo:hi].tolist())
                if edits <= slack:
                    new = (edits / n, lo - base + a, lo - base + b, edits, n)
                    best[text, item_id] = min(best.get((text, item_id), new), new)
        return [(t, i, a, b, e, n) for (t, i), (_, a, b, e, n) in sorted(best.items())]


def parts_of(benchmark: DataFrame, part_chars: int = PART_CHARS) -> list[list[tuple[int, str]]]:
    """The items in parts of a bounded size."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // part_chars))
    part = lambda k: items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
    return [sorted((r["item_id"], r["text"]) for r in part(k).collect()) for k in range(n)]


def detect(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id, start_word, end_word, edits, similarity: one row per document row and item found in it."""
    own, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for items in parts_of(benchmark, part_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Finder(items))

        def run(batches, shared=shared):
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), shared.value.find(batch.column(1).to_pylist())
                cols = list(zip(*((ids[t], i, a, b, e, 1 - e / n) for t, i, a, b, e, n in found), strict=True)) or [[]] * 6
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "start_word", "end_word", "edits", "similarity"])

        part = own.mapInArrow(run, "doc_id long, item_id long, start_word long, end_word long, edits long, similarity double")
        out = part if out is None else out.union(part)
    return out


def drop_leaky(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows without any item, with all columns."""
    at = docs.columns.index("text")
    for items in parts_of(benchmark, part_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Finder(items))

        def run(batches, shared=shared):
            for batch in pieces(batches, 1024):
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in shared.value.find(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
