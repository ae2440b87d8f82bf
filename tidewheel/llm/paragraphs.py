"""Repeated passages: paragraph MinHash banding with exact verification and components.

A text's lines are cut further after every other sentence end, chosen by a hash of the sentence's last word, and runs of over
LONGEST words without one after words chosen by hash.  The cuts depend on nearby words only, so a passage has the same
paragraphs wherever it stands.  Paragraphs of MIN_WORDS words or more take part; shorter neighbours are joined across
line breaks, up to a chosen end, and not to a longer paragraph, which would then differ from its copies.  Paragraphs with
equal shingles of 5 words in a row are one class; classes meet under BANDS bands of ROWS coordinates (tuned by `tune` for
recall), and pairs at a Jaccard similarity of 0.8, on the full sets, are linked; components of links make clusters.

Lists that hold several components after the first pass are joined exactly in memory, rare shingles first, so a very
common line inside otherwise different paragraphs yields no candidates.

Whatever the line breaks and sentence ends, stretches of SPAN words take part too, and are linked when equal: they begin at
the least word-pair hash of every WINDOW places, so any PASSAGE words on end hold one that depends on no other word.
Stretches of a text that overlap an equal one of the same text are left out, being no second copy.

Repeated pieces that touch or overlap in a document make one passage.  Passages of at least SPAN words are reported, so a
stock line that many documents share is not, unless it is that long.  Of each cluster the first piece by (doc_id, start_word) stays.

Null and empty texts, and an empty table, have no paragraphs.  Repeated rows are copies of each other, also under one id;
rows that share an id make their passages together.  Very long texts cost their length.  Ties go to the
smallest (doc_id, start_word).  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import similar
from .common import discard, stash
from .components import components

SHINGLE = 5
PERCENT = 80
MIN_WORDS = 8
LONGEST = 64
RECALL = 0.99
#: Shingles of a list that one task joins in memory; longer lists are cut into pairs of blocks.
MEMBER_LIMIT = 400_000
PASSAGE = 50
SPAN = 36
WINDOW = PASSAGE - SPAN + 1
WORDS_HELD = 1 << 18
#: Words that are worked on at once.
CHUNK_WORDS = 400_000
_ENDS = b".!?"
_LINE = b"\xff"  # no UTF-8 text holds this byte


def tune(threshold: float = PERCENT / 100, recall: float = RECALL, rows: int = 2) -> tuple[int, int]:
    """(bands, rows): the fewest bands that reach the recall at the threshold."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands, rows


BANDS, ROWS = tune()


class Vocabulary(dict):
    """Words by number, with their hashes and whether a sentence may end with them; number 0 is a line break."""

    def __init__(self):
        self.hash, self.ends = np.empty(1024, np.uint64), np.empty(1024, bool)
        self[_LINE]

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == len(self.hash):
            self.hash, self.ends = np.resize(self.hash, 2 * k), np.resize(self.ends, 2 * k)
        self.hash[k] = xxhash.xxh3_64_intdigest(word)
        self.ends[k] = any(c in word[-4:] for c in _ENDS)
        self[word] = k
        return k


def cut(stops: list[int], chosen: set[int], first_word: int, end: int, far: np.ndarray) -> list[tuple[int, int]]:
    """(first word, word after the last) of each paragraph of at least MIN_WORDS words of one text, first_word to end.

    stops: after the text's lines and chosen sentence ends, in order; chosen: those after sentence ends; far: words after
    which a long run may be cut.
    """
    out, start, first = [], first_word, None  # first: of the short pieces at hand

    def piece(start: int, stop: int, last: bool) -> None:
        nonlocal first
        if stop - start >= MIN_WORDS:
            if first is not None and start - first >= MIN_WORDS:
                out.append((first, start))
            out.append((start, stop))
            first = None
            return
        first = start if first is None else first
        if stop - first >= MIN_WORDS and (last or (stop - first > LONGEST and far[stop - 1])):
            out.append((first, stop))
            first = None

    for stop in stops:
        while stop - start > LONGEST and len(more := np.flatnonzero(far[start + LONGEST : stop])):
            middle = start + LONGEST + int(more[0]) + 1
            piece(start, middle, middle in chosen)
            start = middle
        if stop > start:
            piece(start, stop, stop in chosen)
            start = stop
    if first is not None and end - first >= MIN_WORDS:
        out.append((first, end))
    return out


def least_places(key: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` keys the place of its least, the first of equals; keys are told apart by their upper 36 bits."""
    low = (key & ~np.uint64(0xFFFFFFF)) | np.arange(len(key), dtype=np.uint64)
    have = 1
    while 2 * have <= width:  # minima over runs of 1, 2, 4, ... keys
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    return (low & np.uint64(0xFFFFFFF)).astype(np.int64)


class Chunk:
    """The words of some texts in one row, with their paragraphs and stretches, by arrays over all texts."""

    def __init__(self, texts: list[list[bytes]], vocabulary: Vocabulary):
        """texts: words, with a _LINE for each line break."""
        if len(vocabulary) > WORDS_HELD:
            vocabulary.clear()
            vocabulary[_LINE]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(texts)), np.int64, int(size.sum()))
        word = ids > 0
        before = np.concatenate([[0], np.cumsum(word)])  # words before each item
        edge = np.concatenate([[0], np.cumsum(size)])
        self.first = before[edge]  # of each text, and the end of all
        ids_of_words = ids[word]
        self.hash = vocabulary.hash[ids_of_words]
        self.breaks = before[:-1][~word]
        self.chosen = np.flatnonzero(vocabulary.ends[ids_of_words] & (self.hash & np.uint64(1) == 1)) + 1
        self.shingles = similar.shingles_of(self.hash, SHINGLE) if len(self.hash) >= SHINGLE else np.empty(0, np.uint64)

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and word after the last of each paragraph."""
        far = self.hash & np.uint64(15) == 0
        stops = np.unique(np.concatenate([self.breaks, self.chosen, self.first[1:]]))
        # A text's stops: after its first word, up to its end.
        lo, hi = np.searchsorted(stops, self.first[:-1], side="right"), np.searchsorted(stops, self.first[1:], side="right")
        stops, chosen, out = stops.tolist(), set(self.chosen.tolist()), []
        bounds = self.first.tolist()
        for k in range(len(bounds) - 1):
            if bounds[k + 1] - bounds[k] >= MIN_WORDS:
                out += [(k, a, b) for a, b in cut(stops[lo[k] : hi[k]], chosen, bounds[k], bounds[k + 1], far)]
        text, begin, end = np.array(out, np.int64).reshape(-1, 3).T
        return text, begin, end

    def shingles_in(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of the paragraphs in a row, and where each paragraph's begin."""
        size = end - begin - SHINGLE + 1
        at = np.cumsum(size) - size
        return self.shingles[np.arange(int(size.sum())) + np.repeat(begin - at, size)], at

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and name of the stretches of SPAN words."""
        none = np.empty(0, np.int64)
        if len(self.hash) < PASSAGE:
            return none, none, none
        pair = similar.shingles_of(self.hash, 2)
        at = least_places(pair, WINDOW)
        text = np.searchsorted(self.first, np.arange(len(at)), side="right") - 1
        at = np.unique(at[np.arange(len(at)) + PASSAGE <= self.first[text + 1]])  # of windows with PASSAGE words of one text
        name = np.zeros(len(at), np.uint64)
        for k in (*range(0, SPAN - SHINGLE, SHINGLE), SPAN - SHINGLE):
            name = (name ^ (name >> np.uint64(29))) * similar.WORD_MIX[1] + self.shingles[at + k]
        name = (name ^ (name >> np.uint64(32))).view(np.int64)
        text = np.searchsorted(self.first, at, side="right") - 1
        order = np.lexsort((at, name, text))
        same = (text[order][1:] == text[order][:-1]) & (name[order][1:] == name[order][:-1])
        if same.any():  # equal stretches of one text: keep those that overlap no kept one
            own, last, key = np.ones(len(at), bool), 0, None
            for i in np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])):
                x = int(order[i])
                if key == (text[x], name[x]) and at[x] - last < SPAN:
                    own[x] = False
                    continue
                key, last = (text[x], name[x]), int(at[x])
            text, at, name = text[own], at[own], name[own]
        return text, at, name


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().replace(b"\n", b" " + _LINE + b" ").split()


def _chunks(texts: list[bytes | None]):
    """(first text, words of some texts): texts of about CHUNK_WORDS words in all, or one longer one."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(_words(text))
        size += len(held[-1])
        if size >= CHUNK_WORDS:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


SKETCHED = "doc_id long, doc_key long, start_word long, n_words long, cid long, sig binary"


def _doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, start_word, n_words, cid, sig, a row per paragraph and per stretch; sig is null for a stretch.

    doc_key: the id, or a hash of the text where there is none.
    """
    m = BANDS * ROWS

    def rows(chunk: Chunk, ids: list[pa.Array]) -> pa.RecordBatch:
        text, begin, end = chunk.paragraphs()
        shingles, at = chunk.shingles_in(begin, end)
        if len(text):
            place = np.arange(len(shingles)) - np.repeat(at, end - begin - SHINGLE + 1)
            ordered = (shingles ^ (place.astype(np.uint64) * similar.WORD_MIX[2])) * similar.WORD_MIX[3]
            cid = np.add.reduceat(ordered ^ (ordered >> np.uint64(31)), at)
            low = np.empty((len(text), m), "<u4")
            for j in range(m):
                h = (shingles ^ similar.COORD_ADD[j]) * similar.COORD_MUL[j]
                low[:, j] = np.minimum.reduceat((h ^ (h >> np.uint64(31))) * similar.COORD_MUL[63 - j], at) >> np.uint64(32)
            cid = ((cid ^ (cid >> np.uint64(29))) * similar.WORD_MIX[4]).view(np.int64)
        else:
            cid, low = np.empty(0, np.int64), np.empty((0, m), "<u4")
        other, start, name = chunk.spans()
        which, n = np.concatenate([text, other]), len(other)
        offsets = np.append(np.arange(len(text) + 1), np.full(n, len(text))).astype(np.int32) * 4 * m
        valid = np.packbits(np.arange(len(which)) < len(text), bitorder="little").tobytes()
        sig = pa.Array.from_buffers(pa.binary(), len(which), [pa.py_buffer(valid), pa.py_buffer(offsets.tobytes()), pa.py_buffer(low.tobytes())])
        first = np.concatenate([begin, start]) - chunk.first[which]
        length = np.concatenate([end - begin, np.full(n, SPAN, np.int64)])
        return pa.RecordBatch.from_arrays([*(x.take(pa.array(which)) for x in ids), pa.array(first), pa.array(length), pa.array(np.concatenate([cid, name])), sig], names=["doc_id", "doc_key", "start_word", "n_words", "cid", "sig"])

    def run(batches):
        vocabulary = Vocabulary()
        for batch in batches:
            for first, texts in _chunks(batch.column(2).cast(pa.binary()).to_pylist()):
                yield rows(Chunk(texts, vocabulary), [batch.column(k).slice(first, len(texts)) for k in (0, 1)])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc_key().alias("doc_key"), "text")
    return own.mapInArrow(run, SKETCHED)


def sets_of(docs: DataFrame) -> DataFrame:
    """cid, members (sorted distinct shingles) for the wanted places (arrays cids, starts, lengths) of each text."""

    def run(batches):
        for batch in batches:
            cids, members = [], []
            for text, *places in zip(batch.column(0).cast(pa.binary()), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = (text.as_py() or b"").lower().split()
                for cid, start, n in zip(*places, strict=True):
                    if len(own := words[start : start + n]) == n:
                        cids.append(cid)
                        members.append(similar.shingle_set(own, SHINGLE).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(members, pa.binary())], names=["cid", "members"])

    return docs.select("text", "cids", "starts", "lengths").mapInArrow(run, "cid long, members binary")


def bands_of(sig: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), F.substring(sig, 4 * rows * b + 1, 4 * rows)) for b in range(bands)])


def linked_sets(rows: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links of classes (cid, root, sorted members) that connect different roots at the threshold: a prefix-filtered join in memory."""
    often = Counter()
    for _, _, s in rows:
        often.update(s.tolist())
    order = [sorted(s.tolist(), key=lambda x: (often[x], x)) for _, _, s in rows]
    index, out, parent = defaultdict(list), [], {r[1]: r[1] for r in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in sorted(range(len(rows)), key=lambda i: len(order[i])):
        x, n = order[i], len(order[i])
        prefix = n - -(-percent * n // 100) + 1
        seen = set()
        for token in x[:prefix]:
            seen.update(index[token])
            index[token].append(i)
        for j in seen:
            if root(rows[i][1]) != root(rows[j][1]) and 100 * len(order[j]) >= percent * n:
                both = len(np.intersect1d(rows[i][2], rows[j][2], assume_unique=True))
                if 100 * both >= percent * (n + len(order[j]) - both):
                    parent[root(rows[i][1])] = root(rows[j][1])
                    out.append((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))
    return out


def _late_links(lists: DataFrame, percent: int) -> DataFrame:
    """Links in lists (key, cid, root, members) of bounded size, between different roots."""

    def run(batches):
        key, rows = None, []
        flush = lambda rows: linked_sets(rows, percent) if len({r[1] for r in rows}) > 1 else []
        links = lambda out: pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)], names=["a", "b"])
        for batch in batches:
            out = []
            for k, cid, root, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    out += flush(rows)
                    key, rows = k, []
                rows.append((cid, root, np.frombuffer(members, np.uint64)))
            yield links(out)
        yield links(flush(rows))

    return lists.select("key", "cid", "root", "members").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def _clusters(docs: DataFrame, known: DataFrame, percent: int, member_limit: int) -> DataFrame:
    """(node, root) of the paragraph classes linked to another one."""
    place = F.struct("doc_key", "start_word", "n_words")
    classes = stash(known.where("sig is not null").groupBy("cid").agg(F.min(place).alias("at"), F.min("sig").alias("sig")))
    texts = docs.select(_doc_key().alias("doc_key"), "text")

    def fetch(cids: DataFrame) -> DataFrame:
        wanted = classes.drop("sig").join(cids, "cid").select("cid", "at.*").groupBy("doc_key").agg(F.collect_list(F.struct("cid", "start_word", "n_words")).alias("w"))
        wanted = wanted.select("doc_key", F.col("w.cid").alias("cids"), F.col("w.start_word").alias("starts"), F.col("w.n_words").alias("lengths"))  # at most a document's paragraphs
        return sets_of(texts.join(wanted, "doc_key")).groupBy("cid").agg(F.min("members").alias("members"))

    posts = classes.select(F.explode(bands_of(F.col("sig"))).alias("key"), "cid")
    heads = posts.groupBy("key").agg(F.min("cid").alias("head"), F.count("*").alias("n")).where("n > 1")
    posted = stash(posts.join(heads, "key"))
    first = stash(posted.where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct())
    ends = first.select(F.col("a").alias("cid")).unionByName(first.select(F.col("b").alias("cid"))).distinct()
    links = stash(similar.confirm(first, fetch(ends), percent))
    found = components(links)
    rest = stash(similar.mixed_lists(posted, found).select("key", "cid", "root"))
    out = found
    if not rest.isEmpty():
        size = (F.col("at.n_words") - SHINGLE + 1).alias("size")
        lists = similar.blocked(rest.join(classes.select("cid", size), "cid").select("key", "cid", "root", "size"), member_limit, F.col("size"))
        late = stash(_late_links(lists.join(fetch(rest.select("cid").distinct()), "cid"), percent))
        if not late.isEmpty():
            out = components(links.unionByName(late))
        discard(late)
    discard(classes, posted, first, links, rest, *([found] if out is not found else []))
    return out


def repeats(docs: DataFrame, percent: int = PERCENT, member_limit: int = MEMBER_LIMIT) -> DataFrame:
    """doc_id, start_word, n_words, cluster_id, copies, removed, passage_start, passage_words: a row per repeated piece.

    A piece is a paragraph that has an equal or a similar one, or a stretch that has an equal one.  copies: pieces of its
    cluster; removed: whether another piece of the cluster is its first; passage_*: the run of pieces that it is part of.
    """
    known = stash(sketch(docs))
    found = _clusters(docs, known, percent, member_limit)
    often = known.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select("cid")
    clustered = found.select(F.col("node").alias("cid"), F.col("root").alias("cluster_id"))
    equal = often.join(clustered, "cid", "left_anti").select("cid", F.col("cid").alias("cluster_id"))
    placed = known.drop("sig").join(clustered.unionByName(equal), "cid").select("doc_id", "doc_key", "start_word", "n_words", "cluster_id")
    by_start = Window.partitionBy("doc_key").orderBy("start_word", "n_words")
    end = F.col("start_word") + F.col("n_words")
    apart = F.coalesce(F.col("start_word") > F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = placed.withColumn("_run", F.sum(apart.cast("long")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_key", "_run")
    runs = runs.withColumn("passage_start", F.min("start_word").over(whole)).withColumn("passage_words", F.max(end).over(whole) - F.col("passage_start"))
    pieces = stash(runs.where(F.col("passage_words") >= SPAN).drop("_run"))
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "start_word")
    head = stash(pieces.groupBy("cluster_id").agg(F.min(place).alias("head"), F.count("*").alias("copies")))
    out = pieces.join(head, "cluster_id")
    removed = (~F.col("doc_id").eqNullSafe(F.col("head.doc_id"))) | (F.col("start_word") != F.col("head.start_word"))
    discard(known, found)
    return out.select("doc_id", "start_word", "n_words", "cluster_id", "copies", removed.alias("removed"), "passage_start", "passage_words")
