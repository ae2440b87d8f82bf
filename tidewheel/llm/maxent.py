"""Hashed maximum-entropy language model with class-factored softmax.

log P(text) = sum over tokens of log P(class | history) + log P(place | class, history) + log P(token | class, place).  The
KNOWN most frequent tokens fill classes of PLACES, a token per place.  Every other token has the class of its form (which
non-ASCII letters it has, how it ends) and the place that its hash names; within a place its probability is its add-one
share.  Classes and places are softmaxes, so the model is proper over the whole vocabulary, however large, and unseen tokens.
History features: the hashed previous token, the one before it (a skip feature), the hashed pair, and the pair's forms;
the place has one of the hashed previous token and the class.  Any token, frequent or not, is a feature by its own hash.

Texts are cut and hashed once, into chunks of about CHUNK tokens: distinct tokens and numbers into them, in a table in the
shared folder that all later passes read.  Counts cover all learning documents.  Weights start at the counts' log shares and
are trained in ROUNDS distributed updates: every learning document is in exactly one round, each task takes gradient steps
over its documents in numpy batches, and the row-wise weighted mean of the tasks' changes becomes the new model.  Scoring
sends (chunk, rare token) rows with the documents that hold the token to its count and back, so no count table is ever
held by one task.

Tokens are named by 64-bit hashes.  Null text: only the end token.  An empty table: an empty result.  Empty learning data:
N = V = 0, base probability 1.  Repeated rows, and rows with the same doc_id, are scored each; a null doc_id is in no fold:
held_out is null and nothing is learnt from it.  Very long texts are a chunk of their own.  Ties among the most frequent
tokens go to the smaller hash.  Other columns are ignored, whatever their names.  Hot tokens meet pre-aggregated
counts; the rest is a join that can be split.
"""

from __future__ import annotations

import io
from copy import copy
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, discard, fold, give_back, settings, stash

KNOWN, PLACES, FORMS = 512, 32, 16
CLASSES = KNOWN // PLACES + FORMS
LAST_ROWS, PAIR_BITS, WITHIN_BITS = 1 << 13, 13, 13
CODES = KNOWN + FORMS + 1  # the last: before the text
ROUNDS, STEP, BATCH = 2, 1.2, 8_192
END = b"\n"
SLICE = 16 * BATCH  # tokens whose features a task holds at a time
MEMO = 400_000
CHUNK, CHUNK_DOCS = 1_500_000, 60_000
PART = 512
#: Chunks are rows of some MB: each is written as a page and a row group of its own and read by itself, so that an executor's heap holds few at a time.
BY_CHUNK = {"parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.block.row.count.limit": "1"}
ONE_BY_ONE = {**BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": "1"}
_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def form_of(word: bytes) -> int:
    """One of FORMS forms: the kind of ending and which non-ASCII letters there are."""
    last = word[-1:]
    ending = 0 if last.isalnum() else 1 if last in (b".", b",") else 2 if last < b"\x80" else 3
    high = [c & 63 for c in word if 0x80 <= c < 0xC0]
    return ending * 4 + (min(high) % 3 + 1 if high else 0)


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def tally(at: np.ndarray, size: int) -> np.ndarray:
    """How often each number occurs, some at a time: bincount makes wider copies."""
    out = np.zeros(size, np.int64)
    for a in range(0, len(at), SLICE):
        out += np.bincount(at[a : a + SLICE], minlength=size)
    return out


class Numbers(dict):
    """Words to numbers in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Coder:
    """Words to numbers, with a bounded memory of words."""

    def __init__(self):
        self.memo, self.hashes, self.forms = Numbers(), np.empty(0, np.int64), np.empty(0, np.uint8)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths with the end token, and numbers of all tokens in a row."""
        cut = [[*(t or b"").lower().split(), END] for t in texts]
        lens = np.fromiter(map(len, cut), np.int64, len(cut))
        return lens, np.fromiter(map(self.memo.__getitem__, chain.from_iterable(cut)), np.int32, int(lens.sum()))

    def name(self):
        """Hashes and forms of the words that have none yet."""
        new = list(islice(self.memo, len(self.hashes), None))
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(hash_of, new), np.int64, len(new))])
        self.forms = np.concatenate([self.forms, np.fromiter(map(form_of, new), np.uint8, len(new))])

    def chunk(self, doc_id: list, learn: list, held: list, lens: list[np.ndarray], numbers: list[np.ndarray]) -> bytes:
        """Everything that later passes need of some documents; the memory starts anew once it is large.  Empties numbers."""
        self.name()
        parts, numbers = numbers, np.concatenate(numbers)
        parts.clear()
        lens, learn = np.concatenate(lens), np.array(learn, bool)
        often = tally(numbers, len(self.memo))
        used = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
        rank = np.empty(len(often), np.uint32)
        rank[used] = np.arange(len(used), dtype=np.uint32)
        stream = rank[numbers]
        del numbers, rank, often
        learnt = tally(stream[np.repeat(learn, lens)], len(used)).astype(np.int32)
        out = io.BytesIO()
        np.savez(
            out, doc_id=np.array([d or 0 for d in doc_id], np.int64), null=np.array([d is None for d in doc_id]), held=np.array([2 if h is None else h for h in held], np.uint8), learn=learn,
            lens=lens, hashes=self.hashes[used], forms=self.forms[used], learnt=learnt, low=stream.astype(np.uint16), high=(stream >> np.uint32(16)).astype(np.uint16),
        )
        if len(self.memo) > MEMO:
            self.__init__()
        return out.getvalue()


class Chunk:
    """A chunk read again."""

    def __init__(self, blob: bytes):
        own = np.load(io.BytesIO(blob))
        self.doc_id, self.null, self.held, self.learn, self.lens, self.hashes, self.forms, self.learnt = (own[k] for k in ("doc_id", "null", "held", "learn", "lens", "hashes", "forms", "learnt"))
        self.stream = own["low"].astype(np.int32) | own["high"].astype(np.int32) << 16

    def only(self, docs: np.ndarray) -> Chunk:
        """The same with some of its documents."""
        out = copy(self)
        out.stream, out.lens = self.stream[np.repeat(docs, self.lens)], self.lens[docs]
        return out

    def slices(self, known: np.ndarray, size: int):
        """last, skip, shape, pair, class and place of every token, for so many tokens at a time; known: hashes of the most frequent tokens."""
        order = np.argsort(known)
        at = order[np.minimum(np.searchsorted(known, self.hashes, sorter=order), max(0, len(known) - 1))] if len(known) else np.zeros(len(self.hashes), np.int64)
        rare = known[at] != self.hashes if len(known) else np.ones(len(self.hashes), bool)
        spread = self.hashes.view(np.uint64) * _PAIR
        form = self.forms.astype(np.int64)
        code = np.where(rare, KNOWN + form, at)
        row = np.where(rare, KNOWN + (spread >> np.uint64(20)) % np.uint64(LAST_ROWS - KNOWN - 1), at).astype(np.int64)
        group = np.where(rare, KNOWN // PLACES + form, at // PLACES)
        place = np.where(rare, spread >> np.uint64(59), at % PLACES).astype(np.int64)
        s, first = self.stream, np.cumsum(self.lens) - self.lens
        starts = [(first + k)[self.lens > k] for k in range(2)]

        def before(values: np.ndarray, steps: int, start: int, a: int, b: int) -> np.ndarray:
            out, own = np.empty(b - a, np.int64), max(a, steps)
            out[own - a :] = values[s[own - steps : max(0, b - steps)]]
            for x in starts[:steps]:
                out[x[np.searchsorted(x, a) : np.searchsorted(x, b)] - a] = start
            return out

        for a in range(0, len(s), size):
            b = min(a + size, len(s))
            last, other = before(row, 1, LAST_ROWS - 1, a, b), before(row, 2, LAST_ROWS - 1, a, b)
            pair = ((last.astype(np.uint64) * np.uint64(LAST_ROWS) + other.astype(np.uint64)) * _PAIR) >> np.uint64(64 - PAIR_BITS)
            shape = before(form, 1, FORMS, a, b) * (FORMS + 1) + before(form, 2, FORMS, a, b)
            yield last, before(code, 2, CODES - 1, a, b), shape, pair.astype(np.int64), group[s[a:b]], place[s[a:b]]

    def coded(self, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """The one slice with all tokens."""
        return next(self.slices(known, max(1, len(self.stream))), (np.empty(0, np.int64),) * 6)


def code(docs: DataFrame, learn: Column, held_out: Column) -> DataFrame:
    """chunk, blob: the documents' tokens."""

    def run(batches):
        coder, held, number, task = Coder(), [[], [], [], [], []], 0, TaskContext.get().partitionId()

        def flush():
            nonlocal number, held
            out = pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), pa.array([coder.chunk(*held)], pa.binary())], names=["chunk", "blob"])
            number, held = number + 1, [[], [], [], [], []]
            give_back()
            return out

        for batch in batches:
            ids, learns, outs = (batch.column(k).to_pylist() for k in (0, 2, 3))
            texts, at = batch.column(1).cast(pa.binary()), 0
            while at < len(ids):
                size, stop = 0, at  # some texts of about 2 MB
                while stop < len(ids) and stop - at < 512 and size < 2_000_000:
                    size += len(texts[stop].as_py() or b"")
                    stop += 1
                lens, numbers = coder(texts[at:stop].to_pylist())
                for own, new in zip(held, (ids[at:stop], learns[at:stop], outs[at:stop], [lens], [numbers]), strict=True):
                    own += new
                at = stop
                if sum(map(len, held[4])) >= CHUNK or len(held[0]) >= CHUNK_DOCS:
                    yield flush()
        if held[0]:
            yield flush()
        coder = batch = texts = lens = numbers = None
        give_back()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"), held_out.alias("held"))
    return own.mapInArrow(run, "chunk long, blob binary")


class Weights:
    """Class and place weights by feature row; fixed sizes."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a, self.own = arrays, None

    @classmethod
    def start(cls, share: np.ndarray) -> Weights:
        """share: of each place in each class."""
        zeros = lambda r, c: np.zeros((r, c), np.float32)
        total = share.sum(1, keepdims=True)
        return cls({
            "bias": np.log(total.T / total.sum()).astype(np.float32),
            "last": zeros(LAST_ROWS, CLASSES), "skip": zeros(CODES, CLASSES), "shape": zeros((FORMS + 1) ** 2, CLASSES), "pair": zeros(1 << PAIR_BITS, CLASSES),
            "word": np.log(share / total).astype(np.float32), "within": zeros(1 << WITHIN_BITS, PLACES),
        })

    def copy(self) -> Weights:
        return Weights({k: v.copy() for k, v in self.a.items()})

    def space(self, n: int) -> dict[str, np.ndarray]:
        """Arrays that all batches of one size share: fresh ones of this size cost more than what is done in them."""
        if self.own is None or len(self.own["z"]) < n:
            single = ("z", "e", "rows")
            self.own = {k: np.empty((n, max(CLASSES, PLACES)), np.float32) for k in single} | {"columns": np.empty((max(CLASSES, PLACES), n))}
        return {k: v[:n] if k != "columns" else v[:, :n] for k, v in self.own.items()}

    @staticmethod
    def log_soft(z: np.ndarray, e: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logs of the softmax of each row, in place, and exps (in e) with their totals; weights are too small for a row of exps to vanish."""
        z -= z.max()
        e = np.exp(z, out=e)
        total = (e @ np.ones(z.shape[1], np.float32))[:, None]
        z -= np.log(total)
        return z, e, total

    def soft(self, features: list[tuple[str, np.ndarray]], bias: np.ndarray | None, chosen: np.ndarray, use: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logs of the chosen entries of each row's softmax; exps and their totals."""
        width = self.a[features[0][0]].shape[1]
        z, e, rows = (use[k][:, :width] for k in ("z", "e", "rows"))
        np.take(self.a[features[0][0]], features[0][1], 0, out=z, mode="clip")
        for name, at in features[1:]:
            z += np.take(self.a[name], at, 0, out=rows, mode="clip")
        if bias is not None:
            z += bias
        logs, e, total = self.log_soft(z, e)
        return logs[np.arange(len(z)), chosen].astype(np.float64), e, total

    def move(self, features: list[tuple[str, np.ndarray]], chosen: np.ndarray, e: np.ndarray, total: np.ndarray, step: float, seen: dict[str, np.ndarray], columns: np.ndarray):
        """A gradient step: each row of weights moves by its mean gradient in the batch, as if two rows had none."""
        e /= total
        e[np.arange(len(e)), chosen] -= 1
        columns = columns[: e.shape[1]]
        np.copyto(columns, e.T)
        for name, rows in features:
            n = np.bincount(rows, minlength=len(self.a[name]))
            ids = np.flatnonzero(n)
            some, n = (np.cumsum(n > 0) - 1)[rows], n[ids]
            change = np.empty((len(ids), len(columns)), np.float32)
            for k, gradient in enumerate(columns):
                change[:, k] = np.bincount(some, gradient, len(ids))
            change *= (step / (n + 2.0)).astype(np.float32)[:, None]
            self.a[name][ids] -= change
            seen[name][ids] += n

    def batch(self, last, skip, shape, pair, group, place, step: float = 0.0, seen: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Natural log probability of each token's class and place; with a step, the weights move."""
        use = self.space(len(group))
        inner = (((last * CLASSES + group).astype(np.uint64) * _MIX) >> np.uint64(64 - WITHIN_BITS)).astype(np.int64)
        out = np.zeros(len(group))
        for features, bias, chosen in (
            ([("last", last), ("skip", skip), ("shape", shape), ("pair", pair)], self.a["bias"], group),
            ([("within", inner), ("word", group)], None, place),
        ):
            logs, e, total = self.soft(features, bias, chosen, use)
            out += logs
            if step:
                self.move(features, chosen, e, total, step, seen, use["columns"])
        return out


def count(coded: DataFrame) -> DataFrame:
    """h, leaf, c: each learnt token's count; leaf: its form and place if it is rare."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                own = Chunk(blob.as_py())
                has = own.learnt > 0
                h = own.hashes[has]
                leaf = own.forms[has].astype(np.int32) * PLACES + (h.view(np.uint64) * _PAIR >> np.uint64(59)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(leaf), pa.array(own.learnt[has].astype(np.int64))], names=["h", "leaf", "n"])

    return coded.select("blob").mapInArrow(run, "h long, leaf int, n long").groupBy("h").agg(F.min("leaf").alias("leaf"), F.sum("n").alias("c"))


def _merge(deltas: DataFrame) -> DataFrame:
    """Sums of (name, part, seen, change) rows."""

    def add(key, rows):
        seen = np.sum([np.frombuffer(x, np.float32) for x in rows.column("seen").to_pylist()], axis=0, dtype=np.float64).astype(np.float32)
        change = np.sum([np.frombuffer(x, np.float32) for x in rows.column("change").to_pylist()], axis=0, dtype=np.float64).astype(np.float32)
        return pa.table({"name": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "seen": pa.array([seen.tobytes()], pa.binary()), "change": pa.array([change.tobytes()], pa.binary())})

    out = "name string, part int, seen binary, change binary"
    some = deltas.groupBy("name", "part", "salt").applyInArrow(lambda key, rows: add(key, rows), out)
    return some.groupBy("name", "part").applyInArrow(add, out)


def train(coded: DataFrame, known: np.ndarray, start: Weights, rounds: int = ROUNDS) -> Weights:
    """Each learning document takes part in one of the rounds."""
    spark, weights = coded.sparkSession, start
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((known, weights.a))
        step = STEP / (1 + k)

        def run(batches, shared=shared, step=step, k=k):
            known, arrays = shared.value
            base, own = arrays, Weights(arrays).copy()
            seen = {n: np.zeros(len(v), np.float32) for n, v in arrays.items()}
            for batch in batches:
                for blob in batch.column(0):
                    chunk = Chunk(blob.as_py())
                    for tokens in chunk.only(chunk.learn & (np.arange(len(chunk.lens)) % rounds == k)).slices(known, SLICE):
                        for b in range(0, len(tokens[0]), BATCH):
                            own.batch(*(x[b : b + BATCH] for x in tokens), step, seen)
                    chunk = tokens = None
                    give_back()
            salt, rows = TaskContext.get().partitionId() // 64, []
            for name, new in own.a.items():
                for part in range(0, len(new), PART):
                    n = seen[name][part : part + PART]
                    if n.any():
                        change = (new[part : part + PART] - base[name][part : part + PART]) * n[:, None]
                        rows.append((name, part // PART, salt, n.tobytes(), change.astype(np.float32).tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["name", "part", "salt", "seen", "change"])

        merged = _merge(coded.select("blob").mapInArrow(run, "name string, part int, salt int, seen binary, change binary")).collect()  # the model's fixed size
        weights = weights.copy()
        for r in merged:
            at, width = r["part"] * PART, weights.a[r["name"]].shape[1]
            n = np.maximum(np.frombuffer(r["seen"], np.float32), 1)[:, None]
            weights.a[r["name"]][at : at + len(n)] += np.frombuffer(r["change"], np.float32).reshape(-1, width) / n
        shared.unpersist()
    return weights


def lines_up(tokens: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct token numbers, and for each the documents that hold it (once per occurrence), as binary uint16."""
    both = tokens.astype(np.int64) << 16 | docs
    both.sort()
    d = both.astype("<u2")
    both >>= 16
    begin = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
    offsets = np.append(begin, len(both)).astype(np.int32) * 2
    return both[begin], pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(d.tobytes())])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Model:
    """What scoring needs: the weights, and the counts that give base probabilities and shares."""

    def __init__(self, known: np.ndarray, often: np.ndarray, weights: Weights, rare: np.ndarray, total: int, distinct: int):
        """rare: per class of forms and place, the mass (c + 1) of its tokens and of one unseen token."""
        self.known, self.weights, self.total, self.distinct = known, weights, total, distinct
        self.base_log, self.rare_log = np.log10(np.append(often, np.zeros(KNOWN - len(often))) + 1), np.log10(rare)

    def parts(self, chunk: Chunk):
        """A slice of the tokens at a time: where it is, whether each token is rare, base log10 probability and the model's; of rare ones without log10(c + 1)."""
        for a, tokens in zip(range(0, len(chunk.stream), SLICE), chunk.slices(self.known, SLICE), strict=True):
            group, place = tokens[4], tokens[5]
            log = np.concatenate([self.weights.batch(*(x[b : b + BATCH] for x in tokens)) for b in range(0, len(group), BATCH)]) / np.log(10)
            far = group >= KNOWN // PLACES
            log[far] -= self.rare_log[group[far] - KNOWN // PLACES, place[far]]
            yield slice(a, a + len(group)), far, np.where(far, 0.0, self.base_log[np.where(far, 0, group * PLACES + place)]) - np.log10(self.total + self.distinct + 1), log

    def of(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of all tokens."""
        n = len(chunk.stream)
        rare, base, logs = np.empty(n, bool), np.empty(n), np.empty(n)
        for own, *some in self.parts(chunk):
            rare[own], base[own], logs[own] = some
        return rare, base, logs

    def sums(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each token is rare, the document of each, and for each document: tokens that are not rare, base and model's log10 probability."""
        n = len(chunk.lens)
        rare, doc, out = np.empty(len(chunk.stream), bool), np.repeat(np.arange(n, dtype=np.uint16), chunk.lens), np.zeros((3, n))
        for own, far, base, log in self.parts(chunk):
            rare[own] = far
            first, at = int(doc[own.start]), doc[own].astype(np.int64)
            at -= first
            for k, values in enumerate((~far, base, log)):
                new = np.bincount(at, values)
                out[k, first : first + len(new)] += new
        return rare, doc, out


def fit(coded: DataFrame, counts: DataFrame) -> Model:
    """coded: of `code`; counts: of `count`.  What comes to the driver has a fixed size."""
    top = counts.orderBy(F.desc("c"), "h").limit(KNOWN).select("h", "c", "leaf").collect()
    known, often = np.array([r["h"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64)
    mass = np.zeros((3, FORMS * PLACES))  # tokens, distinct ones, and the two without the known tokens
    for r in counts.groupBy("leaf").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        mass[:, r["leaf"]] = r["n"], r["v"], r["n"] + r["v"]
    for r in top:
        mass[2, r["leaf"]] -= r["c"] + 1
    padded = np.full(KNOWN, 1e-6)
    padded[: len(often)] += often
    rare = mass[2].reshape(FORMS, PLACES) + 1
    weights = train(coded, known, Weights.start(np.concatenate([padded.reshape(-1, PLACES), rare])))
    return Model(known, often, weights, rare, int(mass[0].sum()), int(mass[1].sum()))


def score(docs: DataFrame, learn: Column, held_out: Column) -> DataFrame:
    """One row per document.  The result is written too: chunks are never read under settings that hold many of them at once."""
    spark = docs.sparkSession
    coded = stash(code(docs, learn, held_out), **BY_CHUNK, compression="zstd")
    counts = stash(count(coded), ONE_BY_ONE)
    with settings(spark, ONE_BY_ONE):
        model = fit(coded, counts)
    shared, total = spark.sparkContext.broadcast(model), model.total

    def read(batches):
        model = shared.value
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Chunk(blob.as_py())
                rare, doc, (known, base, logs) = model.sums(own)
                keep = io.BytesIO()
                np.savez(keep, doc_id=own.doc_id, null=own.null, held=own.held, n=own.lens, known=known, base=base, score=logs)
                t, holders = lines_up(own.stream[rare], doc[rare])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([None], pa.int64()), pa.array([keep.getvalue()], pa.binary())], names=["block", "h", "holders"])
                for cut in range(0, len(t), 50_000):
                    n = min(50_000, len(t) - cut)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(own.hashes[t[cut : cut + n]]), holders.slice(cut, n)], names=["block", "h", "holders"])
                own = rare = known = base = logs = doc = keep = t = holders = None
                give_back()

    def finish(key, rows):
        c, is_docs = rows.column("c").fill_null(0).to_numpy(), rows.column("c").is_null().to_numpy()
        holders = rows.column("holders").to_pylist()
        sums = np.load(io.BytesIO(holders[int(np.flatnonzero(is_docs)[0])]))
        take = [x for x, own in zip(holders, is_docs, strict=True) if not own]
        size = np.fromiter((len(x) // 2 for x in take), np.int64, len(take))
        doc, each = np.frombuffer(b"".join(take), "<u2"), np.repeat(c[~is_docs], size)
        n = len(sums["n"])
        more = np.bincount(doc, np.log10(each + 1.0), n)
        return pa.table({
            "doc_id": pa.array(sums["doc_id"], mask=sums["null"]), "held_out": pa.array(sums["held"] == 1, mask=sums["held"] == 2), "n_tokens": pa.array(sums["n"], pa.int64()),
            "n_known": pa.array((sums["known"] + np.bincount(doc, each > 0, n)).astype(np.int64)), "train_tokens": pa.array([total] * n, pa.int64()),
            "base_score": pa.array(sums["base"] + more), "score": pa.array(sums["score"] + more),
        })

    posted = coded.mapInArrow(read, "block long, h long, holders binary")
    joined = posted.join(counts.select("h", "c"), "h", "left").select("block", F.when(F.col("h").isNotNull(), F.coalesce("c", F.lit(0))).alias("c"), "holders")
    out = stash(joined.groupBy("block").applyInArrow(finish, SCORED), ONE_BY_ONE)
    shared.unpersist()
    discard(coded, counts)
    return out


def language_scores(docs: DataFrame, modulus: int = 7, out: int = 2) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold."""
    held = fold("doc_id", modulus) == out
    return score(docs, ~held, held)
