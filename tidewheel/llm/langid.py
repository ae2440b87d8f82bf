"""Language identification by segmentation-marginalised unigram models.

The pieces are those of a fixed public vocabulary, all of them.  Each language has a probability per piece; a word's
probability is the sum over all its segmentations into pieces, by the forward algorithm, and a text's is the product over
its words.  Piece probabilities come from EM (forward-backward) on a bounded sample: at most SAMPLE_DOCS documents, shared
out evenly among the languages, of each those first in a hash order.  In EM, words of over SHORT characters count as
stretches of SHORT; scoring sums over whole words and covers whole texts.  Words are scored once per batch in numpy and cached.

Null text, or one without a letter: `und`, score 0.  Without training rows, or in an empty table, there is nothing but `und`.
Characters outside the vocabulary are pieces of a small fixed probability; a text of such ones alone ties, and ties go to
the first language by name.  Repeated rows get equal results; no row depends on another.  A null doc_id is in no fold:
held_out is null and nothing is learnt from it.  Very long texts and words cost their length.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, stable_order

SAMPLE_DOCS = 1_500
#: More languages than this are a mistaken column.
MOST_LANGS = 500
ROUNDS = 2
SHORT = 31  # longer words take the scaled path
UNKNOWN = 1e-7
FLOOR = 0.05
CACHE_WORDS = 300_000
MARK = "▁"
_LETTER = regex.compile(r"\p{L}")
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return [model.id_to_piece(i) for i in known]


#: Per piece length: words, first places and pieces of all occurrences, by place.
Hits = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


class Lattice:
    """All pieces at all places of many words at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.maybe = np.zeros(1 << 20, bool)  # by the hash's upper bits, whether there may be a piece
        for k in sorted({len(p) for p in pieces}):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == k])
            chars = np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64).T
            h = np.zeros(len(ids), np.uint64)
            for row in chars:
                h = (h + row + np.uint64(1)) * _BASE
            keys = self.mixed(h)
            order = np.argsort(keys)
            self.by_length[k] = (keys[order], ids[order])
            self.maybe[keys >> np.uint64(44)] = True

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))

    def hits(self, words: list[str]) -> tuple[np.ndarray, Hits]:
        """Lengths, and every piece at every place; size + 1: a character that is no piece."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(lens.max())
        flat = np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.ascontiguousarray(flat.reshape(len(words), wide).T).astype(np.uint64)
        found, h, n = {}, np.zeros_like(chars), len(words)
        for k in range(1, min(wide, max(self.by_length)) + 1):
            h = (h[: wide - k + 1] + chars[k - 1 :] + np.uint64(1)) * _BASE  # hashes of k characters from each place
            if k not in self.by_length:
                continue
            keys, ids = self.by_length[k]
            mixed = self.mixed(h).ravel()
            some = np.flatnonzero(self.maybe[mixed >> np.uint64(44)])
            at = np.minimum(np.searchsorted(keys, mixed[some]), len(keys) - 1)
            same = keys[at] == mixed[some]
            some, piece = some[same], ids[at[same]]
            if k == 1:
                whole = np.where(chars.ravel() > 0, self.size + 1, -1)
                whole[some] = piece
                some = np.flatnonzero(whole >= 0)
                piece = whole[some]
            found[k] = (some % n, some // n, piece)
        return lens, found


def by_place(hits: Hits, wide: int) -> dict[int, list[slice]]:
    """Per piece length the part of its hits at each first place."""
    out = {}
    for k, (_, start, _) in hits.items():
        edge = np.searchsorted(start, np.arange(wide + 1)).tolist()
        out[k] = [slice(a, b) for a, b in zip(edge, edge[1:], strict=False)]
    return out


def forward(n: int, wide: int, hits: Hits, parts: dict[int, list[slice]], prob: np.ndarray) -> np.ndarray:
    """alpha, positions x words x languages; prob: pieces (+ none, unknown) x languages."""
    alpha = np.zeros((wide + 1, n, prob.shape[1]))
    alpha[0] = 1
    for t in range(1, wide + 1):
        for k, (word, _, piece) in hits.items():
            if k <= t and (part := parts[k][t - k]).start < part.stop:
                rows = word[part]
                alpha[t, rows] += alpha[t - k, rows] * prob[piece[part]]
    return alpha


class Model:
    def __init__(self, pieces: list[str], langs: list[str], docs: list[tuple[str, str]], rounds: int = ROUNDS):
        self.langs, self.lattice = langs, Lattice(pieces)
        n, m = self.lattice.size, len(langs)
        self.prob = np.full((n + 2, m), 1.0 / max(1, n))
        self.fixed()
        counts = [Counter() for _ in langs]
        for text, lang in docs:
            words = (MARK + w for w in text.split())
            counts[langs.index(lang)].update(w[k : k + SHORT] for w in words for k in range(0, len(w), SHORT))
        words = list(dict.fromkeys(w for c in counts for w in c))
        words.sort(key=len)
        for _ in range(rounds if m else 0):
            total = np.full((n + 2, m), FLOOR)
            for at in range(0, len(words), 20_000):
                self.expect(words[at : at + 20_000], counts, total)
            self.prob = total / total[:n].sum(0)
            self.fixed()

    def fixed(self) -> None:
        self.prob[self.lattice.size], self.prob[self.lattice.size + 1] = 0.0, UNKNOWN

    def expect(self, words: list[str], counts: list[Counter], total: np.ndarray) -> None:
        """Add the expected piece counts of these words."""
        often = np.array([[c[w] for c in counts] for w in words], float)
        lens, hits = self.lattice.hits(words)
        wide, row = int(lens.max()), np.arange(len(words))
        parts = by_place(hits, wide)
        alpha = forward(len(words), wide, hits, parts, self.prob)
        z = alpha[lens, row]
        scale = np.divide(often, z, out=np.zeros_like(z), where=z > 0)
        beta = np.zeros_like(alpha)
        beta[lens, row] = scale
        for t in range(wide - 1, -1, -1):
            for k, (word, _, piece) in hits.items():
                if t + k <= wide and (part := parts[k][t]).start < part.stop:
                    rows, ids = word[part], piece[part]
                    ahead = self.prob[ids] * beta[t + k, rows]
                    beta[t, rows] += ahead
                    share = alpha[t, rows] * ahead
                    for j in range(share.shape[1]):
                        total[:, j] += np.bincount(ids, share[:, j], len(total))

    def log_words(self, words: list[str]) -> np.ndarray:
        """log10 probability of each word (with its mark) per language."""
        out = np.empty((len(words), len(self.langs)))
        short = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: len(words[i]))
        for at in range(0, len(short), 8_192):
            part = short[at : at + 8_192]
            lens, hits = self.lattice.hits([words[i] for i in part])
            wide = int(lens.max())
            alpha = forward(len(part), wide, hits, by_place(hits, wide), self.prob)
            out[part] = np.log10(np.maximum(alpha[lens, np.arange(len(part))], 1e-300))
        for i in (i for i, w in enumerate(words) if len(w) > SHORT):
            out[i] = self.log_long(words[i])
        return out

    def log_long(self, word: str) -> np.ndarray:
        """The same sum for a word of any length: only the last alphas are held, rescaled at each step."""
        _, hits = self.lattice.hits([word])
        ending: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
        for k, (_, start, piece) in hits.items():
            for t, p in zip((start + k).tolist(), piece.tolist(), strict=True):
                ending[t].append((k, p))
        most = max(hits)
        last, log = [np.ones(len(self.langs))], np.zeros(len(self.langs))
        for pieces in ending[1:]:
            top = np.maximum(sum(last[-k] * self.prob[p] for k, p in pieces), 1e-300)
            log += np.log10(top)
            last = [x / top for x in [*last[-most + 1 :], top]]
        return log

    def predictor(self):
        """text -> (language, score), with a bounded cache of words."""
        cache: dict[str, int] = {}
        table = np.empty((0, len(self.langs)))
        used = 0

        def predict(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal table, used
            if used > CACHE_WORDS:
                cache.clear()
                used = 0
            cut = [t.split() if t and self.langs and _LETTER.search(t) else None for t in texts]
            new = list({w for ws in cut if ws for w in ws if w not in cache})
            if new:
                if used + len(new) > len(table):
                    table = np.concatenate([table[:used], np.empty((used + 2 * len(new), len(self.langs)))])
                table[used : used + len(new)] = self.log_words([MARK + w for w in new])
                cache.update(zip(new, range(used, used + len(new)), strict=True))
                used += len(new)
            out = []
            for ws in cut:
                if not ws:
                    out.append(("und", 0.0))
                    continue
                total = table[np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws))].sum(0)
                best = int(total.argmax())
                out.append((self.langs[best], float(1 / (10 ** np.clip(total - total[best], -300, 0)).sum())))
            return out

        return predict


def fit(docs: DataFrame, learn: Column, path: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from at most sample_docs documents for which learn holds."""
    own = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    often = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(often) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    some = []
    if often:
        each = max(1, sample_docs // len(often))
        order, whole = F.pmod(stable_order("doc_id", "text"), F.lit(2**31 - 1)), 2**31 - 1
        # About 2 x each rows of a language pass, from all tasks together, before the first ones are taken.
        bound = F.create_map(*[F.lit(x) for lang, n in often.items() for x in (lang, min(whole, int(whole * (2 * each + 50) / n)))])
        few = own.where(order <= bound[F.col("lang")])
        few = few.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", "text"))).where(F.col("_k") <= each)
        some = sorted((r["lang"], r["_k"], r["text"]) for r in few.select("lang", "_k", "text").collect())
    return Model(vocabulary(path or default_vocabulary()), sorted(often), [(text, lang) for lang, _, text in some])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predict = shared.value.predictor()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [x for at in range(0, len(texts), 256) for x in predict(texts[at : at + 256])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
