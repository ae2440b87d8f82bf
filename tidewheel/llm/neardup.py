"""Near-duplicate documents by a signature-coordinate inverted join.

A document's set: its distinct 4-word shingles (lower-cased A-Z; words are runs of non-white-space).  Documents with equal
sets form a class and are joined once.  A class's MinHash signature has COORDS coordinates; sets at the threshold
agree in at least LEAST of them but for 4 in 100,000 pairs, so it is enough to post a class under the first
COORDS - LEAST + 1 coordinate-value pairs (prefix) and to count the other coordinates only for pairs that meet (skip).
Pairs with LEAST agreements are confirmed on their full sets.

Null or empty text, or no words: no set, linked with nothing, kept.  Exact copies, repeated rows among them, share a class
of any size.  An empty table gives an empty result.  Of ties the smallest id decides.  Very long texts cost their length.
Other columns are ignored, whatever their names; `keep_first` passes them on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ids, similar
from .common import pieces, stash

SHINGLE = 4
PERCENT = 80
COORDS = 16
LEAST = 6


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def sketch(docs: DataFrame, shingle: int = SHINGLE, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, cid, sig; cid and sig are null without a set."""

    def run(batches):
        for batch in pieces(batches):
            n, cid, sig = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = similar.shingle_set(_words(text), shingle)
                n.append(len(s))
                cid.append(similar.class_id(s) if len(s) else None)
                sig.append(similar.signature(s, coords) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "cid", "sig"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_shingles long, cid long, sig binary")


def sets_of(docs: DataFrame, places: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """cid, members: the full set of each document row whose id is among the places, and of a few others.

    The places go to the tasks as a filter, so that no text is shuffled, and the filter is applied where the sets are made:
    a Python filter of its own would be a second worker beside each task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ids.bits_of(places))

    def run(batches):
        for batch in pieces(batches):
            there = pa.array(ids.has(shared.value, batch.column(0).to_numpy()))
            sets = [similar.shingle_set(_words(t), shingle) for t in batch.column(1).filter(there).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([similar.class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "members"])

    return docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text").mapInArrow(run, "cid long, members binary")


def _classes(docs: DataFrame, shingle: int, percent: int, coords: int, least: int, limits: dict) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, cid), and the class of every set: cid, at (its least doc_id), component_id, keeper (its component's class to keep)."""
    known = stash(sketch(docs, shingle, coords))
    classes = stash(known.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("at"), F.min("sig").alias("sig"), F.count("*").alias("copies"), F.min("n_shingles").alias("size")))

    def fetch(places: DataFrame) -> DataFrame:
        """Sets of other places may come along; they meet no pair."""
        return sets_of(docs, places, shingle).groupBy("cid").agg(F.min("members").alias("members"))

    roots = similar.roots(classes, fetch, coords=coords, least=least, percent=percent, **limits)
    linked = classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid").select("cid", "at", "root")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("at").isNull(), "at", "cid")).alias("first"))
    named = linked.join(first, "root").select("cid", F.col("first.at").alias("component_id"), F.col("first.cid").alias("keeper"))
    alone = classes.select("cid", "at").join(named, "cid", "left")
    return known, alone.select("cid", F.coalesce("component_id", "at").alias("component_id"), F.coalesce("keeper", "cid").alias("keeper"))


def components_of(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, coords: int = COORDS, least: int = LEAST, **limits: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document row.

    A null doc_id is larger than all others; a document of such ones alone has a null component_id and is kept.
    """
    known, by_class = _classes(docs, shingle, percent, coords, least, limits)
    out = known.select("doc_id", "n_shingles", "cid").join(by_class, "cid", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, **limits: int) -> DataFrame:
    """The row of each component with the smallest id, and every row without a set, with all columns.

    Of rows with that id in one component, one of the class named by `keeper` stays.  A null id is larger than all others.
    Rows with one id and texts of different components each stand for themselves.  Where an id is on one row only, the
    ids to leave out go to the rows, or join them if they are too many; only rows whose id is null or repeated are
    shingled again, to tell them apart.
    """
    known, by_class = _classes(docs, shingle, PERCENT, COORDS, LEAST, limits)
    chosen = known.join(by_class.withColumnRenamed("cid", "_class"), F.col("cid") == F.col("_class"), "left")
    kept = F.col("cid").isNull() | ((F.col("cid") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    by_id = stash(chosen.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows"), F.max(kept).alias("_kept")))
    single = by_id.where("_kept and _id is not null and _rows = 1").select("_id")
    other = by_id.where("_id is not null and not (_kept and _rows = 1)").select("_id")
    own = F.col("doc_id").cast("long")
    if other.count() * ids.BITS_EACH > ids.MOST_BITS:
        plain = docs.join(single, own == F.col("_id"), "left_semi")
    else:
        plain = docs.where(own.isNotNull() & ~ids.among(other, single)(own))
    several = by_id.where("_kept and (_id is null or _rows > 1)").select("_id")
    if several.isEmpty():
        return plain
    doubtful = docs.join(several, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    told = _with_class(doubtful, shingle)
    keepers = by_class.where("cid = keeper").select(F.col("cid").alias("_keeper"), F.col("component_id").alias("_first"))
    same = (F.col("_cid") == F.col("_keeper")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_first"))
    first = told.join(keepers, same, "left_semi").dropDuplicates(["_cid"])
    return plain.unionByName(told.where("_cid is null").drop("_cid")).unionByName(first.drop("_cid"))


def _with_class(docs: DataFrame, shingle: int) -> DataFrame:
    """The rows with the class of their set in _cid."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in pieces(batches):
            sets = [similar.shingle_set(_words(t), shingle) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.append_column("_cid", pa.array([similar.class_id(s) if len(s) else None for s in sets], pa.int64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_cid", T.LongType())]))
