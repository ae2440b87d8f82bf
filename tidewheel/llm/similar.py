"""Links between similar sets from posting lists of their signatures, without all pairs of a list.

Each set (class id, signature) is posted under some coordinate-value pairs such that similar sets share one.  First every
member of a list is held against the list's head, the member with most copies, by counting the coordinates in which their
signatures agree; what agrees often enough is confirmed on the full sets, and confirmed links make components.  Only lists that
still hold several components are looked at again: members that agree enough with one of another component are told
by their signatures, and only those meet, with their full sets, in one task that yields the links which connect
components.  So each pair that shares a key and agrees enough is either confirmed or already connected, and no list yields
more links than it has members.  There a pair is looked at in the list of its first common coordinates alone.  Lists over
LIST_LIMIT members are cut into pairs of blocks, the longest after a division by further coordinates: work is spread, none
is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash
from .components import components

LIST_LIMIT = 4_096
#: Lists of so many members are divided by further coordinates before they are cut into blocks.
DIVISION = 65_536
#: Shingles that one task holds at a time when it compares full sets; longer lists are cut into blocks.
MEMBER_LIMIT = 1_000_000
#: Groups over which the pairs of one head are dealt.
GROUPS = 256
#: Odd multipliers that mix the words of a shingle, and those of the signature's coordinates.
_rng = np.random.default_rng(20_011)
WORD_MIX = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
COORD_MUL = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
COORD_ADD = _rng.integers(0, 2**63, 64, dtype=np.uint64)


def shingles_of(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of n-word shingles, in order, from the words' hashes; of the whole sequence when it is shorter."""
    n = min(n, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        s = (s ^ (s >> np.uint64(29))) * WORD_MIX[0] + h[k : k + len(s)] * WORD_MIX[k + 1 & 15]
    s ^= s >> np.uint64(32)
    s *= WORD_MIX[15]
    return s ^ (s >> np.uint64(29))


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; empty without words."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(shingles_of(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), n))


def coordinates(shingles: np.ndarray, m: int) -> np.ndarray:
    """m hashes of each shingle."""
    h = (shingles[:, None] ^ COORD_ADD[:m]) * COORD_MUL[:m]
    h ^= h >> np.uint64(31)
    h *= COORD_MUL[63 : 63 - m : -1]
    return h


def signature(shingles: np.ndarray, m: int) -> bytes:
    """m minima as little-endian uint32."""
    out = np.full(m, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(out, coordinates(shingles[at : at + 4096], m).min(0), out=out)
    return (out >> np.uint64(32)).astype("<u4").tobytes()


def class_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def coordinate(sig: Column, j: int) -> Column:
    """Coordinate j of a signature, as a bigint that also names j."""
    return F.lit(j << 32) + F.conv(F.hex(F.substring(sig, 4 * j + 1, 4)), 16, 10).cast("long")


def starred(posted: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of a list's head and another member that agree in at least so many coordinates, with their places."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(batch.num_rows, -1) for k in (4, 5))
                yield batch.select([0, 1, 2, 3]).filter(pa.array((x == y).sum(1) >= least))

    rows = posted.where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b"), F.col("head_at").alias("a_at"), F.col("at").alias("b_at"), "head_sig", "sig")
    kind = posted.schema["at"].dataType.simpleString()
    return rows.mapInArrow(run, f"a long, b long, a_at {kind}, b_at {kind}").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) with 100 * intersection >= percent * union, on the full sets (cid, members).

    The pairs of one a are dealt over GROUPS groups, and its set goes to each group once: a hot a neither meets all its
    partners in one task nor travels with each of them.  Rows stream through; a task holds one set of a and one batch.
    """
    own = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(GROUPS)).cast("int").alias("salt"), F.col("b").alias("cid"))
    heads = own.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("cid"))
    rows = own.unionByName(heads).join(sets, "cid").select("a", "salt", (F.col("cid") != F.col("a")).alias("second"), F.col("cid").alias("b"), "members")

    def run(batches):
        a, mine = None, np.empty(0, np.uint64)
        for batch in batches:
            ok = []
            for head, second, members in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                x = np.frombuffer(members.as_buffer(), np.uint64)
                if not second:
                    a, mine = head, x.copy()
                    ok.append(False)
                    continue
                both = len(np.intersect1d(mine, x, assume_unique=True)) if a == head else 0
                ok.append(a == head and 100 * both >= percent * (len(mine) + len(x) - both))
            yield batch.select([0, 3]).filter(pa.array(ok, pa.bool_()))

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "second", "b").mapInArrow(run, "a long, b long").distinct()


def by_list(lists: DataFrame, each: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """each applied to the rows of every key, of bounded number."""
    kinds = dict(part.split() for part in schema.split(", "))
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def batch_of(out):
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    out += each(rows) if len(rows) > 1 else []
                    key, rows = row[0], []
                rows.append(row)
            yield batch_of(out)
            out = []
        yield batch_of(each(rows) if len(rows) > 1 else [])

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


class Open:
    """Which later members of a list may be linked to one of them and are not connected with it."""

    def __init__(self, rows: list[tuple], least: int):
        """rows: (key, path, cid, root, sig, ...)"""
        self.path, self.least = rows[0][1], least
        self.root = np.unique(np.array([r[3] for r in rows]), return_inverse=True)[1]
        self.sig = np.frombuffer(b"".join(r[4] for r in rows), "<u4").reshape(len(rows), -1)

    def after(self, i: int) -> np.ndarray:
        """Agree with i often enough, and up to the path's end in the path's coordinates only."""
        other = np.flatnonzero(self.root[i + 1 :] != self.root[i]) + i + 1
        if not len(other):
            return other
        same = self.sig[other] == self.sig[i]
        return other[(same.sum(1) >= self.least) & (same[:, : self.path[-1] + 1].sum(1) == len(self.path))]

    def connect(self, i: int, j: int) -> bool:
        """Whether i and j were apart until now."""
        if apart := self.root[i] != self.root[j]:
            self.root[self.root == self.root[j]] = self.root[i]
        return bool(apart)


def promising(rows: list[tuple], least: int) -> list[tuple]:
    """The rows of a list that may be linked to one of another component."""
    own, some = Open(rows, least), np.zeros(len(rows), bool)
    for i in range(len(rows) - 1):
        if len(found := own.after(i)):
            some[i] = some[found] = True
    return [rows[i] for i in np.flatnonzero(some)]


def connecting(rows: list[tuple], least: int, percent: int) -> list[tuple]:
    """Links (a, b) on full sets that connect the components of a list; rows end with the members."""
    own, cid = Open(rows, least), [r[2] for r in rows]
    size = np.array([len(r[-1]) // 8 for r in rows])
    begin = np.cumsum(size) - size
    place = np.unique(np.frombuffer(b"".join(r[-1] for r in rows), np.uint64), return_inverse=True)[1]
    mine, out = np.zeros(place.max() + 1, bool), []
    for i in range(len(rows) - 1):
        c = own.after(i)
        c = c[(100 * size[c] >= percent * size[i]) & (100 * size[i] >= percent * size[c])]
        if not len(c):
            continue
        here = place[begin[i] : begin[i] + size[i]]
        mine[here] = True
        start = np.cumsum(size[c]) - size[c]
        at = np.arange(int(size[c].sum())) + np.repeat(begin[c] - start, size[c])
        both = np.add.reduceat(mine[place[at]], start, dtype=np.int64)
        mine[here] = False
        for j in c[100 * both >= percent * (size[i] + size[c] - both)]:
            if own.connect(i, j):
                out.append((min(cid[i], cid[j]), max(cid[i], cid[j])))
    return out


def blocked(lists: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """The same pairs of (key, cid, ...) in lists that weigh about the limit at most: heavier ones become pairs of hashed blocks."""
    weighed = lists.groupBy("key").agg(F.sum(F.lit(1) if weight is None else weight).alias("_w"), F.count("*").alias("_n")).where("_n > 1")
    out = lists.join(weighed, "key").withColumn("_blocks", F.when(F.col("_w") <= limit, 1).otherwise(F.ceil(F.col("_w") * 2 / limit)).cast("int"))
    out = out.withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return out.withColumn("key", F.when(F.col("_blocks") == 1, F.col("key")).otherwise(pair)).select(*lists.columns)


def divided(lists: DataFrame, coords: int, least: int, limit: int, division: int, times: int = 2) -> DataFrame:
    """Lists (key, path, cid, root, sig, at, size) of several components, with their lengths n; `division` members or more are told apart by the next common coordinate, what is over the limit then by blocks.

    A pair with `least` agreements has its k-th one among the first coords - least + k coordinates.
    """
    small, over = lists.where(F.col("n") <= limit).drop("n"), lists.where(F.col("n") > limit)
    if over.isEmpty():
        return small
    middle, large = over.where(F.col("n") < division).drop("n"), over.where(F.col("n") >= division).drop("n")
    if large.isEmpty():
        return small.unionByName(blocked(middle, limit))
    for k in range(1, times + 1):
        large = large.withColumn("next", F.explode(F.sequence(F.element_at("path", -1) + 1, F.lit(coords - least + k))))
        large = large.withColumn("path", F.concat("path", F.array("next"))).withColumn("key", F.expr("xxhash64(key, next, substring(sig, 4 * next + 1, 4))")).drop("next")
        mixed = large.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        large = stash(large.join(mixed.select("key", "n"), "key"))
        small, large = small.unionByName(large.where(F.col("n") <= limit).drop("n")), large.where(F.col("n") > limit).drop("n")
    return small.unionByName(blocked(middle.unionByName(large), limit))


def posted_lists(sketches: DataFrame, keys: Column) -> DataFrame:
    """key, cid, sig, at, size, n, head, head_at, head_sig: the members of every list with several, beside the one with most copies."""
    posts = sketches.select(F.explode(keys).alias("key"), "cid", "sig", "at", "size", "copies")
    top = F.max(F.struct("copies", "cid", "at", "sig")).alias("top")
    heads = posts.groupBy("key").agg(top, F.count("*").alias("n")).where("n > 1")
    heads = heads.select("key", "n", F.col("top.cid").alias("head"), F.col("top.at").alias("head_at"), F.col("top.sig").alias("head_sig"))
    return posts.drop("copies").join(heads, "key")


def mixed_lists(posted: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the lists that hold several components, with root."""
    named = posted.where("n > 2").join(found.select(F.col("node").alias("cid"), "root"), "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    open_keys = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return named.join(open_keys, "key", "left_semi")


def ends_of(pairs: DataFrame) -> DataFrame:
    """The distinct places of both ends."""
    return pairs.select(F.col("a_at").alias("at")).unionByName(pairs.select(F.col("b_at").alias("at"))).distinct()


def roots(sketches: DataFrame, fetch: Callable[[DataFrame], DataFrame], *, coords: int, least: int, percent: int, limit: int = LIST_LIMIT, division: int = DIVISION, member_limit: int = MEMBER_LIMIT) -> DataFrame:
    """(node, root) of all classes linked to another one.

    sketches: one row per class, (cid, sig, copies, size of the set, at: where to find it).  fetch: places (at) -> the
    full sets (cid, members) found there, a row per class.  least: of the coords coordinates, how many must agree.
    percent: of the union that must be shared.
    """
    prefix = F.array(*[coordinate(F.col("sig"), j) for j in range(coords - least + 1)])
    posted = stash(posted_lists(sketches, prefix))
    first = stash(starred(posted, least))
    links = stash(confirm(first, fetch(ends_of(first)), percent))
    found = components(links)
    path = F.array(F.shiftright("key", 32).cast("int")).alias("path")
    rest = stash(mixed_lists(posted, found).select("key", path, "cid", "root", "sig", "at", "size", "n"))
    discard(posted, first)
    kind = sketches.schema["at"].dataType.simpleString()
    schema = f"key long, path array<int>, cid long, root long, sig binary, at {kind}, size long"
    some = stash(by_list(divided(rest, coords, least, limit, division), lambda rows: promising(rows, least), schema))
    if some.isEmpty():
        discard(rest, some, links)
        return found
    lists = blocked(some, member_limit, F.col("size")).drop("size", "at")
    full = lists.join(fetch(some.select("at").distinct()), "cid").select("key", "path", "cid", "root", "sig", "members")
    more = stash(by_list(full, lambda rows: connecting(rows, least, percent), "a long, b long"))
    out = found if more.isEmpty() else components(links.unionByName(more))
    discard(rest, some, links, more, *([found] if out is not found else []))
    return out
