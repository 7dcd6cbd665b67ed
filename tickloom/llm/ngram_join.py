"""Exact n-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct k-word shingles, as 64-bit hashes.  Two sets link when
``den * |A & B| >= num * |A | B|``.  Sets are banded by size so that linking sets meet in a band; linking sets of a
band differ in at most K features, K known for the band.  The feature domain is cut into n1 * n2 equal ranges.  At
most K // (k2 + 1) of the n1 first-level ranges hold more than k2 differences; in every other one at least one choice
of n2 - k2 of its n2 subranges holds the same features in both sets.  One signature is made for each such subset.

n1 is K // (k2 + 1) + 1 + slack, so linking sets share at least slack + 1 signatures, and each set may leave out up to
slack of its own, as long as all sets leave them out in one and the same order: first those of no or one feature,
which most unlike sets would share, then those that most sets have (the longest groups, once counted).  No link is
lost; a set with more signatures of no feature than slack keeps them all.

Steps, all linear in the input and the number of links between different texts but for the last:

1. members: each document's set id (hash of the set), size, and a sketch of its features: for each of 256 ranges their
   number and a byte of hash, which bounds the number of differences from below.  Equal sets are one node from here
   on, whatever their number.
2. signatures are dealt out in packed blocks, some six bytes each, and unpacked a bounded number at a time.  Sets of a
   block that share a signature are sent on as one, so a signature that a third of all rows have costs a row for each
   block and not for each document.
3. each shared signature gives a star of candidate pairs (node, smallest node), not all pairs.  The sketches rule out
   most, ``den * inter >= num * union`` is computed on the sets of the others.  Components of the links follow.
4. nodes of a group (those with one signature) that the stars left in different components still have to be ruled out.
   Groups of equal members are looked at once.  Long groups get further stars around other nodes first; what is then
   left is compared by sketch in blocks of bounded size, twice.  The first time each block gives out a forest: of the
   pairs that the sketches can't rule out only those that, taken in an order that differs by block, join two of its
   components; fewer rows than members.  These are computed as in 3, and most components join up.  The second time the
   blocks that still hold several components give out all such pairs, so no link is lost.  A long group of sets that
   are all nearly, but not quite, similar enough therefore costs the square of its length in comparisons of sketches,
   and in rows where the sketches can't tell.

Sets are sent along for candidates only.  The list of candidates is broadcast when its counted size is small, and
joined by shuffle otherwise.

Empty texts and nulls have the empty set and link with nothing.  A text of fewer than k words has its whole sequence
as its one shingle.  Repeated rows and equal texts are in one component.  Other columns are not read, whatever their
names; an empty table gives an empty result.  Of equal candidates for a component's id there is only one: the smallest
key, where nulls count as larger than any.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb, sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkern as K
from .common import bounded, discard, fresh, map_texts, quoted, table, written
from .components import components

#: Ranges of a sketch; counts stop at 255, which keeps differences lower bounds.
BINS = 256
#: Signatures in a partition; their number follows the input, up to MOST_PARTITIONS.
PARTITION_SIGNATURES = 2_000_000
MOST_PARTITIONS = 100_000
#: Signatures of a partition that are unpacked at a time.
TURN = 1_000_000
#: Most candidate rows that are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Members of a block in which groups are compared.
BLOCK = 2048
#: Further stars for groups longer than a block.
ROUNDS = 2
#: Members from which a group counts as common, so that its nodes may leave its signature out.
COMMON = 32
#: Features that a signature should cover on average.
COVER = 2.5
#: Rows of a record batch that is given to Spark.
ROWS = 1 << 16


class Scheme:
    """Bands and their PartEnum parameters for a threshold num/den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.num, self.den = num, den
        self.tops: list[int] = []

    def band(self, n: int) -> int:
        while not self.tops or self.tops[-1] < n:
            low = self.tops[-1] + 1 if self.tops else 1
            self.tops.append(max(low, low * self.den * self.den // (self.num * self.num)))
        return int(np.searchsorted(self.tops, n))

    def differences(self, band: int) -> int:
        """Most features in which linking sets of the band differ: |A ^ B| <= (den - num) / (den + num) * (|A| + |B|)."""
        return (self.den - self.num) * 2 * self.tops[band] // (self.den + self.num)

    def bands_of(self, n: int) -> list[int]:
        """Its own band, and the next if a linking set can be in it; bands without room for a difference are left out."""
        own = self.band(n)
        found = [own]
        if n * self.den // self.num > self.tops[own]:
            self.band(self.tops[own] + 1)
            found.append(own + 1)
        return [b for b in found if self.differences(b)]

    @cache  # noqa: B019  one object for each task
    def parameters(self, band: int) -> tuple[int, int, int, int]:
        """(n1, n2, k2, slack) with few signatures that cover COVER features each, or not much less.

        slack is what sets of the band's least size have of signatures without features, on average and beyond; where
        no slack is enough for that, such signatures, which most unlike sets share, count as twenty.
        """
        k, size = self.differences(band), (self.tops[band - 1] + 1 if band else 1)
        least = max(1, size * self.num // self.den)
        best = None
        for k2 in range(min(7, k + 1)):
            for n2 in range(k2 + 1, k2 + 6):
                for slack in range(k + 5):
                    n1 = k // (k2 + 1) + 1 + slack
                    share, all_ = (n2 - k2) / (n1 * n2), n1 * comb(n2, k2)
                    if all_ > max(300, 4 * k):
                        break
                    bare = all_ * (1 - share) ** least
                    enough = bare < 0.02 or bare + 2 * sqrt(bare) + 1 <= slack
                    if enough or not slack:
                        cost = all_ * (1 if enough else 1 + 20 * bare) * (1 + 4 * max(0.0, min(COVER, least / 2) - least * share))
                        if best is None or cost < best[0]:
                            best = (cost, (n1, n2, k2, slack))
                    if enough:
                        break
        return best[1]

    @cache  # noqa: B019
    def layout(self, band: int) -> tuple[np.ndarray, np.ndarray]:
        """The subsets as a 0/1 matrix, and a salt for each signature."""
        n1, n2, k2, _ = self.parameters(band)
        subsets = np.array([[j in s for j in range(n2)] for s in combinations(range(n2), n2 - k2)], np.uint64)
        return subsets, K.mix(np.arange(n1 * len(subsets), dtype=np.uint64) + np.uint64((band + 1) << 40))

    def signatures(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sets (sorted, one after another in flat, of sizes n): their signatures, the set of each, and what each set has left of slack.

        The lowest bit of a signature is that of its band; what is left is given for even and for odd bands.
        """
        sigs, owner, left = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], np.zeros((len(n), 2), np.int32)
        mixed, begin = K.mix(flat), np.concatenate([[0], np.cumsum(n)])
        by_band: dict[int, list[int]] = {}
        for i, size in enumerate(n.tolist()):
            for band in self.bands_of(size) if size else ():
                by_band.setdefault(band, []).append(i)
        for band, sets in by_band.items():
            n1, n2, _, slack = self.parameters(band)
            subsets, salt = self.layout(band)
            parts, step = n1 * n2, max(1, (1 << 19) // len(salt))
            for at in range(0, len(sets), step):
                own = np.array(sets[at : at + step])
                size = n[own]
                take = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                cell = np.repeat(np.arange(len(own)) * parts, size) + _scaled(flat[take], parts)
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                total, count = np.zeros(len(own) * parts, np.uint64), np.zeros(len(own) * parts, np.uint64)
                with np.errstate(over="ignore"):
                    total[cell[first]] = np.add.reduceat(mixed[take], first)
                    count[cell[first]] = np.diff(np.append(first, len(cell)))
                    sig = K.mix((total.reshape(-1, n2) @ subsets.T).reshape(len(own), -1) ^ salt)
                held = (count.reshape(-1, n2) @ subsets.T).reshape(len(own), -1)
                none, few = (held == 0).sum(axis=1), (held <= 1).sum(axis=1)
                lowest = np.where(few <= slack, 2, np.where(none <= slack, 1, 0)).astype(np.uint64)
                left[own, band & 1] = np.where(few <= slack, slack - few, 0)
                row, col = np.nonzero(held >= lowest[:, None])
                sigs.append(sig[row, col] & ~np.uint64(1) | np.uint64(band & 1))
                owner.append(own[row])
        return np.concatenate(sigs), np.concatenate(owner), left


def _scaled(x: np.ndarray, parts: int) -> np.ndarray:
    """floor(x * parts / 2^64): which of as many equal ranges x is in."""
    m, half = np.uint64(parts), np.uint64(32)
    return (((x >> half) * m + (((x & np.uint64(0xFFFFFFFF)) * m) >> half)) >> half).astype(np.int64)


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of all rows' sets one after another, and the sets' sizes."""
    sets = [s for c in K.chunks(texts) for s in c.words(K.SPACE, lower=True).sets(k)]
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def _set_ids(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit ids of the sets; that of the empty set has no meaning."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = np.concatenate([[0], np.cumsum(n)[:-1]])[full]
        with np.errstate(over="ignore"):
            a, b = np.add.reduceat(K.mix(flat), at), np.bitwise_xor.reduceat(K.mix(flat + np.uint64(0x9E3779B97F4A7C15)), at)
            out[full] = K.mix((a ^ b) + n[full].astype(np.uint64))
    return out.view(np.int64)


def _sketches(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of 2 * BINS bytes for each set: how many features each range has, up to 255, and a byte of hash of them."""
    cell = np.repeat(np.arange(len(n)) * BINS, n) + _scaled(flat, BINS)
    count = np.bincount(cell, minlength=len(n) * BINS).reshape(-1, BINS)
    hashed = np.bincount(cell, (K.mix(flat ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(255)).astype(np.float64), len(n) * BINS).reshape(-1, BINS)
    return np.concatenate([np.minimum(count, 255), hashed.astype(np.int64) & 255], axis=1).astype(np.uint8)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the number of features in which the sets of sketches x and y (rows by pair) differ."""
    a, b = x[:, :BINS], y[:, :BINS]
    same = a == b
    counts = np.where(same, 0, np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)
    other = same & (x[:, BINS:] != y[:, BINS:])
    # Equal counts and other features: one at least on either side, but for counts that were cut.
    return counts + 2 * other.sum(axis=1) - (other & (a == 255)).sum(axis=1)


def _members(docs: DataFrame, key: str, text: str, k: int, scheme: tuple[int, int]) -> DataFrame:
    fields = [T.StructField(x, kind) for x, kind in (("node", T.LongType()), ("n", T.LongType()), ("n_sigs", T.LongType()), ("even", T.IntegerType()), ("odd", T.IntegerType()), ("sketch", T.BinaryType()))]

    def make():
        own = Scheme(*scheme)

        def run(texts: pa.Array) -> list[pa.Array]:
            out = []
            for c in K.chunks(texts):
                sets = c.words(K.SPACE, lower=True).sets(k)
                flat, n = np.concatenate([np.empty(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)
                _, owner, left = own.signatures(flat, n)
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BINS), len(n), [None, pa.py_buffer(_sketches(flat, n))])
                ids = pa.array(_set_ids(flat, n), mask=n == 0)
                out.append([ids, pa.array(n), pa.array(np.bincount(owner, minlength=len(n))), pa.array(left[:, 0]), pa.array(left[:, 1]), sketch.cast(pa.binary())])
            return [pa.concat_arrays(x) for x in zip(*out, strict=True)] or [pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())]

        return run

    return map_texts(docs, key, text, fields, make)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: planes of zeros cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(sig: np.ndarray, node: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted signatures as differences, the distinct nodes, and for each signature its node's place."""
    names, at = np.unique(node, return_inverse=True)
    return _planes(np.diff(sig, prepend=np.uint64(0))), names.tobytes(), _planes(at.astype(np.uint32))


def _unpacked(sigs: bytes, nodes: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumsum(_unplaned(sigs, np.uint64), dtype=np.uint64), np.frombuffer(nodes, np.int64)[_unplaned(at, np.uint32)]


def _sorted(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, node) sorted, and for each the place where its signature's run starts."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    starts = np.flatnonzero(head)
    return sig, node, np.repeat(starts, np.diff(np.append(starts, len(sig))))


def _batches(columns: list[np.ndarray], names: list[str]):
    """Record batches of bounded length of equal columns."""
    for i in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + ROWS]) for x in columns], names)


_BLOCKS = "part int, local boolean, sigs binary, nodes binary, at binary"
_GROUPS = "sig bigint, node bigint, leader bigint"


def _shared(docs: DataFrame, text: str, k: int, scheme: tuple[int, int], parts: int) -> DataFrame:
    """(sig, node, leader) of signatures that two or more nodes share; leader is the smallest node, in all or in a block."""

    def block(batches):
        own = Scheme(*scheme)
        for b in batches:
            sigs, nodes = [], []
            for c in K.chunks(b.column(0)):
                sets = c.words(K.SPACE, lower=True).sets(k)
                flat, n = np.concatenate([np.empty(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)
                sig, owner, _ = own.signatures(flat, n)
                sigs.append(sig)
                nodes.append(_set_ids(flat, n)[owner])
            sig, node, start = _sorted(np.concatenate([np.empty(0, np.uint64), *sigs]), np.concatenate([np.empty(0, np.int64), *nodes]))
            del sigs, nodes
            if not len(sig):
                continue
            lead = start == np.arange(len(sig))
            shared = ~lead
            shared[start[~lead]] = True
            # What is shared inside the block is settled here and dealt out by block, whole runs together.
            for local, pick in ((False, lead), (True, shared)):
                s, x = sig[pick], node[pick]
                to = _scaled(K.mix(s ^ sig[:1]) if local else s, parts)
                order = np.argsort(to, kind="stable")
                s, x, to = s[order], x[order], to[order]
                cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else to
                ends = np.append(cut[1:], len(to))
                for at in range(0, len(cut), 256):
                    spans = list(zip(cut[at : at + 256].tolist(), ends[at : at + 256].tolist(), strict=True))
                    cols = list(zip(*(_packed(s[i:j], x[i:j]) for i, j in spans), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(to[[i for i, _ in spans]].astype(np.int32)), pa.array([local] * len(spans)), *(pa.array(c, pa.binary()) for c in cols)], ["part", "local", "sigs", "nodes", "at"])

    def settle(batches):
        """Rows of signatures that several nodes have; blocks stay packed, and are read in as many turns as keep each small."""
        held, total = [], 0
        for b in batches:
            for local, *packed in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if local:
                    sig, node, start = _sorted(*_unpacked(*packed))
                    yield from _batches([sig.view(np.int64), node, node[start]], ["sig", "node", "leader"])
                else:
                    held.append(packed)
                    total += len(_unplaned(packed[0], np.uint64))
        turns = -(-total // TURN)
        for turn in range(turns):
            some = []
            for packed in held:
                sig, node = _unpacked(*packed)
                own = _scaled(K.mix(sig), turns) == turn
                some.append((sig[own], node[own]))
            sig, node, start = _sorted(*(np.concatenate(x) for x in zip(*some, strict=True)))
            del some
            out = np.bincount(start, minlength=len(sig))[start] > 1
            yield from _batches([sig[out].view(np.int64), node[out], node[start][out]], ["sig", "node", "leader"])
            K.trim()

    blocks = bounded(docs).select(F.col(quoted(text)).cast("string").alias("t")).mapInArrow(block, _BLOCKS)
    return blocks.repartitionById(parts, F.col("part")).select("part", "local", "sigs", "nodes", "at").mapInArrow(settle, _GROUPS)


def _feature_sets(docs: DataFrame, key: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(node, s) of the wanted nodes, from one document each; wanted has (node, k)."""
    n = wanted.count()
    w = wanted.select(F.col("k").alias("wk"), F.col("node").alias("wn"))
    source = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).cast("string").alias("t"))
    found = source.join(F.broadcast(w) if n <= BROADCAST_ROWS else w, F.col("k").eqNullSafe(F.col("wk"))).select("wn", "t")

    def run(batches):
        for b in batches:
            flat, n = _sets(b.column(1), k)
            # A key that several rows share may have other texts too.
            own = (_set_ids(flat, n) == b.column(0).to_numpy()) & (n > 0)
            flat, n = flat[np.repeat(own, n)], n[own]
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(own)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], ["node", "s"])

    return bounded(found).mapInArrow(run, "node bigint, s array<bigint>")


def _verified(docs: DataFrame, key: str, text: str, k: int, num: int, den: int, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, with |A & B| and |A | B|; Spark splits a join whose key many pairs have."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    wanted = written(reps.join(ends, "node", "left_semi").select("node", "k"))
    sets = _feature_sets(docs, key, text, k, wanted).dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = both.select("a", "b", inter.alias("inter"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return written(both.select("a", "b", "inter", (F.col("total") - F.col("inter")).alias("union")).where(F.lit(den) * F.col("inter") >= F.lit(num) * F.col("union")))


def _not_ruled_out(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    side = nodes.select("node", "n", "sketch")
    p = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xa")), "a").join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("xb")), "b")
    p = p.where(F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")).select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "xa", "xb")

    def run(batches):
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint8).reshape(-1, 2 * BINS) for i in (3, 4))
            keep = pa.array((den + num) * _apart(a, b) <= (den - num) * x.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), x.column(1).filter(keep)], ["a", "b"])

    return bounded(p).mapInArrow(run, "a bigint, b bigint")


def _groups(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sig, node) without the signatures of common groups that a node may leave out, the most common first."""
    groups = shared.select("sig", "node").distinct()
    common = groups.groupBy("sig").agg(F.count("*").alias("m")).where(F.col("m") >= COMMON)
    groups = written(groups.join(common, "sig", "left"))
    odd = F.col("sig").bitwiseAND(F.lit(1))
    g = groups.where("m is not null").join(nodes.select("node", "even", "odd"), "node")
    g = g.select("sig", "node", "m", odd.alias("which"), F.when(odd == 1, F.col("odd")).otherwise(F.col("even")).alias("left")).where("left > 0")
    # Of equally common ones all or none.
    upto = Window.partitionBy("node", "which").orderBy(F.desc("m")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = g.withColumn("rank", F.count("*").over(upto)).where("rank <= left").select("sig", "node")
    return groups.join(out, ["sig", "node"], "left_anti").select("sig", "node")


def _open_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, node, label, m) of groups with several components, pairs included, as nodes may have left a group; groups of equal members once."""
    g = groups.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
    mixed = g.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("i")).where("x != y and m > 1")
    return g.join(mixed.groupBy("m", "h", "i").agg(F.min("sig").alias("sig")).select("sig", "m"), "sig")


def _joining(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, taken in turn, those that join two trees; root, the tree of each place, follows."""
    kept = []
    for at, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        if root[i] != root[j]:
            root[root == root[j]] = root[i]
            kept.append(at)
    pick = np.array(kept, np.int64)
    return x[pick], y[pick]


def _open_pairs(groups: DataFrame, nodes: DataFrame, num: int, den: int, parts: int, forest: bool = False) -> DataFrame:
    """Pairs of a group, of different components, that size and sketch can't rule out; groups come in blocks.

    With ``forest`` a block gives only those that join two of its components, fewer than it has members.
    """
    g = groups.join(nodes.select("node", "n", "sketch"), "node").withColumn("parts", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int"))
    g = g.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    g = g.select(F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") <= F.col("other")).alias("low"), (F.col("own") >= F.col("other")).alias("high"), "node", "label", "n", "sketch")

    def survivors(root, x, y, low, high, node, label, n, sketch):
        """Of pairs of places (x, y): the nodes of those that nothing rules out, nor a forest leaves out."""
        ok = (label[x] != label[y]) & ((low[x] & high[y]) | (low[y] & high[x])) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        for at in range(0, len(x), 4096):
            i, j = x[at : at + 4096], y[at : at + 4096]
            if forest:
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
            keep = (den + num) * _apart(sketch[i], sketch[j]) <= (den - num) * (n[i] + n[j])
            i, j = _joining(root, i[keep], j[keep]) if forest else (i[keep], j[keep])
            i, j = node[i], node[j]
            yield from _batches([np.minimum(i, j), np.maximum(i, j)], ["a", "b"])

    def short(root, cell, *rest):
        """Groups of few members: all pairs, by their distance in the table."""
        i = np.arange(len(cell))
        for d in range(1, len(cell)):
            i = i[: np.searchsorted(i, len(cell) - d)]
            i = i[cell[i] == cell[i + d]]
            if not len(i):
                return
            yield from survivors(root, i, i + d, *rest)

    def long(root, low, high, node, label, n, sketch):
        """A group of many members: products of matrices count the ranges in which two sketches agree, by three bits of each; every other range holds a difference."""
        code = (K.mix(sketch[:, :BINS].astype(np.uint64) << np.uint64(8) | sketch[:, BINS:]) & np.uint64(7)).astype(np.int64) + np.arange(BINS) * 8

        def hot(rows):
            out = np.zeros((len(rows), BINS * 8), np.float32)
            np.put_along_axis(out, code[rows], 1, axis=1)
            return out

        # Members of one component lie together, so tiles within one are left out.
        order = np.argsort(root, kind="stable")
        tiles = [order[at : at + 512] for at in range(0, len(n), 512)]
        for t, rows in enumerate(tiles):
            one = hot(rows)
            for cols in tiles[t:]:
                if (root[rows] == root[cols[0]]).all() and (root[cols] == root[rows[0]]).all():
                    continue
                differ = BINS - (one @ hot(cols).T)
                i, j = np.nonzero((den + num) * differ <= (den - num) * (n[rows][:, None] + n[cols]) + 0.5)
                if rows is cols:
                    i, j = i[i < j], j[i < j]
                yield from survivors(root, rows[i], cols[j], low, high, node, label, n, sketch)

    def trees(cell, label):
        """A number for each component of each cell."""
        order = np.lexsort((label, cell))
        root = np.empty(len(cell), np.int64)
        root[order] = np.cumsum(np.concatenate([[0], (np.diff(cell[order]) != 0) | (np.diff(label[order]) != 0)])) if len(cell) else 0
        return root

    def compare(*cols):
        if not len(cols[0]):
            return
        starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        size = np.diff(np.append(starts, len(cols[0])))
        many = size > 128
        for at, m in zip(starts[many].tolist(), size[many].tolist(), strict=True):
            yield from long(trees(cols[0][at : at + m], cols[4][at : at + m]), *(x[at : at + m] for x in cols[1:]))
        few = np.repeat(~many, size)
        yield from short(trees(cols[0][few], cols[4][few]), *(x[few] for x in cols))

    def run(batches):
        held = None  # the last cell's rows, which the next batch may go on with; two blocks at most
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)] + [np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(-1, 2 * BINS)]
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            cut = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
            yield from compare(*(x[:cut] for x in cols))
            held = [x[cut:].copy() for x in cols]
        if held:
            yield from compare(*held)

    dealt = bounded(g).repartition(parts, "cell").sortWithinPartitions("cell", F.xxhash64("cell", "node"))
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: key, n_shingles, component_id (smallest key of its component) and n_links.

    ``n_links`` is the number of links that were computed for the document's set to other sets, at least one
    for each set of a component with several; it is not the number of all linking pairs.  ``key`` must not be
    named n_shingles, component_id or n_links.
    """
    if key.lower() in ("n_shingles", "component_id", "n_links"):
        raise ValueError(f"the key column can't be named {key}")
    spark = docs.sparkSession
    scheme = (num, den)
    docs = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).cast("string").alias("t"))
    members = written(_members(docs, "k", "t", k, scheme))
    nodes = written(members.where("node is not null").groupBy("node").agg(F.min("k").alias("k"), *(F.min(x).alias(x) for x in ("n", "n_sigs", "even", "odd", "sketch"))))
    total = nodes.agg(F.sum("n_sigs")).first()[0] or 0
    parts = min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PARTITION_SIGNATURES)))
    shared = written(_shared(docs, "t", k, scheme, parts))
    tried = written(shared.where("node != leader").select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct())

    def check(pairs: DataFrame) -> DataFrame:
        return _verified(docs, "k", "t", k, num, den, nodes, written(_not_ruled_out(pairs, nodes, num, den)))

    links = check(tried)
    labels = components(links)
    groups = written(_groups(shared, nodes))
    discard(shared)
    opened = written(_open_groups(groups, labels))
    for turn in range(ROUNDS):
        long = opened.where(F.col("m") > BLOCK)
        if long.isEmpty():
            break
        # The star of another node: in a group of near copies it reaches most of what the one before did not.
        heads = long.groupBy("sig").agg(F.min_by(F.struct("node", "label"), F.xxhash64(F.lit(turn), "node")).alias("head"))
        stars = long.join(heads, "sig").where("label != head.label").select(F.greatest("node", "head.node").alias("a"), F.least("node", "head.node").alias("b")).distinct()
        stars = written(stars.join(tried, ["a", "b"], "left_anti"))
        links = links.unionByName(check(stars))
        tried, labels = tried.unionByName(stars), components(links)
        opened = written(_open_groups(groups, labels))
    for forest in (True, False):
        rest = _open_pairs(opened, nodes, num, den, parts, forest).select(F.col("b").alias("a"), F.col("a").alias("b"))
        rest = written(rest.join(tried, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            links = links.unionByName(_verified(docs, "k", "t", k, num, den, nodes, rest))
            tried, labels = tried.unionByName(rest), components(links)
            opened = written(_open_groups(groups, labels)) if forest else opened
    discard(groups)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = nodes.select("node", "k").join(labels, "node", "left").select("node", "k", F.coalesce("label", "node").alias("label"))
    first = placed.groupBy("label").agg(F.min("k").alias("first"))
    placed = placed.join(first, "label").join(degree, "node", "left").select("node", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = members.select("k", "node", "n").join(placed, "node", "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("first", "k").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, that of the smallest key; all columns stay.

    Rows to drop are listed, not rows to keep: they are fewer, and no text moves while their list can be broadcast.
    Each row is judged by its own text: rows that share a key but have unlinked texts all stay.  A null key is larger
    than any other and equal to none.  Rows whose text has no words are in no component with others and stay.
    Where keys are null or repeat, rows get numbers of their own, and docs is written once to keep them.
    """
    own = F.col(quoted(key))
    if docs.groupBy(own.alias("k")).agg(F.count("*").alias("n")).where("k is null or n > 1").isEmpty():
        found = written(near_duplicates(docs, key, text, k, num, den).select(own.alias("k"), F.col("component_id").alias("c")))
        return _without(docs, key, found.where("k != c").select("k"))
    row = fresh(docs, "row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(docs, row, text, k, num, den).select(F.col(row).alias("k"), F.col("component_id").alias("c"))
    found = written(found.join(docs.select(F.col(row).alias("k"), own.alias("own")), "k"))
    stays = found.groupBy("c").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "k")).alias("m")).select("c", F.col("m.k").alias("m"))
    return _without(docs, row, found.join(stays, "c").where("k != m").select("k")).drop(row)


def _without(docs: DataFrame, key: str, drop: DataFrame) -> DataFrame:
    """docs without the rows whose key is in the one column of drop."""
    drop = drop.toDF("dropped_key")
    few = drop.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(drop) if few else drop, F.col(quoted(key)) == F.col("dropped_key"), "left_anti")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90)
    return found.select("doc_id", "n_shingles", "component_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * i >= 90 * (na + nb - i)),
l2 AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, x) AS (SELECT a, a FROM l2 UNION SELECT r.doc_id, l2.b FROM r JOIN l2 ON r.x = l2.a),
m AS (SELECT doc_id, min(x) AS x FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.x, s.doc_id)) AS component_id FROM s LEFT JOIN m USING (doc_id)
"""

QUERIES = {"op6_ngram_join": op6_ngram_join}
ORACLES = {"op6_ngram_join": SQL}
