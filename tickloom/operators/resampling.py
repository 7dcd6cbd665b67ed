"""Deterministic resampling: bootstrap, permutation and shuffles from hashes.

A draw is a function of the seed, the iteration and the row's key, so a lost task redraws the same rows and any engine can
repeat it.  A bootstrap is a weight for each iteration and row, summed where the rows lie.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ordered import PIECE, deepest_fall


#: Chances of at most 0, 1, 2, ... draws of a row (Poisson with mean 1), as parts of 2 ** 32.
DRAWN = [int(x * 2**32) for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])]
#: Factors of the 32-bit mixer (the finalizer of MurmurHash3, fixed values) and the step between iterations.
MIX = (0x85EBCA6B, 0xC2B2AE35)
STEP = 0x9E3779B9
#: Random numbers held at a time: few enough to stay near the processor.
_CELLS = 1 << 17
#: Edges between the numbers of draws of a row; all rows are compared with the first few, those beyond are looked up.
_EDGES = np.array([t for t in DRAWN if t < 1 << 32], np.uint32)
_COMMON = 4


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((16, MIX[0]), (13, MIX[1])):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h ^ (h >> np.uint32(16))


def keyed(keys: np.ndarray, seed: int) -> np.ndarray:
    """32 bits from the seed and each key, which every iteration goes on from."""
    with np.errstate(over="ignore"):
        k = keys.astype(np.int64).view(np.uint64)
        return _mixed(((k ^ (k >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ np.uint32(seed))


def _halfway(k: np.ndarray, it: int, space: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The hashes of one iteration before their last step, which leaves the upper 16 bits as they are."""
    h, u = space or (np.empty_like(k), np.empty_like(k))
    np.add(k, np.uint32(it * STEP & 0xFFFFFFFF), out=h)
    for shift, factor in ((16, MIX[0]), (13, MIX[1])):
        np.right_shift(h, np.uint32(shift), out=u)
        np.bitwise_xor(h, u, out=h)
        np.multiply(h, np.uint32(factor), out=h)
    return h


def turned(k: np.ndarray, it: int) -> np.ndarray:
    """The hashes of one iteration."""
    h = _halfway(k, it)
    return np.bitwise_xor(h, h >> np.uint32(16), out=h)


def draws(keys: np.ndarray, iters: np.ndarray, seed: int) -> np.ndarray:
    """[iteration, key]: 32 bits from the seed and both numbers."""
    h = np.add.outer((np.asarray(iters).astype(np.int64) * STEP & 0xFFFFFFFF).astype(np.uint32), keyed(keys, seed))
    u = np.empty_like(h)
    for shift, factor in ((16, MIX[0]), (13, MIX[1])):
        np.right_shift(h, np.uint32(shift), out=u)
        np.bitwise_xor(h, u, out=h)
        np.multiply(h, np.uint32(factor), out=h)
    np.right_shift(h, np.uint32(16), out=u)
    return np.bitwise_xor(h, u, out=h)


def _weights(keys: np.ndarray, iters: np.ndarray, seed: int, chance: np.ndarray | None) -> np.ndarray:
    h = draws(keys, iters, seed)
    if chance is not None:
        return (h < chance * 2**32).astype(np.float64)
    w = (h >= _EDGES[0]).view(np.uint8)
    for e in _EDGES[1:_COMMON]:
        np.add(w, (h >= e).view(np.uint8), out=w)
    often = np.flatnonzero(h >= _EDGES[_COMMON])
    w.ravel()[often] = np.searchsorted(_EDGES, h.ravel()[often], "right")
    return w.astype(np.float64)


def resampled_sums(df: DataFrame, key: str, values: dict[str, Column], iterations: int, seed: int = 42, by: str | None = None, chance: str | None = None) -> DataFrame:
    """(by, iter, one sum a value): weighted sums of each iteration; null values add nothing.

    How often an iteration draws a row is Poisson with mean 1, from a hash of seed, iteration and key: a bootstrap that needs no
    row numbers, no join and no shuffle of draws.  All values of a row are drawn together, and rows with one key too.  With
    ``chance`` a row is drawn once or not at all, with the chance in that column (a draw without replacement whose size
    is n on average).  Tasks give out sums for each group and iteration alone, so what moves does not grow with the rows.
    """
    group = F.col(by) if by else F.lit("")
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), (F.col(chance) if chance else F.lit(None)).cast("double").alias("p"), group.alias("_g"), *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in values.items()))
    labels, width, drawn = list(values), len(values), chance is not None

    def run(batches):
        sums: dict = {}
        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            keys, first, at = np.unique(b.column(0).to_numpy(), return_index=True, return_inverse=True)
            p = b.column(1).to_numpy(zero_copy_only=False)[first] if drawn else None
            names = b.column(2).dictionary_encode("encode")
            kind, slots = b.column(2).type, names.indices.to_numpy()
            x = np.zeros((len(keys), len(names.dictionary), width))
            np.add.at(x, (at, slots), np.stack([b.column(3 + j).to_numpy() for j in range(width)], axis=1))
            step = max(1, _CELLS // len(keys))
            s = np.concatenate([_weights(keys, np.arange(i, min(i + step, iterations)), seed, p) @ x.reshape(len(keys), -1) for i in range(0, iterations, step)]).reshape(iterations, -1, width)
            for j, name in enumerate(names.dictionary.to_pylist()):
                sums[name] = sums[name] + s[:, j] if name in sums else s[:, j]
        for name, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * iterations, kind), pa.array(np.arange(iterations, dtype=np.int32)), *(pa.array(np.ascontiguousarray(s[:, j])) for j in range(width))], ["_g", "iter", *labels])

    schema = f"_g {rows.schema['_g'].dataType.simpleString()}, iter int, " + ", ".join(f"{n} double" for n in labels)
    s = rows.mapInArrow(run, schema).groupBy("_g", "iter").agg(*(F.sum(n).alias(n) for n in labels))
    return s.withColumnRenamed("_g", by) if by else s.drop("_g")


def sign_flips(long: DataFrame, key: str, iterations: int, seed: int = 42) -> DataFrame:
    """(cond, sign_flip) of rows (key, target, cond): the share of bootstrap means without the sign of the mean; a mean of 0 is negative."""
    rows = long.where("target is not null")
    s = resampled_sums(rows, key, {"s": F.col("target")}, iterations, seed, by="cond")
    seen = rows.groupBy("cond").agg(F.avg("target").alias("obs"))
    return s.join(F.broadcast(seen), "cond").groupBy("cond").agg(F.avg(((F.col("s") > 0) != (F.col("obs") > 0)).cast("int")).alias("sign_flip"))


def condition_sums(df: DataFrame, key: str, value: str, masks: str, conds: list[int], iterations: int, seed: int = 42) -> DataFrame:
    """(cond, iter, s): ``resampled_sums`` of a value for each of the conditions; ``masks`` has the list of those that a row meets.

    Rows that meet the same conditions lie side by side and are summed together, then a sum is given to each of their conditions: a
    row costs the same whatever the number of conditions.
    """
    x = df.where(F.col(value).isNotNull()).select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.col(value).cast("double").alias("v"), F.col(masks).alias("m"))
    rows = stored(x.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, "m", "k").sortWithinPartitions("m"), "values")
    known = np.array(sorted(conds))

    def run(batches):
        sums = np.zeros((iterations, len(known)))
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            member = np.zeros((b.num_rows, len(known)), bool)
            at, j = np.repeat(np.arange(b.num_rows), np.diff(ends)), np.minimum(np.searchsorted(known, flat), len(known) - 1)
            good = known[j] == flat
            member[at[good], j[good]] = True
            packed = np.packbits(member, axis=1)
            _, first, kind = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
            step = max(1, _CELLS // b.num_rows)
            if len(first) < len(known):
                values, of = np.zeros((b.num_rows, len(first))), member[first].astype(float)
                values[np.arange(b.num_rows), kind] = b.column(1).to_numpy()
            else:  # more sets than conditions
                values, of = member * b.column(1).to_numpy()[:, None], None
            keys = b.column(0).to_numpy()
            for i in range(0, iterations, step):
                drawn = _weights(keys, np.arange(i, min(i + step, iterations)), seed, None) @ values
                sums[i : i + step] += drawn if of is None else drawn @ of
        for j, c in enumerate(known.tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([c] * iterations, pa.int32()), pa.array(np.arange(iterations, dtype=np.int32)), pa.array(np.ascontiguousarray(sums[:, j]))], ["cond", "iter", "s"])

    return rows.mapInArrow(run, "cond int, iter int, s double").groupBy("cond", "iter").agg(F.sum("s").alias("s"))


#: Rows that a task holds at a time (about 50 bytes each at its peak).
BUCKET_ROWS = 1 << 23


def _table(files: list[str], rows: int = 1 << 20):
    """Batches of a stored table, read where the task runs."""
    for f in files:
        fs, path = pyarrow.fs.FileSystem.from_uri(f)
        with fs.open_input_file(path) as handle:
            yield from pq.ParquetFile(handle).iter_batches(rows)


def _fall(h: np.ndarray, v: np.ndarray) -> list[float]:
    """Sum, highest and lowest prefix and deepest fall of the values in order of hash, then value."""
    at = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    at.sort()
    order, h = (at & np.uint64(0xFFFFFFFF)).astype(np.int64), at >> np.uint64(32)
    same = np.flatnonzero(h[1:] == h[:-1])
    if len(same):
        tied = np.union1d(same, same + 1)
        order[tied] = order[tied][np.lexsort((v[order[tied]], h[tied]))]
    s = np.cumsum(v[order])
    return [s[-1], s.max(), s.min(), (np.maximum.accumulate(s) - s).max()]


def permuted_drawdown(df: DataFrame, value: str, key: str, iterations: int, seed: int = 42, by: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(by, iter, max_dd): drawdown of the cumulated value in an order of its own for each iteration: by hash, then value.

    The rows of an iteration do not move: the table is written once (key's hash and value, 12 bytes a row), and tasks take
    iterations and buckets of hashes, read the table and keep the rows of their bucket, bucket_rows at most on average.  A
    bucket is folded to its sum, highest and lowest prefix and deepest fall, and only these states are shuffled and combined in
    order.  A table of one bucket is read once a task; of B buckets, B times an iteration.  Null values count as 0.
    """
    spark = df.sparkSession
    group = F.col(by) if by else F.lit("")
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), group.alias("_g"))
    kind = rows.schema["_g"].dataType.simpleString()

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keyed(b.column(0).to_numpy(), seed).view(np.int32)), b.column(1), b.column(2)], ["h", "v", "_g"])

    rows = stored(rows.mapInArrow(hashed, f"h int, v double, _g {kind}"), "values")
    files = rows.inputFiles()
    names = [r["_g"] for r in rows.select("_g").distinct().collect()]  # a report's groups: few
    buckets = max(1, math.ceil(rows.count() / bucket_rows))

    def read():
        for b in _table(files):
            if b.num_rows:
                d = b.column(2).dictionary_encode("encode")
                code = np.array([names.index(g) for g in d.dictionary.to_pylist()])
                yield b.column(0).to_numpy().view(np.uint32), b.column(1).to_numpy(), code[d.indices.to_numpy()] if by else None

    def joined(parts):
        parts = list(parts)
        return [np.concatenate([p[j] for p in parts]) if parts[0][j] is not None else None for j in range(3)]

    def run(batches):
        whole = joined(read()) if buckets == 1 else None
        for batch in batches:
            for spec in batch.column(0).to_pylist():
                it, bucket = divmod(spec, buckets)
                if whole:
                    h, v, g = turned(whole[0], it), *whole[1:]
                else:
                    low, high = (bucket << 32) // buckets, (bucket + 1 << 32) // buckets - 1
                    kept = []
                    for k, x, c in read():
                        t = turned(k, it)
                        m = np.flatnonzero((t >= np.uint32(low)) & (t <= np.uint32(high)))
                        kept.append((t[m], x[m], c[m] if by else None))
                    h, v, g = joined(kept)
                out = []
                for i in range(len(names)):
                    m = slice(None) if g is None else np.flatnonzero(g == i)
                    if len(v[m]):
                        out.append((i, it, bucket, *map(float, _fall(h[m], v[m]))))
                cols = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 3 + [pa.float64()] * 4, strict=True)], ["_at", "iter", PIECE, "_sum", "_high", "_low", "_fall"])

    count = iterations * buckets if names else 0
    specs = spark.range(0, count, 1, max(1, min(count, 4 * spark.sparkContext.defaultParallelism)))
    state = specs.mapInArrow(run, f"_at int, iter int, {PIECE} int, _sum double, _high double, _low double, _fall double")
    found = spark.createDataFrame(list(enumerate(names)), f"_at int, _g {kind}")
    out = deepest_fall(state, ["_at", "iter"]).join(F.broadcast(found), "_at").select("_g", "iter", "max_dd")
    return out.withColumnRenamed("_g", by) if by else out.drop("_g")


#: Parts of a window of hashes that one pass of a selection tells apart, and rows of a part that are read.
PARTS, READ = 64, 1024
#: Draws (of a condition in an iteration) that are counted at a time: a task holds two counts a part of each.
DRAWS = 200_000
#: Windows begin and end at multiples of 2 ** STEP_BITS; rows that a task sorts by their conditions, and counts, at a time.
STEP_BITS, BLOCK, SLICE = 16, 1 << 20, 1 << 16
_TOP = 32 - STEP_BITS


class _Block:
    """Rows (key, value, numbers of their conditions) in the order of the sets of conditions that they meet.

    What a draw asks of a block are counts and sums below an edge for each condition.  They are made for each set of conditions and
    stretch between edges, in one pass over the rows whatever the number of conditions, and put together from there.
    """

    def __init__(self, held: list[pa.RecordBatch], conds: list[int], seed: int):
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t.column(2).combine_chunks()
        flat = np.searchsorted(conds, lists.flatten().to_numpy())
        known = np.array(conds)[np.minimum(flat, len(conds) - 1)] == lists.flatten().to_numpy()
        at = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        member = np.zeros((t.num_rows, -(-len(conds) // 64) * 64), bool)
        member[at[known], flat[known]] = True
        packed = np.packbits(member, axis=1)
        _, first, kind = np.unique(packed.view(np.uint64 if packed.shape[1] == 8 else f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
        keys, values = t.column(0).to_numpy(), t.column(1).to_numpy()
        order = np.lexsort((values > 0, kind))
        self._fill(keys[order], values[order], kind[order].astype(np.intp), member[first, : len(conds)], keyed(keys[order], seed))

    def _fill(self, keys: np.ndarray, values: np.ndarray, kind: np.ndarray, sets: np.ndarray, start: np.ndarray) -> None:
        self.keys, self.values, self.kind, self.start, self._sets = keys, values, kind, start, sets
        self.won = (values > 0).astype(np.intp)
        self._in, self._out = sets.T.astype(float), 1.0 - sets.T  # [condition, set]
        self._tables: dict = {}
        self._space = np.empty_like(start), np.empty_like(start)  # used again in each iteration
        self._head, self._slot = np.empty(len(kind), np.intp), np.empty(len(kind), np.intp)
        self._pairs = np.nonzero(sets.T)  # (condition, set) of a set in a condition
        some = sets.any(axis=1)
        self._none = int(np.argmax(some[kind])) if some.any() else len(kind)  # rows before it are in no condition
        # numbers of the conditions of a set, filled up with one beyond all: [place, set]
        most = sets.sum(axis=1)
        self._lists = np.where(np.arange(max(1, most.max())) < most[:, None], np.argsort(~sets, axis=1, kind="stable")[:, : max(1, most.max())], sets.shape[1]).T
        # conditions as bits, 32 a word
        bits = [(sets[:, w : w + 32] << np.arange(min(32, sets.shape[1] - w), dtype=np.uint32)).sum(axis=1, dtype=np.uint32)[kind] for w in range(0, sets.shape[1], 32)]
        self._bits = [~x for x in bits], bits

    def cut(self, rows: int):
        """The block in slices that stay near the processor, each with its own few sets of conditions."""
        for a in range(0, len(self.keys), rows):
            found, n = self.kind[a : a + rows], min(rows, len(self.keys) - a)
            low, high = found[0], found[-1] + 1
            at = a + np.argsort(np.arange(n) % max(1, n // 8), kind="stable")  # rows of unlike sets side by side
            x = _Block.__new__(_Block)
            x._fill(self.keys[at], self.values[at], self.kind[at] - low, self._sets[low:high], self.start[at])
            yield x

    def heads(self, it: int) -> np.ndarray:
        h, u = self._space
        np.right_shift(_halfway(self.start, it, (h, u)), np.uint32(STEP_BITS), out=u)
        self._head[:] = u
        return self._head

    def _kept(self, name: str, make: Callable, *edges: np.ndarray):
        """What ``make`` builds of the edges, kept while they stay the same, as they do for all iterations of a first pass."""
        key = b"".join(e.tobytes() for e in edges)
        if self._tables.get(name, (None,))[0] != key:
            self._tables[name] = key, make(*edges)
        return self._tables[name][1]

    def every(self, head: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The number of rows with a head under each edge."""
        table, place, size = self._kept("every", _stretches, edges)
        return np.cumsum(np.bincount(np.take(table, head, mode="clip", out=self._slot), minlength=size))[place]

    def before(self, head: np.ndarray, edges: np.ndarray, inside: bool) -> list[np.ndarray]:
        """For each condition the number of the rows in it (or not in it) with a head under its edge; of those not in it also the wins and the sum."""
        table, place, size = self._kept("before", _stretches, edges)
        skip = self._none if inside else 0
        slot = np.take(table, head[skip:], mode="clip", out=self._slot[skip:])
        of = self._in if inside else self._out

        def each(x: np.ndarray) -> np.ndarray:
            return np.cumsum(of @ x.reshape(-1, size).astype(float), axis=1)[np.arange(len(edges)), place]

        slot += self._kept("rise", lambda _: self.kind * size, np.array(size))[skip:]
        cells = of.shape[1] * size
        if inside:
            return [each(np.bincount(slot, minlength=cells))]
        total = np.bincount(slot, self.values, cells)
        slot += self.won * cells
        n = np.bincount(slot, minlength=2 * cells).reshape(2, cells)
        return [each(n[0] + n[1]), each(n[1]), each(total)]

    def within(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        """(condition, row) of the rows in a condition (or not in it) whose head lies in its window."""
        found, skip = [], self._none if inside else 0
        for w, mine in enumerate(self._bits[inside]):
            bits = np.uint32(1) << np.arange(min(32, len(low) - 32 * w), dtype=np.uint32)
            hit = np.take(self._kept(f"within {w}", _windows, low[32 * w : 32 * w + 32], high[32 * w : 32 * w + 32]), head[skip:], mode="clip", out=self._space[0][skip:])
            np.bitwise_and(hit, mine[skip:], out=hit)
            i = np.flatnonzero(hit != 0)
            j, k = np.nonzero(hit[i] & bits[:, None])
            found.append((j + 32 * w, i[k] + skip))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def met(self, head: np.ndarray, places: _Places) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of every row, and the rows that lie in the window of a condition."""
        stretch = np.take(places.stretch, head, mode="clip")
        return stretch, np.flatnonzero(stretch >= places.free)

    def under(self, stretch: np.ndarray, places: _Places) -> np.ndarray:
        """[number, wins or sum; condition] of the rows not in a condition that lie under its window."""
        sets, size = self._in.shape[1], places.size
        if len(self._lists) * len(self.kind) < 2 * sets * size:  # rows of many sets: one by one for each of their conditions
            at, c, first, won, values = self._kept("pairs", lambda: self._by_condition())
            below = np.take(self._head, at) < self._kept("low", lambda low: low[c], places.low)
            mine = np.zeros((3, len(self._in)))
            if len(at):
                mine[:, c[first]] = [np.add.reduceat(x, first) for x in (below.astype(np.int32), (below & won).astype(np.int32), values * below)]
            upto = np.zeros((3, size + 1))
            upto[:, 1:] = np.cumsum(np.stack([np.bincount(stretch, w, size) for w in (None, self.won, self.values)])[:, places.by_start], axis=1)
            return upto[:, places.at_low] - mine
        lanes = 1 if sets > 8 else 8  # rows side by side that fall into one cell wait for each other
        rise = self._kept("cells", lambda _: ((np.arange(len(self.kind)) % lanes * sets + self.kind) * 2 + self.won) * size, np.array(size))
        slot, cells = np.add(rise, stretch, out=self._slot), 2 * sets * size
        n = np.bincount(slot, minlength=lanes * cells).reshape(lanes, cells).sum(axis=0).reshape(sets, 2, size).astype(float)
        total = np.bincount(slot, self.values, lanes * cells).reshape(lanes, cells).sum(axis=0).reshape(sets, 2, size).sum(axis=1)
        n[:, 0] += n[:, 1]
        # all rows under the window of a condition, less those of the sets in it
        upto = np.zeros((3, sets + 1, size + 1))
        upto[:2, :-1, 1:], upto[2, :-1, 1:] = n.transpose(1, 0, 2)[:, :, places.by_start], total[:, places.by_start]
        np.cumsum(upto, axis=2, out=upto)
        upto[:, -1] = upto.sum(axis=1)
        c, s = self._pairs
        found = upto[:, s, places.at_low[c]]
        return upto[:, -1, places.at_low] - np.stack([np.bincount(c, x, len(self._in)) for x in found])

    def _by_condition(self) -> tuple[np.ndarray, ...]:
        """(row, condition) of each row and each of its conditions, those of a condition together, where each condition begins, and the rows' wins and values."""
        found = self._lists[:, self.kind]
        at = np.nonzero((found < len(self._in)).ravel())[0]
        c, row = found.ravel()[at], at % len(self.kind)
        order = np.argsort(c, kind="stable")
        c = c[order]
        row = row[order]
        return row, c, np.flatnonzero(np.diff(c, prepend=-1)), self.won[row] > 0, self.values[row]

    def inside(self, head: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(condition, row) of those of the given rows, with these heads, that are in a condition and in its window."""
        found = self._lists[:, self.kind[rows]]
        low, high = np.append(low, 0), np.append(high, 0)
        j, k = np.nonzero((head >= low[found]) & (head < high[found]))
        return found[j, k], rows[k]

    def last(self, head: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(condition, row) of those of the given few rows that are not in a condition but in its window."""
        j, k = np.nonzero((head >= low[:, None]) & (head < high[:, None]) & (self._out[:, self.kind[rows]] > 0))
        return j, rows[k]


class _Places:
    """Windows of heads about the expected places of the last rows drawn, the same in all iterations, each of PARTS parts."""

    def __init__(self, low: np.ndarray, step: np.ndarray):
        edges = np.minimum(low[:, None] + step[:, None] * np.arange(PARTS + 1), 1 << _TOP)
        self.low, self.high, self.step = low, edges[:, -1], step
        table, u = _bins(np.concatenate([low, self.high]))
        start = np.concatenate([[0], u])
        covered = ((start[:, None] >= low) & (start[:, None] < self.high)).any(axis=1)
        order = np.argsort(covered, kind="stable")  # stretches in no window have the first numbers
        self.free, self.size = int((~covered).sum()), len(start)
        self.stretch = np.argsort(order)[table].astype(np.min_scalar_type(len(start)))
        self.by_start, self.at_low = np.argsort(order), (start < low[:, None]).sum(axis=1)  # stretches by place, and how many lie under each window
        part, self.edge, self.parts = _stretches(edges)
        self.part = part.astype(np.int32)

    def chosen(self, part: np.ndarray) -> np.ndarray:
        """Whether a bin between edges belongs to one of the parts, one a condition."""
        c = np.arange(len(part))
        begin, end = (np.bincount(self.edge[c, part + x] + 1, minlength=self.parts + 1) for x in (0, 1))
        return np.cumsum(begin - end)[: self.parts] > 0


def _bins(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each head of a hash (its upper _TOP bits) the number of its bin between the sorted distinct edges; and those edges."""
    u = np.unique(np.clip(edges, 0, 1 << _TOP))
    return np.repeat(np.arange(len(u) + 1), np.diff(np.concatenate([[0], u, [1 << _TOP]]))), u


def _stretches(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The bins of all heads, the last bin under each edge, and the number of bins."""
    table, u = _bins(edges)
    return table, np.searchsorted(u, np.minimum(edges, 1 << _TOP)), len(u) + 1


def _windows(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each head a bit for every window that it lies in."""
    table = np.zeros(1 << _TOP, np.uint32)
    for j, (a, z) in enumerate(zip(low, high, strict=True)):
        table[a:z] |= np.uint32(1 << j)
    return table


def subset_sums(df: DataFrame, key: str, value: str, masks: str, sizes: dict[int, int], total: int, iterations: int, seed: int = 42) -> DataFrame:
    """(cond, iter, s, wins): sum of values and number of positive ones of ``sizes[c]`` rows drawn without replacement from those not in c.

    ``masks`` is the column with the list of the conditions c that a row meets; rows without a value take no part; ``total``
    rows do.  An iteration orders all rows by hash, then key, and a condition's draw is the first of its complement: the
    size is exact.  The last row drawn is found by counting hashes in a window about its expected place, for all conditions
    and iterations in one pass; the window is narrowed to one part of PARTS in each pass, until the parts are so small
    that their rows are read.  A row's hash is looked up in one table of all windows' edges and counted for its set of conditions, so
    a row costs the same whatever the number of conditions.  The first windows are the same in all iterations: what lies under
    them is summed in the first pass, and later ones look at the rows in a window alone.  Only counts, sums and the rows of one
    part a draw move.  Many conditions take their iterations in blocks of DRAWS draws, each with its own passes.
    """
    conds = sorted(sizes)
    want = np.array([sizes[c] for c in conds], np.int64)
    rest = np.array([total - sizes[c] for c in conds], np.int64)
    if (want >= rest).any() or not conds:
        raise ValueError("a draw needs more rows outside the condition than in it")
    # rows that meet the same conditions side by side, a large set in several pieces
    x = df.where(F.col(value).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(value).cast("double").alias("v"), F.col(masks).alias("m"))
    rows = stored(x.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, "m", "k"), "values")
    at_once = max(1, DRAWS // len(conds))
    parts = [_subset_sums(rows, conds, want, rest, min(at_once, iterations - i), i, seed) for i in range(0, iterations, at_once)]
    return reduce(DataFrame.unionByName, parts)


def _subset_sums(rows: DataFrame, conds: list[int], want: np.ndarray, rest: np.ndarray, iterations: int, begin: int, seed: int) -> DataFrame:
    """``subset_sums`` of the iterations from ``begin`` on."""
    held_rows = max(SLICE, BLOCK * 64 // (-(-len(conds) // 64) * 64))
    share = want / rest
    spread = 8 * np.sqrt(want * (1 - share)) + 8
    # windows in heads of hashes, PARTS parts of whole heads each
    heads = float(1 << _TOP)
    first = np.floor(np.maximum(0, (want - spread) / rest) * heads).astype(np.int64)
    width = -(-(np.ceil(np.minimum(1, (want + spread) / rest) * heads).astype(np.int64) - first) // PARTS) * PARTS
    lo, part_of = np.repeat(first[:, None], iterations, 1), np.repeat(width[:, None] // PARTS, iterations, 1)

    def blocks(batches):
        """Blocks of about BLOCK rows, those that meet the same conditions side by side."""
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
                if n >= held_rows:
                    yield from _Block(held, conds, seed).cut(SLICE)
                    held, n = [], 0
        if held:
            yield from _Block(held, conds, seed).cut(SLICE)

    places, shares = _Places(lo[:, 0], part_of[:, 0]), [f"p{q}" for q in range(PARTS)]

    def first_counts(batches):
        """Counts and sums under the first windows, and the counts in their parts."""
        under = np.zeros((iterations, 3, len(conds)))
        every, mine = np.zeros((iterations, places.parts), np.int32), np.zeros((iterations, len(conds) * PARTS), np.int32)
        for b in blocks(batches):
            for it in range(iterations):
                head = b.heads(begin + it)
                stretch, at = b.met(head, places)
                under[it] += b.under(stretch, places)
                near = head[at]
                every[it] += np.bincount(places.part[near], minlength=places.parts).astype(np.int32)
                # of the rows in a condition those inside of its window are told apart
                j, i = b.inside(near, at, places.low, places.high)
                mine[it] += np.bincount((head[i] - places.low[j]) // places.step[j] + PARTS * j, minlength=PARTS * len(conds)).astype(np.int32)
        every = np.cumsum(every, axis=1)
        for j, c in enumerate(conds):
            parts = np.diff(every[:, places.edge[j]], axis=1) - mine[:, PARTS * j : PARTS * j + PARTS]
            yield pa.RecordBatch.from_arrays([pa.array([c] * iterations, pa.int32()), pa.array(np.arange(iterations, dtype=np.int32)), *(pa.array(np.ascontiguousarray(under[:, q, j])) for q in range(3)), *(pa.array(parts[:, q].astype(np.int64)) for q in range(PARTS))], ["cond", "iter", "n", "wins", "s", *shares])

    def gathered(got: DataFrame) -> list[np.ndarray]:
        """[condition, iteration] each: rows below the window, in it, the part with the last row drawn, rows in that part."""

        def run(batches):
            for x in batches:
                goal = want[np.searchsorted(conds, x.column(0).to_numpy())]
                below, parts = x.column(2).to_numpy(), np.stack([x.column(3 + q).to_numpy() for q in range(PARTS)], axis=1)
                part = (below[:, None] + np.cumsum(parts, axis=1) < goal[:, None]).sum(axis=1).clip(0, PARTS - 1)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), pa.array(parts.sum(axis=1)), pa.array(part), pa.array(np.take_along_axis(parts, part[:, None], 1)[:, 0])], ["c", "i", "b", "w", "part", "size"])

        x = got.mapInArrow(run, "c int, i int, b long, w long, part long, size long").toPandas().sort_values(["c", "i"])
        return [x[n].to_numpy().reshape(len(conds), iterations) for n in ("b", "w", "part", "size")]

    def counts(low: np.ndarray, size: np.ndarray):
        def run(batches):
            below, parts = np.zeros((len(conds), iterations), np.int64), np.zeros((len(conds), iterations, PARTS), np.int32)
            for b in blocks(batches):
                for it in range(iterations):
                    lo_, step = low[:, it], size[:, it]
                    edges = np.minimum(lo_[:, None] + step[:, None] * np.arange(PARTS + 1), 1 << _TOP)
                    head = b.heads(begin + it)
                    every = b.every(head, edges)
                    below[:, it] += every[:, 0] - b.before(head, lo_, inside=True)[0].astype(np.int64)
                    # of the rows in a condition those inside of its window are told apart
                    j, rows_ = b.within(head, lo_, edges[:, -1], inside=True)
                    mine = np.bincount((head[rows_] - lo_[j]) // step[j] + PARTS * j, minlength=PARTS * len(conds)).reshape(len(conds), PARTS)
                    parts[:, it] += (np.diff(every, axis=1) - mine).astype(np.int32)
            for j, c in enumerate(conds):
                yield pa.RecordBatch.from_arrays([pa.array([c] * iterations, pa.int32()), pa.array(np.arange(iterations, dtype=np.int32)), pa.array(below[j]), *(pa.array(parts[j, :, q].astype(np.int64)) for q in range(PARTS))], ["c", "i", "b", *shares])

        return gathered(rows.mapInArrow(run, "c int, i int, " + ", ".join(f"{n} long" for n in ["b", *shares])).groupBy("c", "i").agg(*(F.sum(n).alias(n) for n in ["b", *shares])))

    got = rows.mapInArrow(first_counts, "cond int, iter int, n double, wins double, s double, " + ", ".join(f"{n} long" for n in shares)).groupBy("cond", "iter")
    got = stored(got.agg(*(F.sum(n).alias(n) for n in ["n", "wins", "s", *shares])), "counts")  # read by the driver, and again as sums
    below, inside, part, size = gathered(got.select(F.col("cond").alias("c"), F.col("iter").alias("i"), F.col("n").cast("long").alias("b"), *shares))
    narrowed = False
    while True:
        # windows that miss the place (a chance under 1e-14 a draw) are opened to all hashes
        miss = (below > want[:, None] - 1) | (below + inside < want[:, None])
        lo, wide = np.where(miss, 0, lo + part * part_of), np.where(miss, 1 << _TOP, part_of)
        if not miss.any() and ((size <= READ) | (wide == 1)).all():
            break
        narrowed, part_of = True, -(-wide // PARTS)
        below, inside, part, size = counts(lo, part_of)
    hi, which = lo + wide, np.arange(len(conds))

    def draw(batches):
        sums = np.zeros((len(conds), iterations, 3))
        held: list[tuple] = []

        def given():
            q, it, h, k, v = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.array(conds, np.int32)[q]), pa.array(it), pa.array(h.astype(np.int64)), pa.array(k), pa.array(np.ones(len(q))), pa.array(v), pa.array((v > 0).astype(float))], names)

        for b in blocks(batches):
            waiting = 0
            for it in range(iterations):
                head = b.heads(begin + it)
                if narrowed:
                    n, wins, total_ = b.before(head, lo[:, it], inside=False)
                    q, i = b.within(head, lo[:, it], hi[:, it], inside=False)
                else:  # what lies under the first windows is summed
                    at = b.met(head, places)[1]
                    near = head[at]
                    bins = places.part[near]
                    j, i = b.inside(near, at, places.low, lo[:, it])
                    every = np.cumsum([np.bincount(bins, w, places.parts) for w in (None, b.won[at], b.values[at])], axis=1)
                    mine = [np.bincount(j, w, len(conds)) for w in (None, b.won[i], b.values[i])]
                    n, wins, total_ = every[:, places.edge[which, part[:, it]]] - every[:, places.edge[:, 0]] - mine
                    few = np.flatnonzero(places.chosen(part[:, it])[bins])
                    q, i = b.last(near[few], at[few], lo[:, it], hi[:, it])
                sums[:, it] += np.stack([n, total_, wins], axis=1)
                held.append((q, np.full(len(i), it, np.int32), turned(b.start[i], begin + it), b.keys[i], b.values[i]))
                waiting += len(i)
                if waiting > BLOCK:
                    yield given()
                    held, waiting = [], 0
            if held:
                yield given()
                held = []
        for j, c in enumerate(conds):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(iterations, c, np.int32)), pa.array(np.arange(iterations, dtype=np.int32)), pa.nulls(iterations, pa.int64()), pa.nulls(iterations, pa.int64()), *(pa.array(np.ascontiguousarray(sums[j, :, q])) for q in range(3))], names)

    names = ["cond", "iter", "h", "k", "n", "s", "wins"]
    x = stored(rows.mapInArrow(draw, "cond int, iter int, h long, k long, n double, s double, wins double"), "drawn")  # read twice
    sure = x.where("h IS NULL").select("cond", "iter", *names[4:])
    if not narrowed:
        sure = sure.unionByName(got.select(*sure.columns))
    sure = sure.groupBy("cond", "iter").agg(*(F.sum(n).alias(n) for n in names[4:]))
    goal = rows.sparkSession.createDataFrame(list(zip(conds, want.tolist(), strict=True)), "cond int, size long")
    edge = x.where("h IS NOT NULL").withColumn("at", F.row_number().over(Window.partitionBy("cond", "iter").orderBy("h", "k"))).join(sure.select("cond", "iter", F.col("n").alias("have")), ["cond", "iter"]).join(F.broadcast(goal), "cond").where("have + at <= size")
    return sure.unionByName(edge.select(*sure.columns)).groupBy("cond", (F.col("iter") + begin).alias("iter")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("wins").alias("wins"))
