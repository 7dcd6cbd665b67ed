"""Exact quantiles of large columns: repeated histograms on an order-preserving 64-bit image of the number.

A pass counts, for every wanted rank, the next 16 bits of the image among the rows that share the bits known so far.  What
moves are at most 65536 counts a rank, whatever the number of rows or of distinct values.  Once a rank's bin has few rows,
their values are read and the rank is picked.  Ranks are found where the counts lie: the driver gets a row a rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

BITS = 16
#: A bin of at most so many rows is read.
FEW = 2048
#: Rows that a task counts at a time.
READ = 1 << 20
_TOP = np.uint64(1 << 63)


def image(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; -0 is 0 and NaN comes last."""
    b = (x + 0.0).view(np.uint64)
    return np.where(b & _TOP, ~b, b | _TOP)


def value(image_of: int) -> float:
    b = image_of & ~(1 << 63) if image_of >> 63 else ~image_of & (2**64 - 1)
    return float(np.array([b], np.uint64).view(np.float64)[0])


def _joined(batches: Iterator[pa.RecordBatch]):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= READ:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _batches(batches: Iterator[pa.RecordBatch]):
    """(group, column number, images) of every group and column of about READ rows: counts of more rows at a time are fewer rows."""
    for b in _joined(batches):
        if b.num_rows:
            names = b.column(0).dictionary_encode("encode")
            slot = names.indices.to_numpy()
            col = b.column(1).to_numpy()
            im = image(b.column(2).to_numpy(zero_copy_only=False))
            for i, g in enumerate(names.dictionary.to_pylist()):
                for c in np.unique(col[slot == i]).tolist():
                    yield g, c, im[(slot == i) & (col == c)]


#: (group, column, prefix) with the ranks looked for among its rows.
Ranks = dict[tuple, set[int]]


def _at(x: DataFrame, ranks: Ranks, below: Column, count: Column, name: str) -> list:
    """The rows of x (g, c, p, ..) that hold a wanted rank: those with ``below`` rows before them and ``count`` of their own; only these move to the driver."""
    wanted = x.sparkSession.createDataFrame([(g, c, p, k) for (g, c, p), ks in ranks.items() for k in ks], "wg string, wc int, wp string, k long")
    found = x.withColumn("_below", below).withColumn("_own", count)
    same = F.col("g").eqNullSafe(F.col("wg")) & (F.col("c") == F.col("wc")) & (F.col("p") == F.col("wp"))
    # a row a rank: few
    return found.join(F.broadcast(wanted), same & (F.col("_below") <= F.col("k")) & (F.col("k") < F.col("_below") + F.col("_own"))).select("g", "c", "p", "k", name, "_below", "_own").collect()


def _histogram(x: DataFrame, ranks: Ranks, bits: int) -> dict[tuple, tuple[int, int, int]]:
    """For each (group, column, prefix of ``bits`` bits, rank): the next BITS bits of its row, the rows of the prefix below that bin, and in it."""
    known: dict[tuple, set[int]] = {}
    for g, c, p in ranks:
        known.setdefault((g, c), set()).add(int(p))

    def run(batches):
        for g, c, im in _batches(batches):
            head = im >> np.uint64(64 - bits) if bits else np.zeros(len(im), np.uint64)
            for p in known.get((g, c), ()):
                part = im[head == np.uint64(p)]
                n = np.bincount((part << np.uint64(bits) >> np.uint64(64 - BITS)).astype(np.int64))
                v = np.flatnonzero(n)
                n = n[v]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(v), pa.string()), pa.array([c] * len(v), pa.int32()), pa.array([str(p)] * len(v), pa.string()), pa.array(v.astype(np.int64)), pa.array(n)], ["g", "c", "p", "b", "n"])

    h = x.mapInArrow(run, "g string, c int, p string, b long, n long").groupBy("g", "c", "p", "b").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "c", "p").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))  # 65536 rows at most
    return {(r["g"], r["c"], r["p"], r["k"]): (r["b"], r["_below"], r["_own"]) for r in _at(h, ranks, upto - F.col("n"), F.col("n"), "b")}


def _values(x: DataFrame, bins: dict[tuple, set[tuple[int, int]]], ranks: Ranks) -> dict[tuple, float]:
    """The value at each (group, column, prefix/bits, rank)."""

    def run(batches):
        for g, c, im in _batches(batches):
            for p, bits in bins.get((g, c), ()):
                part = im[im >> np.uint64(64 - bits) == np.uint64(p)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(part), pa.string()), pa.array([c] * len(part), pa.int32()), pa.array([f"{p}/{bits}"] * len(part), pa.string()), pa.array((part ^ _TOP).view(np.int64))], ["g", "c", "p", "v"])

    rows = x.mapInArrow(run, "g string, c int, p string, v long")
    number = F.row_number().over(Window.partitionBy("g", "c", "p").orderBy("v")).cast("long") - 1  # FEW rows at most
    return {(r["g"], r["c"], r["p"], r["k"]): value(r["v"] + (1 << 63)) for r in _at(rows, ranks, number, F.lit(1), "v")}


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: str | None = None) -> list[dict]:
    """A row a group (one without ``by``): the group and, under each name, the (column, q) quantile by linear interpolation.

    Nulls are left out; the quantile of no values is None.  ``by`` has few groups (a report's); it comes back as a string.
    """
    columns = sorted({c for c, _ in wanted.values()})
    pairs = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))
    group = F.col(by).cast("string") if by else F.lit("")
    x = stored(df.select(group.alias("g"), F.explode(pairs).alias("p")).where("p.v IS NOT NULL").select("g", "p.c", "p.v"), "values")
    size = {(r["g"], r["c"]): r["count"] for r in x.groupBy("g", "c").count().collect()}
    groups = {g: None for g, _ in size}
    if by is None:
        groups = {"": None}
    else:
        groups |= {r["g"]: None for r in df.select(group.alias("g")).distinct().collect()}
    # open ranks of each group and column: rank -> (prefix, bits, rank among the rows of the prefix)
    open_: dict[tuple, tuple[int, int, int]] = {}
    for g in groups:
        for c, q in wanted.values():
            n = size.get((g, columns.index(c)), 0)
            if n:
                at = (n - 1) * q
                for k in {math.floor(at), math.ceil(at)}:
                    open_[g, columns.index(c), k] = (0, 0, k)
    found: dict[tuple, float] = {}
    small: dict[tuple, tuple[int, int, int]] = {}
    bits = 0
    while open_:
        ranks: Ranks = {}
        for (g, c, _), (p, _, rank) in open_.items():
            ranks.setdefault((g, c, str(p)), set()).add(rank)
        seen, going = _histogram(x, ranks, bits), {}
        for (g, c, k), (p, _, rank) in open_.items():
            b, below, n = seen[g, c, str(p), rank]
            now = (p << BITS | b, bits + BITS, rank - below)
            if bits + BITS == 64:
                found[g, c, k] = value(now[0])
            elif n <= FEW:
                small[g, c, k] = now
            else:
                going[g, c, k] = now
        open_, bits = going, bits + BITS
    if small:
        bins: dict[tuple, set] = {}
        ranks = {}
        for (g, c, _), (p, b, rank) in small.items():
            bins.setdefault((g, c), set()).add((p, b))
            ranks.setdefault((g, c, f"{p}/{b}"), set()).add(rank)
        values = _values(x, bins, ranks)
        for (g, c, k), (p, b, rank) in small.items():
            found[g, c, k] = values[g, c, f"{p}/{b}", rank]

    def one(g, c: str, q: float) -> float | None:
        i = columns.index(c)
        n = size.get((g, i), 0)
        if not n:
            return None
        at = (n - 1) * q
        lo, hi = math.floor(at), math.ceil(at)
        a, b = found[g, i, lo], found[g, i, hi]
        return a if lo == hi else (hi - at) * a + (at - lo) * b

    return [{**({by: g} if by else {}), **{name: one(g, c, q) for name, (c, q) in wanted.items()}} for g in groups]


def quantile_table(df: DataFrame, wanted: dict[str, tuple[str, float]], by: str | None = None) -> DataFrame:
    """``quantiles`` as a small table, to be joined to a report."""
    rows = quantiles(df, wanted, by)
    schema = ", ".join([*([f"`{by}` string"] if by else []), *(f"`{n}` double" for n in wanted)])
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], schema)
