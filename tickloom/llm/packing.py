"""Best-fit packing with exact complements.

Documents become token pieces of at most ``capacity`` tokens.  How pieces are
combined depends on their lengths alone, so the plan is made from the number
of pieces of each length: at most ``capacity`` numbers, whatever the corpus.

1. From the longest length down, the gap that a length leaves is looked up
   among the lengths, sums of pairs and sums of triples that are still
   available; a combination that fills it exactly is taken as often as its
   lengths last.  Every such step uses up a length, so there are few.
2. What is left goes best fit by decreasing length, again by counts.

The plan is a table of at most a few thousand rows (its size follows the
number of lengths, not of pieces) and is broadcast.  Pieces are numbered
within their length by salted windows and a table of offsets, then look up
their sequence and place in it.  Pieces alone move, never token ids.

A null or empty text is one piece: the end-of-document id.  Pieces of equal
length are placed by key, piece number and checksum, so that a retried task
places them alike; pieces that tie in all of these hold the same ids.  Repeated
rows are packed each; other columns are not read, whatever their names; an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textkern as K
from .common import bounded, quoted, table, written
from .token_counts import BATCH_BYTES, VOCABULARY, encoder

CAPACITY = 2048
END_ID = 0
#: Pieces of one length numbered by one window.
WINDOW_ROWS = 20_000

Runs = tuple[tuple[int, int], ...]  # (length, copies) from the start of a sequence


def _token_pieces(docs: DataFrame, key: str, text: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every piece."""
    source = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).cast("string").alias("t"))
    long = T.LongType()
    schema = T.StructType([T.StructField(key, source.schema["k"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(x, long) for x in ("start", "length", "ids_crc32"))])

    def run(batches):
        own = encoder(vocabulary, False)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for c in K.chunks(b.column(1), BATCH_BYTES):
                counts, ids = own.encode(c)
                at = 0
                for r, n in enumerate(counts.tolist()):
                    doc = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    first = len(doc) % capacity or capacity
                    cuts = [0, *range(first, len(doc) + 1, capacity)]
                    for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        row.append(c.row + r)
                        piece.append(i)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(doc[a:z].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema.names)

    return bounded(source).mapInArrow(run, schema)


class Plan:
    """Sequences as patterns of lengths, each with its number, from the number of pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a piece of {length} tokens")
            self.left[length] = n
        self.patterns: list[tuple[Runs, int]] = []
        self._exact()
        self._best_fit()

    def _take(self, lengths: list[int], most: int | None = None) -> None:
        """Use a combination as often as its lengths last."""
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(self.left[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                self.left[x] -= times * n
            self.patterns.append((tuple(sorted(need.items(), reverse=True)), times))

    def _exact(self) -> None:
        left, top = self.left, self.capacity
        for big in range(top, 0, -1):
            gap = top - big
            if left[big] and not gap:
                self._take([big])
            if left[big] and 0 < gap <= big:
                self._take([big, gap])
            if left[big] and gap >= 2:
                self._pairs(big, gap)
            if left[big] and gap >= 3:
                self._triples(big, gap)

    def _pairs(self, big: int, gap: int) -> None:
        a = np.arange((gap + 1) // 2, min(gap - 1, big) + 1)
        for x in a[(self.left[a] > 0) & (self.left[gap - a] > 0)].tolist():
            self._take([big, x, gap - x])
            if not self.left[big]:
                return

    def _triples(self, big: int, gap: int) -> None:
        have = np.flatnonzero(self.left[: min(gap - 2, big) + 1])
        for x in have[::-1][: len(have)].tolist():
            if 3 * x < gap:
                return
            rest = gap - x
            y = have[(have <= min(x, rest - 1)) & (2 * have >= rest)]
            for b in y[self.left[rest - y] > 0].tolist():
                self._take([big, x, b, rest - b])
                if not self.left[big]:
                    return

    def _best_fit(self) -> None:
        """Best fit by decreasing length; sequences with the same gap and pattern are handled together."""
        open_: dict[int, list[list]] = defaultdict(list)  # gap: [pattern, number]
        gaps = np.zeros(self.capacity + 1, np.int64)
        for x in range(self.capacity, 0, -1):
            while self.left[x]:
                fit = np.flatnonzero(gaps[x:])
                if len(fit):
                    gap = x + int(fit[0])
                    pattern, n = open_[gap].pop()
                    gaps[gap] -= n
                    copies = min(gap // x, max(1, int(self.left[x]) // n))
                    used = min(n, int(self.left[x]) // copies)
                    self.left[x] -= used * copies
                    if used < n:
                        open_[gap].append([pattern, n - used])
                        gaps[gap] += n - used
                else:
                    gap, pattern = self.capacity, ()
                    copies = min(gap // x, int(self.left[x]))
                    used = int(self.left[x]) // copies
                    self.left[x] -= used * copies
                rest = gap - copies * x
                open_[rest].append([(*pattern, (x, copies)), used])
                gaps[rest] += used
        for groups in open_.values():
            self.patterns += [(tuple(pattern), n) for pattern, n in groups]

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def rows(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first number, end, first sequence, place of the first copy, copies) for every run of every pattern."""
        out, used, sequence = [], defaultdict(int), 0
        for pattern, n in self.patterns:
            place = 0
            for length, copies in pattern:
                out.append((length, used[length], used[length] + n * copies, sequence, place, copies))
                used[length] += n * copies
                place += length * copies
            sequence += n
        return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset; one of these that has the key's name gets an underscore."""
    spark = docs.sparkSession
    own = docs.select(F.col(quoted(key)).alias("key_"), F.col(quoted(text)).cast("string").alias("text_"))
    placed = _placed(spark, written(_token_pieces(own, "key_", "text_", vocabulary, capacity, end_id)), capacity)
    return placed.toDF(key, *(f"{c}_" if c.lower() == key.lower() else c for c in placed.columns[1:]))


def _placed(spark: SparkSession, pieces: DataFrame, capacity: int) -> DataFrame:
    key = "key_"
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if not counts:
        return pieces.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    salts = -(-max(counts.values()) // WINDOW_ROWS)
    plan = spark.createDataFrame(Plan(counts, capacity).rows(), "length bigint, low bigint, high bigint, sequence bigint, place bigint, copies bigint")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(F.col(quoted(key)), "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("m"))
    before = sizes.select("length", "salt", (F.sum("m").over(Window.partitionBy("length").orderBy("salt")) - F.col("m")).alias("before"))
    numbered = salted.withColumn("i", F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.col(quoted(key)), "piece", "ids_crc32", "start")))
    numbered = numbered.join(before, ["length", "salt"]).withColumn("i", F.col("i") - 1 + F.col("before"))
    placed = numbered.join(F.broadcast(plan), "length").where("i >= low and i < high")
    index = F.expr("i - low")
    return placed.select(
        F.col(quoted(key)), "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(index / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(index, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLES: dict[str, str] = {}
