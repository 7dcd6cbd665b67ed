"""Periodic runs of words, by a vectorised scan of all lags.

A run is a longest stretch of consecutive words with smallest period q and at
least ``min_exp`` periods.  The word ids of a text are compared with
themselves shifted by every lag up to n / min_exp, and stretches of equal
words of (min_exp - 1) * q and more are runs:

* lags below ``DENSE`` compare every word, for all texts of a chunk at once;
* a longer lag q compares every (q/4)-th word first.  A stretch as long as
  asked for holds at least 4 * (min_exp - 1) of those in a row, so none is
  missed; only where so many agree are all words around them compared.  All
  lags of a text of n words cost about n log n comparisons, not n squared.

A stretch at a multiple of a run's period is the same run and is skipped; a
stretch found first at a multiple is reduced to its smallest period through
the prime factors of the lag.

Spark deals texts of up to ``long_bytes`` to tasks as they are.  A longer text
is written once under a number of its own and dealt out as ranges of lags, each
with the text; the ranges' runs meet again by that number and equal stretches
keep the smallest period.  Both ways give the same rows.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words and no
runs.  Repeated rows give repeated results.  Runs that tie as the strongest go
to the smallest start, then period.  Columns other than key and text are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkern as K
from .common import bounded, map_texts, quoted, table, written

MIN_EXP, MIN_LENGTH = 4, 6
#: Lags below this compare every word.
DENSE = 8
#: Texts of more bytes are dealt out by ranges of lags, of LAGS lags at least and RANGES ranges at most.
LONG_BYTES, LAGS, RANGES = 1 << 18, 8192, 64


def _primes(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + [q] if q > 1 else out


class _Known:
    """Runs found so far over one array of ids: for each word, the one that reaches furthest."""

    def __init__(self, size: int):
        self.end = np.zeros(size, np.int64)
        self.which = np.zeros(size, np.int32)
        self.runs: list[tuple[int, int, int]] = []

    def has(self, start: int, end: int, q: int) -> bool:
        return self.end[start] >= end and q % self.runs[self.which[start]][2] == 0

    def add(self, start: int, end: int, q: int) -> None:
        reach = self.end[start:end]
        less = reach < end
        reach[less] = end
        self.which[start:end][less] = len(self.runs)
        self.runs.append((start, end, q))


def _smallest(ids: np.ndarray, start: int, end: int, q: int) -> int:
    """The smallest period of ids[start:end], which has the period q at least twice."""
    for r in _primes(q):
        while q % r == 0 and np.array_equal(ids[start : end - q // r], ids[start + q // r : end]):
            q //= r
    return q


def _around(ids: np.ndarray, size: int, q: int, a: int, b: int) -> tuple[int, np.ndarray]:
    """ids[i] == ids[i + q] from the mismatch before a to the mismatch after b, and where that begins."""
    step, left = 4 * q, a
    while left > 0:
        to = max(0, left - step)
        bad = np.flatnonzero(ids[to:left] != ids[to + q : left + q])
        if len(bad):
            left = to + int(bad[-1]) + 1
            break
        left, step = to, 2 * step
    step, right = 4 * q, b + 1
    while right < size - q:
        to = min(size - q, right + step)
        bad = np.flatnonzero(ids[right:to] != ids[right + q : to + q])
        if len(bad):
            right += int(bad[0])
            break
        right, step = to, 2 * step
    return left, ids[left:right] == ids[left + q : right + q]


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of at least ``least`` true values."""
    at = np.flatnonzero(equal)
    if len(at) < least:
        return at[:0], at[:0]
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1
    good = last - first >= least
    return first[good], last[good]


def find_runs(ids: np.ndarray, sizes: np.ndarray, low: int = 1, high: int | None = None, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs with a stretch at a lag of ``low`` to ``high``.

    ``ids`` holds texts one after the other, longest first, of ``sizes`` words; no id stands in two texts.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    most = int(sizes[0]) // min_exp if len(sizes) else 0
    known = _Known(int(total[-1]))
    for q in range(low, min(most, high or most) + 1):
        need = max(min_length, min_exp * q)
        size = int(total[np.searchsorted(-sizes, -need, "right")])  # the texts that are long enough
        if size <= q:
            break
        least = need - q
        if q < DENSE:
            found = zip(*(x.tolist() for x in _stretches(ids[: size - q] == ids[q:size], least)), strict=True)
        else:
            step = q // 4
            k = least // step
            at = np.flatnonzero(ids[0 : size - q : step] == ids[q:size:step])
            if len(at) < k or not np.any(at[k - 1 :] - at[: len(at) - k + 1] == k - 1):
                continue
            hit = np.zeros(int(at[-1]) + 1, bool)
            hit[at] = True
            found = _verified(ids, size, q, least, known, [(a * step, (b - 1) * step) for a, b in zip(*(x.tolist() for x in _stretches(hit, k)), strict=True)])
        for start, end in found:
            if not known.has(start, end + q, q):
                known.add(start, end + q, _smallest(ids, start, end + q, q) if low > 1 else q)
    return known.runs


def _verified(ids: np.ndarray, size: int, q: int, least: int, known: _Known, spots: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for a, b in spots:
        if known.has(a, b + q + 1, q):
            continue
        left, equal = _around(ids, size, q, a, b)
        for start, end in zip(*_stretches(equal, least), strict=True):
            yield left + int(start), left + int(end)


def _ids(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of a chunk's texts, the longest text first, the texts' sizes and their order."""
    with np.errstate(over="ignore"):
        own = K.mix(w.hash ^ K.mix(w.doc.astype(np.uint64)))
    ids = np.unique(own, return_inverse=True)[1].astype(np.int32)
    sizes = np.diff(w.bounds)
    order = np.argsort(-sizes, kind="stable")
    return np.concatenate([ids[w.bounds[i] : w.bounds[i + 1]] for i in order] or [ids]), sizes[order], order


FIELDS = [
    *(T.StructField(x, T.LongType()) for x in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")),
    T.StructField("runs_sha256", T.StringType()),
    T.StructField("collapsed_sha256", T.StringType()),
]
KINDS = [pa.int64()] * 6 + [pa.string()] * 2


def _report(text: bytes, runs: list[tuple[int, int, int]], with_text: bool) -> tuple:
    """Result columns of one text with its runs (start, end, period)."""
    words = text.split()  # at exactly the bytes 09 to 0D and 20
    runs = sorted((s, e - s, q) for s, e, q in runs)
    best = (None,) * 4
    for s, n, q in runs:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, 1000 * n // q)
    if runs:
        keep = np.ones(len(words), bool)
        for s, n, q in runs:
            keep[s + q : s + n] = False
        kept = [words[i] for i in np.flatnonzero(keep).tolist()]
    else:
        kept = words
    kept = b" ".join(kept)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    out = (len(words), len(runs), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    return (*out, kept.decode("utf-8", "replace"), [{"start": s, "length": n, "period": q} for s, n, q in runs]) if with_text else out


def _scan(texts: pa.Array, min_exp: int, min_length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    for c in K.chunks(texts):
        w = c.words(K.SPACE, lower=False)
        ids, sizes, order = _ids(w)
        first = np.concatenate([[0], np.cumsum(sizes)])
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(c.n)]
        found = find_runs(ids, sizes, min_exp=min_exp, min_length=min_length)
        if found:
            where = np.searchsorted(first, [s for s, _, _ in found], "right") - 1
            for (s, e, q), i in zip(found, where.tolist(), strict=True):
                runs[order[i]].append((s - int(first[i]), e - int(first[i]), q))
        data = c.buf.tobytes()
        for i in range(c.n):
            yield data[c.offsets[i] : c.offsets[i + 1]], runs[i]


_RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
_RUNS_ARROW = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH, long_bytes: int = LONG_BYTES, with_text: bool = True) -> DataFrame:
    """Key, n_words, n_runs, the strongest run, digests and, on request, ``collapsed_text`` (each run cut to its first period) and ``runs``.

    ``min_exp`` is the least number of periods of a run (2 or more), ``min_length`` its least number of words.
    """
    if min_exp < 2:
        raise ValueError("min_exp must be at least 2")
    fields = FIELDS + ([T.StructField("collapsed_text", T.StringType()), T.StructField("runs", _RUNS)] if with_text else [])
    kinds = KINDS + ([pa.string(), _RUNS_ARROW] if with_text else [])

    def columns(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    def make():
        return lambda texts: columns([_report(t, runs, with_text) for t, runs in _scan(texts, min_exp, min_length)])

    source = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).cast("string").alias("t"))
    is_long = F.coalesce(F.octet_length("t") > long_bytes, F.lit(False))
    out = map_texts(source.where(~is_long), "k", "t", fields, make)
    far = written(source.where(is_long).withColumn("id", F.monotonically_increasing_id()))
    if far.isEmpty():
        return out.withColumnRenamed("k", key)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                (c,) = K.chunks(one.column(1))
                ids, sizes, _ = _ids(c.words(K.SPACE, lower=False))
                runs = find_runs(ids, sizes, one.column(2)[0].as_py(), one.column(3)[0].as_py(), min_exp, min_length)
                flat = np.array(runs, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), one.column(0)[0].as_py())), *(pa.array(flat[:, j]) for j in range(3))], ["id", "s", "e", "q"])
                K.trim()

    # A text of n bytes has at most (n + 1) / 2 words, so lags up to (n + 1) / 2 / min_exp.
    lags = F.floor((F.octet_length("t") + 1) / (2 * min_exp)).cast("long")
    width = F.greatest(F.lit(LAGS), F.ceil(lags / RANGES)).cast("long")
    dealt = far.withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(lags, F.lit(1)), width))).withColumn("high", F.col("low") + width - 1)
    dealt = dealt.select("id", "t", "low", "high").repartition("id", "low")
    runs = bounded(dealt).mapInArrow(ranges, "id long, s long, e long, q long").groupBy("id", "s", "e").agg(F.min("q").alias("q"))
    # the runs of one text, fewer than its words
    runs = runs.groupBy("id").agg(F.collect_list(F.struct("s", "e", "q")).alias("r"))
    joined = far.join(runs, "id", "left").select("k", "t", "r")
    schema = T.StructType([T.StructField("k", source.schema["k"].dataType), *fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_report(t.encode(), [(x["s"], x["e"], x["q"]) for x in r or []], with_text) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns(rows)], schema.fieldNames())

    return out.unionByName(bounded(joined).mapInArrow(finish, schema)).withColumnRenamed("k", key)


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text, where of documents with crc32(key) % 10 = 0 each word i >= a becomes word a + (i - a) % p."""
    source = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).cast("string").alias("t"))
    crc = F.crc32(F.col("k").cast("string").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for h, t in zip(b.column(2).to_pylist(), b.column(1), strict=True):
                words = t.as_py().encode().split() if h is not None and h % 10 == 0 and t.is_valid else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words = words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]
                    texts.append(b" ".join(words).decode())
                else:
                    texts.append(t.as_py())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, text])

    schema = T.StructType([T.StructField(key, source.schema["k"].dataType), T.StructField(text, T.StringType())])
    return bounded(source.withColumn("h", crc)).mapInArrow(run, schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")), with_text=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


#: crc32 of a decimal number as text, and the table of its 256 steps (polynomial EDB88320).
CRC_TABLE = "(SELECT list(list_reduce([n] || range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY n) AS tab FROM range(256) r(n))"
CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {CRC.format("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents, {CRC_TABLE}),
e AS (SELECT *, len(w0) AS n, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
g AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM f),
u AS (SELECT rid, n, unnest(ws) AS w, unnest(range(n)) AS i FROM g),
m AS (SELECT x.rid, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT rid, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m) GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT rid, s, l, min(q) AS q FROM s GROUP BY rid, s, l),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY l / q::DOUBLE DESC, s, q) = 1),
said AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM r),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM u ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT g.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
 sha256(coalesce(said.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM g LEFT JOIN best USING (rid) LEFT JOIN said USING (rid) LEFT JOIN kept USING (rid)
"""

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op13_periodic_runs": SQL}
