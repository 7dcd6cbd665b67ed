"""Benchmark decontamination with a positional inverted index.

The training corpus is indexed by document: every Arrow batch of documents
becomes one shard of the index, which stores for each benchmark term the
sorted positions at which the shard's documents have it.  A benchmark window
is looked up from its rarest term: that term's postings, moved back by its
offset, are the candidate places, and the postings of the window's other terms
(from rare to frequent, each moved by its own offset) are intersected with
them.  What is left are exact phrase matches; a second pass allows terms to
stand within a slop of their place and gives proximity matches.

A shard is as large as a batch and lives as long as it, so neither a frequent
term nor a large corpus makes a long posting list anywhere, and there is no
shuffle: all words of a document are in one shard.  The benchmark is the
stated query set.  It is read in blocks whose size is checked; a larger one
takes several passes over the documents, which are written once under a number
of their own and merged by it.

Null and empty texts have no words; an item without words has no window.
Items of fewer words than a window are one window.  Items that share an id
are one item with the windows of all of them; a null id is the empty string.
Repeated and null keys are rows of their own.  Columns other than key and text
are not read, whatever their names; the key may have the name of no result
column.  Without documents there are no rows, without items no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkern as K
from .common import add_columns, bounded, fresh, quoted, table, written

WINDOW = 10
#: Bytes of benchmark text looked up in one pass over the documents.
BLOCK_BYTES = 16 << 20
#: A proximity match: the three rarest terms within SLOP of their places and at most MISSING terms not.
SLOP, MISSING = 2, 2


class Windows:
    """A block of the benchmark as arrays: distinct terms, distinct windows by length, and which items have which."""

    def __init__(self, items: list[str], texts: list[str | None], k: int):
        self.items = items
        hashes, rows = [], []
        for c in K.chunks(pa.array(texts, pa.string())):
            w = c.words(K.ALNUM, lower=True)
            hashes.append(w.hash)
            rows.append(w.doc + c.row)
        h = np.concatenate([np.empty(0, np.uint64), *hashes])
        row = np.concatenate([np.empty(0, np.int64), *rows])
        self.terms, ids = np.unique(h, return_inverse=True)
        bounds = np.searchsorted(row, np.arange(len(items) + 1))
        found: dict[tuple[int, ...], set[int]] = {}
        for i in range(len(items)):
            t = ids[bounds[i] : bounds[i + 1]].tolist()
            for a in range(max(1, len(t) - k + 1) if t else 0):
                found.setdefault(tuple(t[a : a + k]), set()).add(i)
        self.by_length: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for size in sorted({len(x) for x in found}):
            own = [x for x in found if len(x) == size]
            self.by_length[size] = (np.array(own, np.int64), [np.fromiter(sorted(found[x]), np.int64) for x in own])


class Shard:
    """The positional inverted index of one chunk of documents."""

    def __init__(self, w: K.Words, terms: np.ndarray):
        slot = np.minimum(np.searchsorted(terms, w.hash), max(0, len(terms) - 1))
        self.at = np.where(terms[slot] == w.hash, slot, -1) if len(terms) else np.full(len(w.hash), -1)
        indexed = np.flatnonzero(self.at >= 0)
        self.postings = indexed[np.argsort(self.at[indexed], kind="stable")]
        self.df = np.bincount(self.at[indexed], minlength=len(terms))
        self.begin = np.cumsum(self.df) - self.df
        self.doc = w.doc

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of all exact occurrences."""
        which, start, rank = self._candidates(windows)
        for r in range(1, windows.shape[1]):
            col = rank[which, r]
            good = self.at[start + col] == windows[which, col]
            which, start = which[good], start[good]
        return which, start

    def near(self, windows: np.ndarray, slop: int, missing: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) where the rarest terms stand within slop of their places and at most ``missing`` terms do not."""
        which, start, rank = self._candidates(windows)
        lacking = np.zeros(len(which), np.int64)
        for r in range(1, windows.shape[1]):
            col = rank[which, r]
            place, term, doc = start + col, windows[which, col], self.doc[start]
            there = np.zeros(len(which), bool)
            for d in range(-slop, slop + 1):
                p = np.clip(place + d, 0, len(self.at) - 1)
                there |= (self.at[p] == term) & (self.doc[p] == doc)
            lacking += ~there
            good = lacking <= (missing if r > 2 else 0)
            which, start, lacking = which[good], start[good], lacking[good]
        return which, start

    def _candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rarest term's postings of each window, moved back by its offset; and the windows' columns by rarity."""
        freq = self.df[windows]
        rank = np.argsort(freq, axis=1, kind="stable")
        live = np.flatnonzero(freq.min(axis=1) > 0)
        first = rank[live, 0]
        term = windows[live, first]
        n = self.df[term]
        which, offset = np.repeat(live, n), np.repeat(first, n)
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.postings[np.repeat(self.begin[term], n) + run] - offset
        size = windows.shape[1]
        good = (start >= 0) & (start + size <= len(self.at))
        which, start, offset = which[good], start[good], offset[good]
        good = (self.doc[start] == self.doc[start + offset]) & (self.doc[start + size - 1] == self.doc[start + offset])
        return which[good], start[good], rank


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int):
    """The benchmark's rows in blocks of a checked size: one, or as many as its size asks for."""
    b = benchmark.select(F.col(quoted(item)).cast("string").alias("item"), F.col(quoted(text)).cast("string").alias("text"))
    total = b.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n = max(1, -(-int(total) // limit))
    for i in range(n):
        rows = (b if n == 1 else b.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i)).collect()
        yield n, sorted({(r["item"] if r["item"] is not None else "", r["text"]) for r in rows}, key=lambda x: (x[0], x[1] or ""))


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, near: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, spans hit (arrays of first words and of ends, exclusive), items with exact matches, and items with proximity matches if asked for."""
    source = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).cast("string").alias("t"))
    blocks = [(Windows([r[0] for r in rows], [r[1] for r in rows], window), n) for n, rows in _blocks(benchmark, item, item_text, block_bytes)]
    several = len(blocks) > 1
    if several:
        numbered = written(source.withColumn("id", F.monotonically_increasing_id()))
        source = numbered.select("id", "t")
    schema = T.StructType([T.StructField("id" if several else key, source.schema[0].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("near_items", T.ArrayType(T.StringType()))])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    passes = []
    for found, n_blocks in blocks:
        shipped = spark_broadcast(docs, found)

        def run(batches, shipped=shipped):
            block = shipped.value
            for b in batches:
                words, hits, spans, items, close = [], [], [], [], []
                for c in K.chunks(b.column(1)):
                    w = c.words(K.ALNUM, lower=True)
                    shard = Shard(w, block.terms)
                    cover = np.zeros(len(w.start) + 1, np.int64)
                    exact: list[set[str]] = [set() for _ in range(c.n)]
                    loose: list[set[str]] = [set() for _ in range(c.n)]
                    for size, (windows, owners) in block.by_length.items():
                        which, start = shard.phrases(windows)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + size, -1)
                        for doc, i in set(zip(w.doc[start].tolist(), which.tolist(), strict=True)):
                            exact[doc].update(block.items[o] for o in owners[i])
                        if near and size > 2:
                            which, start = shard.near(windows, SLOP, MISSING)
                            for doc, i in set(zip(w.doc[start].tolist(), which.tolist(), strict=True)):
                                loose[doc].update(block.items[o] for o in owners[i])
                    hit = np.cumsum(cover[:-1]) > 0
                    words.append(np.diff(w.bounds))
                    per_word = np.zeros(len(hit) + 1, np.int64)
                    np.cumsum(hit, out=per_word[1:])
                    hits.append(per_word[w.bounds[1:]] - per_word[w.bounds[:-1]])
                    for r in range(c.n):
                        a, z = w.bounds[r], w.bounds[r + 1]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:z].view(np.int8), [0]]))).tolist() if hits[-1][r] else []
                        spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                        items.append(sorted(exact[r]))
                        close.append(sorted(loose[r] - exact[r]))
                none = [np.empty(0, np.int64)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(none + words), pa.int64()), pa.array(np.concatenate(none + hits), pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string())), pa.array(close, pa.list_(pa.string()))], schema.names)

        passes.append(bounded(source).mapInArrow(run, schema))
        if n_blocks == 1:
            return passes[0]
    merged = passes[0]
    for p in passes[1:]:
        merged = merged.unionByName(p)
    whole = _merge(merged, "id").join(numbered.select("id", F.col("k").alias(fresh(merged, key) if key == "id" else key)), "id")
    out = whole.select(whole.columns[-1], *(c for c in schema.names if c != "id"))
    return out.withColumnRenamed(out.columns[0], key)


def _merge(found: DataFrame, key: str) -> DataFrame:
    """One row a number from those of several blocks; words hit are those of the union of the spans."""
    k = quoted(key)
    g = found.groupBy(key).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"))
    joined = F.expr("aggregate(s, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) -> if(size(a) > 0 and element_at(a, -1).end >= x.start, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, x.end) as end))), concat(a, array(x))))")
    return g.withColumn("spans", joined).select(F.col(k), "n_words", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)").alias("n_hit"), "spans", "items", F.array_except("near_items", "items").alias("near_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that hold a window of any item; all columns stay.  Blocks of the benchmark filter one after another."""
    for _, rows in _blocks(benchmark, item, item_text, block_bytes):
        shipped = spark_broadcast(docs, Windows([r[0] for r in rows], [r[1] for r in rows], window))
        name = fresh(docs, "contaminated")

        def make(shipped=shipped):
            def run(texts: pa.Array) -> list[pa.Array]:
                hit = np.zeros(len(texts), bool)
                for c in K.chunks(texts):
                    shard = Shard(c.words(K.ALNUM, lower=True), shipped.value.terms)
                    for windows, _ in shipped.value.by_length.values():
                        hit[c.row + shard.doc[shard.phrases(windows)[1]]] = True
                return [pa.array(hit)]

            return run

        docs = add_columns(docs, text, [T.StructField(name, T.BooleanType())], make).where(~F.col(name)).drop(name)
    return docs


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WINDOW} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) END) AS g,
 least(len(w), {WINDOW}) AS size FROM b),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + size - 1], ' ')}})) AS x FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, x.i AS i, bw.size, item FROM dw JOIN bw ON bw.size = dw.size AND bw.g = dw.x.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES = {"op8_decontamination": SQL}
