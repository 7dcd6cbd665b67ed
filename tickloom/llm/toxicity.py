"""Toxicity after noisy-channel deobfuscation.

Writers hide words by look-alike characters (leetspeak), by spacing letters
out and by repeating them.  The channel model gives, for a suspicious segment,
the lattice of strings it may stand for, each step with a cost; a character
trigram model of the corpus gives the cost of the strings; Viterbi decoding
picks the cheapest path.  The text with restored segments is then scored.

* The language model is counted over all characters of all documents: every
  task sends one row for each trigram it met, so what is gathered grows with
  the input, while the model is bounded by the alphabet.
* The scorer knows words, and word beginnings that go on in several ways.
  Evidence is the share of training documents of either label that hold a
  feature.  A feature of toxic documents must stand after several different
  words, so passages that were copied teach nothing.  Its candidates are found
  in toxic documents alone (those in at least SUPPORT of them, which bounds
  their number whatever the corpus) and then counted in all training documents.
* A document's score is 1 - product over its distinct words of 1 - p, where p
  is the word's strongest feature.

Segments that nothing hides have a lattice of one path and are not decoded.
Null, empty and word-free texts score 0.  Equal texts get equal scores.
Without usable labels every score is 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkern as K
from .common import add_columns, bounded, fresh, map_texts, quoted, table

THRESHOLD = 0.7
#: Letters a-z, classes of other letters, and one class for all else.
LETTERS, OTHERS = 26, 13
ALPHABET = 1 + LETTERS + OTHERS
#: Least share of toxic training documents that hold a feature, and least number of such documents.
SUPPORT, LEAST = 0.004, 4
#: Least probability of a toxic document given the feature.
PRECISION = 0.9
#: A feature is learned if so many of its documents were toxic by chance with at most this probability.
CHANCE = 1e-6
#: The words before a feature, hashed to 64 cells, must fill this share of the cells that as many different words would;
#: a beginning must go on in so many ways.
CONTEXTS, ENDINGS = 0.5, 3
BEGINNINGS = (4, 5, 6)
#: Most label rows that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Longest token that is decoded as one segment; of longer ones the parts between punctuation are.
LONGEST = 48

#: What a look-alike may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = " .-_*~"
#: Costs in nats: a look-alike, one letter for two, a run of three or more as one or two letters, a separator dropped or kept.
COST_LOOK, COST_HALF, COST_ONE, COST_TWO, COST_JOIN, COST_KEEP, COST_SELF = 1.0, 2.5, 0.5, 0.7, 0.3, 1.5, 7.0

_LETTER = r"a-zß-öø-ɏ"
_LOOK = "".join(map(re.escape, LOOKALIKES))
_SPACED = re.compile(rf"(?<![\w@$])(?:[{_LETTER}{_LOOK}][ .\-_*~]{{1,2}}){{3,}}[{_LETTER}{_LOOK}](?![\w@$])")
_TOKEN = re.compile(r"\S+")
_HIDDEN = re.compile(rf"[{_LETTER}][{_LOOK}]+[{_LETTER}]|[{_LOOK}][{_LETTER}]|[{_LETTER}][013457]|([{_LETTER}])\1\1")
_LEAD = re.compile(r"[^\w@$!|+€£]*")
_PART = re.compile(r"(?:[^\W_]|[@$!|+€£])+")
_table: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The alphabet's class of every code point."""
    if not _table:
        import regex

        t = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]))
        at = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        for m in regex.finditer(r"\p{L}+", every):
            t[at[m.start() : m.end()]] = 1 + LETTERS + at[m.start() : m.end()] % OTHERS
        t[0x61:0x7B] = np.arange(1, LETTERS + 1)
        t[0x41:0x5B] = np.arange(1, LETTERS + 1)
        _table.append(t)
    return _table[0]


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all class trigrams of all documents, as an array of ALPHABET ** 3."""

    def run(batches):
        total = np.zeros(ALPHABET**3, np.int64)
        for b in batches:
            for c in K.chunks(b.column(0)):
                raw = c.buf.tobytes()
                kind = classes()[np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)].astype(np.int32)
                sums = np.concatenate([[0], np.cumsum(K.code_points(c.buf))])
                row = np.repeat(np.arange(c.n), np.diff(sums[c.offsets]))
                if len(kind) < 3 or len(kind) != len(row):
                    continue
                code = (kind[:-2] * ALPHABET + kind[1:-1]) * ALPHABET + kind[2:]
                total += np.bincount(code[row[:-2] == row[2:]], minlength=ALPHABET**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["code", "n"])

    rows = bounded(docs).select(F.col(quoted(text)).cast("string").alias("t")).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most ALPHABET ** 3 rows
    out = np.zeros(ALPHABET**3, np.int64)
    for r in rows:
        out[r["code"]] = r["n"]
    return out


@dataclass
class Channel:
    """The noisy channel: costs of trigrams, and Viterbi decoding of lattices."""

    cost: np.ndarray  # [a, b, c]: nats of c after a, b
    seen: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Channel:
        tri = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + ALPHABET)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 3 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 3)
        return cls(-np.log(p3))

    def lattice(self, segment: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """Alternatives (string, cost) for each step of the segment."""
        steps, i = [], 0
        while i < len(segment):
            ch, j = segment[i], i + 1
            while j < len(segment) and segment[j] == ch:
                j += 1
            run, i = j - i, j
            if spaced and ch in SEPARATORS:
                steps.append([("", COST_JOIN * run), (" ", COST_KEEP / run)])
            elif ch in LOOKALIKES:
                alts = [(ch * run, COST_SELF * run)]
                for x in LOOKALIKES[ch]:
                    alts.append((x, COST_LOOK + (COST_HALF if run == 2 else COST_ONE if run > 2 else 0)))
                    if run > 1:
                        alts.append((x * 2, COST_LOOK + (0 if run == 2 else COST_TWO)))
                steps.append(alts)
            elif ch.isalpha():
                steps.append([(ch, 0.0)] if run == 1 else [(ch * 2, 0.0), (ch, COST_HALF)] if run == 2 else [(ch, COST_ONE), (ch * 2, COST_TWO)])
            else:
                steps.append([(ch * run, 0.0)])
        return steps

    def decode(self, segment: str, spaced: bool = False) -> str:
        """The cheapest string that the segment may stand for."""
        key = segment + " " * spaced
        if key in self.seen:
            return self.seen[key]
        kind, cost = classes(), self.cost
        # A path is its last string and the path before it, so a step costs the same however long the segment is.
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for alts in self.lattice(segment, spaced):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (c0, out) in paths.items():
                for s, c1 in alts:
                    x, y, c = a, b, c0 + c1
                    for ch in s:
                        z = int(kind[ord(ch)])
                        c += cost[x, y, z]
                        x, y = y, z
                    if (x, y) not in new or c < new[x, y][0]:
                        new[x, y] = (c, (s, out))
            paths = new

        def joined(path: tuple | None) -> str:
            parts = []
            while path:
                parts.append(path[0])
                path = path[1]
            return "".join(reversed(parts))

        ends = [(c + cost[a, b, 0], out) for (a, b), (c, out) in paths.items()]
        least = min(c for c, _ in ends)
        best = min(joined(out) for c, out in ends if c == least)
        if len(segment) > LONGEST:
            return best
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[key] = best
        return best

    def restore(self, text: str) -> str:
        """The text in lower case with suspicious segments decoded."""
        low = text.lower()
        if any(x in low for x in SEPARATORS):
            low = _SPACED.sub(lambda m: " " + self.decode(m[0], True) + " " if any(c.isalpha() for c in m[0]) else m[0], low)

        def part(m: re.Match) -> str:
            if not _HIDDEN.search(m[0]):
                return m[0]
            a, z = _LEAD.match(m[0]).end(), len(m[0])
            while z > a and not m[0][z - 1].isalnum():
                z -= 1
            core = m[0][a:z]
            if not any(c.isalpha() for c in core):
                return m[0]
            return m[0][:a] + self.decode(core) + m[0][z:]

        def token(m: re.Match) -> str:
            return part(m) if len(m[0]) <= LONGEST else _PART.sub(part, m[0])

        return _TOKEN.sub(token, low)


def _suspicious(c: K.Chunk) -> np.ndarray:
    """Rows in which something may be hidden: a look-alike next to a letter, three equal letters, or letters apart."""
    low = K.LOWER[c.buf]
    n = len(low)
    if n < 3:
        return np.empty(0, np.int64)
    letter = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    look = np.isin(low, np.frombuffer("".join(x for x in LOOKALIKES if x.isascii()).encode(), np.uint8)) | (low == 0xE2) | (low == 0xC2)
    digit = (low >= 0x30) & (low <= 0x39)
    flag = np.zeros(n, bool)
    flag[:-1] |= look[:-1] & letter[1:]
    flag[1:] |= digit[1:] & letter[:-1]
    flag[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    flag[:-5] |= (low[:-5] >= 0x80) & (low[:-5] == low[2:-3]) & (low[2:-3] == low[4:-1]) & (low[1:-4] == low[3:-2]) & (low[3:-2] == low[5:])
    sep = np.isin(low, np.frombuffer(SEPARATORS.encode(), np.uint8))
    single = (letter | look) & (low < 0x80)
    single[1:] &= ~letter[:-1]
    single[:-1] &= ~letter[1:]
    apart = single[:-2] & sep[1:-1] & (single[2:] | sep[2:])
    flag[:-2] |= apart & (np.convolve(apart, np.ones(9, np.int8))[4 : 4 + n - 2] >= 3)
    return np.unique(np.searchsorted(c.offsets, np.flatnonzero(flag), "right") - 1)


def restored(texts: pa.Array, channel: Channel) -> list[K.Chunk]:
    """The batch as chunks, with suspicious rows replaced by what they stand for."""
    out = []
    for c in K.chunks(texts):
        rows = set(_suspicious(c).tolist())
        if rows:
            raw = [c.buf[c.offsets[i] : c.offsets[i + 1]].tobytes() for i in range(c.n)]
            new = [channel.restore(x.decode("utf-8", "replace")).encode() if i in rows else x for i, x in enumerate(raw)]
            (d,) = K.chunks(pa.array(new, pa.large_binary()), 1 << 62)
            c = K.Chunk(c.row, d.n, d.buf, d.offsets)
        out.append(c)
    return out


def _features(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of all words: the word itself, and its beginnings if it goes on."""
    n = len(w.start)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    points = np.flatnonzero(K.code_points(w.data))
    first = np.searchsorted(points, w.start)
    size = np.searchsorted(points, w.end) - first
    words, feats = [np.arange(n)], [w.hash]
    for k in BEGINNINGS:
        at = np.flatnonzero(size > k)
        words.append(at)
        feats.append(K.mix(w.chunk.span_hash(w.data, w.start[at], points[first[at] + k]) ^ np.uint64(k)))
    return np.concatenate(words), np.concatenate(feats)


def _bit(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.uint64(1) << (K.mix(h + np.uint64(7)) >> np.uint64(58))


def _toxic_features(batches, channel: Channel):
    """(feature, documents, contexts, endings) of one class of documents, summed for each chunk."""
    for b in batches:
        for c in restored(b.column(0), channel):
            w = c.words(K.ALNUM, lower=True)
            word, feat = _features(w)
            if not len(word):
                continue
            before = np.zeros(len(w.start), np.uint64)
            before[1:] = np.where(w.doc[1:] == w.doc[:-1], w.hash[:-1], 0)
            order = np.lexsort((w.doc[word], feat))
            word, feat = word[order], feat[order]
            cut = np.flatnonzero(np.concatenate([[True], feat[1:] != feat[:-1]]))
            new = np.concatenate([[True], (feat[1:] != feat[:-1]) | (w.doc[word[1:]] != w.doc[word[:-1]])])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(feat[cut].view(np.int64)),
                    pa.array(np.add.reduceat(new.astype(np.int64), cut)),
                    pa.array(np.bitwise_or.reduceat(_bit(before[word]), cut).view(np.int64)),
                    pa.array(np.bitwise_or.reduceat(_bit(w.hash[word]), cut).view(np.int64)),
                ],
                ["f", "n", "contexts", "endings"],
            )


def _counts(batches, channel: Channel, wanted: np.ndarray):
    """(feature, toxic documents, other documents) of the wanted features."""
    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False)
        for c in restored(b.column(0), channel):
            w = c.words(K.ALNUM, lower=True)
            word, feat = _features(w)
            slot = np.minimum(np.searchsorted(wanted, feat), len(wanted) - 1)
            good = wanted[slot] == feat
            pair = np.unique(w.doc[word[good]] * np.int64(len(wanted)) + slot[good])
            slot, doc = pair % len(wanted), pair // len(wanted)
            bad = toxic[c.row + doc] == 1
            t, n = np.bincount(slot[bad], minlength=len(wanted)), np.bincount(slot[~bad], minlength=len(wanted))
            at = np.flatnonzero(t + n)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[at].view(np.int64)), pa.array(t[at], pa.int64()), pa.array(n[at], pa.int64())], ["f", "t", "n"])


@dataclass
class Model:
    channel: Channel
    features: np.ndarray  # sorted
    weights: np.ndarray  # -log(1 - p)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.features):
            return out
        for c in restored(texts, self.channel):
            w = c.words(K.ALNUM, lower=True)
            word, feat = _features(w)
            slot = np.minimum(np.searchsorted(self.features, feat), len(self.features) - 1)
            good = self.features[slot] == feat
            word, value = word[good], self.weights[slot[good]]
            if not len(word):
                continue
            # The strongest feature of each distinct word of each row.
            with np.errstate(over="ignore"):
                key = K.mix(w.hash[word] ^ K.mix(w.doc[word].astype(np.uint64)))
            order = np.lexsort((-value, key))
            first = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]
            total = np.bincount(w.doc[word[first]], weights=value[first], minlength=c.n)
            out[c.row : c.row + c.n] = 1 - np.exp(-total)
        return out


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(t, toxic) of labelled documents that are not held out; of several labels of a document the largest counts."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("lk")).agg(F.max(label).cast("int").alias("toxic")).where(F.pmod(F.crc32(F.col("lk").cast("string").cast("binary")), F.lit(3)) != 1)
    known = F.broadcast(known) if labels.count() <= BROADCAST_ROWS else known
    return docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).cast("string").alias("t")).join(known, F.col("k") == F.col("lk")).select("t", "toxic")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Count the language model over all documents, then learn features from the training rows."""
    sc = docs.sparkSession.sparkContext
    channel = Channel.from_counts(count_trigrams(docs, text))
    rows = training_rows(docs, labels, key, text, label)
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = size.get(1, 0), sum(n for x, n in size.items() if x != 1)
    empty = Model(channel, np.empty(0, np.uint64), np.empty(0))
    if not toxic or not other:
        return empty
    shipped = sc.broadcast(channel)
    least = max(LEAST, int(SUPPORT * toxic))
    found = rows.where("toxic = 1").select("t").mapInArrow(lambda x: _toxic_features(x, shipped.value), "f bigint, n bigint, contexts bigint, endings bigint")
    found = found.groupBy("f").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("contexts")).alias("contexts"), F.bit_count(F.bit_or("endings")).alias("endings")).where((F.col("n") >= least) & (F.col("contexts") >= F.lit(CONTEXTS * 64) * (1 - F.exp(-F.col("n") / 64))))
    kept = found.collect()  # at most a document's mean number of features divided by SUPPORT
    if not kept:
        return empty
    wanted = np.sort(np.array([r["f"] for r in kept], np.int64).view(np.uint64))
    endings = {r["f"]: r["endings"] for r in kept}
    shipped_wanted = sc.broadcast(wanted)
    counts = rows.mapInArrow(lambda x: _counts(x, shipped.value, shipped_wanted.value), "f bigint, t bigint, n bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
    base = toxic / (toxic + other)
    strong = []
    for r in counts:
        yes, no = base * r["t"] / toxic, (1 - base) * (r["n"] + 0.5) / (other + 1)
        p = yes / (yes + no)
        # A word has one ending of its own; a beginning must have several, or it says no more than its word.
        if p >= PRECISION and _tail(r["t"], r["t"] + r["n"], base) <= CHANCE and (endings[r["f"]] == 1 or endings[r["f"]] >= ENDINGS):
            strong.append((p, r["f"], r["t"]))
    f = np.array([x[1] for x in strong], np.int64).view(np.uint64)
    order = np.argsort(f)
    return Model(channel, f[order], -np.log1p(-np.minimum(np.array([x[0] for x in strong]), 0.9995))[order])


def _tail(least: int, trials: int, p: float) -> float:
    """P(at least so many of the trials succeed); 1 where that is no more than the mean."""
    if least <= trials * p:
        return 1.0
    term = math.exp(math.lgamma(trials + 1) - math.lgamma(least + 1) - math.lgamma(trials - least + 1) + least * math.log(p) + (trials - least) * math.log1p(-p))
    total, i = 0.0, least
    while i <= trials and term > total * 1e-15:  # terms fall beyond the mean
        total += term
        term *= (trials - i) / (i + 1) * p / (1 - p)
        i += 1
    return min(1.0, total)


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score in [0, 1]."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, key, text, [T.StructField("score", T.DoubleType())], lambda: lambda texts: [pa.array(shipped.value.score(texts))])


def restore_text(docs: DataFrame, channel: Channel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and the text as it is scored: lower case, suspicious segments decoded."""
    shipped = docs.sparkSession.sparkContext.broadcast(channel)
    return map_texts(docs, key, text, [T.StructField("restored", T.StringType())], lambda: lambda texts: [pa.array([None if x is None else shipped.value.restore(x) for x in texts.to_pylist()], pa.string())])


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at least ``threshold``."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text))
    name = fresh(docs, "toxicity")
    scored = add_columns(docs, text, [T.StructField(name, T.DoubleType())], lambda: lambda texts: [pa.array(shipped.value.score(texts))])
    return scored.where(F.col(name) < threshold).drop(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    # A document without an id has no label to learn from, and is not held out.
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
