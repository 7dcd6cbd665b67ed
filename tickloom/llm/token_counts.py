"""Token counts by batch encoding.

Each text is split at safe boundaries, the places where the byte-level
vocabulary's own pre-tokenisation starts a new piece whatever stands around,
so encoding the parts gives the ids of the whole.  The split is found for a
whole batch of texts in vectorised passes.  Equal pieces recur very often
(words), so each distinct piece of a byte-balanced batch is encoded once and
the ids, or only their number, are gathered back by position.  Distinct pieces
go to the library in one batch; a bounded table keeps those met before.

Texts that hold the string of an added token are encoded by the library whole
(their handling of it is its default).  Null and empty texts have 0 tokens.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import textkern as K
from .common import map_texts, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Distinct pieces a Python worker remembers, at some 40 bytes each; beyond it the table starts anew (results do not change).
REMEMBERED = 600_000

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
#: Bytes encoded at a time, or one text.
BATCH_BYTES = 1 << 21
_kinds: list[np.ndarray] = []
_encoders: dict[tuple[str, bool], Encoder] = {}


def kinds() -> np.ndarray:
    """The class of every code point: letter, number, white space, other."""
    if not _kinds:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        at = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        t = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            for m in regex.finditer(f"{pattern}+", every):
                t[at[m.start() : m.end()]] = kind
        _kinds.append(t)
    return _kinds[0]


def piece_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of texts that begin at ``rows`` (all of them not empty)."""
    n = len(points)
    kind = kinds()[points]
    first = np.zeros(n, bool)
    first[rows] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    start = change | first
    blank = kind == _SPACE
    # The last blank before a non-blank of its text stands apart from the blanks before it ...
    inner = np.zeros(n, bool)
    inner[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
    start |= inner
    # ... and, if it is a space, belongs to what follows.
    after = np.flatnonzero(inner & (points == 0x20)) + 1
    start[after] = False
    # Contractions: an apostrophe that begins a piece of its own takes s, t, re, ve, m, ll or d from the letters after it.
    tick = np.flatnonzero(start & (points == 0x27))
    tick = tick[tick + 1 < n]
    tick = tick[~first[tick + 1] & (kind[tick + 1] == _LETTER)]
    for i in tick:
        a = points[i + 1]
        b = points[i + 2] if i + 2 < n and not first[i + 2] else 0
        size = 2 if a in (0x73, 0x74, 0x6D, 0x64) else 3 if (a, b) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)) else 0
        if size:
            start[i + 1] = False
            if i + size < n:
                start[i + size] = True
    return start


class Encoder:
    """Ids, or their numbers, of batches of texts; equal to the library's one text at a time."""

    def __init__(self, vocabulary: str = VOCABULARY, lengths_only: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        kind = type(self.library.pre_tokenizer).__name__
        if kind != "ByteLevel" or self.library.normalizer is not None:
            raise ValueError(f"{vocabulary}: pieces are known for plain byte-level vocabularies only, not {kind}")
        self.added = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()).encode() or rb"(?!)")
        self.lengths_only = lengths_only
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted hashes of known pieces
        self.sizes = np.empty(0, np.int32)
        self.at = np.empty(0, np.int64)  # where each one's ids begin
        self.ids = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Remember new pieces (sorted, distinct keys): the library takes each as one word that is split already."""
        groups = [pieces[i : i + 1000] for i in range(0, len(pieces), 1000)]
        sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for group, e in zip(groups, self.library.encode_batch(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(group)))
            if not self.lengths_only:
                ids.append(np.array(e.ids, np.uint32))
        size = np.concatenate(sizes)
        slot = np.searchsorted(self.keys, keys)
        self.keys, self.sizes = np.insert(self.keys, slot, keys), np.insert(self.sizes, slot, size)
        if not self.lengths_only:
            self.at = np.insert(self.at, slot, len(self.ids) + np.cumsum(size) - size)
            self.ids = np.concatenate([self.ids, *ids])

    def encode(self, c: K.Chunk) -> tuple[np.ndarray, np.ndarray | None]:
        """Numbers of tokens of the chunk's rows and, unless only lengths are wanted, all ids one after another."""
        odd = {int(np.searchsorted(c.offsets, m.start(), "right")) - 1 for m in self.added.finditer(c.buf.tobytes())}
        points = np.frombuffer(c.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        sums = np.zeros(len(c.buf) + 1, np.int64)
        np.cumsum(K.code_points(c.buf), out=sums[1:])
        rows = sums[c.offsets]
        count = np.zeros(c.n, np.int64)
        if not len(points):
            return count, None if self.lengths_only else np.empty(0, np.uint32)
        full = np.unique(rows[:-1][np.diff(rows) > 0])
        begin = np.flatnonzero(piece_starts(points, full))
        # The bytes at which pieces begin, for hashing.
        byte_at = np.append(np.flatnonzero(K.code_points(c.buf))[begin], len(c.buf))
        h = c.span_hash(c.buf, byte_at[:-1], byte_at[1:])
        distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        known = self._known(distinct)
        if not known.all():
            new = where[~known]
            if len(self.keys) + len(new) > REMEMBERED:  # all pieces of this chunk must be known at once
                new, known = where, np.zeros(len(distinct), bool)
                self._forget()
            raw = c.buf.tobytes()
            self._learn(distinct[~known], [raw[byte_at[i] : byte_at[i + 1]].decode("utf-8") for i in new])
        slot = np.searchsorted(self.keys, distinct)[inverse]
        sizes = self.sizes[slot].astype(np.int64)
        cut = np.searchsorted(begin, rows)
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        count = total[cut[1:]] - total[cut[:-1]]
        ids = None
        if not self.lengths_only:
            shift = np.repeat(self.at[slot] - total[:-1], sizes)
            ids = self.ids[shift + np.arange(total[-1])]
        for i in sorted(odd, reverse=True):
            own = self.library.encode(c.buf[c.offsets[i] : c.offsets[i + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids
            if ids is not None:
                a = int(count[:i].sum())
                ids = np.concatenate([ids[:a], np.array(own, np.uint32), ids[a + count[i] :]])
            count[i] = len(own)
        return count, ids

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys


def encoder(vocabulary: str, lengths_only: bool) -> Encoder:
    """The worker's encoder; tasks that follow one another in a worker share what it remembers."""
    key = (vocabulary, lengths_only)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, lengths_only)
    return _encoders[key]


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Key, n_bytes (UTF-8), n_tokens and whether they exceed ``limit``; special strings are read as the library's default has it."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def make():
        own = encoder(vocabulary, True)

        def run(texts: pa.Array) -> list[pa.Array]:
            texts = K.binary(texts)
            n = np.concatenate([np.empty(0, np.int64), *(own.encode(c)[0] for c in K.chunks(texts, BATCH_BYTES))])
            return [pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]

        return run

    return map_texts(docs, key, text, fields, make)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
