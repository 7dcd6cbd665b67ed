"""Quality rules, line first.

Every line of a text is judged alone by punctuation, navigation, boilerplate
and noise rules.  Lines that fail are removed, and a document that loses too
large a share of its words, or has too few left, is rejected.

All rules are integer comparisons on per-line counts found in vectorised
passes over byte buffers; only lines that hold a boilerplate phrase are
touched one by one.  There is no shuffle.

Rules, for a ``\\n``-split line of w words (w >= 1):

* ``noise``: more than one symbol ``#*$%&|<>`` for every ten words and at least two of them, or two ``!``
  and more than three for every ten words
* ``shouting``: w >= 3 and more letters A-Z than a-z
* ``navigation``: w <= 12 and two or more of ``|`` and ``>``
* ``boilerplate``: holds one of BOILERPLATE in any ASCII case and w <= 25
* ``unfinished``: w <= 2 and the line's last byte that is no white space is none of ``.!?:;"')``
* ``repetitive``: w >= 10 and distinct words are under three tenths of w

Null and empty texts, and texts of white space, have no words and fail the
base rule.  Repeated rows give repeated results; ties do not arise.  Columns
other than key and text are not read, whatever their names; the key may have
the name of no result column.  An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import textkern as K
from .common import map_texts, table

#: Phrases of site furniture, lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "follow us on", "lorem ipsum", "privacy policy", "read more", "sign up for", "subscribe to our", "terms of use",
)
#: A document is rejected if more than this percentage of its words goes with removed lines.
MAX_LOST_PERCENT = 40
MIN_WORDS = 50
RULES = ("noise", "shouting", "navigation", "boilerplate", "unfinished", "repetitive")

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BARS = np.zeros(256, bool)
_BARS[list(b"|>")] = True
_FINAL = np.zeros(256, bool)
_FINAL[list(b".!?:;\"')")] = True
#: Looks ahead, so that a match across the edge of two rows hides none that starts inside it.
_PHRASES = re.compile(f"(?=({'|'.join(map(re.escape, BOILERPLATE))}))".encode())


def _repeats(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the same (group, h) stands more than once."""
    with np.errstate(over="ignore"):
        key = K.mix(h ^ K.mix(group.astype(np.uint64)))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _judge(c: K.Chunk, max_lost: int, min_words: int, with_text: bool) -> dict[str, np.ndarray | list[str]]:
    w = c.words(K.SPACE, lower=False)
    n, data, off = c.n, c.buf, c.offsets
    n_words = np.diff(w.bounds)
    out: dict = {"n_words": n_words}
    nonsep = ~K.SPACE[data]
    out["word_chars"] = K.per_row(nonsep & K.code_points(data), off)
    out["n_symbols"] = K.per_row(_SYMBOLS[data], off)

    # Lines: a row of b bytes with m newlines has m + 1.
    newline = np.flatnonzero(data == 10)
    row_of = np.searchsorted(off, newline, "right") - 1
    start = np.concatenate([off[:-1], newline + 1])
    line_row = np.concatenate([np.arange(n), row_of])
    order = np.lexsort((start, line_row))
    start, line_row = start[order], line_row[order]
    end = np.empty_like(start)
    last = np.ones(len(start), bool)
    last[:-1] = line_row[1:] != line_row[:-1]
    end[last] = off[1:][line_row[last]]
    inner = np.flatnonzero(~last)
    end[inner] = start[inner + 1] - 1
    cut = np.searchsorted(w.start, np.append(start, len(data)))
    line_words = np.searchsorted(w.start, end) - cut[:-1]
    full = line_words > 0
    start, end, line_row, line_words, first_word = start[full], end[full], line_row[full], line_words[full], cut[:-1][full]

    h = c.span_hash(data, start, end)
    with np.errstate(over="ignore"):
        key = K.mix(h ^ K.mix(line_row.astype(np.uint64)))
    _, firsts = np.unique(key, return_index=True)
    dup = np.ones(len(key), bool)
    dup[firsts] = False
    out["n_dup_lines"] = np.bincount(line_row[dup], minlength=n)

    at, wh = w.windows(3)
    again = at[_repeats(w.doc[at], wh)]
    covered = np.zeros(len(w.start), bool)
    for j in range(3):
        covered[again + j] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[end] - sums[start]

    symbols, bangs, bars = count(_SYMBOLS[data]), count(data == 0x21), count(_BARS[data])
    upper, lower = count((data >= 0x41) & (data <= 0x5A)), count((data >= 0x61) & (data <= 0x7A))
    fails = np.zeros((len(RULES), len(start)), bool)
    fails[0] = ((symbols >= 2) & (10 * symbols > line_words)) | ((bangs >= 2) & (10 * bangs > 3 * line_words))
    fails[1] = (line_words >= 3) & (upper > lower)
    fails[2] = (line_words <= 12) & (bars >= 2)
    text = K.LOWER[data].tobytes()
    hits, ends = np.array([m.span(1) for m in _PHRASES.finditer(text)], np.int64).reshape(-1, 2).T
    if len(hits):  # a phrase holds no newline and so lies inside one line, or across the edge of two rows
        line = np.searchsorted(start, hits, "right") - 1
        good = (line >= 0) & (ends <= end[line])
        fails[3, line[good]] = True
        fails[3] &= line_words <= 25
    final = w.end[first_word + line_words - 1] - 1
    fails[4] = (line_words <= 2) & ~_FINAL[data[final]]
    line_of_word = np.repeat(np.arange(len(start)), line_words)
    with np.errstate(over="ignore"):
        key = K.mix(w.hash ^ K.mix(line_of_word.astype(np.uint64)))
    _, firsts = np.unique(key, return_index=True)
    distinct = np.bincount(line_of_word[firsts], minlength=len(start))
    fails[5] = (line_words >= 10) & (10 * distinct < 3 * line_words)

    failed = fails.any(axis=0)
    lost = np.bincount(line_row, weights=np.where(failed, line_words, 0), minlength=n).astype(np.int64)
    out["base_failed"] = (n_words < min_words) | (100 * out["n_repeat_words"] > 50 * n_words)
    out["lost_words"] = lost
    out["kept"] = ~out["base_failed"] & (100 * lost <= max_lost * n_words)
    for r, rule in enumerate(RULES):
        out[f"lines_{rule}"] = np.bincount(line_row[fails[r]], minlength=n)
    if with_text:
        keep = np.flatnonzero(~failed)
        cuts = np.searchsorted(line_row[keep], np.arange(n + 1))
        out["clean_text"] = ["\n".join(data[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in keep[cuts[r] : cuts[r + 1]]) for r in range(n)]
    return out


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT, min_words: int = MIN_WORDS, with_text: bool = True) -> DataFrame:
    """Key, counts, lines failed by each rule, verdict ``kept`` and, on request, the text without its failed lines."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", *(f"lines_{r}" for r in RULES)]
    fields = [T.StructField(x, T.LongType()) for x in names] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    kinds = {x: pa.int64() for x in names} | {"base_failed": pa.bool_(), "kept": pa.bool_()}
    if with_text:
        fields.append(T.StructField("clean_text", T.StringType()))
        kinds["clean_text"] = pa.string()

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            parts = [_judge(c, max_lost_percent, min_words, with_text) for c in K.chunks(texts)]
            return [pa.concat_arrays([pa.array(p[x], kinds[x]) for p in parts]) if parts else pa.array([], kinds[x]) for x in kinds]

        return run

    return map_texts(docs, key, text, fields, make)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean_lines(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_COUNT = "(length({0}) - length(regexp_replace({0}, '{1}', '', 'g')))"

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format("text")} AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (SELECT doc_id, CASE WHEN len(ws) < 3 THEN [] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2]) END AS tri FROM w),
u AS (SELECT doc_id, unnest(tri) AS g, generate_subscripts(tri, 1) AS i FROM t),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM u) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS x FROM w),
c AS (SELECT doc_id, x, {_WORDS.format("x")} AS xw, {_COUNT.format("x", "[#*$%&|<>]")} AS sy, {_COUNT.format("x", "[!]")} AS ba, {_COUNT.format("x", "[|>]")} AS br,
 {_COUNT.format("x", "[A-Z]")} AS up, {_COUNT.format("x", "[a-z]")} AS lo, regexp_replace(x, '[\x20\x09-\x0D]+$', '') AS tr FROM l),
f AS (SELECT doc_id, x, len(xw) AS n, (sy >= 2 AND 10 * sy > len(xw)) OR (ba >= 2 AND 10 * ba > 3 * len(xw)) OR (len(xw) >= 3 AND up > lo) OR (len(xw) <= 12 AND br >= 2)
 OR (len(xw) <= 25 AND regexp_matches(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(BOILERPLATE)}'))
 OR (len(xw) <= 2 AND NOT regexp_matches(tr, '[.!?:;")'']$')) OR (len(xw) >= 10 AND 10 * len(list_distinct(xw)) < 3 * len(xw)) AS bad FROM c),
s AS (SELECT doc_id, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost, count(*) - count(DISTINCT x) AS dups FROM f GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, {_COUNT.format("text", "[#*$%&|<>]")}::BIGINT AS n_symbols,
 coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost FROM w LEFT JOIN s USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= {MAX_LOST_PERCENT} * n_words AS kept FROM m
"""

QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": SQL}
