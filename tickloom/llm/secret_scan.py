"""Secret scans: fixed patterns, and dictionary-primed novelty for what they miss.

Three fixed patterns give the base spans.  The method adds strings that stand
near a sensitive word and do not compress: for each candidate it measures the
marginal compressed bytes, that is how many more bytes zstandard needs for
surrounding text plus candidate than for surrounding text alone, with the
compressor primed by a full dictionary: content and entropy tables trained on
texts put together from IDENTIFIERS and WORDS (a bounded, fixed sample), so
that letters cost what they carry.  Words, paths and repeated strings cost up
to about 0.65 bytes a character, random strings 0.9 and more (of small letters
alone 0.7); strings in the
shape of a UUID or a date are identifiers and no candidates.

A byte search over the whole batch finds the rows that hold any literal a
pattern or a sensitive context needs; only those are decoded and scanned, each
from its first to its last character.  There is no shuffle.

Positions are code points, ends exclusive.  Null and empty texts have no spans.
Repeated rows give repeated results; spans that start together stand in the
order of KINDS.  Columns other than key and text are not read, whatever their
names, and an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkern as K
from .common import add_columns, fresh, map_texts, quoted, table

KINDS = ("assign", "access", "hex", "novel")
BASE_KINDS = KINDS[:3]
#: Bytes around a sensitive word in which candidates are looked for, and around a candidate that prime the compressor.
NEAR, AROUND = 64, 256
#: Least marginal bytes for each character of a candidate, and the length that shorter ones are measured as: they must cost as many bytes.
MIN_LENGTH, MIN_NOVELTY = 14, 0.68
SENSITIVE = ("passw", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "authorization", "private key", "access key", "access_key", "akia")
#: Strings that are common in code and configuration; they prime the compressor.
IDENTIFIERS = """password passwd secret token api_key apikey access_key private_key public_key client_id client_secret
authorization bearer credential username user_name account session cookie config configuration settings environment
localhost example.com http:// https:// www. .com/ .org/ .net/ .html .json .yaml .xml .txt index main init self this return
function class import export default const static public private protected void string integer boolean number object
array list dict value values key keys name names type types id ids uuid path file filename directory folder url uri host
port database table column select insert update delete from where order group create connection timeout retries version
license copyright abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 placeholder changeme
your_token_here your_api_key_here xxxxxxxxxxxxxxxx ----------------""".encode()
#: Ordinary words, whose letters teach the compressor what letters cost.
WORDS = """the of and to in is that for it as was with be by on not he at are this have from or had an they which you were all there would their we
been has when who will more out said what about into than them can only other new some could time these two may then first any now such like over
und der die das nicht ein eine ist mit von den auf sich werden wird durch gesellschaft schiff fahrt entwicklung verwaltung
les des une dans pour que pas sont avec nous vous mais comme los las una por con para como pero
international organisation information counter revolution characteristics responsibilities application resources source java python test
component controller service repository interface implementation abstract factory manager handler request response internal documentation""".encode()
#: Texts that the dictionary is trained on, and its bytes.
SAMPLES, DICTIONARY_BYTES = 3000, 16384
#: Letters by how often they stand in ordinary text, and bytes of filler made of them.
LETTERS = tuple(zip("etaoinshrdlucmfwypvbgkjqxz", (12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 1, 1, 2, 1, 1, 1, 1, 1), strict=True))
FILLER_BYTES = 600


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(rf"""({_either("password")}|{_either("passwd")}|{_either("secret")}|{_either("token")}|{_either("api")}_?{_either("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CONTEXT = re.compile("|".join(_either(w) for w in SENSITIVE))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_IDENTIFIER = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-][0-9.-]*[Z]?)?")
_LITERALS = [w.encode() for w in ("passw", "secret", "token", "apikey", "api_key", *SENSITIVE)]
_LITERALS = list(dict.fromkeys(_LITERALS))
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True

Span = tuple[int, str, int, float | None]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end, no novelty): leftmost non-overlapping matches of each kind that pass its test."""
    out = [(m.start(), "assign", m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end(), None) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


@functools.cache
def dictionary() -> bytes:
    """The trained dictionary; the driver makes it once and sends it to the tasks."""
    draw = random.Random(20240229)
    words = IDENTIFIERS.split() + 2 * WORDS.split()
    samples = [draw.choice([b" ", b" ", b" ", b"/", b"_", b"."]).join(draw.choice(words) for _ in range(draw.randint(6, 20))) for _ in range(SAMPLES)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=19).as_bytes()


@functools.cache
def plain_text() -> bytes:
    """Text of ordinary letters, digits and separators that no dictionary holds: ahead of a measurement it keeps the compressor
    in one and the same mode, so that a difference of two sizes is what the candidate costs and not a change of mode."""
    draw = random.Random(7)
    letters = "".join(c * n for c, n in LETTERS)
    out = ""
    while len(out) < FILLER_BYTES:
        out += "".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) + draw.choice([" ", " ", " ", " ", "-", "/", ".", "_", f" 20{draw.randint(0, 30):02d}-"])
    return out[:FILLER_BYTES].encode()


class Novelty:
    """Marginal compressed bytes under a primed compressor."""

    def __init__(self, trained: bytes | None = None) -> None:
        words = zstandard.ZstdCompressionDict(trained or dictionary(), dict_type=zstandard.DICT_TYPE_FULLDICT)
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    def marginal(self, before: str, candidate: str, after: str) -> int:
        """Bytes that the candidate adds to the compressed surroundings, behind them or in its place: the fewer."""
        if candidate.isupper() and candidate.upper() != candidate.lower() and not any(map(str.isdigit, candidate)):
            candidate = candidate.lower()  # a name in capitals
        b, c, a = plain_text() + before.encode(), candidate.encode(), after.encode()
        return min(len(self.compressor.compress(x)) for x in (b + a + c, b + c + a)) - len(self.compressor.compress(b + a))

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        """Incompressible strings in sensitive context that no base span touches."""
        near = [(m.start() - NEAR, m.end() + NEAR) for m in CONTEXT.finditer(text)]
        if not near:
            return []
        # A literal costs one byte at most, so what is shorter than the least bytes can't reach them.
        runs = [c.span() for c in CANDIDATE.finditer(text) if c.end() - c.start() >= MIN_LENGTH * MIN_NOVELTY and not _IDENTIFIER.fullmatch(c[0].strip(".="))]
        out: list[Span] = []
        w = b = 0
        used = sorted((s, e) for s, _, e, _ in taken)
        until = 0  # where the base spans that begin before a run's end end
        for s, e in runs:  # whole runs, each once, even where a window's edge cuts them
            while w < len(near) and near[w][1] <= s:
                w += 1
            while b < len(used) and used[b][0] < e:
                until, b = max(until, used[b][1]), b + 1
            if w < len(near) and near[w][0] < e and until <= s:
                cost = self.marginal(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND])
                if cost >= MIN_NOVELTY * max(MIN_LENGTH, e - s):
                    out.append((s, "novel", e, round(cost / (e - s), 4)))
        return out


def _suspects(c: K.Chunk) -> list[int]:
    """Rows that hold a literal some pattern needs, or a run of 24 hexadecimal digits."""
    low = K.LOWER[c.buf].tobytes()
    at: list[int] = []
    for w in _LITERALS:
        i = low.find(w)
        while i >= 0:
            at.append(i)
            i = low.find(w, i + 1)  # one across the edge of two rows must not hide the next
    hexa = _HEX[c.buf]
    first, last = np.zeros(len(hexa), bool), np.zeros(len(hexa), bool)
    first[c.offsets[:-1][c.offsets[:-1] < len(hexa)]] = True
    last[c.offsets[1:][c.offsets[1:] > 0] - 1] = True
    # Runs end at the edges of rows.
    start = np.flatnonzero(hexa & (first | ~np.concatenate([[False], hexa[:-1]])))
    end = np.flatnonzero(hexa & (last | ~np.concatenate([hexa[1:], [False]])))
    at = np.concatenate([np.array(at, np.int64), start[end + 1 - start >= 24]])
    return np.unique(np.searchsorted(c.offsets, at, "right") - 1).tolist()


def _scan(texts: pa.Array, novelty: Novelty) -> list[list[Span]]:
    out: list[list[Span]] = [[] for _ in range(len(texts))]
    for c in K.chunks(texts):
        for r in _suspects(c):
            text = c.buf[c.offsets[r] : c.offsets[r + 1]].tobytes().decode("utf-8", "replace")
            base = base_spans(text)
            out[c.row + r] = sorted(base + novelty.spans(text, base), key=lambda x: (x[0], KINDS.index(x[1])))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("novelty", T.DoubleType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and spans, sorted by start and kind; ``novelty`` is in bytes a character and null for base kinds."""

    trained = dictionary()

    def make():
        novelty = Novelty(trained)
        return lambda texts: [pa.array([[{"kind": k, "start": s, "end": e, "novelty": v} for s, k, e, v in x] for x in _scan(texts, novelty)], _SPAN_ARROW)]

    return map_texts(docs, key, text, [T.StructField("spans", _SPAN)], make)


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret in ``text`` replaced by ``[SECRET]``; all rows and columns stay, in their order."""
    flag = fresh(docs, "redacted")

    trained = dictionary()

    def make():
        novelty = Novelty(trained)

        def run(texts: pa.Array) -> list[pa.Array]:
            clean: list[str | None] = []
            for t, spans in zip(texts, _scan(texts, novelty), strict=True):
                if not spans:
                    clean.append(None)
                    continue
                out, at, old = [], 0, t.as_py()
                for s, _, e, _ in spans:
                    if s >= at:
                        out += [old[at:s], "[SECRET]"]
                    at = max(at, e)
                clean.append("".join(out) + old[at:])
            return [pa.array(clean, pa.string())]

        return run

    out = add_columns(docs, text, [T.StructField(flag, T.StringType())], make)
    return out.withColumn(text, F.coalesce(F.col(flag), F.col(quoted(text)))).drop(flag)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base columns of one text, by plain matching (for tests)."""
    spans = sorted(base_spans(text or ""), key=lambda x: (x[0], KINDS.index(x[1])))
    n = [sum(k == kind for _, k, _, _ in spans) for kind in BASE_KINDS]
    return (*n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e, _ in spans).encode()).hexdigest())


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES: dict[str, str] = {}
