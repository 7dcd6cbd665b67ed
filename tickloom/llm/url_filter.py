"""URL filter: host and path rules, and for all other URLs a likelihood ratio of character models.

A rule (host, path, verdict) fits its host and all subdomains where the URL's
path starts with the rule's; of several the longest decides.  URLs that the
rules accept or reject, and those whose host has one of ``reject_words`` as a
part between dots and hyphens (weak labels; a URL that its rule accepts in
spite of such a word trains nothing), train two variable-order Markov models
of the characters of host and path.

A model's chance of a character after its context is interpolated over all
context lengths from none to ``ORDER`` (Witten-Bell): a context seen n times
with t kinds of followers gives weight t / (n + t) to the next shorter one, so
a context never seen passes on the shorter one's chance.  Digits count as one
character, letters A-Z as a-z, everything outside printable ASCII as ``~``.

Counting takes every labelled URL: character grams are counted per class over
the whole table, then each gram's log ratio (rejected over accepted, in
millionths) is computed once by joins among the tables of distinct grams.  A
URL's score is the sum over its characters divided by their number.  One
labelled URL in ``HELD`` (by a hash of the URL) trains nothing and calibrates
the threshold: the bin edge of the score with the greatest difference of the
shares of rejected and of accepted URLs at or above it; of equal ones the
nearest to 0, then the larger.  Without held-out URLs of both classes it is 0;
without training URLs of both classes all scores are 0 and nothing is blocked
but by rules.

All steps are SQL functions.  Grams that stand in most URLs are frequent keys:
counts combine before they move, and scores join on a gram and one of ``SALT``
numbers, unless Spark finds the distinct grams small enough to broadcast.

Null URLs and URLs without ``://`` have an empty host and path; the models
judge the empty text like any other.  Repeated rows give repeated results.
Other columns are not read, whatever their names; a key of the name of a
result column is returned under that name, the result under a fresh one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, quoted, table, written

#: Rules of the registered query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words of a host that mark it as rejected for training.
REJECT_WORDS = ("adult", "ads", "bet", "bets", "casino", "gambling", "loans", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
#: Longest context of the models.
ORDER = 4
#: One labelled URL in so many calibrates.
HELD = 4
#: Width of the score's bins in millionths of a nat a character.
BIN = 10_000
SALT = 8
#: Kinds of characters: printable ASCII without A-Z and nine of the digits, and the end.
ALPHABET = 95 - 26 - 9 + 1

_START, _END = "\x02", "\x03"


def _parts(url: Column) -> tuple[Column, Column]:
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def _rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...], value: int | None) -> Column:
    """The longest fitting rule's text (``value`` None) or its part of that number; null if none fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = (F.concat(F.lit("."), host).endswith("." + r[0])) & path.startswith(r[1])
        out = F.when(fits, F.lit(r[0] + r[1] if value is None else r[value])).otherwise(out)
    return out


def _text(host: Column, path: Column) -> Column:
    t = F.translate(F.concat(host, path), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(t, r"[^\x20-\x7E]", "~"), "[0-9]", "0")


def _grams(text: Column) -> Column:
    """Every character and the end, each behind its ORDER characters before (a start mark where there are fewer)."""
    padded = F.concat(F.lit(_START * ORDER), text, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def _log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, units): millionths of log P(rejected) - log P(accepted) of each gram's last character after its context."""
    spark = counts.sparkSession
    chance = spark.range(1).select(F.lit("").alias("gram"), *(F.lit(1.0 / ALPHABET).alias(f"p{c}") for c in "ar"))
    for k in range(ORDER + 1):
        level = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in "ar"))
        context = level.groupBy(F.substring("gram", 1, k).alias("context")).agg(*(F.sum(f"n{c}").alias(f"s{c}") for c in "ar"), *(F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"t{c}") for c in "ar"))
        shorter = chance.select(F.col("gram").alias("less"), *(F.col(f"p{c}").alias(f"q{c}") for c in "ar"))
        less = F.substring("gram", 2, k) if k else F.lit("")
        both = level.withColumn("context", F.substring("gram", 1, k)).withColumn("less", less).join(context, "context").join(shorter, "less")
        chance = both.select("gram", *(F.when(F.col(f"s{c}") == 0, F.col(f"q{c}")).otherwise((F.col(f"n{c}") + F.col(f"t{c}") * F.col(f"q{c}")) / (F.col(f"s{c}") + F.col(f"t{c}"))).alias(f"p{c}") for c in "ar"))
    return chance.select("gram", F.round((F.log("pr") - F.log("pa")) * 1_000_000).cast("long").alias("units"))


def judge_urls(
    df: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, reject_words: tuple[str, ...] = REJECT_WORDS, threshold: float | None = None
) -> DataFrame:
    """Key, host, path, rule, verdict, and the models' score (nats a character, higher: likelier rejected) and threshold.

    ``threshold`` (nats a character) takes the place of the calibrated one.
    """
    if any(v not in ("allow", "block") for _, _, v in rules):
        raise ValueError("a rule's verdict is allow or block")
    u = F.col("u")
    host, path = _parts(u)
    rows = df.select(F.col(quoted(key)).alias("k"), F.col(quoted(url)).cast("string").alias("u")).groupBy("k", "u").count()
    rows = rows.select("k", "u", "count", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", _rule(F.col("host"), F.col("path"), rules, None)).withColumn("said", _rule(F.col("host"), F.col("path"), rules, 2))
    marked = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, reject_words))) if reject_words else F.lit(False)
    label = F.when(F.col("said") == "block", "r").when(marked, F.when(F.col("said").isNull(), "r")).when(F.col("said") == "allow", "a")
    held = F.conv(F.substring(F.md5(u.cast("binary")), 1, 8), 16, 10).cast("long") % HELD == 0
    # numbered once and written, so that the number stays with its row whatever is computed again
    base = written(rows.select("k", "host", "path", "rule", "said", "count", label.alias("label"), held.alias("held"), _text(F.col("host"), F.col("path")).alias("text"), F.monotonically_increasing_id().alias("id")))

    trains = [F.when(F.col("label").eqNullSafe(c) & ~F.col("held"), F.col("count")).otherwise(0).alias(f"n{c}") for c in "ar"]
    counts = base.select(F.explode(_grams(F.col("text"))).alias("gram"), *trains).groupBy("gram").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in "ar"))
    units = written(_log_ratios(written(counts)))
    salted = units.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    spread = base.select("id", F.explode(_grams(F.col("text"))).alias("gram"), F.pmod(F.col("id"), F.lit(SALT)).cast("int").alias("salt"))
    sums = spread.join(salted, ["gram", "salt"]).groupBy("id").agg(F.sum("units").alias("units"))
    scored = base.join(sums, "id").withColumn("units", F.floor(F.col("units") / (F.char_length("text") + 1)))
    trained = base.agg(*(F.coalesce(F.max((F.col("label") == c) & ~F.col("held")), F.lit(False)).alias(c) for c in "ar")).first()
    if not (trained["a"] and trained["r"]):
        scored = scored.withColumn("units", F.lit(0).cast("long"))
    scored = written(scored)
    edge = round(threshold * 1_000_000) if threshold is not None else _calibrated(scored) if trained["a"] and trained["r"] else BIN
    verdict = F.coalesce("said", F.when(F.col("units") >= edge, "block").otherwise("allow"))
    out = scored.select(F.col("k").alias(key), "host", "path", "rule", verdict.alias("verdict"), (F.col("units") / 1_000_000).alias("score"), F.lit(edge / 1_000_000).alias("threshold"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("_copy"))
    names = ["host", "path", "rule", "verdict", "score", "threshold"]
    if key not in names:
        return out.drop("_copy")
    wanted = fresh(out, key)
    return out.toDF(key, *(wanted if n == key else n for n in names), "_copy").drop("_copy")


def _calibrated(scored: DataFrame) -> int:
    """The bin edge that parts held-out rejected from held-out accepted URLs best; bins are as many as scores are wide, not as rows."""
    held = scored.where("held AND label IS NOT NULL").groupBy(F.floor(F.col("units") / BIN).alias("bin")).agg(*(F.sum(F.when(F.col("label") == c, F.col("count")).otherwise(0)).alias(c) for c in "ar"))
    bins = sorted(held.collect())
    a, r = (sum(x[c] for x in bins) for c in "ar")
    if not a or not r:
        return 0
    best, above_a, above_r = (0, 0, 0), 0, 0
    for x in reversed(bins):
        above_a, above_r = above_a + x["a"], above_r + x["r"]
        best = max(best, (above_r * a - above_a * r, -abs(x["bin"]), x["bin"]))
    return best[2] * BIN


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    rule = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}')" for h, p, _ in rule]
    case = "CASE " + " ".join(f"WHEN {f} THEN '{{}}'" for f in fits) + " END"
    words = ", ".join(f"'{w}'" for w in REJECT_WORDS)
    levels = ["l0 AS (SELECT '' AS gram, 1.0::DOUBLE / %d AS pa, 1.0::DOUBLE / %d AS pr)" % (ALPHABET, ALPHABET)]
    for k in range(ORDER + 1):
        levels.append(f"""g{k} AS (SELECT substr(gram, {ORDER + 1 - k}, {k + 1}) AS gram, sum(na)::DOUBLE AS na, sum(nr)::DOUBLE AS nr FROM counts GROUP BY 1),
c{k} AS (SELECT substr(gram, 1, {k}) AS context, sum(na) AS sa, sum(nr) AS sr, count(*) FILTER (na > 0) AS ta, count(*) FILTER (nr > 0) AS tr FROM g{k} GROUP BY 1),
l{k + 1} AS MATERIALIZED (SELECT g.gram, CASE WHEN sa = 0 THEN l.pa ELSE (na + ta * l.pa) / (sa + ta) END AS pa, CASE WHEN sr = 0 THEN l.pr ELSE (nr + tr * l.pr) / (sr + tr) END AS pr
 FROM g{k} g JOIN c{k} c ON substr(g.gram, 1, {k}) = c.context JOIN l{k} l ON l.gram = {f"substr(g.gram, 2, {k})" if k else "''"})""")
    return rf"""
WITH p AS (SELECT row_number() OVER () AS id, page_id, url, coalesce({low.format(f"regexp_extract(url, '{shape}', 1)")}, '') AS host, coalesce(regexp_extract(url, '{shape}', 2), '') AS path FROM pages),
q AS (SELECT *, {case.format(*(h + p for h, p, _ in rule))} AS rule, {case.format(*(v for _, _, v in rule))} AS said, list_has_any(regexp_split_to_array(host, '[.-]'), [{words}]) AS marked FROM p),
base AS MATERIALIZED (SELECT *, CASE WHEN said = 'block' OR said IS NULL AND marked THEN 'r' WHEN said = 'allow' AND NOT marked THEN 'a' END AS label,
 coalesce(('0x' || substr(md5(url), 1, 8))::BIGINT % {HELD} = 0, false) AS held, regexp_replace(regexp_replace({low.format("host || path")}, '[^\x20-\x7E]', '~', 'g'), '[0-9]', '0', 'g') AS text FROM q),
e AS MATERIALIZED (SELECT id, label, held, unnest(list_transform(range(1, length(text) + 2), lambda i: substr(repeat(chr(2), {ORDER}) || text || chr(3), i, {ORDER + 1}))) AS gram FROM base),
counts AS MATERIALIZED (SELECT gram, count(*) FILTER (label = 'a' AND NOT held) AS na, count(*) FILTER (label = 'r' AND NOT held) AS nr FROM e GROUP BY gram),
{", ".join(levels)},
scored AS MATERIALIZED (SELECT b.*, floor(u::DOUBLE / (length(text) + 1))::BIGINT AS units FROM base b JOIN (SELECT id, sum(round((ln(pr) - ln(pa)) * 1000000)::BIGINT) AS u FROM e JOIN l{ORDER + 1} USING (gram) GROUP BY id) s USING (id)),
bins AS (SELECT floor(units::DOUBLE / {BIN})::BIGINT AS bin, count(*) FILTER (label = 'a') AS a, count(*) FILTER (label = 'r') AS r FROM scored WHERE held AND label IS NOT NULL GROUP BY 1),
cum AS (SELECT bin, sum(r) OVER w * sum(a) OVER () - sum(a) OVER w * sum(r) OVER () AS gain, sum(a) OVER () AS ta, sum(r) OVER () AS tr FROM bins WINDOW w AS (ORDER BY bin DESC)),
edge AS (SELECT bin FROM (SELECT bin, gain FROM cum WHERE ta > 0 AND tr > 0 UNION ALL SELECT 0, 0) ORDER BY gain DESC, abs(bin), bin DESC LIMIT 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN units >= bin * {BIN} THEN 'block' ELSE 'allow' END) AS verdict FROM scored, edge
"""


QUERIES = {"op12_url_filter": op12_url_filter}
ORACLES = {"op12_url_filter": _sql()}
