"""Trie of conversation prefixes, by rolling fingerprints.

A node is a distinct sequence of the first d turns (role, text) of some
conversation; its members are the conversations that start with it.

* Turns become digests at once (SHA-256 of role and text), so texts never
  move in a shuffle.
* Turns are sorted by conversation and place into ranges.  In each range a
  NumPy scan numbers the turns of a conversation and sums their polynomial
  prefix fingerprints (two moduli under 2^31).  A conversation that goes on in
  the next range takes up what the ranges before left of it: one small state a
  range, combined in order.  So a conversation of any length is spread out.
* Turns of equal depth and fingerprint are a candidate group.  Every group is
  verified turn by turn: all members must have their representative's turn
  and come from one and the same group, as least and greatest digest and
  parent show in the same aggregate.  By induction over depths, a group that
  passes has equal prefixes.  Conversations of groups that do not pass are
  keyed by a chain of SHA-256 digests from there on, which splits them.
* Sums over subtrees: a node's own figures are put on the turn of its smallest
  member, summed from each turn to the end of the conversation, and added up
  over all turns of a node.  There is no loop over depths.

Where a key is looked up that many rows share, the frequent keys are joined
by broadcast: keys of more than 1 row in ``MANY`` are fewer than ``MANY``.

Ties of the order column are settled by the turns' digests.  Null roles and
texts count as empty; rows without a conversation are left out.  Turns with
a null order come first.  Repeated rows are turns of their own.  An empty
table gives no node, not even the root.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded, quoted, table, written

#: Moduli (primes under 2^31) and bases of the prefix fingerprints.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 69069069)
#: Bound of the number of keys that are joined by broadcast.
MANY = 10_000


def turn_digests(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, digest, chars) of every turn with a conversation."""
    r, t = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.char_length(r).cast("string"), r, t).cast("binary"), 256))
    kept = turns.where(F.col(quoted(conv)).isNotNull())
    return kept.select(F.col(quoted(conv)).cast("long").alias("conv"), F.col(quoted(turn)).alias("turn"), digest.alias("digest"), F.char_length(t).cast("long").alias("chars"))


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo modulus, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, modulus)) % np.uint64(modulus)
        have += more
    return out


def _scan(moduli: tuple[int, int]):
    """Task of one range: each turn's place among its conversation's turns here, and the fingerprints of its prefix from here on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, at, open_ = TaskContext.get().partitionId(), 0, None  # of the conversation that the last batch ended in
        carry = [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy(zero_copy_only=False)
            start = np.append(0, np.flatnonzero(np.diff(conv)) + 1)
            size = np.diff(np.append(start, len(conv)))
            place = np.arange(len(conv)) - np.repeat(start, size)
            goes_on = conv[0] == open_
            digests = np.frombuffer(b"".join(b.column(2).to_pylist()), ">u8").reshape(-1, 4)
            sums = []
            for j, (m, base) in enumerate(zip(moduli, BASES, strict=True)):
                u = np.uint64(m)
                value = digests[:, j].astype(np.uint64) % u * _powers(base, m, int(size.max()))[place] % u
                total = np.cumsum(value)  # under 2^31 a turn: no batch is long enough to overflow
                before = np.repeat(total[start] - value[start], size)
                s = (total - before) % u
                if goes_on:  # the turns here stand behind ``at`` others
                    s[: size[0]] = (s[: size[0]] * np.uint64(pow(base, at, m)) + np.uint64(carry[j])) % u
                carry[j] = int(s[-1])
                sums.append(s.astype(np.int64))
            if goes_on:
                place[: size[0]] += at
            open_, at = conv[-1], int(place[-1]) + 1
            n = len(conv)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, piece)), pa.array(place), *map(pa.array, sums), pa.array(np.append(start[1:], n)[np.searchsorted(start, np.arange(n), "right") - 1] - 1 == np.arange(n))], ["conv", "turn", "digest", "chars", "piece", "place", "s0", "s1", "ends"])

    return run


def number_turns(digests: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Adds depth (from 1), the prefix fingerprints f0 and f1 with the turn, g0 and g1 without it, and the range ``piece``; written."""
    spark = digests.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*digests.schema.fields, T.StructField("piece", T.LongType()), *(T.StructField(x, T.LongType()) for x in ("place", "s0", "s1")), T.StructField("ends", T.BooleanType())])
    order = ["conv", F.col("turn").asc_nulls_first(), "digest"]
    local = written(bounded(digests.repartitionByRange(parts, *order).sortWithinPartitions(*order)).mapInArrow(_scan(moduli), schema))
    # one row a range and conversation at its end
    last = local.where("ends").groupBy("piece").agg(F.max_by(F.struct("conv", "place", "s0", "s1"), F.struct("conv", "place")).alias("l"), F.min("conv").alias("first")).orderBy("piece").collect()
    carried, now = [], None
    for row in last:
        if now and row["first"] == now[0]:
            carried.append((row["piece"], now[0], now[1], now[2], now[3], pow(BASES[0], now[1], moduli[0]), pow(BASES[1], now[1], moduli[1])))
        l = row["l"]
        if now and l["conv"] == now[0]:
            now = (now[0], now[1] + l["place"] + 1, (now[2] + pow(BASES[0], now[1], moduli[0]) * l["s0"]) % moduli[0], (now[3] + pow(BASES[1], now[1], moduli[1]) * l["s1"]) % moduli[1])
        else:
            now = (l["conv"], l["place"] + 1, l["s0"], l["s1"])
    carry = spark.createDataFrame(carried, "piece long, conv long, before long, c0 long, c1 long, b0 long, b1 long")
    joined = local.join(F.broadcast(carry), ["piece", "conv"], "left")  # at most one row a range

    def whole(j: int, s: Column) -> Column:
        return F.when(F.col("before").isNull(), s).otherwise((F.col(f"c{j}") + F.col(f"b{j}") * s) % moduli[j])

    out = joined.select("conv", "turn", "digest", "chars", "piece", (F.coalesce("before", F.lit(0)) + F.col("place") + 1).alias("depth"), *(whole(j, F.col(f"s{j}")).alias(f"f{j}") for j in (0, 1)))
    back = F.lag(F.struct("f0", "f1")).over(Window.partitionBy("piece", "conv").orderBy("depth"))
    out = out.withColumn("back", back).join(F.broadcast(carry.select("piece", "conv", "c0", "c1")), ["piece", "conv"], "left")
    return written(out.withColumns({f"g{j}": F.coalesce(F.col(f"back.f{j}"), F.col(f"c{j}"), F.lit(0)) for j in (0, 1)}).drop("back", "c0", "c1"))


def _look_up(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows left-joined with found, whose column ``weight`` says how many rows have its key, ``total`` in all."""
    often = F.broadcast(found.where(F.col(weight) * MANY > total).withColumn("often", F.lit(True)))
    values = [c for c in found.columns if c not in keys]
    first = rows.join(often, keys, "left")
    rest = first.where("often IS NULL").drop("often", *values).join(found.where(F.col(weight) * MANY <= total), keys, "left")
    return first.where("often").drop("often").unionByName(rest)


def _split(turns: DataFrame, bad: DataFrame) -> DataFrame:
    """turns with the key ``chain``: empty, or the digest of the whole prefix from the first group of ``bad`` in a conversation on."""
    group = ["depth", "f0", "f1"]
    hit = turns.join(bad.select(*group), group, "left_semi").groupBy("conv").agg(F.min("depth").alias("since"))
    listed = turns.join(hit.select("conv"), "conv", "left_semi").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "digest"))).alias("ds"))

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, ds in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, depth, said = b"", [], []
                for d in ds:
                    h = hashlib.sha256(h + d["digest"]).digest()
                    depth.append(d["depth"])
                    said.append(h)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(depth), pa.int64()), pa.array(depth, pa.int64()), pa.array(said, pa.binary())], ["conv", "depth", "said"])

    exact = bounded(listed).mapInArrow(chains, "conv long, depth long, said binary").join(hit, "conv").where("depth >= since").drop("since")
    before = exact.select("conv", (F.col("depth") + 1).alias("depth"), F.col("said").alias("prior"))
    joined = turns.drop("chain", "chain_before").join(exact, ["conv", "depth"], "left").join(before, ["conv", "depth"], "left")
    return written(joined.withColumns({"chain": F.coalesce("said", F.lit(b"")), "chain_before": F.coalesce("prior", F.lit(b""))}).drop("said", "prior"))


def prefix_trie(digests: DataFrame, conversations: DataFrame | None = None, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``digests`` as from ``turn_digests``; ``conversations`` (a column conv) names those that have no turn as well.
    ``saved_tokens`` sums (members - 1) times the code points of a node's last text over its subtree.
    """
    turns = number_turns(digests, moduli).withColumns({"chain": F.lit(b""), "chain_before": F.lit(b"")})
    # the parent's key: fingerprints without the last turn, the digest chain where groups had to be split
    parent = F.struct("g0", "g1", "chain_before")
    key = ["depth", "f0", "f1", "chain"]

    def groups(rows: DataFrame) -> DataFrame:
        sums = [F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min(parent).alias("parent"), F.max(parent).alias("parent_most"), F.min("digest").alias("turn_least"), F.max("digest").alias("turn_most")]
        return written(rows.groupBy(*key).agg(*sums))

    nodes = groups(turns)
    bad = nodes.where("turn_least <> turn_most OR parent <> parent_most")
    if not bad.isEmpty():
        turns = _split(turns, bad)
        nodes = groups(turns)
    total = turns.count()
    if total == 0 and (conversations is None or conversations.isEmpty()):
        return _empty(digests.sparkSession)

    # children of each node, and each node's parent
    of = F.struct(F.col("depth"), F.col("f0"), F.col("f1"), F.col("chain"))
    ups = nodes.where("depth > 1").select((F.col("depth") - 1).alias("depth"), F.col("parent.g0").alias("f0"), F.col("parent.g1").alias("f1"), F.col("parent.chain_before").alias("chain"), F.col("conv_id").alias("child"))
    children = ups.groupBy(*key).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.select(*key, "conv_id", "n_convs", "chars", "parent").join(children, key, "left").fillna(0, ["n_children"]))
    parents = _look_up(ups, nodes.where("n_children > 0").select(*key, F.col("conv_id").alias("parent_conv_id"), "n_children"), key, "n_children", max(total, 1))
    parents = parents.select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent_conv_id")

    # figures of each node on the turn of its smallest member, summed to the end of the conversation: all of it less what stands before
    own = nodes.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"))
    placed = written(turns.select("conv", "piece", *key).join(own, ["conv", "depth"], "left").fillna(0, ["saved", "leaf"]))
    here = Window.partitionBy("piece", "conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(*key, "conv", "piece", *(F.sum(c).over(here).alias(c) for c in ("saved", "leaf")))
    edges = placed.groupBy("conv", "piece").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    cut = edges.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1")  # conversations across ranges: at most one a range
    later = Window.partitionBy("conv").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    after = edges.join(F.broadcast(cut.select("conv")), "conv").select("conv", "piece", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("s", "l")))
    suffix = local.join(F.broadcast(after), ["conv", "piece"], "left").fillna(0, ["s", "l"])
    below = suffix.groupBy(*key).agg(F.sum(F.col("saved") + F.col("s")).alias("saved_tokens"), F.sum(F.col("leaf") + F.col("l")).alias("n_leaves"))

    # conversations that end in a node, in order; the digest of a node is made as its members stream by
    lasts = turns.groupBy("conv").agg(F.max_by(of, "depth").alias("node"))
    if conversations is not None:
        lasts = conversations.select(F.col(conversations.columns[0]).cast("long").alias("conv")).where("conv IS NOT NULL").distinct().join(lasts, "conv", "left")
    lasts = written(lasts.select("conv", *(F.coalesce(F.col(f"node.{c}"), F.lit(b"" if c == "chain" else 0)).alias(c) for c in key)))
    ends = bounded(lasts.repartition(*key).sortWithinPartitions(*key, "conv")).mapInArrow(_digest_members, "depth long, f0 long, f1 long, chain binary, ends_sha256 string")

    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(below, key).join(ends, key, "left").join(parents, ["conv_id", "depth"], "left")
    top = lasts.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    sums = nodes.agg(F.coalesce(F.sum(F.when(F.col("depth") == 1, 1)), F.lit(0)).alias("n_children"), F.greatest(F.coalesce(F.sum(F.when(F.col("n_children") == 0, 1)), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("chars")), F.lit(0)).alias("saved_tokens"))
    root = top.crossJoin(sums).join(ends.where("depth = 0").select("ends_sha256"), F.lit(True), "left")  # one row each
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    least = top.select(F.col("conv_id").alias("least"))
    out = out.crossJoin(F.broadcast(least)).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("least")).otherwise(F.col("parent_conv_id")))
    root = root.withColumns({"depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    both = out.select(*columns).unionByName(root.select(*columns))
    return both.select(*(F.col(c).cast("long") for c in columns[:-1]), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def _empty(spark: SparkSession) -> DataFrame:
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return spark.createDataFrame([], ", ".join(f"{n} long" for n in names) + ", ends_sha256 string")


def _digest_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest for every run of equal keys of a sorted stream; holds one digest's state, not its members."""
    key, state = None, None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["depth", "f0", "f1", "chain", "ends_sha256"])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv = b.column(0).to_pylist()
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
        change = np.zeros(n, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        start = np.flatnonzero(change).tolist()
        done = []
        for s, e in zip(start, [*start[1:], n], strict=True):
            k = (*(int(c[s]) for c in cols[:3]), cols[3][s])
            said = ",".join(map(str, conv[s:e])).encode()
            if k == key:
                state.update(b"," + said)
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(said)
        yield rows(done)
    if key is not None:
        yield rows([(*key, state.hexdigest())])


#: Conversations that share a start in the registered query come in blocks of so many ids, and share fewer than HEADS turns.
BLOCK, HEADS = 100, 6


def with_shared_heads(digests: DataFrame) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % 100, then its own after its first h; h = crc32(c) % 6."""
    numbered = number_turns(digests).select("conv", "digest", "chars", (F.col("depth") - 1).alias("at"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    convs = numbered.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % BLOCK).alias("base"), h.alias("h"))
    first = numbered.where(F.col("at") < HEADS - 1).select(F.col("conv").alias("base"), "digest", "chars", "at")
    heads = convs.join(first, "base").where(F.col("at") < F.col("h"))
    tails = numbered.where(F.col("at") >= h)
    columns = ["conv", F.col("at").alias("turn"), "digest", "chars"]
    return heads.select(*columns).unionByName(tails.select(*columns))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = turn_digests(table(spark, sf_dir, "conversations"))
    return prefix_trie(with_shared_heads(digests), digests.select("conv"))


def _sql() -> str:
    from .periodic_runs import CRC, CRC_TABLE

    return f"""
WITH t0 AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT DISTINCT c, c - c % 100 AS b, {CRC.format("c")} % 6 AS h FROM t0, {CRC_TABLE}),
rb AS (SELECT cs.c, i, r, x FROM cs JOIN t0 ON t0.c = cs.b AND i < h UNION ALL SELECT cs.c, i, r, x FROM cs JOIN t0 ON t0.c = cs.c AND i >= h),
ls AS (SELECT c, list(length(r) || ':' || r || x ORDER BY i) AS ts, list(length(x) ORDER BY i) AS ns FROM rb GROUP BY c),
al AS (SELECT cs.c, coalesce(ts, []) AS ts, ns FROM cs LEFT JOIN ls USING (c)),
mb AS MATERIALIZED (SELECT c, d, md5(ts[1:d]::VARCHAR) || '/' || d AS k, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, d = len(ts) AS is_end FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM al)),
nd AS MATERIALIZED (SELECT k, d, min(c) AS v, count(*) AS m, any_value(n) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '')) AS e FROM mb GROUP BY k, d),
pa AS MATERIALIZED (SELECT nd.k, a.k AS up, a2.v AS pv FROM nd JOIN mb a ON a.c = nd.v AND a.d = nd.d - 1 JOIN nd a2 ON a2.k = a.k),
ch AS (SELECT up AS k, count(*) AS n_children FROM pa GROUP BY up),
su AS (SELECT a.k, sum((nd.m - 1) * nd.n) AS saved, count(*) FILTER (ch.k IS NULL) AS leaves FROM nd JOIN mb a ON a.c = nd.v AND a.d <= nd.d LEFT JOIN ch ON ch.k = nd.k GROUP BY a.k)
SELECT nd.v::BIGINT AS conv_id, nd.d::BIGINT AS depth, pa.pv::BIGINT AS parent_conv_id, nd.m::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, e AS ends_sha256
FROM nd LEFT JOIN pa USING (k) LEFT JOIN ch USING (k) JOIN su USING (k)
"""


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": _sql()}
