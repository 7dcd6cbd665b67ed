"""Sharding by a permutation-filled lookup table.

A table of a prime number of slots is filled by the shards in turn: each turn
a shard claims the first free slot of its own permutation of the slots, which
follows from two hashes of its name (an offset and a skip; the prime makes
every skip a full cycle).  Every shard gets the same number of slots but for
one, and a shard that comes or goes moves few other slots.  A row's slot is a
hash of its key modulo the table's size.

The table depends on the shards only and has a bounded size; it is joined by
broadcast, so placement is one lookup a row, in generated code, without a
shuffle.  ``write_shards`` writes the shards with a rebalancing step that
splits large ones.

A null key hashes as the empty string.  Equal keys go to the same shard.
Columns of the input are kept; the two new ones get fresh names on a clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, quoted, table

SHARDS = tuple(f"shard-{i:03d}" for i in range(32))
#: A prime of about 100 slots for each shard keeps shares within one per cent.
SLOTS = 3203
MOST_SLOTS = 1 << 20


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)  # noqa: S324


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that claimed it."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must be distinct and at least one")
    if not len(shards) <= slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    place = [_hash(f"offset:{s}") % slots for s in shards]
    skip = [_hash(f"skip:{s}") % (slots - 1) + 1 if slots > 1 else 0 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[place[i]] >= 0:
            place[i] = (place[i] + skip[i]) % slots
        owner[place[i]] = i
    return owner


def _table(spark: SparkSession, shards: tuple[str, ...], slots: int) -> DataFrame:
    owners = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")).alias("slot", "i"))
    names = F.array(*map(F.lit, shards))
    return owners.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("i").cast("int") + 1).alias("shard"))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the columns ``slot`` and ``shard``."""
    slot, shard = fresh(df, "slot"), fresh(df, "shard")
    text = F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    owners = _table(df.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    return df.withColumn(slot, F.pmod(number, F.lit(slots))).join(F.broadcast(owners), slot).select(*(F.col(quoted(c)) for c in df.columns), slot, shard)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """Write df partitioned by shard; AQE splits large shards into several files and joins small ones."""
    placed = assign_shards(df, key, shards, slots)
    shard = placed.columns[-1]
    placed.hint("rebalance", F.col(quoted(shard))).write.partitionBy(shard).parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


_NUMBER = "('0x' || substr(md5({}), 1, 12))::BIGINT"
SQL = f"""
WITH RECURSIVE s AS (SELECT list({_NUMBER.format("'offset:' || n")} % {SLOTS} ORDER BY n) AS o, list({_NUMBER.format("'skip:' || n")} % {SLOTS - 1} + 1 ORDER BY n) AS k
 FROM (SELECT 'shard-' || lpad(i::VARCHAR, 3, '0') AS n FROM range({len(SHARDS)}) r(i))),
f(turn, own) AS (SELECT 0, list_transform(range({SLOTS}), lambda x: -1) UNION ALL
 SELECT turn + 1, own[1:p] || [turn % {len(SHARDS)}] || own[p + 2:] FROM
 (SELECT turn, own, list_filter(list_transform(range({SLOTS}), lambda j: (o[turn % {len(SHARDS)} + 1] + j * k[turn % {len(SHARDS)} + 1]) % {SLOTS}), lambda q: own[q + 1] = -1)[1] AS p FROM f, s WHERE turn < {SLOTS})),
t AS MATERIALIZED (SELECT unnest(own) AS i, unnest(range({SLOTS})) AS slot FROM f WHERE turn = {SLOTS})
SELECT doc_id, d.slot, 'shard-' || lpad(i::VARCHAR, 3, '0') AS shard FROM (SELECT doc_id, {_NUMBER.format("coalesce(doc_id::VARCHAR, '')")} % {SLOTS} AS slot FROM documents) d JOIN t USING (slot)
"""

QUERIES = {"op5_sharding": op5_sharding}
ORACLES = {"op5_sharding": SQL}
