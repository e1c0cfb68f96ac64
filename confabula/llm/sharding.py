"""Placement of rows on shards through a permutation-filled lookup table (native Spark expressions only).

Each shard has its own permutation of the slots of a table of prime size, given by an offset and a step that its name's
digest fixes. The shards take turns; at its turn a shard claims the first slot of its permutation that is still free, so
shards differ by one slot at most, and a change of the shard list moves few slots besides those of the shard concerned.
A row is placed by the digest of its key: the slot is the digest modulo the table size, and a join with the broadcast
table gives the shard. The table has as many rows as it has slots, whatever the size of the data, so broadcasting it is
safe; placement needs no shuffle and no hot key can matter.

Defined cases: a null key counts as the text ``null``; repeated keys get the same shard; an empty table stays empty;
columns of the input named ``slot`` or ``shard`` are replaced by those of the result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHARDS = 32
#: A prime at least a hundred times the number of shards keeps shards within one per cent of each other.
SLOTS = 4099


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation of the slots."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in names) that owns each slot. slots: a prime, at least as many as names."""
    if not names or len(names) > slots or len(set(names)) < len(names):
        raise ValueError("between 1 and slots different names are needed")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    owner = [-1] * slots
    at = [preference(x, slots) for x in names]
    place = [offset for offset, _ in at]
    for turn in range(slots):
        shard = turn % len(names)
        while owner[place[shard]] >= 0:
            place[shard] = (place[shard] + at[shard][1]) % slots
        owner[place[shard]] = shard
    return owner


def lookup_frame(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    owners = ",".join(map(str, lookup_table(names, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard."""
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(lookup_frame(df.sparkSession, names, slots)), "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shard_names())


def op2_sql() -> str:
    """The table is filled again by recursion: one claimed slot in each step."""
    return f"""
    WITH RECURSIVE names AS (
      SELECT i, md5('shard-' || lpad(i::VARCHAR, 5, '0')) AS h FROM range({SHARDS}) t(i)),
    pref AS (
      SELECT i, ('0x' || substr(h, 1, 15))::BIGINT % {SLOTS} AS off, ('0x' || substr(h, 16, 15))::BIGINT % {SLOTS - 1} + 1 AS step FROM names),
    claims AS (
      SELECT 0 AS turn, -1::BIGINT AS slot, -1::BIGINT AS shard, list_transform(range({SLOTS}), lambda x: -1::BIGINT) AS owner
      UNION ALL
      SELECT turn + 1, s, turn % {SHARDS}, owner[:s] || [(turn % {SHARDS})::BIGINT] || owner[s + 2:]
      FROM (SELECT c.turn, c.owner, list_filter(list_transform(range({SLOTS}), lambda j: (p.off + j * p.step) % {SLOTS}), lambda x: c.owner[x + 1] < 0)[1] AS s
            FROM claims c JOIN pref p ON p.i = c.turn % {SHARDS} WHERE c.turn < {SLOTS})),
    lookup AS (SELECT slot, shard FROM claims WHERE turn > 0)
    SELECT d.doc_id, l.slot::INTEGER AS slot, l.shard::INTEGER AS shard
    FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) d
    JOIN lookup l ON l.slot = d.slot"""
