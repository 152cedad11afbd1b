"""Placement by a permutation-filled lookup table (Eisenbud et al. 2016); DataFrame operations only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 8191


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it. slots is a prime; names are distinct.

    Shards take turns; on its turn a shard claims the first free slot of its own permutation offset + j * skip. Shares
    differ by one slot at most, and a removed shard moves few slots besides its own.
    """
    if not names or len(set(names)) != len(names) or slots < max(2, len(names)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("needs distinct names and a prime number of slots, no fewer than names")
    at = [_number(f"offset:{n}") % slots for n in names]
    skip = [_number(f"skip:{n}") % (slots - 1) + 1 for n in names]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def place(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """Add slot and shard to each row, by the key's md5 modulo the slots and a broadcast lookup table of `slots` rows.

    The broadcast size depends on the parameter alone. Keys, not sources, are placed, so a hot source spreads evenly.
    Null keys count as the empty string. Repeated rows get the same shard. Columns named slot or shard are replaced.
    """
    names = [f"shard-{i:05d}" for i in range(shards)]
    filled = ",".join(map(str, lookup_table(names, slots)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))
    digest = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8)
    slot = F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int")
    return docs.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(table), "slot")


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The same rows for DuckDB, with the table as a list."""
    filled = ", ".join(map(str, lookup_table([f"shard-{i:05d}" for i in range(shards)], slots)))
    return f"""
WITH t AS (SELECT [{filled}] shards), d AS (SELECT doc_id, (('0x' || substring(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {slots})::INT slot FROM documents)
SELECT doc_id, slot, shards[slot + 1]::INT shard FROM d CROSS JOIN t
"""
