"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in its own order (an offset and a step taken from
hashes of its name); shards take turns claiming their next free slot until none is left. A key's hash picks
a slot, the slot its shard. When shards come or go, few keys move and loads stay even.

The table is filled on the driver, since its size is a parameter (at most ``MOST_SLOTS``), and reaches the
executors as a literal: a table of that many rows, broadcast whatever the data. Placement is one expression
and one broadcast join: nothing is shuffled, hot keys make no difference, and only built-in functions run.

Edge cases: a null key is placed as the empty text; repeated rows are placed alike; extra columns stay; with
names of this operator's own columns (slot, shard) replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
MOST_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's order of slots."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of its shard."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must have distinct names, one at least")
    if slots > MOST_SLOTS or not _is_prime(slots) or slots < len(shards):
        raise ValueError(f"{slots} slots: a prime of at most {MOST_SLOTS} is needed, no less than the shards")
    wishes = [preference(s, slots) for s in shards]
    at, step = [o for o, _ in wishes], [s for _, s in wishes]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + step[k]) % slots
            table[slot] = k
            at[k] = slot
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """rows with slot (long) and shard (string)."""
    table = ",".join(map(str, lookup_table(shards, slots)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    lookup = rows.sparkSession.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("_slot", "_k")).select(F.col("_slot").cast("long").alias("_slot"), F.get(names, F.col("_k").cast("int")).alias("_shard"))
    keyed = rows.withColumn("slot", slot_of(F.col(key), slots))
    kept = [keyed[c] for c in rows.columns if c not in ("slot", "shard")]
    return keyed.join(F.broadcast(lookup), keyed["slot"] == lookup["_slot"]).select(*kept, keyed["slot"], lookup["_shard"].alias("shard"))
