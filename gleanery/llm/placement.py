"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, given by an offset and a step. The shards take
turns claiming their next free slot until the table is full, so their numbers of slots differ by one at most (a shard of
weight w takes w turns in a row), and taking a shard away moves few of the other keys. The table is as large as a
parameter says, whatever the data; placing a row is one hash and one look-up in a broadcast table.

A null key goes by the hash of the empty string; equal keys share a shard; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
#: A table beyond this size isn't broadcast.
MAX_SLOTS = 5_000_011
#: Hex digits of md5 that make a row's number.
DIGITS = 15


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's walk through the slots."""
    words = hashlib.blake2b(shard.encode(), digest_size=16).digest()
    return int.from_bytes(words[:8], "little") % slots, int.from_bytes(words[8:], "little") % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> list[int]:
    """The owner (position in shards) of every slot."""
    if not is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError("the table's size must be a prime of at most MAX_SLOTS")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least and one a slot at most")
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    walks = [preference(s, slots) for s in shards]
    at = [offset for offset, _ in walks]
    owner = [-1] * slots
    left = slots
    while left:
        for k, (_, step) in enumerate(walks):
            for _ in range(turns[k]):
                slot = at[k]
                while owner[slot] >= 0:
                    slot = (slot + step) % slots
                owner[slot] = k
                at[k] = (slot + step) % slots
                left -= 1
                if not left:
                    return owner
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A number below slots from the md5 of the key as text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long"), F.lit(slots)).cast("long")


def place(
    rows: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS,
    weights: Mapping[str, int] | None = None, slot: str = "slot", shard: str = "shard",
) -> DataFrame:
    """rows with their slot and shard (the shard's position in the given order); columns of these names give way to them."""
    spark = rows.sparkSession
    owners = ",".join(map(str, lookup_table(shards, slots, weights)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("at", "owner"))
    table = table.select(F.col("at").cast("long").alias("at"), F.col("owner").cast("long").alias("owner"))
    kept = [F.col(f"row.`{c}`") for c in rows.columns if c not in (slot, shard)]
    keyed = rows.select(F.struct("*").alias("row"), slot_of(rows[key], slots).alias("at"))
    joined = keyed.join(F.broadcast(table), "at")
    return joined.select(*kept, F.col("at").alias(slot), F.col("owner").alias(shard))


def write_shards(rows: DataFrame, path: str, shards: Sequence[str], key: str = "doc_id", files: int = 1, **options) -> None:
    """One folder a shard, each of so many files; the rows of a shard are dealt over its files by the hash of the key."""
    placed = place(rows, shards, key, **options)
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(files))
    placed.repartition(max(1, len(shards) * files), "shard", part).write.partitionBy("shard").parquet(path)
