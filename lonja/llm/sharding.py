"""Shard placement by a permutation-filled lookup table (Maglev hashing, Eisenbud et al. 2016).

Every shard has a preference order over the slots of a prime-sized table: a start and a step from two hashes of its name
visit each slot once. Shards take turns claiming their best free slot until the table is full, so slots per shard differ
by one at most, and adding or removing a shard moves few slots beyond its own. A key's slot is its hash modulo the table
size; the table has a fixed number of rows, whatever the data, and is broadcast, so placement is one look-up and needs no
shuffle.

Edge cases
    A null key counts as one key. Repeated keys share a shard. Shard names must be distinct, at least one and no more than
    slots; the size must be prime. Extra columns are kept by ``place``; those called ``slot`` or ``shard``, as
    the columns that it adds are, come back as ``slot_input`` and ``shard_input``. Empty tables give empty results.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime; hundreds of slots a shard for a hundred shards keep shares within a percent.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position of its shard in ``shards``; the order of ``shards`` does not change who gets a slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or not _is_prime(slots):
        raise ValueError("distinct shard names, one at least and no more than slots, and a prime number of slots are needed")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    start = [xxhash.xxh64_intdigest(name.encode(), 1) % slots for name in shards]
    step = [xxhash.xxh64_intdigest(name.encode(), 2) % max(1, slots - 1) + 1 for name in shards]
    table, free, tried = [-1] * slots, slots, [0] * len(shards)
    while True:
        for shard in turns:
            slot = (start[shard] + tried[shard] * step[shard]) % slots
            while table[slot] >= 0:
                tried[shard] += 1
                slot = (start[shard] + tried[shard] * step[shard]) % slots
            table[slot] = shard
            tried[shard] += 1
            free -= 1
            if not free:
                return table


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``."""
    spark = rows.sparkSession
    names = [c if c not in ("slot", "shard") else f"{c}_input" for c in rows.columns]
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], "slot int, shard string")
    slot = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(slots)).cast("int")
    kept = rows.select(slot.alias("slot"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names, strict=True)])
    return kept.join(F.broadcast(table), "slot").select(*[F.col(f"`{n}`") for n in names], "slot", "shard")
