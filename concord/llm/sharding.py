"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table, a prime well above the number of shards. The table has so many rows whatever the data, so it may
#: be sent to every executor.
SLOTS = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot.

    Each shard prefers the slots ``offset + k * skip`` in this order; by turns each takes its first free one. Shares
    differ by one slot at most, and a shard that comes or goes moves little more than its own slots.
    """
    if not 0 < len(set(shards)) == len(shards) < slots:
        raise ValueError("shard names must be distinct, and fewer than the slots")
    table: list[str | None] = [None] * slots
    at = [_number(f"offset {s}") % slots for s in shards]
    skip = [_number(f"skip {s}") % (slots - 1) + 1 for s in shards]
    left = slots
    while left:
        for i, name in enumerate(shards):
            while table[at[i]] is not None:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = name
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots))


def table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill(shards, slots))), "slot long, shard string")


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) of every row, by one look into the table.

    Equal keys share a shard; a null key counts as an empty text. Repeated rows are kept, an empty table gives no rows,
    and further columns are not looked at.
    """
    keyed = rows.select(F.col(f"`{key}`").alias(key)).withColumn("slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(table(rows.sparkSession, shards, slots)), "slot").select(key, "slot", "shard")
