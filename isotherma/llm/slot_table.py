"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table. Shards take turns, each claiming the
first slot of its order that is still free, until the table is full. A key goes to the shard that holds slot
``hash(key) mod slots``. When a shard leaves or joins, few slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 65_537  # prime; it bounds the table that is broadcast


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position in ``shards`` of its owner.

    Duplicate names are an error, and so are no shards, more shards than slots, and a size that is not prime.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, and no more than the slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    place, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "little") % slots)
        step.append(int.from_bytes(digest[8:16], "little") % (slots - 1) + 1)
    owner, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            at = place[k]
            while owner[at] >= 0:
                at = (at + step[k]) % slots
            owner[at], place[k] = k, (at + step[k]) % slots
            left -= 1
            if not left:
                break
    return owner


def table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (_slot, shard)."""
    schema = T.StructType([T.StructField("_slot", T.LongType()), T.StructField("shard", T.StringType())])
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(fill_table(shards, slots))], schema)


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots))


def place(df: DataFrame, key: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard``, by one join with the broadcast table and no shuffle.

    The table has ``slots`` rows whatever the data, which bounds the broadcast. Equal keys go to one shard; a NULL key is a key like
    any other, so rows with NULL keys go together (give more key columns to spread them). An empty table stays empty.
    Repeated rows stay. Columns of ``df`` named ``slot`` or ``shard`` are replaced.
    """
    kept = df.drop("slot", "shard", "_slot")
    slotted = kept.withColumn("_slot", slot_of([kept[k] for k in key], slots))
    return slotted.join(F.broadcast(table(df.sparkSession, shards, slots)), "_slot").withColumnRenamed("_slot", "slot")


def write_sharded(df: DataFrame, key: list[str], shards: list[str], path: str, slots: int = SLOTS, files: int = 8) -> None:
    """Write one folder per shard. Each shard is spread over up to ``files`` tasks by slot, so no task holds a whole shard."""
    placed = place(df, key, shards, slots)
    spread = placed.repartition(F.col("shard"), F.pmod(F.xxhash64("slot", *key), F.lit(files)))
    spread.write.partitionBy("shard").parquet(path)
