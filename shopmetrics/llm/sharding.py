"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table
(offset and step derived from two hashes of its name). The shards take turns;
at its turn a shard claims the first free slot of its permutation, until the
table is full. Each shard ends with an equal share (to one slot) and, when a
shard goes, few slots of the others change. A row's slot is a hash of its key
modulo the table size, so placement is one lookup.

The table has ``table_size`` rows whatever the data (65,537 pairs of integers,
about 1 MB); that bound is what makes its broadcast safe.

Defined results: a null key hashes like the empty string; equal keys share a
shard; columns of the input keep their values, a clash with ``slot`` or
``shard`` is replaced by the placement.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TABLE_SIZE = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _number(seed: str, name: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "little")


def lookup_table(names: list[str], table_size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index in ``names``. Names are served in sorted order, so the
    table does not depend on the order in which they are given."""
    if not _is_prime(table_size):
        raise ValueError("table_size must be a prime number")
    if not names or len(set(names)) != len(names) or len(names) > table_size:
        raise ValueError("names must be distinct, at least one and at most table_size")
    turn = sorted(range(len(names)), key=lambda i: names[i])
    at = {i: _number("offset", names[i]) % table_size for i in turn}
    step = {i: 1 + _number("step", names[i]) % (table_size - 1) for i in turn}
    slots, free = [-1] * table_size, table_size
    while free:
        for i in turn[:free]:
            while slots[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % table_size
            slots[at[i]] = i
            free -= 1
    return slots


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of its MD5, modulo the table size."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return F.pmod(bits, F.lit(table_size)).cast("int")


def table_frame(spark: SparkSession, names: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    rows = [(s, i, names[i]) for s, i in enumerate(lookup_table(names, table_size))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def place(docs: DataFrame, key: str | Column, names: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with slot, shard (index in ``names``) and shard_name."""
    key = F.col(key) if isinstance(key, str) else key
    rows = docs.withColumn("_slot", slot_of(key, table_size)).drop("slot", "shard", "shard_name")
    lookup = F.broadcast(table_frame(docs.sparkSession, names, table_size))  # table_size rows, whatever the data
    return rows.join(lookup, F.col("_slot") == F.col("slot")).drop("_slot")


def write_shards(docs: DataFrame, key: str, names: list[str], path: str, files_per_shard: int = 4,
                 table_size: int = TABLE_SIZE) -> None:
    """Write ``docs`` as one folder per shard. Rows of a shard are dealt over
    ``files_per_shard`` tasks by slot, so no task writes a whole shard."""
    placed = place(docs, key, names, table_size)
    part = F.pmod(F.col("slot"), F.lit(files_per_shard))
    (placed.repartition(len(names) * files_per_shard, "shard", part)
     .write.partitionBy("shard").parquet(path))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Placement of every document: doc_id, slot, shard, shard_name."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shard_names())
