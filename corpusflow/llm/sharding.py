"""Rendezvous (highest random weight) hashing of record keys over weighted shards.

Each shard draws for each key a uniform number u from the MD5 digest of
``key|shard``; the shard with the largest ``weight / -ln(u)`` owns the key.  A
shard's share is its weight over the sum of weights.  A key moves only to a shard
that was added or whose weight rose, or away from one that was removed or whose
weight fell, so going from N to N+1 equal shards moves about 1/(N+1) of the keys.

A pure projection: no shuffle, no Python, and the owner depends on nothing but
the key, so any reader can compute it.

* null key: shard null (such a record has no stable key); the row stays
* repeated keys: the same shard each time; ties of score: the smaller shard name
* empty table: empty result; very long key: hashed whole; extra columns: kept out of the result of ``assign``
* weights must be positive and shard names distinct: otherwise ValueError
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm._common import picked

#: hex digits of the digest that make u: 52 bits, exact in a double
_HEX, _SCALE = 13, float(1 << 52)


def equal_shards(n: int) -> dict[str, float]:
    return {f"shard-{i:05d}": 1.0 for i in range(n)}


def _checked(shards: Mapping[str, float]) -> list[tuple[str, float]]:
    if not shards or any(not w > 0 or w == float("inf") for w in shards.values()):
        raise ValueError("shards need positive, finite weights")
    return sorted((str(k), float(w)) for k, w in shards.items())


def owner(key: Column, shards: Mapping[str, float]) -> Column:
    """The name of the shard that owns the key."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(w).alias("weight")) for k, w in _checked(shards)])
    key = key.cast("string")

    def scored(s: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), s["name"])), 1, _HEX), 16, 10).cast("double") + 0.5) / F.lit(_SCALE)
        return F.struct((-s["weight"] / F.ln(u)).alias("score"), s["name"].alias("name"))

    def better(a: Column, b: Column) -> Column:
        return F.when(b["score"] > a["score"], b).otherwise(a)

    start = F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("name"))
    best = F.aggregate(rows, start, lambda a, s: better(a, scored(s)), lambda a: a["name"])
    return F.when(key.isNotNull(), best)


def assign(records: DataFrame, key: str, shards: Mapping[str, float], after: Mapping[str, float] | None = None) -> DataFrame:
    """key, shard and, with ``after`` (the shards after a change), shard_after and moved."""
    k = F.col(f"`{key}`")
    out = picked(records, key).select(k.alias(key), owner(k, shards).alias("shard"))
    if after is None:
        return out
    out = out.withColumn("shard_after", owner(F.col(f"`{key}`"), after))
    return out.withColumn("moved", F.col("shard") != F.col("shard_after"))


def write_sharded(records: DataFrame, key: str, shards: Mapping[str, float], path: str) -> None:
    """The records as Parquet, a folder for each shard (column ``shard``, which must not exist yet)."""
    if "shard" in records.columns:
        raise ValueError("records already have a column named shard")
    records.withColumn("shard", owner(F.col(f"`{key}`"), shards)).write.partitionBy("shard").parquet(path)
