"""Keyed upserts: batch deduplication and a partitioned table sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .versions import publish, read_table

PART = "part"


def last_op(ops: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Winning operation per key.  Deletes apply before puts, so any put beats every
    delete; among equals the latest wins.  ``ops`` carry ``op`` (put / delete)."""
    rest = [c for c in ops.columns if c not in keys]
    at = F.struct((F.col("op") == "put").alias("__put"), *order)
    won = ops.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("w"))
    return won.select(*keys, "w.*")


def upsert_sink(ops: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64, part: Column | None = None) -> None:
    """Apply puts and deletes to a versioned table, partitioned by key hash or by a whole-number ``part`` of the keys.

    Only the partitions the batch touches are read and written again; readers keep the version before until the new one
    is published. Replaying a batch gives the same table.
    """
    spark = ops.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if part is None else part
    won = stage(last_op(ops, keys, order).withColumn(PART, part.cast("bigint")))
    new = won.filter(F.col("op") == "put").drop("op")
    touched = {r[0] for r in won.select(PART).distinct().collect()}  # numbers of partitions
    old = read_table(spark, path)
    if old is not None:
        kept = old.filter(F.col(PART).isin(*touched)).join(won.select(*keys), list(keys), "left_anti") if touched else old.limit(0)
        new = new.unionByName(kept.select(*new.columns))
    publish(new, path, PART, touched.__contains__)
