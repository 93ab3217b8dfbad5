"""Chain shape: divergence after a reorganisation and the canonical ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage


def reorg_point(indexed: DataFrame, chain: DataFrame, genesis: int = 0) -> DataFrame:
    """First height to index again: one above the highest block both sides share, or
    the genesis height.  Both: height, block_hash."""
    j = indexed.join(chain.select("height", F.col("block_hash").alias("__h")), "height")
    same = F.max(F.when(F.col("block_hash") == F.col("__h"), F.col("height")))
    return j.agg(F.coalesce(same + 1, F.lit(genesis)).cast("bigint").alias("reorg_height"))


def canonical_chain(blocks: DataFrame, tip: DataFrame) -> DataFrame:
    """Blocks on the path from the tip back to the first known ancestor.

    blocks: block_hash, prev_hash, …; tip: block_hash.  Pointer doubling: round k joins
    the found set with its 2^k-th ancestors, so a chain of n blocks takes log2(n)
    rounds instead of n.
    """
    jump = stage(blocks.select(F.col("block_hash").alias("a"), F.col("prev_hash").alias("b"))
                 .join(blocks.select(F.col("block_hash").alias("b")), "b", "left_semi").select("a", "b"))
    found = stage(tip.select("block_hash"))
    while True:
        more = found.join(jump, found.block_hash == jump.a).select(F.col("b").alias("block_hash"))
        if more.isEmpty():
            break
        found = stage(found.union(more))
        right = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jump = stage(jump.join(right, "b").select("a", F.col("c").alias("b")))
    return blocks.join(found, "block_hash", "left_semi")
