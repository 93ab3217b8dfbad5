"""Pending-transaction state in batch and streaming form.

mempool: txid, first_seen, address, fee_rate
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paging import page, top_per_key

# The usual bound on pending transactions and the least fee rate kept; callers name the ones that they want.
MAX_PENDING = 50_000
MIN_FEE_RATE = 0.5


def _transactions(pending: DataFrame) -> DataFrame:
    """One row per transaction with its earliest sighting."""
    return pending.groupBy("txid").agg(F.min("first_seen").alias("first_seen"))


def mempool_state(seen: DataFrame, min_fee_rate: float) -> DataFrame:
    """One row per pending (txid, address) with its earliest sighting; low fees are skipped.
    Works on a stream too, where it keeps one state row per pair."""
    return seen.filter(F.col("fee_rate") >= min_fee_rate).groupBy("txid", "address").agg(
        F.min("first_seen").alias("first_seen"), F.max("fee_rate").alias("fee_rate"))


def mempool_prune(pending: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` transactions with all their addresses; the oldest beyond it leave."""
    kept = _transactions(pending).orderBy(F.desc("first_seen"), F.desc("txid")).limit(limit)
    return pending.join(kept.select("txid"), "txid", "left_semi").select(*pending.columns)


def mempool_confirmed(pending: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Pending rows without those confirmed since."""
    return pending.join(confirmed.select("txid").distinct(), "txid", "left_anti")


def pending_for_address(pending: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest pending transactions per address."""
    return top_per_key(pending, ["address"], [F.desc("first_seen"), F.desc("txid")], limit, offset)


def pending_traces(pending: DataFrame, traces: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Page of pending transactions that carry traces, one row each."""
    t = _transactions(pending).join(traces.select("txid").distinct(), "txid", "left_semi")
    return page(t, [F.desc("first_seen"), F.desc("txid")], limit, offset)


def stream_mempool(sightings: DataFrame, min_fee_rate: float) -> DataFrame:
    """Streaming form: the first sighting of each (txid, address); none is forgotten, so ``first_seen`` never moves."""
    return sightings.filter(F.col("fee_rate") >= min_fee_rate).dropDuplicates(["txid", "address"])
