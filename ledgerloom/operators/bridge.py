"""Wrap and unwrap history and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.asof import asof_backward
from ..functions.paging import page
from ..functions.scan import running_sums

#: Heights of a chunk of the running totals.
HEIGHTS = 10_000


def wrap_history(events: DataFrame, kind: str, address=None, successful: bool | None = None,
                 limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest-first page.  ``successful`` only ever narrows to successful events."""
    e = events.filter(F.col("kind") == kind)
    if address is not None:
        e = e.filter(F.col("address") == address)
    if successful:
        e = e.filter("success")
    return page(e, [F.desc("height"), F.desc("seq")], limit, offset)


def unwrap_totals(events: DataFrame) -> DataFrame:
    """Cumulative unwrapped amount, all and successful, per height with unwraps."""
    per = events.filter(F.col("kind") == "unwrap").groupBy("height").agg(
        F.sum("amount").alias("a"), F.sum(F.when(F.col("success"), F.col("amount")).otherwise(0)).alias("s"))
    sums = {"total_all": F.col("a"), "total_successful": F.col("s")}
    return running_sums(per, [], [F.col("height")], F.floor(F.col("height") / HEIGHTS).cast("bigint"), sums).select("height", *sums)


def unwrap_total_at(totals: DataFrame, heights: DataFrame) -> DataFrame:
    """Totals at or before each height; null before the first."""
    return asof_backward(heights, totals, [], "height", ["total_all", "total_successful"], 100_000)
