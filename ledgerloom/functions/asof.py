"""As-of joins: backward (latest at or before) and nearest in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scan import carry_last


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str,
                  values: Sequence[str], chunk_size: int, strict: bool = False) -> DataFrame:
    """Attach to each left row the right values with the greatest ``at`` not above
    (``strict``: below) its own.  Both sides carry ``keys`` and ``at``; the rows are
    united and scanned once, so no range join is planned.  Right rows must be unique
    per (keys, at); ``chunk_size`` is the width of the scan chunks in units of ``at``.
    """
    lcols = left.columns
    side = F.lit(1 if not strict else -1)
    l = left.withColumn("__side", side)
    for v in values:
        l = l.withColumn(f"__r_{v}", F.lit(None).cast(right.schema[v].dataType))
    r = right.select(*keys, at, *[F.col(v).alias(f"__r_{v}") for v in values],
                     F.lit(0).alias("__side"))
    u = l.unionByName(r, allowMissingColumns=True)
    # one carried struct, so that a null value on the right row is kept as null
    packed = F.when(F.col("__side") == 0, F.struct(*[F.col(f"__r_{v}") for v in values]))
    s = carry_last(u, keys, [F.col(at), F.col("__side")],
                   F.floor(F.col(at) / chunk_size).cast("bigint"), {"__hit": packed})
    return s.filter(F.col("__side") != 0).select(
        *lcols, *[F.col(f"__hit.__r_{v}").alias(v) for v in values])


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str,
                 values: Sequence[str], chunk_size: int, matched: str = "matched_at") -> DataFrame:
    """Attach the right row closest in ``at``; a tie takes the earlier one."""
    lcols = left.columns
    l = left.withColumn("__side", F.lit(1))
    r = right.select(*keys, at, F.struct(F.col(at).alias("__at"), *values).alias("__row"),
                     F.lit(0).alias("__side"))
    u = l.unionByName(r, allowMissingColumns=True)
    chunk = F.floor(F.col(at) / chunk_size).cast("bigint")
    s = carry_last(u, keys, [F.col(at), F.col("__side")], chunk, {"__back": F.col("__row")})
    s = carry_last(s.withColumn("__neg", -F.col(at)), keys, [F.col("__neg"), F.col("__side")],
                   F.floor(F.col("__neg") / chunk_size).cast("bigint"), {"__fwd": F.col("__row")})
    s = s.filter(F.col("__side") == 1)
    back, fwd = F.col("__back.__at"), F.col("__fwd.__at")
    use_fwd = back.isNull() | (fwd.isNotNull() & ((fwd - F.col(at)) < (F.col(at) - back)))
    best = F.when(use_fwd, F.col("__fwd")).otherwise(F.col("__back"))
    s = s.withColumn("__best", best)
    return s.select(*lcols, F.col("__best.__at").alias(matched),
                    *[F.col(f"__best.{v}").alias(v) for v in values])
