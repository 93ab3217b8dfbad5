"""Ordered scans (running sums, carried values) that split hot keys.

A plain window puts every row of a key in one task.  When a key may hold a
large share of the rows, the scan here runs over ``(key, chunk)`` instead: the
chunk is a coarse, monotone function of the leading order column (a height
range, say).  Each chunk is scanned on its own, one summary row per chunk is
scanned per key, and the two are joined back on ``(key, chunk)``.  Only the
summaries of a key meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .exact import big

CHUNK = "__chunk"


def _local(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the per-chunk carry back.  Rows and carry share the (key, chunk) columns the
    rows are already partitioned by; keys are taken to be non-null."""
    return rows.join(carry, [*keys, CHUNK], "left")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column,
                 sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sum per key for each ``name -> value`` in ``sums``."""
    base = df.withColumns({CHUNK: chunk, **{f"__v_{n}": c for n, c in sums.items()}})
    part = base.groupBy(*keys, CHUNK).agg(*[F.sum(f"__v_{n}").alias(f"__c_{n}") for n in sums])
    carry = part.withColumns({f"__c_{n}": F.sum(f"__c_{n}").over(_before(keys)) for n in sums})
    w = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumns({n: F.sum(f"__v_{n}").over(w) for n in sums})
    types = {n: rows.schema[n].dataType for n in sums}
    out = _attach(rows, carry, keys)
    out = out.withColumns({n: (F.coalesce(F.col(f"__c_{n}"), F.lit(0)) + F.col(n)).cast(types[n]) for n in sums})
    return out.drop(CHUNK, *[f"__c_{n}" for n in sums], *[f"__v_{n}" for n in sums])


def clamped_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column,
                 sums: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Running value ``x = max(0, x + delta)`` per key, from ``(delta, initial)``.

    Closed form: with S the plain running sum started at the initial value,
    ``x_t = S_t - min(0, min_{s<=t} S_s)``.  Sum and prefix minimum combine over
    chunks, so hot keys split like in :func:`running_sums`.
    """
    from .exact import DEC
    base = df.withColumns({CHUNK: chunk, **{f"__d_{n}": d.cast(DEC) for n, (d, _) in sums.items()},
                           **{f"__i_{n}": i.cast(DEC) for n, (_, i) in sums.items()}})
    w = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumns({f"__s_{n}": F.sum(f"__d_{n}").over(w).cast(DEC) for n in sums})
    rows = rows.withColumns({f"__m_{n}": F.min(f"__s_{n}").over(w) for n in sums})
    part = rows.groupBy(*keys, CHUNK).agg(
        *[F.sum(f"__d_{n}").cast(DEC).alias(f"__cs_{n}") for n in sums],
        *[F.min(f"__s_{n}").alias(f"__cm_{n}") for n in sums])
    part = part.withColumns({f"__cs0_{n}": F.coalesce(F.sum(f"__cs_{n}").over(_before(keys)), big(0)).cast(DEC)
                             for n in sums})
    part = part.withColumns({f"__cm0_{n}": F.min((F.col(f"__cs0_{n}") + F.col(f"__cm_{n}")).cast(DEC)).over(_before(keys))
                             for n in sums})
    carry = part.select(*keys, CHUNK, *[f"__cs0_{n}" for n in sums], *[f"__cm0_{n}" for n in sums])
    out = _attach(rows, carry, keys)

    def value(n: str) -> Column:
        init, s0 = F.col(f"__i_{n}"), F.col(f"__cs0_{n}")
        total = (init + s0 + F.col(f"__s_{n}")).cast(DEC)
        low = F.least(F.col(f"__cm0_{n}"), (s0 + F.col(f"__m_{n}")).cast(DEC))
        return (total - F.least(big(0), (init + low).cast(DEC))).cast(DEC)

    out = out.withColumns({n: value(n) for n in sums})
    helper = [f"{p}_{n}" for n in sums for p in ("__d", "__i", "__s", "__m", "__cs0", "__cm0")]
    return out.drop(CHUNK, *helper)


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column,
               values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Most recent non-null value per key (the row itself counts if ``inclusive``)."""
    base = df.withColumns({CHUNK: chunk, **{f"__v_{n}": c for n, c in values.items()}})
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    part = base.groupBy(*keys, CHUNK).agg(
        *[F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), rank)).alias(f"__c_{n}") for n in values])
    carry = part
    carry = carry.withColumns({f"__c_{n}": F.last(f"__c_{n}", ignorenulls=True).over(_before(keys)) for n in values})
    w = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = base.withColumns({n: F.last(f"__v_{n}", ignorenulls=True).over(w) for n in values})
    out = _attach(rows, carry, keys).withColumns({n: F.coalesce(F.col(n), F.col(f"__c_{n}")) for n in values})
    return out.drop(CHUNK, *[f"__c_{n}" for n in values], *[f"__v_{n}" for n in values])


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column,
            name: str) -> DataFrame:
    """1-based position of each row within its key."""
    return running_sums(df, keys, order, chunk, {name: F.lit(1).cast("bigint")})
