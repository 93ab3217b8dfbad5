"""Offset pages, keyset pages and per-key top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

#: Offsets past this are found by ranges instead of a top-k.
DEEP = 10_000


def row_total(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def positions(df: DataFrame, order: Sequence[Column], position: str = "position", total: str = "total") -> DataFrame:
    """Every row with its place in the given order and the number of rows.

    Rows are dealt by ranges of the order; a place is the row's number in its range plus the sizes of the ranges before it, so no task sees
    more than a range and only one row a range is summed up in one place.  The order should end with a unique column.
    """
    dealt = stage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    w = Window.orderBy("__range")
    ends = sizes.select("__range", F.coalesce(F.sum("__rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
                        F.sum("__rows").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total))
    rows = dealt.withColumn("__row", F.row_number().over(Window.partitionBy("__range").orderBy(*order))).join(ends, "__range")
    return rows.select(*df.columns, (F.col("__before") + F.col("__row")).cast("bigint").alias(position), total)


def page(df: DataFrame, order: Sequence[Column], limit: int | None, offset: int = 0,
         total: bool = True, position: str = "position") -> DataFrame:
    """One page in the given order, with its row positions.  No ``limit`` takes all rows; a negative ``offset`` counts from the end.

    Near the top the sort is a top-k of ``offset + limit`` rows, so the closing global
    ``row_number`` sees no more rows than the page needs; deep pages, pages from the end and whole lists go by ranges.
    """
    if limit is None or offset < 0 or offset > DEEP:
        rows = positions(df, order, position, "__total")
        start = F.greatest(F.col("__total") + offset, F.lit(0)) if offset < 0 else F.lit(offset)
        rows = rows.filter(F.col(position) > start)
        if limit is not None:
            rows = rows.filter(F.col(position) <= start + limit)
        if total:
            rows = rows.withColumn("total", F.col("__total")).withColumn("has_more", F.lit(False) if limit is None else F.col("total") > start + limit)
        return rows.drop("__total")
    top = df.orderBy(*order).limit(offset + limit)
    rows = top.withColumn(position, F.row_number().over(Window.orderBy(*order)).cast("bigint")) \
        .filter(F.col(position) > offset)
    if total:
        n = row_total(df)
        rows = rows.withColumn("total", n).withColumn("has_more", F.col("total") > offset + limit)
    return rows


def keyset_page(df: DataFrame, order: Sequence[Column], after: Column | None, limit: int) -> DataFrame:
    """Next ``limit`` rows past a cursor predicate."""
    return (df if after is None else df.filter(after)).orderBy(*order).limit(limit)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int | None,
                offset: int = 0, position: str = "position") -> DataFrame:
    """Per-key page; no ``limit`` takes all rows.  The rank filter is pushed below the shuffle as a group limit,
    so a hot key sends at most ``offset + limit`` rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn(position, F.row_number().over(w).cast("bigint"))
    return (rows if limit is None else rows.filter(F.col(position) <= offset + limit)).filter(F.col(position) > offset)
