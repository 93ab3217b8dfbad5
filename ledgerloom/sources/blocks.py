"""Readers for decoded block tables and price files, and trace attachment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def load_blocks(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """A height-partitioned fact table limited to a height range; the bounds prune
    partitions or reach the scan as pushed filters."""
    df = spark.read.parquet(path)
    if lo is not None:
        df = df.filter(F.col("height") >= lo)
    if hi is not None:
        df = df.filter(F.col("height") <= hi)
    return df


def reversed_hex(c: Column) -> Column:
    """Hex text with its bytes in opposite order."""
    pairs = F.transform(F.sequence(F.lit(1), (F.length(c) / 2).cast("int")), lambda i: F.substring(c, i * 2 - 1, F.lit(2)))
    return F.array_join(F.reverse(pairs), "")


def attach_traces(txs: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces of each transaction in output order; the trace's txid may be in either
    byte order.  Transactions without traces stay, with null trace columns.

    Each trace offers both spellings of its id, so this is one equi-join; an id that
    reads the same both ways is offered once.
    """
    ids = F.array_distinct(F.array(F.lower("txid"), reversed_hex(F.lower(F.col("txid")))))
    t = traces.withColumn("__id", F.explode(ids)).drop("txid")
    t = t.drop(*[c for c in t.columns if c in txs.columns and c not in ("__id",)])
    return txs.join(t, F.lower(txs["txid"]) == F.col("__id"), "left").drop("__id")


def block_summary(blocks: DataFrame, traces: DataFrame) -> DataFrame:
    """Trace count per block; blocks without traces count 0."""
    n = traces.groupBy("height").agg(F.count(F.lit(1)).alias("traces"))
    return blocks.join(n, "height", "left").withColumn("traces", F.coalesce("traces", F.lit(0)).cast("bigint"))


def recent_blocks(summary: DataFrame, center: int | None = None, radius: int = 8) -> DataFrame:
    """Trace counts of the heights around ``center`` (the last height if none is given), up to the last one; heights without a block count 0."""
    if not 0 <= radius <= 50:
        raise ValueError("a radius is 0 to 50")
    tip = summary.agg(F.max("height").alias("tip"), F.lit(center).cast("bigint").alias("center"))
    middle = F.least(F.coalesce("center", "tip"), F.col("tip"))
    heights = tip.filter("tip is not null").select(F.explode(F.sequence(F.greatest(middle - radius, F.lit(0)), F.least(middle + radius, F.col("tip")))).alias("height"))
    return heights.join(summary.select("height", "traces"), "height", "left").withColumn("traces", F.coalesce("traces", F.lit(0)).cast("bigint"))


def read_price_history(spark: SparkSession, path: str) -> DataFrame:
    """Height and BTC/USD price points of a JSON file holding one object of
    ``height: price`` pairs."""
    raw = spark.read.text(path, wholetext=True)
    pairs = F.explode(F.from_json("value", "map<string,string>")).alias("h", "p")
    return raw.select(pairs).select(F.col("h").cast("bigint").alias("height"), F.col("p").cast("decimal(38,0)").alias("price"))
