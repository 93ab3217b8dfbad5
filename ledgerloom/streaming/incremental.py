"""Incremental runs: candles on a stream, per-block modules, reprocessing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.amm import chain_position, split_sides
from ..functions.exact import AMOUNT_SCALE, PRICE_SCALE, big, sat_mul, sat_sum
from ..session import stage
from ..sources.upsert import upsert_sink
from ..sources.versions import publish, read_table

#: Files of a height range when it is derived again.
RANGE_FILES = 8
Module = tuple[str, int, Callable[[DataFrame], DataFrame]]


def stream_candles(trades: DataFrame) -> DataFrame:
    """Ten-minute candles on a stream of priced trades, for update mode.

    Open and close carry their chain position, and no watermark closes a bucket: a trade
    of any age lands in its candle.  State holds one row per pool and bucket.
    """
    at = chain_position()
    t = trades.withColumn("event_time", F.timestamp_seconds("ts"))
    aggs = []
    for side in ("base", "quote"):
        p, v = F.col(f"price_{side}"), sat_mul(F.abs(F.col(f"{side}_delta")), big(PRICE_SCALE // AMOUNT_SCALE))
        aggs += [F.min_by(p, at).alias(f"{side}_open"), F.max(p).alias(f"{side}_high"), F.min(p).alias(f"{side}_low"),
                 F.max_by(p, at).alias(f"{side}_close"), sat_sum(v).alias(f"{side}_volume")]
    g = t.groupBy("pool_id", F.window("event_time", "10 minutes").alias("w")).agg(*aggs)
    return g.withColumn("bucket_ts", F.unix_seconds("w.start")).drop("w")


def candles_to_table(candles: DataFrame, path: str, checkpoint: str):
    """Start the stream of updated candles into a table by day; returns the query.  A batch rewrites the days that its trades fall in, late or not."""
    def write(batch: DataFrame, epoch: int) -> None:
        rows = split_sides(batch).withColumn("op", F.lit("put")).withColumn("epoch", F.lit(epoch).cast("bigint"))
        upsert_sink(rows, path, ["pool_id", "bucket_ts", "side"], ["epoch"], part=F.floor(F.col("bucket_ts") / 86400))

    return candles.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def _received(spark: SparkSession, path: str, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the touched height ranges.  Each run delivers a block at most once as a whole, in any
    number of parts, so a row counts as often as the run that delivered it most often did."""
    rows = spark.read.parquet(path).join(ranges, "height_range", "left_semi").groupBy("height_range", "run", *columns).agg(F.count(F.lit(1)).alias("n"))
    most = rows.groupBy("height_range", *columns).agg(F.max("n").cast("int").alias("n"))
    return most.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


def run_incremental(spark: SparkSession, blocks: DataFrame, ledger_path: str, out_path: str, modules: list[Module],
                    checkpoint: str, range_width: int = 1000):
    """Feed a stream of block rows to modules in order; returns the started query.

    ``blocks``: height, block_hash and the module's columns; a block may arrive in parts.
    Every batch is kept under ``ledger_path/blocks``, and each module's ledger holds the
    blocks it has seen with their number of rows.  Height ranges with a block that is new or has
    grown are derived again from all rows received and replaced, results first; rows delivered again by another
    run change nothing, and a replayed batch publishes the same partitions again.  A module's
    results carry ``height``.  If a module fails, the others still finish the batch; the
    query then ends with its error and the batch is replayed at the next start.
    """
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    inbox = f"{ledger_path}/blocks"
    if any(name == "blocks" for name, _, _ in modules):
        raise ValueError("no module can be named blocks")

    def put(df: DataFrame, path: str, *parts: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    def derive(name: str, genesis: int, fn: Callable[[DataFrame], DataFrame], rows: DataFrame, sizes: DataFrame) -> None:
        known, where = read_table(spark, f"{ledger_path}/{name}"), f"{out_path}/{name}"
        now = sizes.filter(F.col("height") >= genesis)
        stale = now if known is None else now.join(known.select("height_range", "block_hash", "rows"), ["height_range", "block_hash", "rows"], "left_anti")
        ranges = stage(stale.select("height_range").distinct())
        if ranges.isEmpty():
            return
        todo = rows.join(ranges, "height_range", "left_semi").filter(F.col("height") >= genesis).drop("height_range")
        fresh = stage(fn(todo).withColumn("height_range", F.floor(F.col("height") / range_width).cast("bigint")))
        touched = {r.height_range for r in ranges.collect()}  # numbers of ranges
        publish(fresh, where, "height_range", touched.__contains__)
        publish(now.join(ranges, "height_range", "left_semi"), f"{ledger_path}/{name}", "height_range", touched.__contains__)

    def write(batch: DataFrame, epoch: int) -> None:
        part = F.floor(F.col("height") / range_width).cast("bigint")
        got = batch.filter("height is not null").withColumns({"height_range": part, "run": F.lit(run), "epoch": F.lit(epoch).cast("bigint")})
        put(got, inbox, "height_range", "run", "epoch")
        ranges = batch.select(part.alias("height_range")).distinct()
        rows = stage(_received(spark, inbox, ranges, batch.columns))
        sizes = stage(rows.groupBy("height_range", "height", "block_hash").agg(F.count(F.lit(1)).alias("rows")))
        failed = []
        for module in modules:
            try:
                derive(*module, rows, sizes)
            except Exception as e:  # the other modules still finish the batch
                failed.append(e)
        if failed:
            raise failed[0]

    return blocks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reprocess_from(facts: DataFrame, out_path: str, fn: Callable[[DataFrame], DataFrame], height: int,
                   range_width: int = 1000) -> None:
    """Derive all heights from ``height`` on again and replace them in the table.

    The table is partitioned by height range.  Only ranges from the rewound height on
    are rewritten; rows below it in the boundary range are kept, and derived rows of
    heights that no longer exist go.
    """
    spark = facts.sparkSession
    part = F.floor(F.col("height") / range_width).cast("bigint")
    fresh = fn(facts.filter(F.col("height") >= height)).withColumn("height_range", part)
    old = read_table(spark, out_path)
    if old is not None:
        kept = old.filter((F.col("height_range") == height // range_width) & (F.col("height") < height))
        fresh = fresh.unionByName(kept)
    # a range is dealt by height over a few tasks, each of which adds a file to it
    fresh = fresh.repartition("height_range", F.pmod(F.xxhash64("height"), F.lit(RANGE_FILES)))
    publish(fresh, out_path, "height_range", lambda r: r >= height // range_width)
