"""Pool activity, running reserves, trade prices and candles.

Conventions
-----------
flow      pool_id, height, ts, seq, tx_id, address, success, base_delta, quote_delta
activity  flow + kind, direction
trades    activity rows of kind trade_buy / trade_sell + base_reserve, quote_reserve
candles   <series keys>, bucket_ts, open, high, low, close, volume (one series per key)

Pool flows are scanned in day-sized height chunks so that one busy pool is
spread over many tasks.  Candle series hold at most one row per ten minutes, so
plain per-series windows over them stay small whatever the trade volume.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exact import AMOUNT_SCALE, DEC, PRICE_SCALE, big, bucket_start, mul_div_floor, sat_mul, sat_sum
from ..functions.paging import page
from ..functions.scan import clamped_sums

# Bucket lengths in seconds.
TIMEFRAMES = {"10m": 600, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800, "1M": 2592000}
HIGHER_TIMEFRAMES = {k: v for k, v in TIMEFRAMES.items() if k != "10m"}
BLOCKS_PER_DAY = 144
BLOCKS_PER_WEEK = 1008

TRADE_KINDS = ("trade_buy", "trade_sell")
FLOW_ORDER = ("height", "seq")


def height_chunk(column: str = "height", width: int = BLOCKS_PER_DAY) -> Column:
    return F.floor(F.col(column) / width).cast("bigint")



def chain_position(height: str = "height", seq: str = "seq") -> Column:
    """(height, seq) as one number: a fixed-width key keeps ``min_by`` / ``max_by`` in
    hash aggregation, where a struct key would force a sort."""
    return (F.col(height).cast("decimal(18,0)") * F.lit(Decimal(10**19)) + F.col(seq)).cast(DEC)


# ---------------------------------------------------------------- activity

def pool_balance_flow(deltas: DataFrame, pools: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base and quote delta of each pool and transaction.

    ``deltas``: *keys* (transaction attributes), owner, token, delta.  Rows whose
    two deltas are both zero are dropped.
    """
    legs = deltas.join(pools.select("pool_id", "base_id", "quote_id"), deltas.owner == pools.pool_id)
    out = legs.groupBy("pool_id", *keys).agg(
        F.sum(F.when(F.col("token") == F.col("base_id"), F.col("delta")).otherwise(big(0))).cast(DEC).alias("base_delta"),
        F.sum(F.when(F.col("token") == F.col("quote_id"), F.col("delta")).otherwise(big(0))).cast(DEC).alias("quote_delta"))
    return out.filter((F.col("base_delta") != 0) | (F.col("quote_delta") != 0))


def classify_activity(flow: DataFrame) -> DataFrame:
    """Kind and direction from the delta signs; other sign pairs are dropped."""
    b, q = F.signum("base_delta"), F.signum("quote_delta")
    kind = (F.when((b > 0) & (q < 0), "trade_sell").when((b < 0) & (q > 0), "trade_buy")
            .when((b > 0) & (q > 0), "liquidity_add").when((b < 0) & (q < 0), "liquidity_remove"))
    return (flow.withColumn("kind", kind).filter(F.col("kind").isNotNull())
            .withColumn("direction", F.when(F.col("kind") == "trade_sell", "base_in")
                        .when(F.col("kind") == "trade_buy", "quote_in"))
            .withColumn("success", F.coalesce(F.col("success"), F.lit(True))))


def pool_create_rows(creations: DataFrame) -> DataFrame:
    """Zero-delta activity rows for pool creations."""
    return (creations.withColumn("base_delta", big(0)).withColumn("quote_delta", big(0))
            .withColumn("kind", F.lit("pool_create")).withColumn("direction", F.lit(None).cast("string")))


def running_reserves(flow: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Reserves after each transaction, floored at zero step by step.

    Every flow row moves the reserves, classified or not.  ``initial``: pool_id,
    base_initial, quote_initial (0 when absent).
    """
    if initial is not None:
        flow = flow.join(initial, "pool_id", "left")
        b0, q0 = F.coalesce("base_initial", big(0)), F.coalesce("quote_initial", big(0))
    else:
        b0, q0 = big(0), big(0)
    out = clamped_sums(flow, ["pool_id"], [F.col(c) for c in FLOW_ORDER], height_chunk(),
                       {"base_reserve": (F.col("base_delta"), b0), "quote_reserve": (F.col("quote_delta"), q0)})
    return out.drop("base_initial", "quote_initial")


def latest_reserves(reserves: DataFrame) -> DataFrame:
    """Last reserve pair of each pool."""
    at = chain_position()
    return reserves.groupBy("pool_id").agg(F.max_by("base_reserve", at).alias("base_reserve"),
                                           F.max_by("quote_reserve", at).alias("quote_reserve"))


def live_reserves(contract_balances: DataFrame, pools: DataFrame) -> DataFrame:
    """Holdings of each pool in its own two tokens; 0 when it holds none."""
    b = contract_balances.select(F.col("owner").alias("pool_id"), "token", "amount")
    j = pools.join(b, "pool_id", "left")
    return j.groupBy("pool_id", "base_id", "quote_id").agg(
        F.coalesce(F.max(F.when(F.col("token") == F.col("base_id"), F.col("amount"))), big(0)).alias("base_reserve"),
        F.coalesce(F.max(F.when(F.col("token") == F.col("quote_id"), F.col("amount"))), big(0)).alias("quote_reserve"))


def trade_prices(reserves: DataFrame) -> DataFrame:
    """Both prices after each trade, at 1e16; 0 on an empty side."""
    t = classify_activity(reserves).filter(F.col("kind").isin(*TRADE_KINDS))
    b, q = F.col("base_reserve"), F.col("quote_reserve")
    return t.withColumn("price_base", mul_div_floor(q, big(PRICE_SCALE), b)).withColumn("price_quote", mul_div_floor(b, big(PRICE_SCALE), q))


# ---------------------------------------------------------------- candles

def candles(trades: DataFrame, seconds: int = 600) -> DataFrame:
    """Open/high/low/close/volume of both price sides per pool and bucket."""
    at = chain_position()

    def scaled(c: str) -> Column:
        return sat_mul(F.abs(F.col(c)), big(PRICE_SCALE // AMOUNT_SCALE))

    aggs = []
    for side, delta in (("base", "base_delta"), ("quote", "quote_delta")):
        p = F.col(f"price_{side}")
        aggs += [F.min_by(p, at).alias(f"{side}_open"), F.max(p).alias(f"{side}_high"),
                 F.min(p).alias(f"{side}_low"), F.max_by(p, at).alias(f"{side}_close"),
                 sat_sum(scaled(delta)).alias(f"{side}_volume")]
    wide = trades.withColumn("bucket_ts", bucket_start(F.col("ts"), seconds)) \
        .groupBy("pool_id", "bucket_ts").agg(*aggs)
    return split_sides(wide)


def split_sides(wide: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{f}").alias(f)
                                                        for f in ("open", "high", "low", "close", "volume")])
                     for s in ("base", "quote")])
    return wide.select("pool_id", "bucket_ts", F.explode(rows).alias("c")).select("pool_id", "bucket_ts", "c.*")


def merge_candles(older: DataFrame, newer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold newer partial candles into older ones of the same bucket."""
    u = older.withColumn("__age", F.lit(0)).unionByName(newer.withColumn("__age", F.lit(1)))
    return u.groupBy(*keys, "bucket_ts").agg(
        F.min_by("open", "__age").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "__age").alias("close"), sat_sum(F.col("volume")).alias("volume"))


def _series(keys: Sequence[str], by: str = "bucket_ts"):
    return Window.partitionBy(*keys).orderBy(by)


def chained(c: DataFrame, keys: Sequence[str], first_open: Column) -> DataFrame:
    """Reopen each candle at the close before it and widen high/low to include it."""
    o = F.coalesce(F.lag("close").over(_series(keys)), first_open)
    return (c.withColumn("__o", o).withColumn("high", F.greatest("high", "__o"))
            .withColumn("low", F.least("low", "__o")).withColumn("open", F.col("__o")).drop("__o"))


def rollup_candles(m10: DataFrame, keys: Sequence[str], frames: dict[str, int] | None = None) -> DataFrame:
    """Higher timeframes from 10-minute candles.

    Each sample opens at the close before it; the series' first sample opens at its
    own close.  Flat samples between trades change no bound, so only real ones are
    read.  All timeframes come from one pass.
    """
    frames = frames or HIGHER_TIMEFRAMES
    c = chained(m10, keys, F.col("close"))
    tf = F.explode(F.array(*[F.struct(F.lit(n).alias("tf"), F.lit(s).cast("bigint").alias("dur"))
                             for n, s in frames.items()])).alias("t")
    x = c.select("*", tf).withColumn("tf", F.col("t.tf")) \
        .withColumn("__b", bucket_start(F.col("bucket_ts"), F.col("t.dur")))
    return x.groupBy(*keys, "tf", "__b").agg(
        F.min_by("open", "bucket_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bucket_ts").alias("close"), sat_sum(F.col("volume")).alias("volume")
    ).withColumnRenamed("__b", "bucket_ts")


def fill_candles(c: DataFrame, keys: Sequence[str], seconds: int, now: int | Column) -> DataFrame:
    """Dense series up to the bucket of ``now``: gaps are flat at the last close.

    Each row carries its own gap (to the next row, or to ``now``), so the filler
    rows are made by one explode next to the data, without a join.
    """
    w = _series(keys)
    n = F.lit(now) if isinstance(now, int) else now
    end = F.greatest(bucket_start(n.cast("bigint"), seconds), F.col("bucket_ts"))
    nxt = F.coalesce(F.lead("bucket_ts").over(w) - seconds, end)
    x = chained(c, keys, F.col("open")).withColumn("__until", nxt)
    x = x.withColumn("__t", F.explode(F.sequence("bucket_ts", "__until", F.lit(seconds).cast("bigint"))))
    real = F.col("__t") == F.col("bucket_ts")
    flat = [F.when(real, F.col(f)).otherwise(F.col("close")).alias(f) for f in ("open", "high", "low")]
    return x.select(*keys, F.col("__t").alias("bucket_ts"), *flat, "close",
                    F.when(real, F.col("volume")).otherwise(big(0)).alias("volume"), real.alias("is_real"))


def price_line(prices: DataFrame, now: int | Column, frames: dict[str, int] | None = None) -> DataFrame:
    """Last price per bucket and timeframe, forward filled up to ``now``.
    ``prices``: ts, height, price."""
    frames = frames or TIMEFRAMES
    tf = F.explode(F.array(*[F.struct(F.lit(n).alias("tf"), F.lit(s).cast("bigint").alias("dur"))
                             for n, s in frames.items()])).alias("t")
    x = prices.select("ts", "height", "price", tf).select("t.*", "height", "price",
                                                          bucket_start(F.col("ts"), F.col("t.dur")).alias("bucket_ts"))
    b = x.groupBy("tf", "dur", "bucket_ts").agg(F.max_by("price", "height").alias("price"))
    n = F.lit(now) if isinstance(now, int) else now
    end = F.greatest(bucket_start(n.cast("bigint"), F.col("dur")), F.col("bucket_ts"))
    nxt = F.coalesce(F.lead("bucket_ts").over(_series(["tf"])) - F.col("dur"), end)
    return (b.withColumn("__until", nxt)
            .select("tf", F.explode(F.sequence("bucket_ts", "__until", "dur")).alias("bucket_ts"), "price"))


# ---------------------------------------------------------------- windows and feeds

def _window_sums(df: DataFrame, keys: Sequence[str], values: dict[str, Column], now: int) -> DataFrame:
    aggs = []
    for name, v in values.items():
        for label, days in (("1d", 1), ("7d", 7), ("30d", 30)):
            inside = (F.col("ts") >= now - days * 86400)
            aggs.append(sat_sum(F.when(inside, v).otherwise(big(0))).alias(f"{name}_{label}"))
        aggs.append(sat_sum(v).alias(f"{name}_all"))
    return df.groupBy(*keys).agg(*aggs)


def pool_trade_windows(activity: DataFrame, now: int) -> DataFrame:
    """Traded base and quote amounts of each pool over 1, 7, 30 days and all time."""
    t = activity.filter(F.col("kind").isin(*TRADE_KINDS) & (F.col("ts") <= now))
    return _window_sums(t, ["pool_id"], {"base": F.abs("base_delta"), "quote": F.abs("quote_delta")}, now)


def token_trade_windows(pool_windows: DataFrame, pools: DataFrame) -> DataFrame:
    """Per token, the sum of its own side over all its pools."""
    j = pool_windows.join(pools.select("pool_id", "base_id", "quote_id"), "pool_id")
    labels = ("1d", "7d", "30d", "all")
    sides = F.explode(F.array(*[
        F.struct(F.col(f"{s}_id").alias("token"), *[F.col(f"{s}_{w}").alias(f"amount_{w}") for w in labels])
        for s in ("base", "quote")])).alias("s")
    return j.select(sides).select("s.*").groupBy("token").agg(
        *[sat_sum(F.col(f"amount_{w}")).alias(f"amount_{w}") for w in labels])


def activity_feed(activity: DataFrame, sort: str = "ts", desc: bool = True, side: str = "all",
                  group: str = "all", price_side: str = "base", pool_id=None,
                  limit: int = 50, offset: int = 0) -> DataFrame:
    """Page over pool activity.

    sort: ts, base_amount, quote_amount, side_ts, side_amount.  side: all, buy, sell,
    seen from ``price_side``.  group: all, trades, events.  Events have no side, so
    events with a side filter give no rows.
    """
    a = activity if pool_id is None else activity.filter(F.col("pool_id") == pool_id)
    trade = F.col("kind").isin(*TRADE_KINDS)
    buys = "trade_buy" if price_side == "base" else "trade_sell"
    code = F.when(~trade, 2).when(F.col("kind") == buys, 0).otherwise(1)
    a = a.withColumn("side_code", code).withColumn("base_amount", F.abs("base_delta")) \
        .withColumn("quote_amount", F.abs("quote_delta"))
    if group == "trades":
        a = a.filter(trade)
    elif group == "events":
        a = a.filter(~trade)
    if side != "all":
        a = a.filter(F.col("side_code") == (0 if side == "buy" else 1))
    amount = F.col(f"{price_side}_amount")
    cols = {"ts": [F.col("ts")], "base_amount": [F.col("base_amount")], "quote_amount": [F.col("quote_amount")],
            "side_ts": [F.col("side_code"), F.col("ts")], "side_amount": [F.col("side_code"), amount]}[sort]
    cols = [*cols, *([] if sort.endswith("ts") else [F.col("ts")]), F.col("seq")]
    return page(a, [c.desc() if desc else c.asc() for c in cols], limit, offset)


def activity_rows(activity: DataFrame, price_side: str = "base") -> DataFrame:
    """Presentation rows: side label and amounts of the chosen side."""
    buys = "trade_buy" if price_side == "base" else "trade_sell"
    label = (F.when(~F.col("kind").isin(*TRADE_KINDS), "neutral")
             .when(F.col("kind") == buys, "buy").otherwise("sell"))
    amount = F.abs(F.col(f"{price_side}_delta"))
    return activity.select("pool_id", "tx_id", "ts", "kind", label.alias("side"), amount.alias("amount"),
                           (amount.cast("double") / F.lit(float(AMOUNT_SCALE))).alias("amount_scaled"), "success")


def activity_counts(activity: DataFrame) -> DataFrame:
    """Row counts per pool and per (pool, group); the pool total has a null group."""
    g = F.when(F.col("kind").isin(*TRADE_KINDS), "trades").otherwise("events")
    return activity.withColumn("grp", g).rollup("pool_id", "grp").agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("pool_id").isNotNull())


def token_swaps(activity: DataFrame, pools: DataFrame) -> DataFrame:
    """Trades of every pool a token belongs to, once per token."""
    p = pools.select("pool_id", F.explode(F.array_distinct(F.array("base_id", "quote_id"))).alias("token"))
    return activity.filter(F.col("kind").isin(*TRADE_KINDS)).join(p, "pool_id")


def address_events(activity: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Events of the given kinds that carry an address."""
    a = F.col("address")
    return activity.filter(F.col("kind").isin(*kinds) & a.isNotNull() & (a.cast("string") != ""))


def amm_history(activity: DataFrame, kinds: Sequence[str] | None = None, address=None,
                successful: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    a = activity
    if kinds:
        a = a.filter(F.col("kind").isin(*kinds))
    if address is not None:
        a = a.filter(F.col("address") == address)
    if successful is not None:
        a = a.filter(F.col("success") == F.lit(successful))
    return page(a, [F.desc("ts"), F.desc("seq")], limit, offset)


def swap_history(activity: DataFrame, pools: DataFrame) -> DataFrame:
    """Sold and bought token and amount of each trade."""
    t = activity.filter(F.col("kind").isin(*TRADE_KINDS)).join(
        pools.select("pool_id", "base_id", "quote_id"), "pool_id")
    sell = F.col("kind") == "trade_sell"
    pick = lambda a, b: F.when(sell, F.col(a)).otherwise(F.col(b))
    return t.select("pool_id", "tx_id", "ts", "seq", "address", "success",
                    pick("base_id", "quote_id").alias("sold_token"), pick("quote_id", "base_id").alias("bought_token"),
                    F.abs(pick("base_delta", "quote_delta")).alias("sold_amount"),
                    F.abs(pick("quote_delta", "base_delta")).alias("bought_amount"))


def candle_volume_sums(daily: DataFrame, now: int) -> DataFrame:
    """Volume of the newest seven daily buckets and of all of them, per pool and side."""
    start = bucket_start(F.lit(now).cast("bigint"), 86400)
    return daily.groupBy("pool_id", "side").agg(
        sat_sum(F.when((F.col("bucket_ts") > start - 7 * 86400) & (F.col("bucket_ts") <= start), F.col("volume"))
                .otherwise(big(0))).alias("volume_7d"),
        sat_sum(F.col("volume")).alias("volume_all"))


def pool_catalog(pools: DataFrame, names: DataFrame) -> DataFrame:
    """Pools with their display names.  ``names``: pool_id, name."""
    from ..functions.text import strip_lp_suffix
    return pools.join(names, "pool_id", "left").withColumn("pool_name", strip_lp_suffix(F.col("name")))


def pools_of_token(pools: DataFrame) -> DataFrame:
    return pools.select(F.explode(F.array_distinct(F.array("base_id", "quote_id"))).alias("token"), "pool_id")


def pool_name_prefix(catalog: DataFrame, prefix: str) -> DataFrame:
    from ..functions.text import normalize_name
    return catalog.filter(normalize_name(F.col("pool_name")).startswith(prefix.strip().lower()))
