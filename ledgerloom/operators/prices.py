"""BTC price resolution and token price series in USD, sats and derived quotes.

Series conventions: candles as in :mod:`.amm`; canonical quotes come as a small
table ``quotes(quote_id, unit)`` with unit ``btc`` or ``usd``.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.asof import asof_backward, asof_nearest
from ..functions.exact import (AMOUNT_SCALE, CAP, DEC, PRICE_SCALE, U128_MAX, big, bucket_start,
    div_floor, invert_price, mul_div_floor, percent_change_bp, sat_add, sat_mul)
from ..functions.scan import carry_last
from ..session import stage
from .amm import BLOCKS_PER_DAY, TIMEFRAMES, chained, height_chunk, price_line, rollup_candles

SATS_PER_BTC = 10**8
PRICES = ("open", "high", "low", "close")


# ---------------------------------------------------------------- BTC price

def btc_price_asof(heights: DataFrame, backfill: DataFrame, feed: DataFrame, stored: DataFrame) -> DataFrame:
    """Price of each trading height: backfill, else feed, else stored at that height,
    else the latest one known before it.  Every price table: height, price."""
    out = heights.select("height").distinct()
    for name, src in (("b", backfill), ("f", feed), ("s", stored)):
        out = out.join(src.select("height", F.col("price").alias(f"__{name}")), "height", "full_outer")
    traded = heights.select("height").distinct().withColumn("__traded", F.lit(True))
    out = out.join(traded, "height", "left")
    here = F.coalesce("__b", "__f", "__s")
    kept = F.when(F.col("__traded"), here).otherwise(F.col("__s"))
    out = carry_last(out, [], [F.col("height")], height_chunk("height", 100 * BLOCKS_PER_DAY), {"price": kept})
    return out.filter("__traded").select("height", "price")


def nearest_price(heights: DataFrame, feed: DataFrame, chunk_seconds: int = 86400) -> DataFrame:
    """Feed price whose timestamp is closest to each block's; a tie takes the earlier."""
    return asof_nearest(heights, feed, [], "ts", ["price"], chunk_seconds, matched="feed_ts")


@F.pandas_udf(T.DecimalType(38, 0))
def _sqrt_price(sqrt_x96: pd.Series, inverse: pd.Series, scale: pd.Series) -> pd.Series:
    """Square of a Q64.96 number in plain integers: the intermediate has up to 320 bits."""
    out = []
    for s, inv, k in zip(sqrt_x96, inverse, scale):
        if s is None or int(s) == 0:
            out.append(None)
            continue
        n = int(s) * int(s)
        v = (int(k) << 192) // n if inv else n * int(k) // (1 << 192)
        out.append(Decimal(v) if v <= CAP else None)
    return pd.Series(out, dtype=object)


def price_from_sqrt(sqrt_x96: Column, inverse: Column, scale: Column) -> Column:
    """Price from a square-root price in 96-bit fixed point, given as decimal text.
    ``inverse`` swaps the pair; zero or out-of-range results are null."""
    return _sqrt_price(sqrt_x96.cast("string"), inverse, scale.cast("bigint"))


# ---------------------------------------------------------------- canonical pools

def canonical_pools(pools: DataFrame, quotes: DataFrame) -> DataFrame:
    """(token, pool, quote) for every pool with a canonical quote on either side."""
    sides = F.explode(F.array(
        F.struct(F.col("base_id").alias("token"), F.col("quote_id").alias("quote"), F.lit(True).alias("token_is_base")),
        F.struct(F.col("quote_id").alias("token"), F.col("base_id").alias("quote"), F.lit(False).alias("token_is_base"))))
    x = pools.select("pool_id", sides.alias("s")).select("pool_id", "s.*")
    return x.join(quotes, x.quote == quotes.quote_id).drop("quote_id")


def derived_pool_choice(pools: DataFrame, derived_quotes: DataFrame) -> DataFrame:
    """One pool per (token, derived quote): token as base first, then the smallest id."""
    c = canonical_pools(pools, derived_quotes)
    best = F.min(F.struct((~F.col("token_is_base")).alias("flip"), "pool_id")).alias("b")
    return c.groupBy("token", "quote").agg(best).select(
        "token", "quote", F.col("b.pool_id").alias("pool_id"), (~F.col("b.flip")).alias("token_is_base"))


def _paired(candles: DataFrame) -> DataFrame:
    """Both sides of a pool candle in one row: base_open … quote_volume."""
    fields = (*PRICES, "volume")
    return candles.groupBy("pool_id", "bucket_ts").agg(*[
        F.max(F.when(F.col("side") == s, F.col(f))).alias(f"{s}_{f}") for s in ("base", "quote") for f in fields])


def last_bucket(btc: DataFrame, candles: DataFrame, seconds: int) -> Column:
    """Newest bucket among prices and candles, as a scalar subquery."""
    a = btc.agg(F.max(bucket_start(F.col("ts"), seconds)).alias("m"))
    b = candles.agg(F.max("bucket_ts").alias("m"))
    return a.union(b).agg(F.max("m").alias("m")).scalar()


def token_usd_candles(candles: DataFrame, canonical: DataFrame, btc: DataFrame, seconds: int = 600) -> DataFrame:
    """USD candles per token from its BTC- and USD-quoted pools.

    BTC prices are converted at the last BTC price known when the bucket closes
    (``btc``: ts, price); with both quotes the fields are averaged and the volumes
    added.  Where a token has several pools in one unit the largest pool id counts.
    A candle opens at the close of the directly preceding bucket.
    """
    p = _paired(candles).join(canonical, "pool_id")
    base = F.col("token_is_base")
    p = p.select(
        "token", "unit", "pool_id", "bucket_ts",
        *[F.when(base, F.col(f"base_{f}")).otherwise(F.col(f"quote_{f}")).alias(f) for f in PRICES],
        *[F.when(base, F.col(f"quote_{f}")).otherwise(F.col(f"base_{f}")).alias(f"inv_{f}") for f in PRICES],
        F.when(base, F.col("quote_volume")).otherwise(F.col("base_volume")).alias("volume"))
    # the BTC line on the bucket grid turns the as-of lookup into an equi-join
    line = price_line(btc, last_bucket(btc, candles, seconds), {"line": seconds}).select("bucket_ts", F.col("price").alias("btc"))
    p = p.join(line, "bucket_ts", "left")
    is_usd, one = F.col("unit") == "usd", big(PRICE_SCALE)
    p = p.filter(is_usd | F.col("btc").isNotNull())
    p = p.withColumns({"factor": F.when(is_usd, one).otherwise(F.col("btc")),
                       "inverse": F.when(~is_usd, sat_mul(F.col("btc"), one))})

    def conv(f: str) -> Column:
        # a BTC price of 0 is read from the other side of the pool
        via = F.when(is_usd | (F.col(f"inv_{f}") == 0), big(0)).otherwise(div_floor(F.col("inverse"), F.col(f"inv_{f}")))
        return F.when(F.col(f) != 0, mul_div_floor(F.col(f), F.col("factor"), PRICE_SCALE)).otherwise(via).cast(DEC).alias(f)

    p = p.select("token", "unit", "pool_id", "bucket_ts", *[conv(f) for f in PRICES],
                 mul_div_floor(F.col("volume"), F.col("factor"), PRICE_SCALE).alias("volume"))
    fields = (*PRICES, "volume")
    w = p.groupBy("token", "bucket_ts").agg(*[
        F.max_by(F.col(f), F.when(F.col("unit") == u, F.col("pool_id"))).alias(f"{u}_{f}")
        for u in ("btc", "usd") for f in fields])

    def both(f: str) -> Column:
        a, c = F.col(f"btc_{f}"), F.col(f"usd_{f}")
        joined = sat_add(a, c) if f == "volume" else div_floor(sat_add(a, c), 2)
        return F.when(a.isNotNull() & c.isNotNull(), joined).otherwise(F.coalesce(a, c)).cast(DEC).alias(f)

    return chain_adjacent(w.select("token", "bucket_ts", *[both(f) for f in fields]), ["token"], seconds)


def chain_adjacent(c: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Open at the close of the directly preceding bucket, if there is one and it is not 0."""
    w = Window.partitionBy(*keys).orderBy("bucket_ts")
    prev = F.when(F.lag("bucket_ts").over(w) == F.col("bucket_ts") - seconds, F.lag("close").over(w))
    c = c.withColumn("__p", prev)
    o = F.when(F.coalesce("__p", big(0)) != 0, F.col("__p")).otherwise(F.col("open"))
    return (c.withColumn("open", o).withColumn("high", F.greatest("high", "open"))
            .withColumn("low", F.least("low", "open")).drop("__p"))


def merge_strategy(a: Column, b: Column, va: Column, vb: Column, strategy: Column) -> Column:
    """Combine two prices: optimistic, pessimistic, neutral or neutral_vwap."""
    mean = div_floor(sat_add(a, b), 2)
    weight = sat_add(va, vb)
    vwap = F.when(weight == 0, mean).otherwise(div_floor(sat_add(sat_mul(a, va), sat_mul(b, vb)), weight))
    return (F.when(strategy == "optimistic", F.greatest(a, b)).when(strategy == "pessimistic", F.least(a, b))
            .when(strategy == "neutral", mean).otherwise(vwap)).cast(DEC)


def merge_strategies(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candles present in both inputs, merged under each strategy."""
    l = a.select(*keys, *[F.col(f).alias(f"a_{f}") for f in (*PRICES, "volume")])
    r = b.select(*keys, *[F.col(f).alias(f"b_{f}") for f in (*PRICES, "volume")])
    s = F.explode(F.array(*[F.lit(x) for x in ("optimistic", "pessimistic", "neutral", "neutral_vwap")]))
    j = l.join(r, list(keys)).withColumn("strategy", s)
    va, vb = F.col("a_volume"), F.col("b_volume")
    return j.select(*keys, "strategy", *[
        merge_strategy(F.col(f"a_{f}"), F.col(f"b_{f}"), va, vb, F.col("strategy")).alias(f) for f in PRICES],
        F.when(va == 0, vb).otherwise(va).alias("volume"))


def mcap_candles(candles: DataFrame, supply: DataFrame) -> DataFrame:
    """Price candles times circulating supply; tokens without supply drop out."""
    s = supply.filter(F.col("supply") != 0).select("token", "supply")
    j = candles.join(s, "token")
    return j.withColumns({f: mul_div_floor(F.col(f), F.col("supply"), AMOUNT_SCALE) for f in PRICES}).drop("supply")


def usd_to_sats(usd: Column, btc: Column) -> Column:
    """USD value at 1e16 to sats at 1e16, whole part and remainder scaled apart; the product before the first division saturates at 2^128 - 1."""
    sats = F.try_multiply(usd.cast(DEC), big(SATS_PER_BTC)).cast(DEC)
    whole = mul_div_floor(usd, big(SATS_PER_BTC), btc)
    # a product past 38 digits is divided but for its last digit, then with it
    tens = F.when(usd > big(U128_MAX // SATS_PER_BTC), big(U128_MAX // 10)).otherwise(F.try_multiply(usd.cast(DEC), big(SATS_PER_BTC // 10)).cast(DEC))
    last = F.when(usd > big(U128_MAX // SATS_PER_BTC), big(U128_MAX % 10)).otherwise(big(0))
    divisor = F.nullif(btc.cast(DEC), big(0))
    wide = (((tens % divisor) * 10 + last).cast(DEC) % divisor).cast(DEC)
    rest = F.when(sats.isNotNull(), F.try_subtract(sats, F.try_multiply(whole, btc.cast(DEC)).cast(DEC)).cast(DEC)).otherwise(wide)
    return F.when(btc == 0, big(0)).otherwise(
        sat_add(sat_mul(whole, big(PRICE_SCALE)), mul_div_floor(rest, big(PRICE_SCALE), btc))).cast(DEC)


def sats_candles(candles: DataFrame, keys: Sequence[str], line: DataFrame, seconds: int) -> DataFrame:
    """Filled USD candles in sats at the bucket's BTC price, reopened at the close before.

    ``line``: bucket_ts, price of the same timeframe, dense.  Buckets outside the
    line take its nearest end.
    """
    l = line.select("bucket_ts", F.col("price").alias("btc"))
    j = candles.join(l, "bucket_ts", "left")
    ends = line.agg(F.min_by("price", "bucket_ts").alias("first"), F.max_by("price", "bucket_ts").alias("last"),
                    F.min("bucket_ts").alias("lo"))
    lo, first, last = (ends.select(c).scalar() for c in ("lo", "first", "last"))
    j = j.withColumn("btc", F.coalesce("btc", F.when(F.col("bucket_ts") < lo, first).otherwise(last), big(0)))
    j = j.withColumns({f: usd_to_sats(F.col(f), F.col("btc")) for f in (*PRICES, "volume")})
    w = Window.partitionBy(*keys).orderBy("bucket_ts")
    j = j.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("open")))
    return j.withColumn("high", F.greatest("high", "open")).withColumn("low", F.least("low", "open")).drop("btc")


def spot_override(newest_first: DataFrame, keys: Sequence[str], spot: DataFrame, position: str = "position") -> DataFrame:
    """Replace the newest close of a page by the 10-minute spot close.  ``spot``: keys, spot_close."""
    j = newest_first.join(spot, list(keys), "left")
    hit = (F.col(position) == 1) & F.col("spot_close").isNotNull()
    j = j.withColumn("close", F.when(hit, F.col("spot_close")).otherwise(F.col("close")))
    return (j.withColumn("high", F.when(hit, F.greatest("high", "open", "close")).otherwise(F.col("high")))
            .withColumn("low", F.when(hit, F.least("low", "open", "close")).otherwise(F.col("low"))).drop("spot_close"))


def candle_pages(candles: DataFrame, keys: Sequence[str], now: int, limit: int = 120, offset: int = 0,
                 frames: dict[str, int] | None = None, btc: DataFrame | None = None) -> DataFrame:
    """A page of dense candles, newest first, of every series and timeframe.

    ``candles``: ten-minute candles of any kind of series (pool sides, USD, market cap, derived).  Series run to the bucket of ``now``, flat where
    nothing happened; ``position`` counts from the newest bucket, ``total`` is the length.  With ``btc`` (ts, height, price) values are given in
    sats at each bucket's BTC price, buckets outside the price line taking its nearest end, and a candle opens at the close before it in sats.
    Every timeframe closes at the last ten-minute close, so the newest candle shows the spot price.

    Positions follow from the bucket alone: only rows of the page are ever filled in.
    """
    frames = frames or TIMEFRAMES
    k = [*keys, "tf"]
    rolled = rollup_candles(candles, keys, {n: s for n, s in frames.items() if s != 600} or {"1h": 3600}).filter(F.col("tf").isin(*frames))
    for n in (n for n, s in frames.items() if s == 600):
        rolled = rolled.unionByName(candles.select(*keys, F.lit(n).alias("tf"), "bucket_ts", *PRICES, "volume"))
    dur = F.element_at(F.create_map(*[F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for item in frames.items() for x in item]), F.col("tf"))
    series = Window.partitionBy(*k)
    order = series.orderBy("bucket_ts")
    c = rolled.withColumn("dur", dur).withColumns({
        "__first": F.min("bucket_ts").over(series), "__before": F.lag("close").over(order), "__next": F.lead("bucket_ts").over(order),
        "__end": F.greatest(F.max("bucket_ts").over(series), bucket_start(F.lit(now).cast("bigint"), F.col("dur")))})
    c = chained(c, k, F.col("open"))
    lo = F.greatest(F.col("bucket_ts"), F.col("__end") - (offset + limit - 1) * F.col("dur"))
    hi = F.least(F.coalesce(F.col("__next") - F.col("dur"), F.col("__end")), F.col("__end") - offset * F.col("dur"))
    c = c.withColumns({"__lo": lo, "__hi": hi}).filter("__lo <= __hi").withColumn("__t", F.explode(F.sequence("__lo", "__hi", "dur")))
    real = F.col("__t") == F.col("bucket_ts")
    first = F.col("__t") == F.col("__first")
    flat = {f: F.when(real, F.col(f)).otherwise(F.col("close")) for f in ("open", "high", "low")}
    c = c.select(*k, "dur", F.col("__t").alias("bucket_ts"), *[v.alias(f) for f, v in flat.items()], "close",
                 F.when(real, F.col("volume")).otherwise(big(0)).alias("volume"),
                 F.when(~first, F.when(real, F.col("__before")).otherwise(F.col("close"))).alias("__before"),
                 ((F.col("__end") - F.col("__t")) / F.col("dur") + 1).cast("bigint").alias("position"),
                 ((F.col("__end") - F.col("__first")) / F.col("dur") + 1).cast("bigint").alias("total"))
    if btc is not None:
        w = Window.partitionBy("tf").orderBy("bucket_ts")
        line = price_line(btc, now, frames).withColumn("__prev", F.coalesce(F.lag("price").over(w), F.col("price")))
        ends = line.groupBy("tf").agg(F.min("bucket_ts").alias("__lo"), F.min_by("price", "bucket_ts").alias("__first"), F.max_by("price", "bucket_ts").alias("__last"))
        c = c.join(line, ["tf", "bucket_ts"], "left").join(ends, "tf", "left")
        outside = F.when(F.col("bucket_ts") < F.col("__lo"), F.col("__first")).otherwise(F.col("__last"))
        c = c.withColumns({"__btc": F.coalesce("price", outside, big(0)), "__prev": F.coalesce("__prev", outside, big(0))})
        # one conversion over an array: its expression is large
        chain = F.struct(F.coalesce("__before", "open").cast(DEC).alias("v"), F.when(F.col("__before").isNotNull(), F.col("__prev")).otherwise(F.col("__btc")).cast(DEC).alias("b"))
        pairs = F.array(chain, *[F.struct(F.col(f).cast(DEC).alias("v"), F.col("__btc").cast(DEC).alias("b")) for f in ("high", "low", "close", "volume")])
        c = c.withColumn("__sats", F.transform(pairs, lambda x: usd_to_sats(x["v"], x["b"])))
        c = c.withColumns({f: F.col("__sats")[i] for i, f in enumerate((*PRICES, "volume"))})
        c = c.withColumns({"high": F.greatest("high", "open"), "low": F.least("low", "open")})
    return c.select(*k, "bucket_ts", "position", "total", *PRICES, "volume")


# ---------------------------------------------------------------- change sets

def close_windows(candles: DataFrame, keys: Sequence[str], now: int, spans: dict[str, int]) -> DataFrame:
    """Latest close and the close at or before ``now - span`` per series, in one
    aggregation; a target before the series takes the first close."""
    nb = now - now % 600
    c = candles
    aggs = [F.min_by("close", "bucket_ts").alias("first_close")]
    for n, s in {"now": 0, **spans}.items():
        t = max(nb - s, 0)
        aggs.append(F.max_by("close", F.when(F.col("bucket_ts") <= t, F.col("bucket_ts"))).alias(f"c_{n}"))
    out = c.groupBy(*keys).agg(*aggs)
    return out.withColumns({f"c_{n}": F.coalesce(F.col(f"c_{n}"), F.col("first_close")) for n in ("now", *spans)})


def chart_changes(usd: DataFrame, mcusd: DataFrame, now: int, frames: dict[str, int] | None = None) -> DataFrame:
    """Change per timeframe of price and market cap; the market cap falls back to the
    price where either of its ends is 0."""
    frames = frames or TIMEFRAMES
    u = close_windows(usd, ["token"], now, frames)
    m = close_windows(mcusd, ["token"], now, frames)
    mm = m.select("token", *[F.col(c).alias(f"m_{c}") for c in m.columns if c != "token"])
    j = u.join(mm, "token", "left")
    zero = big(0)
    rows = []
    for tf in frames:
        now_m, prev_m = F.coalesce("m_c_now", zero), F.coalesce(F.col(f"m_c_{tf}"), zero)
        bad = (now_m == 0) | (prev_m == 0)
        rows.append(F.struct(
            F.lit(tf).alias("tf"), percent_change_bp(F.col("c_now"), F.col(f"c_{tf}")).alias("usd_bp"),
            percent_change_bp(F.when(bad, F.col("c_now")).otherwise(now_m),
                              F.when(bad, F.col(f"c_{tf}")).otherwise(prev_m)).alias("mcusd_bp")))
    return j.select("token", F.explode(F.array(*rows)).alias("r")).select("token", "r.*")


def diff_changes(snapshots: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Snapshot rows that differ from the one before, per key."""
    w = Window.partitionBy(*keys).orderBy(at)
    row = F.struct(*values)
    return (snapshots.withColumn("__prev", F.lag(row).over(w)).withColumn("__now", row)
            .filter(~F.col("__prev").eqNullSafe(F.col("__now"))).drop("__prev", "__now"))


def change_history(candles: DataFrame, frames: dict[str, int]) -> DataFrame:
    """Price change per token, bucket and timeframe against the close at or before
    the lookback (else the first close), as one as-of join for all timeframes."""
    first = Window.partitionBy("token").orderBy("bucket_ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = candles.select("token", "bucket_ts", "close").withColumn("first_close", F.first("close").over(first))
    tf = F.explode(F.array(*[F.struct(F.lit(n).alias("tf"), F.lit(s).cast("bigint").alias("dur"))
                             for n, s in frames.items()])).alias("t")
    probe = c.select("token", "bucket_ts", "close", "first_close", tf) \
        .select("token", "bucket_ts", F.col("close").alias("now_close"), "first_close", "t.tf",
                (F.col("bucket_ts") - F.col("t.dur")).alias("at"))
    src = c.select("token", F.col("bucket_ts").alias("at"), F.col("close").alias("prev_close"))
    j = asof_backward(probe, src, ["token"], "at", ["prev_close"], 86400)
    prev = F.coalesce("prev_close", "first_close")
    return j.select("token", "bucket_ts", "tf", percent_change_bp(F.col("now_close"), prev).alias("usd_bp"))


def canonical_pool_prices(candles: DataFrame, canonical: DataFrame, now: int) -> DataFrame:
    """Latest 10-minute close of each token in its BTC pool and its USD pool."""
    nb = now - now % 600
    j = candles.filter(F.col("bucket_ts") <= nb).join(canonical, "pool_id")
    j = j.filter(F.col("side") == F.when(F.col("token_is_base"), "base").otherwise("quote"))
    key = lambda u: F.when(F.col("unit") == u, (F.col("bucket_ts").cast(DEC) * big(10**18) + F.col("pool_id")).cast(DEC))
    return j.groupBy("token").agg(F.max_by("close", key("btc")).alias("btc_price"),
                                  F.max_by("close", key("usd")).alias("usd_price"))


# ---------------------------------------------------------------- derived series

def derived_inputs(candles: DataFrame, choice: DataFrame, token_usd: DataFrame, derived_quotes: DataFrame,
                   seconds: int = 600) -> DataFrame:
    """Non-recursive inputs of the derived series, one row per active bucket.

    A bucket is active for (token, quote) when the token's or the quote's USD candle
    or their pool has data in it, or the token has a USD candle at all.
    """
    pc = _paired(candles).join(choice, "pool_id")
    base = F.col("token_is_base")
    inv = lambda f: invert_price(F.col(f"base_{f}"))
    pool = pc.select(
        "token", "quote", "bucket_ts",
        F.when(base, F.col("base_open")).otherwise(inv("open")).cast(DEC).alias("p_open"),
        F.when(base, F.col("base_high")).otherwise(inv("low")).cast(DEC).alias("p_high"),
        F.when(base, F.col("base_low")).otherwise(inv("high")).cast(DEC).alias("p_low"),
        F.when(base, F.col("base_close")).otherwise(inv("close")).cast(DEC).alias("p_close"),
        F.when(base, F.col("base_volume")).otherwise(F.col("quote_volume")).cast(DEC).alias("p_volume"),
        F.lit(True).alias("p_real"))
    usd = token_usd.select("token", "bucket_ts", *PRICES, "volume")
    dq = derived_quotes.select(F.col("quote_id").alias("quote"), "strategy")
    pairs = choice.select("token", "quote")
    # every token with USD candles, against each of the (few, configured) derived quotes
    t_all = usd.withColumn("quote", F.explode(derived_quotes.agg(F.collect_set("quote_id")).scalar())) \
        .filter(F.col("token") != F.col("quote"))
    t = t_all.select("token", "quote", "bucket_ts", *[F.col(f).alias(f"t_{f}") for f in (*PRICES, "volume")])
    q = usd.select(F.col("token").alias("quote"), "bucket_ts", *[F.col(f).alias(f"q_{f}") for f in (*PRICES, "volume")])
    q = q.join(pairs, "quote")
    k = ["token", "quote", "bucket_ts"]
    j = t.join(pool, k, "full_outer").join(q, k, "full_outer")
    j = j.join(pairs.withColumn("has_pool", F.lit(True)), ["token", "quote"], "left")
    j = j.join(dq, "quote", "left")
    w = Window.partitionBy("token", "quote").orderBy("bucket_ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("last_p_close", F.last(F.when(F.col("p_real"), F.struct("p_close")), ignorenulls=True).over(upto))
    j = j.withColumn("last_p_close", F.col("last_p_close.p_close"))
    j = j.withColumn("last_q_close", F.last("q_close", ignorenulls=True).over(upto))
    before = w.rangeBetween(Window.unboundedPreceding, -seconds)
    return j.withColumn("prev_q_close", F.last("q_close", ignorenulls=True).over(before))


# How a token's own candle and the one carried over from the quote make one.
HIGHER, LOWER, MIDDLE, OWN = range(4)


def _middle(a: Column, b: Column) -> Column:
    return div_floor(sat_add(a, b), 2)


def _own_candle(inputs: DataFrame) -> DataFrame:
    """Columns of a bucket that do not depend on the bucket before: ``own_*`` (the pool's
    prices in USD blended with the token's USD candle, else whichever there is), ``how``
    own and carried candles combine, ``pull`` and ``idle`` (the candle is averaged with
    the previous close because only one source moved), ``moved`` (the quote has a candle)."""
    strategy, pooled = F.coalesce("strategy", F.lit("neutral")), F.coalesce("has_pool", F.lit(False))
    names = (*PRICES, "volume")
    have = lambda p: F.coalesce(F.col(f"{p}_close").isNotNull(), F.lit(False))
    priced = pooled & F.col("last_q_close").isNotNull()
    for f in (*PRICES, "volume"):
        priced &= F.coalesce(F.col(f"p_{f}") != 0, F.lit(False)) if f != "volume" else F.col("p_volume").isNotNull()
    e = inputs.withColumn("__priced", priced)
    for f in PRICES:
        e = e.withColumn(f"b_{f}", F.when(F.col("__priced"), mul_div_floor(F.col("last_q_close"), F.col(f"p_{f}"), PRICE_SCALE)))
    e = e.withColumn("b_volume", F.when(F.col("__priced"), mul_div_floor(F.col("p_volume"), F.col("b_close"), PRICE_SCALE)))
    # each part is a column of its own: a wide product is a large expression, and must not be repeated inside others
    e = e.withColumn("__weight", sat_add(F.col("b_volume"), F.col("t_volume")))
    weight, bv, tv = F.col("__weight"), F.col("b_volume"), F.col("t_volume")
    e = e.withColumn("__cap", mul_div_floor(big(CAP), big(CAP), weight))
    parts = {}
    for f in PRICES:
        b, t = F.col(f"b_{f}"), F.col(f"t_{f}")
        total = F.try_add(F.try_multiply(b, bv).cast(DEC), F.try_multiply(t, tv).cast(DEC)).cast(DEC)
        parts |= {f"__total_{f}": total, f"__by_{f}": mul_div_floor(b, bv, weight), f"__ty_{f}": mul_div_floor(t, tv, weight), f"__mid_{f}": _middle(b, t)}
    e = e.withColumns(parts)
    e = e.withColumns({f"__share_{f}": div_floor(F.col(f"__total_{f}"), weight) for f in PRICES} | {f"__both_{f}": sat_add(F.col(f"__by_{f}"), F.col(f"__ty_{f}")) for f in PRICES})

    def blend(f: str) -> Column:
        # past 38 digits: share by share, at most one unit below, and held where the sum saturates
        weighted = F.when(F.col(f"__total_{f}").isNotNull(), F.col(f"__share_{f}")).otherwise(F.least(f"__both_{f}", "__cap"))
        return (F.when(strategy == "optimistic", F.greatest(f"b_{f}", f"t_{f}")).when(strategy == "pessimistic", F.least(f"b_{f}", f"t_{f}"))
                .when((strategy == "neutral") | (weight == 0), F.col(f"__mid_{f}")).otherwise(weighted))

    both = F.col("__priced") & have("t")
    own = {f: F.when(both, blend(f) if f != "volume" else weight).otherwise(F.coalesce(f"b_{f}", f"t_{f}")).cast(DEC) for f in names}
    e = e.withColumns({f"own_{f}": c for f, c in own.items()}).drop(*parts, "__weight", "__cap", *[f"__{k}_{f}" for k in ("share", "both") for f in PRICES])
    seen = F.coalesce("p_real", F.lit(False))
    e = e.withColumn("moved", pooled & have("q"))
    evenly = (strategy == "neutral") | (F.coalesce("own_volume", big(0)) == 0)
    how = F.when(strategy == "optimistic", HIGHER).when(strategy == "pessimistic", LOWER).when(evenly, MIDDLE).otherwise(OWN)
    anchored = pooled & strategy.isin("neutral", "neutral_vwap")
    # price times volume saturates in a weighted mean, even with a partner of no volume
    e = e.withColumn("own_limit", F.when(~evenly, mul_div_floor(big(CAP), big(CAP), F.col("own_volume"))))
    return e.withColumns({"how": how, "pull": anchored & ~F.col("moved") & have("own") & (have("t") != seen),
                          "idle": anchored & F.col("moved") & ~have("t") & ~seen})


def _fold_closes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Closes of one stretch of a series, each from the close before it."""
    whole = {c: [None if v is None or v != v else int(v) for v in pdf[c]] for c in ("own_close", "own_limit", "q_close", "prev_q_close", "last_p_close")}
    last, closes = 0, []
    for own, limit, quote, base, pool, how, pull, idle, moved in zip(*whole.values(), pdf["how"], pdf["pull"], pdf["idle"], pdf["moved"]):
        ends = []
        if own is not None:
            ends.append(own if not (pull and last) else min(own, limit) if how == OWN else (own + last) // 2)
        rate = pool if not last else min(last * PRICE_SCALE, U128_MAX) // base if base else None
        if moved and rate:
            carried = min(quote * rate, U128_MAX) // PRICE_SCALE
            ends.append((carried + last) // 2 if idle and last else carried)
        if len(ends) == 2:
            last = max(ends) if how == HIGHER else min(ends) if how == LOWER else sum(ends) // 2 if how == MIDDLE else min(ends[0], limit)
        elif ends:
            last = ends[0]
        closes.append(Decimal(min(last, CAP)) if ends or last and not moved else None)
    return pdf[["token", "quote", "bucket_ts"]].assign(close=closes)


def derived_candles(inputs: DataFrame) -> DataFrame:
    """USD candles of a token seen through another token's USD series.

    A close may depend on the one before it, so each series is cut where it does not: at
    buckets that only the token's own candle decides.  Stretches in which nothing else
    happens need no more than a window; the closes of the others are folded stretch by
    stretch.  With the previous close known, candles are plain columns.
    """
    key = ["token", "quote"]
    order = Window.partitionBy(*key).orderBy("bucket_ts")
    e = _own_candle(inputs)
    settled = F.col("own_close").isNotNull() & ~F.col("moved") & ~F.col("pull")
    e = e.withColumn("stretch", F.sum(settled.cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*key, "stretch")
    e = e.withColumn("chained", F.max(F.col("moved") | F.col("pull")).over(inside))
    e = stage(e.withColumn("plain_close", F.first("own_close").over(inside.orderBy("bucket_ts"))))
    types = {f.name: f.dataType.simpleString() for f in e.schema}
    folded = e.filter("chained").select(*key, "stretch", "bucket_ts", "own_close", "own_limit", "q_close", "prev_q_close", "last_p_close", "how", "pull", "idle", "moved") \
        .withColumn("last_p_close", F.col("last_p_close").cast(DEC)).groupBy(*key, "stretch") \
        .applyInPandas(lambda pdf: _fold_closes(pdf.sort_values("bucket_ts")), ", ".join(f"{c} {types[c]}" for c in (*key, "bucket_ts")) + f", close {DEC}")
    e = e.join(folded.withColumnRenamed("close", "folded"), [*key, "bucket_ts"], "left")
    e = e.withColumn("ended", F.when(F.col("chained"), F.col("folded")).otherwise(F.col("plain_close")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("last", F.coalesce(F.last("ended", ignorenulls=True).over(before), big(0)))
    old = F.col("last") != 0
    e = e.withColumn("__drift", mul_div_floor(F.col("last"), big(PRICE_SCALE), F.col("prev_q_close")))
    e = e.withColumn("__rate", F.when(old, F.when(F.col("prev_q_close") != 0, F.col("__drift"))).otherwise(F.col("last_p_close").cast(DEC)))
    e = e.withColumn("rate", F.when(F.col("moved") & (F.col("__rate") != 0), F.col("__rate")))

    # own and carried prices, then their averages with the close before, then the two together: a column each
    e = e.withColumns({f"__c_{f}": mul_div_floor(F.col(f"q_{f}"), F.col("rate"), PRICE_SCALE) for f in PRICES} | {f"__m_{f}": _middle(F.col(f"own_{f}"), F.col("last")) for f in PRICES})
    e = e.withColumns({f"__a_{f}": _middle(F.col(f"__c_{f}"), F.col("last")) for f in PRICES})
    held = lambda f: F.least(f"own_{f}", "own_limit")
    e = e.withColumns({f"__o_{f}": F.when(F.col("pull") & old, F.when(F.col("how") == OWN, held(f)).otherwise(F.col(f"__m_{f}"))).otherwise(F.col(f"own_{f}")) for f in PRICES}
                      | {f"__k_{f}": F.when(F.col("idle") & old, F.col(f"__a_{f}")).otherwise(F.col(f"__c_{f}")) for f in PRICES})
    e = e.withColumns({f"__j_{f}": _middle(F.col(f"__o_{f}"), F.col(f"__k_{f}")) for f in PRICES})

    def value(f: str) -> Column:
        own, carried = F.col(f"__o_{f}"), F.col(f"__k_{f}")
        joint = F.when(F.col("how") == HIGHER, F.greatest(own, carried)).when(F.col("how") == LOWER, F.least(own, carried)) \
            .when(F.col("how") == MIDDLE, F.col(f"__j_{f}")).otherwise(held(f))
        flat = F.when(~F.col("moved") & old, F.col("last"))
        return F.when(own.isNotNull() & carried.isNotNull(), joint).otherwise(F.coalesce(own, carried, flat)).cast(DEC)

    # written before it is filtered: a filter would be pushed below all these columns, with their expressions spelt out in it
    e = stage(e.select(*key, "bucket_ts", "last", "own_volume", *[value(f).alias(f"v_{f}") for f in PRICES])).filter("v_close is not null")
    return e.select(*key, "bucket_ts", F.when(old, F.col("last")).otherwise(F.col("v_open")).alias("open"),
                    F.when(old, F.greatest("v_high", "last")).otherwise(F.col("v_high")).alias("high"),
                    F.when(old, F.least("v_low", "last")).otherwise(F.col("v_low")).alias("low"),
                    F.col("v_close").alias("close"), F.coalesce("own_volume", big(0)).cast(DEC).alias("volume"))
