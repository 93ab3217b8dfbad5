"""Token and pool metrics, rankings and ranked search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.asof import asof_backward
from ..functions.exact import (AMOUNT_SCALE, DEC, PRICE_SCALE, apr_bp_30d,
    big, mul_div_floor, percent_change_bp, sat_add, sat_mul)
from ..functions.paging import page, top_per_key
from ..functions.text import format_bp, normalize_name
from .amm import BLOCKS_PER_DAY, BLOCKS_PER_WEEK, chain_position
from .prices import close_windows

DAY = 86400
SIDES = ("base", "quote")
SPANS = {"1d": DAY, "7d": 7 * DAY, "30d": 30 * DAY}


def scaled_value(amount: Column, price: Column) -> Column:
    return mul_div_floor(amount, price, AMOUNT_SCALE)


def token_metrics(usd: DataFrame, supply: DataFrame, windows: DataFrame, now: int,
                  keys: Sequence[str] = ("token",)) -> DataFrame:
    """Price, valuation, volumes and changes per series.

    Volumes are amounts at the latest price.  Changes compare the latest close with
    the close at or before the lookback, else with the first close.
    """
    c = close_windows(usd, list(keys), now, SPANS)
    j = c.join(supply.select("token", "supply"), "token", "left").join(windows, "token", "left")
    price = F.col("c_now")
    amount = lambda w: F.coalesce(F.col(f"amount_{w}"), big(0))
    fdv = scaled_value(price, F.coalesce("supply", big(0)))
    j = j.withColumn("fdv_usd", fdv)
    return j.select(
        *keys, price.alias("price_usd"), "fdv_usd", F.col("fdv_usd").alias("marketcap_usd"),
        scaled_value(amount("all"), price).alias("volume_all_time"),
        *[scaled_value(amount(w), price).alias(f"volume_{w}") for w in SPANS],
        *[percent_change_bp(price, F.col(f"c_{w}")).alias(f"change_{w}_bp") for w in SPANS],
        percent_change_bp(price, F.col("first_close")).alias("change_all_time_bp"))


def pool_values(amounts: DataFrame, pools: DataFrame, quotes: DataFrame, prices: DataFrame,
                btc_price: Column) -> DataFrame:
    """TVL of each pool row in USD (1e16) and sats (1e8).

    ``amounts``: pool_id, base_reserve, quote_reserve (further columns kept).
    ``prices``: token, price_usd, price_sats.  A canonical side is valued directly.
    """
    info = prices.select("token", "price_usd", "price_sats").join(
        quotes.select(F.col("quote_id").alias("token"), "unit"), "token", "full_outer")
    j = amounts.join(pools.select("pool_id", "base_id", "quote_id"), "pool_id")
    for s in SIDES:
        j = j.join(info.select(F.col("token").alias(f"{s}_id"), F.coalesce("price_usd", big(0)).alias(f"{s}_price_usd"),
                               F.coalesce("price_sats", big(0)).alias(f"{s}_price_sats"), F.col("unit").alias(f"{s}_unit")), f"{s}_id", "left")
    j = j.withColumns({"__btc": btc_price, **{f"{s}_price_{u}": F.coalesce(f"{s}_price_{u}", big(0)) for s in SIDES for u in ("usd", "sats")}})

    def usd(s: str) -> Column:
        a, unit, x = F.col(f"{s}_reserve"), F.col(f"{s}_unit"), F.col("__btc")
        # one product: the price of a canonical side is 1 USD or the BTC price
        price = F.when(unit == "usd", big(PRICE_SCALE)).when((unit == "btc") & x.isNotNull(), x).otherwise(F.col(f"{s}_price_usd"))
        return scaled_value(a, price)

    def sats(s: str) -> Column:
        a, unit, x = F.col(f"{s}_reserve"), F.col(f"{s}_unit"), F.col("__btc")
        direct = F.when(unit == "btc", a).when((unit == "usd") & x.isNotNull(), mul_div_floor(a, big(PRICE_SCALE), x))
        return F.coalesce(direct, scaled_value(a, F.col(f"{s}_price_sats"))).cast(DEC)

    j = j.withColumns({**{f"{s}_tvl_usd": usd(s) for s in SIDES}, **{f"{s}_tvl_sats": sats(s) for s in SIDES}})
    return j.withColumns({f"tvl_{u}": sat_add(F.col(f"base_tvl_{u}"), F.col(f"quote_tvl_{u}")) for u in ("usd", "sats")}) \
        .drop("__btc", "base_unit", "quote_unit")


def pool_metrics(values: DataFrame, windows: DataFrame, past: DataFrame) -> DataFrame:
    """Volumes in both currencies, TVL changes and yield.

    ``values`` from :func:`pool_values`; ``past``: pool_id, tvl_1d, tvl_7d (0 if none).
    """
    j = values.join(windows, "pool_id", "left").join(past, "pool_id", "left")
    amount = lambda s, w: F.coalesce(F.col(f"{s}_{w}"), big(0))
    cells = [(w, u) for u in ("usd", "sats") for w in ("1d", "7d", "30d", "all")]
    j = j.withColumns({f"{s}_{w}_{u}": scaled_value(amount(s, w), F.col(f"{s}_price_{u}")) for w, u in cells for s in SIDES})
    j = j.withColumns({f"volume_{w}_{u}": sat_add(F.col(f"base_{w}_{u}"), F.col(f"quote_{w}_{u}")) for w, u in cells})
    t = F.col("tvl_usd")
    return j.select(
        "pool_id", "tvl_usd", "tvl_sats",
        *[f"volume_{w}_{u}" for u in ("usd", "sats") for w in ("1d", "7d", "30d", "all")],
        percent_change_bp(t, F.coalesce("tvl_1d", big(0))).alias("tvl_change_1d_bp"),
        percent_change_bp(t, F.coalesce("tvl_7d", big(0))).alias("tvl_change_7d_bp"),
        apr_bp_30d(F.col("volume_30d_usd"), t).alias("apr_bp"))


def tvl_asof(history: DataFrame, heights: DataFrame, name: str = "tvl_usd") -> DataFrame:
    """TVL at or before each requested (pool_id, height); 0 before the first."""
    h = history.select("pool_id", "height", name)
    out = asof_backward(heights, h, ["pool_id"], "height", [name], 7 * BLOCKS_PER_DAY)
    return out.withColumn(name, F.coalesce(name, big(0)))


def past_tvl(history: DataFrame, tip: int) -> DataFrame:
    """TVL one day and one week of blocks before the tip, in one aggregation."""
    def at(blocks: int) -> Column:
        ok = F.col("height") <= max(tip - blocks, 0)
        return F.coalesce(F.max_by("tvl_usd", F.when(ok, F.col("height"))), big(0))
    return history.groupBy("pool_id").agg(at(BLOCKS_PER_DAY).alias("tvl_1d"), at(BLOCKS_PER_WEEK).alias("tvl_7d"))


def formatted_changes(metrics: DataFrame) -> DataFrame:
    """Basis-point columns as percent text."""
    cols = [c for c in metrics.columns if c.endswith("_bp")]
    return metrics.withColumns({c[:-3]: format_bp(F.col(c)) for c in cols}).drop(*cols)


def rank_tokens(creations: DataFrame, metrics: DataFrame, field: str, desc: bool = True,
                limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Page of tokens by a metric.  Tokens without metrics follow the ranked ones in
    creation order (descending sort) or come before them (ascending)."""
    j = creations.select("token", "creation_height").join(metrics, "token", "left")
    missing = F.col(field).isNull()
    order = ([missing.asc(), F.col(field).desc(), F.when(missing, F.col("creation_height")), F.col("token").desc()]
             if desc else [missing.desc(), F.col(field).asc(), F.when(missing, F.col("creation_height")), F.col("token")])
    return page(j, order, limit, offset)


def rank_tokens_by_quote(creations: DataFrame, derived: DataFrame, quotes: DataFrame, field: str, desc: bool = True,
                         limit: int | None = 50, offset: int = 0) -> DataFrame:
    """A page of tokens for each derived quote, by a metric of their derived series; tokens without one follow as in :func:`rank_tokens`.

    ``derived``: token, quote, metrics; ``quotes``: the few configured quote_ids.
    """
    every = creations.select("token", "creation_height").withColumn("quote", F.explode(quotes.agg(F.collect_set("quote_id")).scalar()))
    j = every.join(derived, ["token", "quote"], "left")
    missing = F.col(field).isNull()
    order = ([missing.asc(), F.col(field).desc(), F.when(missing, F.col("creation_height")), F.col("token").desc()]
             if desc else [missing.desc(), F.col(field).asc(), F.when(missing, F.col("creation_height")), F.col("token")])
    return top_per_key(j, ["quote"], order, limit, offset)


def search_ranked(prefixes: DataFrame, metrics: DataFrame, prefix: str, field: str,
                  limit: int = 20, offset: int = 0) -> DataFrame:
    """Tokens having the prefix, best metric first.  ``prefixes``: token, prefix."""
    hits = prefixes.filter(F.col("prefix") == prefix).select("token").distinct()
    j = hits.join(metrics, "token", "left").withColumn(field, F.coalesce(F.col(field), F.lit(0).cast(metrics.schema[field].dataType)))
    return page(j, [F.desc(field), F.asc("token")], limit, offset)


def search_or_scan(prefixes: DataFrame, creations: DataFrame, holders: DataFrame, metrics: DataFrame, text: str, field: str,
                   limit: int = 20, offset: int = 0, quote: int | None = None, longest: int = 6) -> DataFrame:
    """A page of tokens for a search text: from the prefix index by a metric, or, where that page is empty, every token any of whose names or
    symbols starts with the text, by holders.  ``scanned`` tells which.

    ``prefixes``: token, prefix (of at most ``longest`` characters: longer texts always scan); ``holders``: token, holders.  With ``quote``,
    ``metrics`` are derived ones (token, quote, …) and only tokens that have them count.
    """
    q = text.strip().lower()
    if quote is not None:
        metrics = metrics.filter(F.col("quote") == quote).drop("quote")
    known = prefixes if quote is None else prefixes.join(metrics.select("token"), "token", "left_semi")
    found = search_ranked(known if len(q) <= longest else known.filter(F.lit(False)), metrics, q, field, limit, offset).select("token", "position")
    starts = F.exists(F.concat("names", "symbols"), lambda n: normalize_name(n).startswith(q))
    named = creations.filter(starts).select("token").join(holders, "token", "left").withColumn("holders", F.coalesce("holders", F.lit(0)).cast("bigint"))
    scan = page(named, [F.desc("holders"), F.asc("token")], limit, offset, total=False).select("token", "position")
    if quote is not None:
        scan = scan.join(metrics.select("token"), "token", "left_semi")
    empty = found.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    return found.withColumn("scanned", F.lit(False)).unionByName(scan.filter(empty).withColumn("scanned", F.lit(True)))


def rank_pools(metrics: DataFrame, field: str, desc: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    c = F.col(field)
    return page(metrics, [c.desc() if desc else c.asc(), F.col("pool_id").asc()], limit, offset)


def tvl_history(reserves: DataFrame, pools: DataFrame, quotes: DataFrame, token_usd: DataFrame, btc: DataFrame,
                epoch: int, block_seconds: int) -> DataFrame:
    """USD TVL of a pool after each block that moved it, at the prices known then."""
    at = chain_position()
    c = reserves.groupBy("pool_id", "height").agg(F.max_by("base_reserve", at).alias("base_reserve"),
                                                  F.max_by("quote_reserve", at).alias("quote_reserve"))
    c = c.join(pools.select("pool_id", "base_id", "quote_id"), "pool_id") \
        .withColumn("at", F.col("height") * block_seconds + epoch)
    sides = F.explode(F.array(*[F.struct(F.col(f"{s}_id").alias("token"), F.col(f"{s}_reserve").alias("amount"))
                                for s in ("base", "quote")])).alias("s")
    legs = c.select("pool_id", "height", "at", sides).select("pool_id", "height", "at", "s.*")
    legs = asof_backward(legs, token_usd.select("token", F.col("bucket_ts").alias("at"), F.col("close").alias("price")),
                         ["token"], "at", ["price"], 7 * DAY)
    legs = asof_backward(legs, btc.select(F.col("ts").alias("at"), F.col("price").alias("btc")), [], "at", ["btc"], DAY)
    legs = legs.join(quotes.withColumnRenamed("quote_id", "token"), "token", "left")
    a = F.col("amount")
    value = (F.when(F.col("unit") == "usd", sat_mul(a, big(PRICE_SCALE // AMOUNT_SCALE)))
             .when((F.col("unit") == "btc") & F.col("btc").isNotNull(), scaled_value(a, F.col("btc")))
             .otherwise(scaled_value(a, F.coalesce("price", big(0)))))
    return legs.groupBy("pool_id", "height").agg(F.sum(value).cast(DEC).alias("tvl_usd"))
