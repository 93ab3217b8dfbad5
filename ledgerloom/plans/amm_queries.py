"""Plans over pool activity, candles and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exact import DEC, big
from ..functions.paging import page
from ..operators import amm
from .facts import NOW, Facts
from .registry import query
from .sqltext import HIGHER_VALUES, TF_VALUES

OHLCV = "open high low close volume"
DELTAS = "base_delta quote_delta"
ACT_COLS = ("pool_id", "tx_id", "height", "ts", "seq", "address", "success", "kind", "base_delta", "quote_delta")
ACT_SQL = ", ".join(ACT_COLS)


@query("candles_10m", "select * from m10", text=OHLCV)
def candles_10m(t: Facts):
    return t.m10_plan


@query("pool_flow", """
select pool_id, tx_id, height, ts, seq, address, success, base_delta, quote_delta from flow where base_delta <> 0 or quote_delta <> 0
""", text=DELTAS)
def pool_flow(t: Facts):
    return amm.pool_balance_flow(t.flow_legs, t.pools, ["tx_id", "height", "ts", "seq", "address", "success"])


@query("activity", f"select {ACT_SQL}, direction from activity", text=DELTAS)
def activity(t: Facts):
    return t.activity.select(*ACT_COLS, "direction")


@query("running_reserves", "select pool_id, seq, base_reserve, quote_reserve from reserves", text="base_reserve quote_reserve")
def running_reserves(t: Facts):
    return t.reserves.select("pool_id", "seq", "base_reserve", "quote_reserve")


LIVE_SQL = """
select pool_id, base_id, quote_id, greatest(coalesce(b.amount, 0), 0) as base_reserve, greatest(coalesce(q.amount, 0), 0) as quote_reserve
from pools left join (select pool_id, sum(base_delta) as amount from flow group by pool_id) b using (pool_id)
left join (select pool_id, sum(quote_delta) as amount from flow group by pool_id) q using (pool_id)
"""


@query("live_reserves", LIVE_SQL, text="base_reserve quote_reserve")
def live_reserves(t: Facts):
    held = t.flow_legs.groupBy("owner", "token").agg(F.greatest(F.sum("delta").cast(DEC), big(0)).alias("amount"))
    return amm.live_reserves(held, t.pools)


@query("trade_prices", "select pool_id, seq, price_base, price_quote from trades", text="price_base price_quote")
def trade_prices(t: Facts):
    return t.trades.select("pool_id", "seq", "price_base", "price_quote")


@query("wide_prices", """
select pool_id, seq, case when b = 0 then 0 when q > 34028236692093846346337 then cast(340282366920938463463374607431768211455::uhugeint // cast(b as uhugeint) as hugeint)
    else q // b * 10000000000000000 + q % b * 10000000000000000 // b end as price_base, case when q = 0 then 0 else b * 10000000000000000 // q end as price_quote
from (select pool_id, seq, base_reserve as b, quote_reserve * case when pool_id % 2 = 0 then 20000000000 else 50000000000 end as q from trades)
""", text="price_base price_quote")
def wide_prices(t: Facts):
    # quote reserves of 1e22 to 1e23: their products with the price scale pass 38 digits, and in part 2^128 - 1
    wide = t.reserves.withColumn("quote_reserve", (F.col("quote_reserve") * F.when(F.col("pool_id") % 2 == 0, big(2 * 10**10)).otherwise(big(5 * 10**10))).cast(DEC))
    return amm.trade_prices(wide).select("pool_id", "seq", "price_base", "price_quote")


@query("candles_merge", "select * from m10", text=OHLCV)
def candles_merge(t: Facts):
    early = F.col("ts") % 600 < 300
    keys = ["pool_id", "side"]
    return amm.merge_candles(amm.candles(t.trades.filter(early)), amm.candles(t.trades.filter(~early)), keys)


ROLLUP_CTE = f"""
select pool_id, side, tf, bucket_ts // dur * dur as bucket_ts, arg_min(o, bucket_ts) as open, max(greatest(high, o)) as high,
       min(least(low, o)) as low, arg_max(close, bucket_ts) as close, sum(volume) as volume
from (select *, coalesce(lag(close) over (partition by pool_id, side order by bucket_ts), close) as o from m10), {HIGHER_VALUES}
group by 1, 2, 3, 4
"""


@query("candles_rollup", ROLLUP_CTE, text=OHLCV)
def candles_rollup(t: Facts):
    return amm.rollup_candles(t.m10_plan, ["pool_id", "side"])


FILLED_SQL = f"""
select pool_id, side, bucket_ts,
       case when is_real then coalesce(prev, open) else fill end as open,
       case when is_real then greatest(high, coalesce(prev, open)) else fill end as high,
       case when is_real then least(low, coalesce(prev, open)) else fill end as low,
       fill as close, case when is_real then volume else 0 end as volume, is_real
from (select *, lag(fill) over (partition by pool_id, side order by bucket_ts) as prev
      from (select g.pool_id, g.side, g.bucket_ts, open, high, low, volume, close is not null as is_real,
                   last_value(close ignore nulls) over (partition by g.pool_id, g.side order by g.bucket_ts) as fill
            from (select pool_id, side, unnest(generate_series(min(bucket_ts), {NOW} // 600 * 600, 600)) as bucket_ts
                  from m10 group by 1, 2) g
            left join m10 using (pool_id, side, bucket_ts)))
"""


@query("candles_filled", FILLED_SQL, text=OHLCV)
def candles_filled(t: Facts):
    return amm.fill_candles(t.m10_plan, ["pool_id", "side"], 600, NOW)


BTC_LINE_SQL = f"""
select tf, g.bucket_ts, last_value(price ignore nulls) over (partition by tf order by g.bucket_ts) as price
from (select tf, unnest(generate_series(min(ts // dur * dur), {NOW} // any_value(dur) * any_value(dur), any_value(dur))) as bucket_ts
      from btc, {TF_VALUES} group by tf) g
left join (select tf, ts // dur * dur as bucket_ts, arg_max(price, height) as price from btc, {TF_VALUES} group by 1, 2) b
using (tf, bucket_ts)
"""


@query("btc_line", BTC_LINE_SQL, text="price")
def btc_line(t: Facts):
    return amm.price_line(t.btc, NOW)


def _windows_sql(keys: str, names: dict[str, str], source: str) -> str:
    cols = []
    for n, c in names.items():
        cols += [f"sum(case when ts >= {NOW - d * 86400} then {c} else 0 end) as {n}_{label}"
                 for label, d in (("1d", 1), ("7d", 7), ("30d", 30))]
        cols.append(f"sum({c}) as {n}_all")
    return f"select {keys}, {', '.join(cols)} from {source} group by {keys}"


LABELS = ("1d", "7d", "30d", "all")


@query("pool_trade_windows", _windows_sql("pool_id", {"base": "abs(base_delta)", "quote": "abs(quote_delta)"}, "trades"),
       text=" ".join(f"{s}_{w}" for s in ("base", "quote") for w in LABELS))
def pool_trade_windows(t: Facts):
    return amm.pool_trade_windows(t.activity, NOW)


SIDES_SQL = """(select base_id as token, ts, abs(base_delta) as v from trades join pools using (pool_id)
 union all select quote_id, ts, abs(quote_delta) from trades join pools using (pool_id))"""


@query("token_trade_windows", _windows_sql("token", {"amount": "v"}, SIDES_SQL), text=" ".join(f"amount_{w}" for w in LABELS))
def token_trade_windows(t: Facts):
    return amm.token_trade_windows(amm.pool_trade_windows(t.activity, NOW), t.pools)


@query("activity_feed", f"""
select {ACT_SQL}, position, (select count(*) from activity where kind = 'trade_buy') as total
from (select *, row_number() over (order by abs(quote_delta) desc, ts desc, seq desc) as position from activity where kind = 'trade_buy')
where position > 50 and position <= 150
""", text=DELTAS)
def activity_feed(t: Facts):
    f = amm.activity_feed(t.activity, sort="quote_amount", side="buy", group="trades", limit=100, offset=50)
    return f.select(*ACT_COLS, "position", "total")


@query("activity_feed_by_side", f"""
select {ACT_SQL}, position from (select *, row_number() over (order by kind = 'trade_sell', abs(base_delta), ts, seq) as position
  from activity where kind in ('trade_buy', 'trade_sell')) where position <= 200
""", text=DELTAS)
def activity_feed_by_side(t: Facts):
    return amm.activity_feed(t.activity, sort="side_amount", desc=False, group="trades", limit=200).select(*ACT_COLS, "position")


@query("activity_rows", """
select pool_id, tx_id, ts, kind, case kind when 'trade_buy' then 'buy' when 'trade_sell' then 'sell' else 'neutral' end as side,
       abs(base_delta) as amount, cast(abs(base_delta) as double) / 100000000.0 as amount_scaled, success from activity
""", text="amount")
def activity_rows(t: Facts):
    return amm.activity_rows(t.activity)


@query("activity_counts", """
select pool_id, case when kind in ('trade_buy', 'trade_sell') then 'trades' else 'events' end as grp, count(*) as n from activity group by 1, 2
union all select pool_id, null, count(*) from activity group by 1
""")
def activity_counts(t: Facts):
    return amm.activity_counts(t.activity)


@query("token_swaps", """
select token, pool_id, tx_id, position from (
  select *, row_number() over (partition by token order by ts desc, seq desc) as position
  from (select base_id as token, a.* from activity a join pools using (pool_id)
        union all select quote_id, a.* from activity a join pools using (pool_id))
  where kind in ('trade_buy', 'trade_sell')) where position <= 25
""")
def token_swaps(t: Facts):
    from ..functions.paging import top_per_key
    s = amm.token_swaps(t.activity, t.pools)
    return top_per_key(s, ["token"], [F.desc("ts"), F.desc("seq")], 25).select("token", "pool_id", "tx_id", "position")


CREATED_SQL = "select pool_id, min(event_id) as tx_id, min(ts) as ts, min(height) as height from ev group by pool_id"


def created_pools(t: Facts):
    """The first event of each pool stands for its creation."""
    return t.ev.groupBy("pool_id").agg(F.min("event_id").alias("tx_id"), F.min("ts").alias("ts"), F.min("height").alias("height"))


@query("pool_creations", f"""
select *, 'pool_create' as kind, '0' as base_delta, '0' as quote_delta, row_number() over (order by ts desc, tx_id desc) as position
from ({CREATED_SQL})
""")
def pool_creations(t: Facts):
    c = amm.pool_create_rows(created_pools(t)).drop("direction")
    return page(c, [F.desc("ts"), F.desc("tx_id")], None, total=False)


@query("address_events", """
select address, kind, count(*) as n, max(tx_id) as last_tx, sum(abs(base_delta)) as base_moved from activity group by 1, 2
""", text="base_moved")
def address_events(t: Facts):
    e = amm.address_events(t.activity, ["trade_buy", "trade_sell", "liquidity_add", "liquidity_remove"])
    return e.groupBy("address", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("tx_id").alias("last_tx"),
                                            F.sum(F.abs("base_delta")).cast(DEC).alias("base_moved"))


@query("amm_history", f"""
select {ACT_SQL}, position, (select count(*) from activity where success and kind like 'liquidity%') as total
from (select *, row_number() over (order by ts desc, seq desc) as position from activity where success and kind like 'liquidity%')
where position > 20 and position <= 120
""", text=DELTAS)
def amm_history(t: Facts):
    return amm.amm_history(t.activity, ["liquidity_add", "liquidity_remove"], successful=True, limit=100, offset=20) \
        .select(*ACT_COLS, "position", "total")


@query("swap_history", """
select pool_id, tx_id, ts, seq, address, success, case when kind = 'trade_sell' then base_id else quote_id end as sold_token,
       case when kind = 'trade_sell' then quote_id else base_id end as bought_token,
       abs(case when kind = 'trade_sell' then base_delta else quote_delta end) as sold_amount,
       abs(case when kind = 'trade_sell' then quote_delta else base_delta end) as bought_amount
from activity join pools using (pool_id) where kind in ('trade_buy', 'trade_sell')
""", text="sold_amount bought_amount")
def swap_history(t: Facts):
    return amm.swap_history(t.activity, t.pools)


def _kind_history(kind: str):
    return f"""
select pool_id, tx_id, ts, address, success, base_delta, quote_delta, position from (
  select *, row_number() over (partition by pool_id order by ts desc, seq desc) as position from activity where kind = '{kind}')
where position <= 20"""


def _history_of(t: Facts, kind: str, key: str):
    from ..functions.paging import top_per_key
    h = top_per_key(t.activity.filter(F.col("kind") == kind), [key], [F.desc("ts"), F.desc("seq")], 20)
    return h.select("pool_id", "tx_id", "ts", "address", "success", "base_delta", "quote_delta", "position")


@query("mint_history", _kind_history("liquidity_add"), text=DELTAS)
def mint_history(t: Facts):
    return _history_of(t, "liquidity_add", "pool_id")


@query("burn_history", _kind_history("liquidity_remove"), text=DELTAS)
def burn_history(t: Facts):
    return _history_of(t, "liquidity_remove", "pool_id")


@query("address_history", """
select address, kind, pool_id, tx_id, ts, base_delta, quote_delta, position from (
  select *, row_number() over (partition by address, kind order by ts desc, seq desc) as position from activity)
where position <= 10
""", text=DELTAS)
def address_history(t: Facts):
    from ..functions.paging import top_per_key
    e = amm.address_events(t.activity, ["trade_buy", "trade_sell", "liquidity_add", "liquidity_remove"])
    return top_per_key(e, ["address", "kind"], [F.desc("ts"), F.desc("seq")], 10) \
        .select("address", "kind", "pool_id", "tx_id", "ts", "base_delta", "quote_delta", "position")


@query("candle_volume_sums", f"""
select pool_id, side, sum(case when bucket_ts // 86400 * 86400 > {NOW // 86400 * 86400 - 7 * 86400} and bucket_ts // 86400 * 86400 <= {NOW}
       then volume else 0 end) as volume_7d, sum(volume) as volume_all from m10 group by 1, 2
""", text="volume_7d volume_all")
def candle_volume_sums(t: Facts):
    return amm.candle_volume_sums(amm.rollup_candles(t.m10_plan, ["pool_id", "side"], {"1d": 86400}), NOW)


NAMES_SQL = """
select pool_id, case when pool_id % 2 = 0 then b.p_name || ' / ' || q.p_name || ' LP' else b.p_name || ' / ' || q.p_name || 'lp ' end as name
from pools join part b on base_id = b.p_partkey join part q on quote_id = q.p_partkey
"""


def pool_names(t: Facts):
    p = t.table("part").select("p_partkey", "p_name")
    b = p.select(F.col("p_partkey").alias("base_id"), F.col("p_name").alias("b"))
    q = p.select(F.col("p_partkey").alias("quote_id"), F.col("p_name").alias("q"))
    j = t.pools.join(b, "base_id").join(q, "quote_id")
    tail = F.when(F.col("pool_id") % 2 == 0, " LP").otherwise("lp ")
    return j.select("pool_id", F.concat("b", F.lit(" / "), "q", tail).alias("name"))


CATALOG_SQL = f"""
select pool_id, base_id, quote_id, factory_id, n.name, regexp_replace(rtrim(n.name), '\\s*(LP|lp)$', '') as pool_name
from pools left join ({NAMES_SQL}) n using (pool_id)
"""


@query("pool_catalog", CATALOG_SQL)
def pool_catalog(t: Facts):
    return amm.pool_catalog(t.pools.drop("base_initial", "quote_initial"), pool_names(t))


@query("pools_of_token", """
select base_id as token, pool_id from pools union select quote_id, pool_id from pools
""")
def pools_of_token(t: Facts):
    return amm.pools_of_token(t.pools)


@query("pool_name_prefix", f"select pool_id, pool_name from ({CATALOG_SQL}) where lower(pool_name) like 's%'")
def pool_name_prefix(t: Facts):
    return amm.pool_name_prefix(amm.pool_catalog(t.pools, pool_names(t)), "S").select("pool_id", "pool_name")
