"""Plans over BTC prices, token price series, metrics and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exact import DEC, big
from ..operators import amm, metrics, prices
from ..operators.amm import TIMEFRAMES
from .facts import EPOCH, NOW, TIP, Facts
from .registry import query
from .facts_sql import CTES
from .sqltext import HIGHER_VALUES, TF_VALUES, bp_text, muldiv, muldiv_wide, pct

OHLCV = "open high low close volume"
PRICES = ("open", "high", "low", "close")

# ---------------------------------------------------------------- BTC price


@query("btc_price_latest", "select max(height) as height, arg_max(price, height) as price from btc", text="price")
def btc_price_latest(t: Facts):
    return t.btc.agg(F.max("height").alias("height"), F.max_by("price", "height").alias("price"))


@query("btc_price_asof", """
select h.height, k.price from (select distinct height from trades) h asof left join (
  select height, price from btc where height % 3 = 2
  union all select height, price from btc where height % 3 < 2 and height in (select height from trades)) k
on h.height >= k.height
""", text="price")
def btc_price_asof(t: Facts):
    # the price points are dealt out to the three sources by height
    h, src = t.trades, t.btc.select("height", "price", (F.col("height") % 3).alias("s"))
    part = lambda i: src.filter(F.col("s") == i).drop("s")
    return prices.btc_price_asof(h, part(0), part(1), part(2))


@query("nearest_price", """
select ts, feed_ts, price from (
  select h.ts, b.ts as feed_ts, b.price, row_number() over (partition by h.ts order by abs(b.ts - h.ts), b.ts) as rn
  from (select distinct ts from flow) h, btc b) where rn = 1
""", text="price")
def nearest_price(t: Facts):
    return prices.nearest_price(t.flow.select("ts").distinct(), t.btc.select("ts", "price"))


@query("price_from_sqrt")
def price_from_sqrt(t: Facts):
    sqrt = (F.col("cents").cast(DEC) * big(2**90)).cast(DEC)
    e = t.ev.select("event_id", sqrt.alias("sqrt_x96"), (F.col("event_id") % 2 == 0).alias("inverse"))
    return e.select("event_id", prices.price_from_sqrt(F.col("sqrt_x96"), F.col("inverse"), F.lit(10**14)).alias("price"))


# ---------------------------------------------------------------- token series


@query("canonical_pools", "select * from canonical")
def canonical_pools(t: Facts):
    return t.canonical


CHOICE_SQL = """
select token, quote, pool_id, token_is_base from (
  select *, row_number() over (partition by token, quote order by token_is_base desc, pool_id) as rn from (
    select pool_id, base_id as token, quote_id as quote, true as token_is_base from pools
    union all select pool_id, quote_id, base_id, false from pools)) where rn = 1
"""


@query("derived_pool_choice", CHOICE_SQL)
def derived_pool_choice(t: Facts):
    any_quote = t.pools.select(F.explode(F.array("base_id", "quote_id")).alias("quote_id")).distinct()
    return prices.derived_pool_choice(t.pools, any_quote)


@query("token_usd_candles", "select * from token_usd", text=OHLCV)
def token_usd_candles(t: Facts):
    return t.token_usd


def _merge_sql(f: str) -> str:
    w = f"(a.{f} * a.volume + b.{f} * b.volume) // (a.volume + b.volume)"
    return (f"case strategy when 'optimistic' then greatest(a.{f}, b.{f}) when 'pessimistic' then least(a.{f}, b.{f}) "
            f"when 'neutral' then (a.{f} + b.{f}) // 2 else case when a.volume + b.volume = 0 then (a.{f} + b.{f}) // 2 else {w} end end as {f}")


@query("merge_strategies", f"""
select a.pool_id // 2 as pair, a.bucket_ts, strategy, {', '.join(_merge_sql(f) for f in PRICES)},
       case when a.volume = 0 then b.volume else a.volume end as volume
from m10 a join m10 b on b.pool_id = a.pool_id + 1 and a.bucket_ts = b.bucket_ts and a.pool_id % 2 = 0
     and a.side = 'base' and b.side = 'base', (values ('optimistic'), ('pessimistic'), ('neutral'), ('neutral_vwap')) s(strategy)
""", text=OHLCV, ints="pair")
def merge_strategies(t: Facts):
    c = t.m10.filter(F.col("side") == "base") \
        .withColumn("pair", F.floor(F.col("pool_id") / 2)).drop("side")
    odd = F.col("pool_id") % 2 == 1
    return prices.merge_strategies(c.filter(~odd), c.filter(odd), ["pair", "bucket_ts"])


CTES["mcusd"] = f"""
select token, bucket_ts, {', '.join(f"{muldiv(f, 'supply', 10**8)} as {f}" for f in PRICES)}, volume
from token_usd join supply using (token)
"""


def mcusd(t: Facts):
    return prices.mcap_candles(t.token_usd, t.supply)


@query("mcap_candles", "select * from mcusd", text=OHLCV)
def mcap_candles(t: Facts):
    return mcusd(t)


CTES["usd_1h"] = f"""
select token, bucket_ts // 3600 * 3600 as bucket_ts, arg_min(o, bucket_ts) as open, max(greatest(high, o)) as high,
       min(least(low, o)) as low, arg_max(close, bucket_ts) as close, sum(volume) as volume
from (select *, coalesce(lag(close) over (partition by token order by bucket_ts), close) as o from token_usd) group by 1, 2
"""

CTES["usd_1h_filled"] = f"""
select token, bucket_ts,
       case when is_real then coalesce(prev, open) else fill end as open,
       case when is_real then greatest(high, coalesce(prev, open)) else fill end as high,
       case when is_real then least(low, coalesce(prev, open)) else fill end as low,
       fill as close, case when is_real then volume else 0 end as volume
from (select *, lag(fill) over (partition by token order by bucket_ts) as prev
      from (select g.token, g.bucket_ts, open, high, low, volume, close is not null as is_real,
                   last_value(close ignore nulls) over (partition by g.token order by g.bucket_ts) as fill
            from (select token, unnest(generate_series(min(bucket_ts), {NOW} // 3600 * 3600, 3600)) as bucket_ts from usd_1h group by 1) g
            left join usd_1h using (token, bucket_ts)))
"""

CTES["line_1h"] = f"""
select g.bucket_ts, last_value(price ignore nulls) over (order by g.bucket_ts) as price
from (select unnest(generate_series(min(ts // 3600 * 3600), {NOW} // 3600 * 3600, 3600)) as bucket_ts from btc) g
left join (select ts // 3600 * 3600 as bucket_ts, arg_max(price, height) as price from btc group by 1) b using (bucket_ts)
"""


def usd_1h_filled(t: Facts):
    c = prices_rollup(t.token_usd)
    return amm.fill_candles(c, ["token"], 3600, NOW).drop("is_real")


def prices_rollup(token_usd):
    return amm.rollup_candles(token_usd, ["token"], {"1h": 3600}).drop("tf")


def _sats(c: str) -> str:
    s = f"({c} * cast(100000000 as hugeint))"
    return f"case when btc = 0 then 0 else ({s} // btc) * {10**16} + ({s} % btc) * cast({10**16} as hugeint) // btc end"


SATS_SQL = f"""
select token, bucket_ts, coalesce(prev, open) as open, greatest(high, coalesce(prev, open)) as high,
       least(low, coalesce(prev, open)) as low, close, volume
from (select *, lag(close) over (partition by token order by bucket_ts) as prev
      from (select token, bucket_ts, {', '.join(f'{_sats(f)} as {f}' for f in (*PRICES, 'volume'))}
            from (select u.*, coalesce(l.price, case when u.bucket_ts < (select min(bucket_ts) from line_1h)
                         then (select arg_min(price, bucket_ts) from line_1h) else (select arg_max(price, bucket_ts) from line_1h) end) as btc
                  from usd_1h_filled u left join line_1h l using (bucket_ts))))
"""


@query("sats_candles", SATS_SQL, text=OHLCV)
def sats_candles(t: Facts):
    line = amm.price_line(t.btc, NOW, {"1h": 3600})
    return prices.sats_candles(usd_1h_filled(t), ["token"], line, 3600)


@query("candles_page", f"""
select token, bucket_ts, position, total, open,
       case when position = 1 then greatest(high, open, spot) else high end as high,
       case when position = 1 then least(low, open, spot) else low end as low,
       case when position = 1 then spot else close end as close, volume
from (select f.*, row_number() over (partition by token order by bucket_ts desc) as position, count(*) over (partition by token) as total,
             (select arg_max(close, bucket_ts) from token_usd u where u.token = f.token) as spot
      from usd_1h_filled f) where position <= 48
""", text=OHLCV)
def candles_page(t: Facts):
    from ..functions.paging import top_per_key
    f = usd_1h_filled(t)
    # the series length follows from its first bucket: it is dense up to now
    first = prices_rollup(t.token_usd).groupBy("token").agg(
        ((F.lit(NOW - NOW % 3600) - F.min("bucket_ts")) / 3600 + 1).cast("bigint").alias("total"))
    spot = t.token_usd.groupBy("token").agg(F.max_by("close", "bucket_ts").alias("spot_close"))
    p = top_per_key(f, ["token"], [F.desc("bucket_ts")], 48).join(first, "token")
    return prices.spot_override(p, ["token"], spot).select(
        "token", "bucket_ts", "position", "total", *PRICES, "volume")


# Pages of every kind of series at every timeframe.

def _dense(name: str, src: str, keys: str) -> None:
    """Named subquery: the dense candles of ``src`` at all timeframes."""
    w = f"partition by {keys}, tf order by bucket_ts"
    CTES[f"{name}_frames"] = f"""
select {keys}, '10m' as tf, cast(600 as bigint) as dur, bucket_ts, open, high, low, close, volume from {src}
union all
select {keys}, tf, dur, bucket_ts // dur * dur, arg_min(o, bucket_ts), max(greatest(high, o)), min(least(low, o)), arg_max(close, bucket_ts), sum(volume)
from (select *, coalesce(lag(close) over (partition by {keys} order by bucket_ts), close) as o from {src}), {HIGHER_VALUES}
group by {keys}, tf, dur, bucket_ts // dur * dur
"""
    CTES[f"{name}_dense"] = f"""
select {keys}, tf, bucket_ts, case when is_real then coalesce(prev, open) else fill end as open,
       case when is_real then greatest(high, coalesce(prev, open)) else fill end as high,
       case when is_real then least(low, coalesce(prev, open)) else fill end as low,
       fill as close, case when is_real then volume else 0 end as volume,
       row_number() over ({w} desc) as position, count(*) over (partition by {keys}, tf) as total
from (select *, lag(fill) over ({w}) as prev
      from (select *, close is not null as is_real, last_value(close ignore nulls) over ({w}) as fill
            from (select {keys}, tf, unnest(generate_series(min(bucket_ts), {NOW} // dur * dur, dur)) as bucket_ts from {name}_frames group by {keys}, tf, dur)
            left join {name}_frames using ({keys}, tf, bucket_ts)))
"""
    CTES[f"{name}_spot"] = f"""
select d.* replace (case when hit then greatest(high, open, spot) else high end as high, case when hit then least(low, open, spot) else low end as low,
                    case when hit then spot else close end as close)
from (select *, position = 1 and tf <> '10m' as hit from {name}_dense) d join (select {keys}, arg_max(close, bucket_ts) as spot from {src} group by {keys}) using ({keys})
"""


_dense("pool", "m10", "pool_id, side")
_dense("usd", "token_usd", "token")
_dense("mcusd", "mcusd", "token")

CTES["line_frames"] = f"""
select g.tf, g.bucket_ts, last_value(price ignore nulls) over (partition by g.tf order by g.bucket_ts) as btc
from (select tf, unnest(generate_series(min(ts // dur * dur), {NOW} // dur * dur, dur)) as bucket_ts from btc, {TF_VALUES} group by tf, dur) g
left join (select tf, ts // dur * dur as bucket_ts, arg_max(price, height) as price from btc, {TF_VALUES} group by 1, 2) b using (tf, bucket_ts)
"""


def _page_sql(source: str, keys: str, limit: int, offset: int) -> str:
    return f"""
select {keys}, tf, bucket_ts, position, total, {', '.join(PRICES)}, volume from {source} where position > {offset} and position <= {offset + limit}
"""


def _sats_pages_sql(name: str, limit: int, offset: int) -> str:
    return f"""
select token, tf, bucket_ts, position, total, coalesce(prev, open) as open, greatest(high, coalesce(prev, open)) as high,
       least(low, coalesce(prev, open)) as low, close, volume
from (select *, lag(close) over (partition by token, tf order by bucket_ts) as prev
      from (select token, tf, bucket_ts, position, total, {', '.join(f'{_sats(f)} as {f}' for f in (*PRICES, 'volume'))}
            from (select u.*, coalesce(l.btc, case when u.bucket_ts < e.lo then e.head else e.tail end) as btc
                  from {name}_spot u left join line_frames l using (tf, bucket_ts)
                  join (select tf, min(bucket_ts) as lo, arg_min(btc, bucket_ts) as head, arg_max(btc, bucket_ts) as tail from line_frames group by 1) e using (tf))))
where position > {offset} and position <= {offset + limit}
"""


@query("pool_candle_pages", _page_sql("pool_dense", "pool_id, side", 40, 0), text=OHLCV)
def pool_candle_pages(t: Facts):
    return prices.candle_pages(t.m10, ["pool_id", "side"], NOW, 40)


@query("usd_candle_pages", _page_sql("usd_spot", "token", 60, 0), text=OHLCV)
def usd_candle_pages(t: Facts):
    return prices.candle_pages(t.token_usd, ["token"], NOW, 60)


@query("mcusd_candle_pages", _page_sql("mcusd_spot", "token", 50, 0), text=OHLCV)
def mcusd_candle_pages(t: Facts):
    return prices.candle_pages(mcusd(t), ["token"], NOW, 50)


@query("sats_candle_pages", _sats_pages_sql("usd", 60, 0), text=OHLCV)
def sats_candle_pages(t: Facts):
    return prices.candle_pages(t.token_usd, ["token"], NOW, 60, btc=t.btc)


@query("mcsats_candle_pages", _sats_pages_sql("mcusd", 50, 50), text=OHLCV)
def mcsats_candle_pages(t: Facts):
    # the second page
    return prices.candle_pages(mcusd(t), ["token"], NOW, 50, 50, btc=t.btc)


# ---------------------------------------------------------------- changes


def _close_at(src: str, target: str) -> str:
    return (f"coalesce(arg_max(close, bucket_ts) filter (where bucket_ts <= {target}), arg_min(close, bucket_ts))")


CHART_SQL = f"""
select u.token, u.tf, {pct('u.c_now', 'u.c_prev')} as usd_bp,
       case when coalesce(m.c_now, 0) = 0 or coalesce(m.c_prev, 0) = 0 then {pct('u.c_now', 'u.c_prev')} else {pct('m.c_now', 'm.c_prev')} end as mcusd_bp
from (select token, tf, {_close_at('', str(NOW))} as c_now, {_close_at('', f'{NOW} - dur')} as c_prev from token_usd, {TF_VALUES} group by token, tf) u
left join (select token, tf, {_close_at('', str(NOW))} as c_now, {_close_at('', f'{NOW} - dur')} as c_prev from mcusd, {TF_VALUES} group by token, tf) m
using (token, tf)
"""


@query("chart_changes", CHART_SQL)
def chart_changes(t: Facts):
    return prices.chart_changes(t.token_usd, mcusd(t), NOW)


HISTORY_SQL = f"""
select p.token, p.bucket_ts, tf, {pct('p.close', 'coalesce(s.close, p.first_close)')} as usd_bp
from (select *, bucket_ts - dur as at from (select *, first_value(close) over (partition by token order by bucket_ts) as first_close from token_usd), {TF_VALUES}) p
asof left join token_usd s on p.token = s.token and p.at >= s.bucket_ts
"""


@query("chart_change_events", f"""
select token, bucket_ts, tf, usd_bp from (select *, lag(usd_bp) over (partition by token, tf order by bucket_ts) as prev,
  row_number() over (partition by token, tf order by bucket_ts) as rn from ({HISTORY_SQL})) where rn = 1 or usd_bp <> prev
""")
def chart_change_events(t: Facts):
    h = prices.change_history(t.token_usd, TIMEFRAMES)
    return prices.diff_changes(h, ["token", "tf"], "bucket_ts", ["usd_bp"])


CANON_PRICE_SQL = """
select token, arg_max(close, cast(bucket_ts as hugeint) * 1000000000000000000 + pool_id) filter (where unit = 'btc') as btc_price,
       arg_max(close, cast(bucket_ts as hugeint) * 1000000000000000000 + pool_id) filter (where unit = 'usd') as usd_price
from m10 join canonical using (pool_id) where side = case when token_is_base then 'base' else 'quote' end group by token
"""


@query("canonical_prices", CANON_PRICE_SQL, text="btc_price usd_price")
def canonical_prices(t: Facts):
    return prices.canonical_pool_prices(t.m10, t.canonical, NOW)


# ---------------------------------------------------------------- metrics

SUM_ALL = ", ".join(f"sum(case when ts >= {NOW - d * 86400} then v else 0 end) as amount_{n}" for n, d in
                    (("1d", 1), ("7d", 7), ("30d", 30))) + ", sum(v) as amount_all"
CTES["token_windows"] = f"""
select token, {SUM_ALL} from (select base_id as token, ts, abs(base_delta) as v from trades join pools using (pool_id)
 union all select quote_id, ts, abs(quote_delta) from trades join pools using (pool_id)) group by token
"""

CTES["token_metrics"] = f"""
select token, price_usd, {muldiv('price_usd', 'coalesce(supply, 0)', 10**8)} as fdv_usd, {muldiv('price_usd', 'coalesce(supply, 0)', 10**8)} as marketcap_usd,
       {', '.join(f"{muldiv(f'coalesce(amount_{w}, 0)', 'price_usd', 10**8)} as {n}" for w, n in
                  (('all', 'volume_all_time'), ('1d', 'volume_1d'), ('7d', 'volume_7d'), ('30d', 'volume_30d')))},
       {', '.join(f"{pct('price_usd', f'c_{w}')} as change_{w}_bp" for w in ('1d', '7d', '30d'))}, {pct('price_usd', 'c_first')} as change_all_time_bp
from (select token, arg_max(close, bucket_ts) as price_usd, arg_min(close, bucket_ts) as c_first,
             {', '.join(f"{_close_at('', str(NOW - d * 86400))} as c_{w}" for w, d in (('1d', 1), ('7d', 7), ('30d', 30)))}
      from token_usd group by token)
left join supply using (token) left join token_windows using (token)
"""

METRIC_TEXT = "price_usd fdv_usd marketcap_usd volume_all_time volume_1d volume_7d volume_30d"


def token_windows(t: Facts):
    return amm.token_trade_windows(amm.pool_trade_windows(t.activity, NOW), t.pools)


def metrics_of(t: Facts):
    return metrics.token_metrics(t.token_usd, t.supply, token_windows(t), NOW)


@query("token_metrics", "select * from token_metrics", text=METRIC_TEXT)
def token_metrics(t: Facts):
    return metrics_of(t)


@query("token_metrics_text", f"""
select token, price_usd, {', '.join(f"{bp_text(f'change_{w}_bp')} as change_{w}" for w in ('1d', '7d', '30d', 'all_time'))} from token_metrics
""", text="price_usd")
def token_metrics_text(t: Facts):
    return metrics.formatted_changes(metrics_of(t)).select(
        "token", "price_usd", "change_1d", "change_7d", "change_30d", "change_all_time")


def derived_of(t: Facts):
    choice = prices.derived_pool_choice(t.pools, t.derived_quotes)
    return prices.derived_candles(prices.derived_inputs(t.m10, choice, t.token_usd, t.derived_quotes))


# Every derived quote merges by the neutral strategy: the rules below are that one's, bucket after bucket.
CTES["derived_quotes"] = "select distinct quote_id from pools where quote_id not in (1, 2)"

CTES["derived_pairs"] = f"select * from ({CHOICE_SQL}) where quote in (select quote_id from derived_quotes)"


def _pool_price(f: str, mirrored: str) -> str:
    return f"case when token_is_base then base_{f} when base_{mirrored} = 0 then 0 else cast('100000000000000000000000000000000' as hugeint) // base_{mirrored} end as p_{f}"


def _priced(f: str) -> str:
    value = muldiv_wide("p_volume", "b_close", 10**16) if f == "volume" else muldiv_wide("last_q", f"p_{f}", 10**16)
    return f"case when priced then {value} end as b_{f}"


CTES["derived_rows"] = f"""
select *, has_pool and not moved and own_close is not null and (t_close is not null) <> real as pull, has_pool and moved and t_close is null and not real as idle,
       row_number() over (partition by token, quote order by bucket_ts) as n
from (select *, {', '.join(f"case when b_{f} is not null and t_{f} is not null then {'b_volume + t_volume' if f == 'volume' else f'(b_{f} + t_{f}) // 2'} else coalesce(b_{f}, t_{f}) end as own_{f}" for f in (*PRICES, 'volume'))}
  from (select *, {_priced('volume')}
    from (select *, {', '.join(_priced(f) for f in PRICES)}
      from (select *, has_pool and last_q is not null and real and p_open <> 0 and p_high <> 0 and p_low <> 0 and p_close <> 0 as priced, has_pool and q_close is not null as moved
        from (select *, last_value(q_close ignore nulls) over w as last_q, last_value(p_close ignore nulls) over w as last_p,
                     last_value(q_close ignore nulls) over (partition by token, quote order by bucket_ts rows between unbounded preceding and 1 preceding) as prev_q
          from (select token, quote, bucket_ts, {', '.join(f't.{f} as t_{f}' for f in (*PRICES, 'volume'))}, {', '.join(f'p_{f}' for f in (*PRICES, 'volume'))},
                       {', '.join(f'q.{f} as q_{f}' for f in PRICES)}, p_close is not null as real, d.pool_id is not null as has_pool
            from (select u.*, quote_id as quote from token_usd u, derived_quotes where token <> quote_id) t
            full join (select token, quote, bucket_ts, {_pool_price('open', 'open')}, {_pool_price('high', 'low')}, {_pool_price('low', 'high')}, {_pool_price('close', 'close')},
                              case when token_is_base then base_volume else quote_volume end as p_volume
                       from m10_wide join derived_pairs using (pool_id)) p using (token, quote, bucket_ts)
            full join (select d.token, d.quote, u.bucket_ts, {', '.join(f'u.{f}' for f in PRICES)} from token_usd u join derived_pairs d on u.token = d.quote) q using (token, quote, bucket_ts)
            left join derived_pairs d using (token, quote))
          window w as (partition by token, quote order by bucket_ts rows unbounded preceding))))))
"""

_OWN = "case when pull and last <> 0 then (own_{f} + last) // 2 else own_{f} end"
_CARRIED = "case when moved and rate <> 0 then case when idle and last <> 0 then (" + muldiv_wide("q_{f}", "rate", 10**16) + " + last) // 2 else " + muldiv_wide("q_{f}", "rate", 10**16) + " end end"
# the product saturates at 2^128 - 1
_WIDE = "cast({} as uhugeint)"
_DRIFT = (f"case when last <= {(2**128 - 1) // 10**16} then {_WIDE.format('last')} * {_WIDE.format(10**16)} "
          f"else {_WIDE.format(chr(39) + str(2**128 - 1) + chr(39))} end // {_WIDE.format('prev_q')}")
_RATE = f"case when last = 0 then last_p when prev_q <> 0 then cast({_DRIFT} as hugeint) end as rate"


def _joint(f: str) -> str:
    """Value of a bucket: own and carried price averaged, else whichever there is, else the close before unless the quote moved."""
    own, carried = _OWN.format(f=f), _CARRIED.format(f=f)
    return f"coalesce(({own} + {carried}) // 2, {own}, {carried}, case when not moved and last <> 0 then last end)"


CTES["derived"] = f"""
select token, quote, bucket_ts, case when last <> 0 then last else v_open end as open, case when last <> 0 then greatest(v_high, last) else v_high end as high,
       case when last <> 0 then least(v_low, last) else v_low end as low, v_close as close, coalesce(own_volume, 0) as volume
from (select *, {', '.join(f'{_joint(f)} as v_{f}' for f in PRICES)}
      from (select r.*, last, {_RATE} from derived_rows r join (
        with recursive walk as (
          select token, quote, cast(1 as bigint) as n, cast(0 as hugeint) as last from derived_rows group by token, quote
          union all
          select token, quote, n + 1, cast(coalesce({_joint('close')}, last) as hugeint)
          from (select r.*, last, {_RATE} from walk join derived_rows r using (token, quote, n)))
        select * from walk) using (token, quote, n)))
where v_close is not null
"""


@query("derived_candles", "select * from derived", text=OHLCV)
def derived_candles(t: Facts):
    return derived_of(t)


CTES["derived_metrics"] = f"""
select token, quote, price_usd, {muldiv('price_usd', 'coalesce(supply, 0)', 10**8)} as fdv_usd, {muldiv('price_usd', 'coalesce(supply, 0)', 10**8)} as marketcap_usd,
       {', '.join(f"{muldiv(f'coalesce(amount_{w}, 0)', 'price_usd', 10**8)} as {n}" for w, n in
                  (('all', 'volume_all_time'), ('1d', 'volume_1d'), ('7d', 'volume_7d'), ('30d', 'volume_30d')))},
       {', '.join(f"{pct('price_usd', f'c_{w}')} as change_{w}_bp" for w in ('1d', '7d', '30d'))}, {pct('price_usd', 'c_first')} as change_all_time_bp
from (select token, quote, arg_max(close, bucket_ts) as price_usd, arg_min(close, bucket_ts) as c_first,
             {', '.join(f"{_close_at('', str(NOW - d * 86400))} as c_{w}" for w, d in (('1d', 1), ('7d', 7), ('30d', 30)))}
      from derived group by token, quote)
left join supply using (token) left join token_windows using (token)
"""


def derived_metrics_of(t: Facts):
    return metrics.token_metrics(derived_of(t), t.supply, token_windows(t), NOW, keys=("token", "quote"))


@query("derived_metrics", "select * from derived_metrics", text=METRIC_TEXT)
def derived_metrics(t: Facts):
    return derived_metrics_of(t)


_dense("derived", "derived", "token, quote")


@query("derived_candle_pages", _page_sql("derived_spot", "token, quote", 40, 0), text=OHLCV)
def derived_candle_pages(t: Facts):
    return prices.candle_pages(derived_of(t), ["token", "quote"], NOW, 40)


@query("derived_mcap_candles", f"""
select token, quote, bucket_ts, {', '.join(f"{muldiv(f, 'supply', 10**8)} as {f}" for f in PRICES)}, volume from derived join supply using (token)
""", text=OHLCV)
def derived_mcap_candles(t: Facts):
    return prices.mcap_candles(derived_of(t), t.supply)


# TVL after every block with pool activity, at the prices of that block.
CTES["pool_closing"] = """
select pool_id, height, arg_max(base_reserve, seq) as base_reserve, arg_max(quote_reserve, seq) as quote_reserve from reserves group by 1, 2
"""


def _tvl_side(s: str) -> str:
    r, p = f"{s}_reserve", f"coalesce({s}u.close, 0)"
    return (f"case when {s}_id = 2 then {r} * 100000000 when {s}_id = 1 and x.price is not null then {muldiv(r, 'x.price', 10**8)} "
            f"else {muldiv(r, p, 10**8)} end")


CTES["tvl_history"] = f"""
select c.pool_id, c.height, {_tvl_side('base')} + {_tvl_side('quote')} as tvl_usd
from (select c.*, base_id, quote_id, height * 600 + 1704067200 as at from pool_closing c join pools using (pool_id)) c
asof left join token_usd baseu on c.base_id = baseu.token and c.at >= baseu.bucket_ts
asof left join token_usd quoteu on c.quote_id = quoteu.token and c.at >= quoteu.bucket_ts
asof left join btc x on c.at >= x.ts
"""


def tvl_history_of(t: Facts):
    return metrics.tvl_history(t.reserves, t.pools, t.quotes, t.token_usd, t.btc, EPOCH, 600)


@query("tvl_history", "select * from tvl_history", text="tvl_usd")
def tvl_history(t: Facts):
    return tvl_history_of(t)


@query("tvl_asof", """
select r.pool_id, r.height, coalesce(h.tvl_usd, 0) as tvl_usd
from (select pool_id, unnest([0, 1000, 2000, 3000, 4319]) as height from pools) r
asof left join tvl_history h on r.pool_id = h.pool_id and r.height >= h.height
""", text="tvl_usd", ints="height")
def tvl_asof(t: Facts):
    at = F.explode(F.array(*[F.lit(h).cast("bigint") for h in (0, 1000, 2000, 3000, TIP)]))
    return metrics.tvl_asof(tvl_history_of(t), t.pools.select("pool_id", at.alias("height")))


CTES["price_table"] = f"""
select token, coalesce(price_usd, 0) as price_usd, coalesce(btc_price, 0) as price_sats
from token_metrics full join ({CANON_PRICE_SQL}) using (token)
"""


def _value(s: str, unit: str) -> str:
    r = f"{s}_reserve"
    if unit == "usd":
        return (f"case when {s}_id = 2 then {r} * 100000000 when {s}_id = 1 then {muldiv(r, 'btc', 10**8)} "
                f"else {muldiv(r, f'{s}_price_usd', 10**8)} end as {s}_tvl_usd")
    return (f"case when {s}_id = 1 then {r} when {s}_id = 2 then {r} * cast({10**16} as hugeint) // btc "
            f"else {muldiv(r, f'{s}_price_sats', 10**8)} end as {s}_tvl_sats")


CTES["pool_values"] = f"""
select *, base_tvl_usd + quote_tvl_usd as tvl_usd, base_tvl_sats + quote_tvl_sats as tvl_sats
from (select *, {', '.join(_value(s, u) for s in ('base', 'quote') for u in ('usd', 'sats'))}
      from (select r.pool_id, base_id, quote_id, base_reserve, quote_reserve, coalesce(b.price_usd, 0) as base_price_usd, coalesce(b.price_sats, 0) as base_price_sats,
                   coalesce(q.price_usd, 0) as quote_price_usd, coalesce(q.price_sats, 0) as quote_price_sats,
                   (select arg_max(price, height) from btc) as btc
            from (select pool_id, arg_max(base_reserve, seq) as base_reserve, arg_max(quote_reserve, seq) as quote_reserve from reserves group by 1) r
            join pools using (pool_id) left join price_table b on b.token = base_id left join price_table q on q.token = quote_id))
"""

WIN = ("1d", "7d", "30d", "all")
CTES["pool_metrics"] = f"""
select pool_id, tvl_usd, tvl_sats, {', '.join(f"{muldiv(f'base_{w}', f'base_price_{u}', 10**8)} + {muldiv(f'quote_{w}', f'quote_price_{u}', 10**8)} as volume_{w}_{u}"
                                              for u in ('usd', 'sats') for w in WIN)},
       {pct('tvl_usd', 'coalesce(tvl_1d, 0)')} as tvl_change_1d_bp, {pct('tvl_usd', 'coalesce(tvl_7d, 0)')} as tvl_change_7d_bp,
       cast(case when tvl_usd = 0 then 0 else ({muldiv('base_30d', 'base_price_usd', 10**8)} + {muldiv('quote_30d', 'quote_price_usd', 10**8)}) * 36000 // tvl_usd end as bigint) as apr_bp
from pool_values left join (select pool_id, {', '.join(f"coalesce(sum(case when ts >= {NOW - d * 86400} then abs({s}_delta) else 0 end), 0) as {s}_{w}"
                                                       for s in ('base', 'quote') for w, d in (('1d', 1), ('7d', 7), ('30d', 30), ('all', 10000)))} from trades group by 1) using (pool_id)
left join (select pool_id, arg_max(tvl_usd, height) filter (where height <= {TIP - 144}) as tvl_1d,
                  arg_max(tvl_usd, height) filter (where height <= {TIP - 1008}) as tvl_7d from tvl_history group by 1) using (pool_id)
"""

POOL_TEXT = "tvl_usd tvl_sats " + " ".join(f"volume_{w}_{u}" for u in ("usd", "sats") for w in WIN)


def price_table(t: Facts):
    m = metrics_of(t).select("token", "price_usd")
    c = prices.canonical_pool_prices(t.m10, t.canonical, NOW).select("token", F.col("btc_price").alias("price_sats"))
    return m.join(c, "token", "full_outer").select(
        "token", F.coalesce("price_usd", big(0)).alias("price_usd"), F.coalesce("price_sats", big(0)).alias("price_sats"))


def pool_values_of(t: Facts):
    t.keep_reserves()
    btc = t.btc.agg(F.max_by("price", "height").alias("price")).scalar()
    return metrics.pool_values(amm.latest_reserves(t.reserves), t.pools, t.quotes, price_table(t), btc)


def pool_metrics_of(t: Facts):
    return metrics.pool_metrics(pool_values_of(t), amm.pool_trade_windows(t.activity, NOW),
                                metrics.past_tvl(tvl_history_of(t), TIP))


@query("pool_metrics", "select * from pool_metrics", text=POOL_TEXT)
def pool_metrics(t: Facts):
    return pool_metrics_of(t)


# ---------------------------------------------------------------- rankings


@query("rank_tokens", """
select token, volume_all_time, change_7d_bp, position, total from (
  select c.token, volume_all_time, change_7d_bp, count(*) over () as total,
         row_number() over (order by volume_all_time is null, volume_all_time desc, case when volume_all_time is null then creation_height end, c.token desc) as position
  from creations c left join token_metrics m on c.token = m.token) where position <= 60
""", text="volume_all_time")
def rank_tokens(t: Facts):
    return metrics.rank_tokens(t.creations, metrics_of(t), "volume_all_time", True, 60) \
        .select("token", "volume_all_time", "change_7d_bp", "position", "total")


@query("rank_tokens_asc", """
select token, change_7d_bp, position from (
  select c.token, change_7d_bp,
         row_number() over (order by change_7d_bp is null desc, change_7d_bp, case when change_7d_bp is null then creation_height end, c.token) as position
  from creations c left join token_metrics m on c.token = m.token) where position > (select count(*) - 30 from creations)
""")
def rank_tokens_asc(t: Facts):
    return metrics.rank_tokens(t.creations, metrics_of(t), "change_7d_bp", False, 30, -30) \
        .select("token", "change_7d_bp", "position")


@query("rank_pools", """
select pool_id, apr_bp, row_number() over (order by apr_bp desc, pool_id) as position from pool_metrics
""")
def rank_pools(t: Facts):
    return metrics.rank_pools(pool_metrics_of(t), "apr_bp").select("pool_id", "apr_bp", "position")
