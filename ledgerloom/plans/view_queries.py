"""Plans over routes and product-level listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exact import DEC, big
from ..operators import amm, metrics, routing, views
from ..operators import catalogue as cat
from .amm_queries import CATALOG_SQL, created_pools, pool_names
from .facts import EPOCH, NOW, TIP, Facts
from .facts_sql import CTES
from .price_queries import CANON_PRICE_SQL, METRIC_TEXT, derived_metrics_of, metrics_of, pool_metrics_of, pool_values_of
from .catalogue_queries import PREFIX_SQL
from .registry import query
from .trace_queries import wraps_of
from ..operators.prices import canonical_pool_prices

CTES["last_reserves"] = """
select pool_id, arg_max(base_reserve, seq) as base_reserve, arg_max(quote_reserve, seq) as quote_reserve from reserves group by 1
"""

CTES["edges"] = """
select pool_id, base_id as token_in, quote_id as token_out, base_reserve as r_in, quote_reserve as r_out
from last_reserves join pools using (pool_id) where base_reserve > 0 and quote_reserve > 0
union all
select pool_id, quote_id, base_id, quote_reserve, base_reserve from last_reserves join pools using (pool_id) where base_reserve > 0 and quote_reserve > 0
"""

CTES["requests"] = """
select event_id as request_id, base_id as source, 100 + event_id % 10 as target, cast(cents as hugeint) * 1000000 as amount from ev join pools using (pool_id)
"""


def edges_of(t: Facts):
    return routing.pool_edges(amm.latest_reserves(t.reserves), t.pools)


def staged_edges(t: Facts):
    from ..session import stage
    return stage(edges_of(t))


def requests_of(t: Facts):
    return t.ev.join(t.pools, "pool_id").select(
        F.col("event_id").alias("request_id"), F.col("base_id").alias("source"), (F.col("event_id") % 10 + 100).alias("target"),
        (F.col("cents").cast(DEC) * 1000000).cast(DEC).alias("amount"))


@query("pool_edges", "select * from edges", text="r_in r_out")
def pool_edges(t: Facts):
    return edges_of(t)


def _out(a: str) -> str:
    return f"(({a}) * 9950 // 10000) * r_out // (r_in + ({a}) * 9950 // 10000)"


def _cdiv(a: str, b: str) -> str:
    return f"case when ({a}) = 0 then 0 else 1 + (({a}) - 1) // ({b}) end"


@query("xyk_quotes", f"""
select request_id, pool_id, token_in, case when amount > 0 then {_out('amount')} end as got,
       case when amount > 0 and amount < r_out then {_cdiv('(' + _cdiv('amount * r_in', 'r_out - amount') + ') * 10000', '9950')} end as needed
from requests join edges on source = token_in
""", text="got needed")
def xyk_quotes(t: Facts):
    e = staged_edges(t)
    j = requests_of(t).join(e, F.col("source") == F.col("token_in"))
    j = routing.with_xyk_out(j, "r_in", "r_out", "amount", "got")
    j = j.withColumn("got", F.when(F.col("amount") > 0, F.col("got")))
    return routing.with_xyk_in(j, "r_in", "r_out", "amount", "needed").select("request_id", "pool_id", "token_in", "got", "needed")


@query("route_exact_in", f"""
select request_id, amount, hops, list_aggregate(pools, 'string_agg', '>') as path from (
  with recursive walk as (
    select request_id, target, source as token, amount, [source] as tokens, cast([] as bigint[]) as pools, 0 as hops from requests where source <> target
    union all
    select request_id, target, token_out, {_out('amount')}, list_append(tokens, token_out), list_append(pools, cast(pool_id as bigint)), hops + 1
    from walk join edges on token = token_in where token <> target and hops < 3 and amount > 0 and not list_contains(tokens, token_out))
  select *, row_number() over (partition by request_id order by amount desc, hops, pools) as rn from walk where token = target and amount > 0) where rn = 1
""", text="amount", ints="hops")
def route_exact_in(t: Facts):
    r = routing.best_route_exact_in(requests_of(t), staged_edges(t))
    return r.select("request_id", "amount", F.col("hops").cast("bigint").alias("hops"), F.array_join(F.col("pools").cast("array<string>"), ">").alias("path"))


@query("route_exact_out", f"""
select request_id, amount, hops, list_aggregate(pools, 'string_agg', '>') as path from (
  with recursive walk as (
    select request_id, source, target as token, amount, [target] as tokens, cast([] as bigint[]) as pools, 0 as hops from requests where source <> target and amount > 0
    union all
    select request_id, source, token_in, {_cdiv('(' + _cdiv('amount * r_in', 'r_out - amount') + ') * 10000', '9950')},
           list_append(tokens, token_in), list_prepend(cast(pool_id as bigint), pools), hops + 1
    from walk join edges on token = token_out where token <> source and hops < 3 and amount < r_out and not list_contains(tokens, token_in))
  select *, row_number() over (partition by request_id order by amount, hops, pools) as rn from walk where token = source) where rn = 1
""", text="amount", ints="hops")
def route_exact_out(t: Facts):
    r = routing.best_route_exact_out(requests_of(t), staged_edges(t))
    return r.select("request_id", "amount", F.col("hops").cast("bigint").alias("hops"), F.array_join(F.col("pools").cast("array<string>"), ">").alias("path"))


@query("pair_route", f"""
select b.request_id, amount, b.hops, step, b.pools[step + 1] as pool_id, base_id, quote_id, factory_id from (
  select * from (
    with recursive walk as (
      select request_id, target, source as token, cast(1000000 as hugeint) as amount, [source] as tokens, cast([] as bigint[]) as pools, 0 as hops
      from (select distinct source * 1000 + target as request_id, source, target from requests where source <> target)
      union all
      select request_id, target, token_out, amount * r_out // (r_in + amount), list_append(tokens, token_out), list_append(pools, cast(pool_id as bigint)), hops + 1
      from walk join edges on token = token_in where token <> target and hops < 3 and amount > 0 and not list_contains(tokens, token_out))
    select *, row_number() over (partition by request_id order by amount desc, hops, pools) as rn from walk where token = target and amount > 0) where rn = 1) b,
  lateral (select unnest(range(0, b.hops)) as step) s join pools p on p.pool_id = b.pools[step + 1]
""", text="amount", ints="hops step")
def pair_route(t: Facts):
    pairs = requests_of(t).filter(F.col("source") != F.col("target")).select(
        (F.col("source") * 1000 + F.col("target")).alias("request_id"), "source", "target").distinct()
    return routing.pair_route(pairs, staged_edges(t), t.pools, amount=1000000) \
        .withColumn("hops", F.col("hops").cast("bigint")).withColumn("step", F.col("step").cast("bigint"))


@query("arb_cycles")
def arb_cycles(t: Facts):
    e = staged_edges(t)
    return routing.arbitrage_cycles(e.select(F.col("token_in").alias("token")).distinct(), e)


SMALL_EDGES_SQL = """(
  select pool_id, a as token_in, b as token_out, x as r_in, y as r_out from (
    select s_suppkey as pool_id, s_suppkey // 4 * 3 + case s_suppkey % 4 when 1 then 1 when 2 then 2 else 0 end as a, s_suppkey // 4 * 3 + case s_suppkey % 4 when 1 then 2 when 2 then 0 else 1 end as b,
      50 + cents % 2950 as x, 50 + cents // 7 % 2950 as y from (select s_suppkey, abs(cast(cast(s_acctbal as decimal(18,2)) * 100 as bigint)) as cents from supplier))
  union all
  select pool_id, b, a, y, x from (
    select s_suppkey as pool_id, s_suppkey // 4 * 3 + case s_suppkey % 4 when 1 then 1 when 2 then 2 else 0 end as a, s_suppkey // 4 * 3 + case s_suppkey % 4 when 1 then 2 when 2 then 0 else 1 end as b,
      50 + cents % 2950 as x, 50 + cents // 7 % 2950 as y from (select s_suppkey, abs(cast(cast(s_acctbal as decimal(18,2)) * 100 as bigint)) as cents from supplier)))"""


@query("arb_cycles_small", f"""
select token, profit, amount_in, cycle from (select *, row_number() over (partition by token order by profit desc, legs, cycle desc) as place from (
  select token, cycle, legs, max(v - x) as profit, arg_max(x, (v - x) * 10000 - x) as amount_in from (
    select token, cycle, legs, x, case when legs = 2 then v2 else (v2 * 9950 // 10000) * o3 // (i3 + v2 * 9950 // 10000) end as v from (
      select *, (v1 * 9950 // 10000) * o2 // (i2 + v1 * 9950 // 10000) as v2 from (
        select *, (x * 9950 // 10000) * o1 // (i1 + x * 9950 // 10000) as v1 from (
          select *, unnest(range(1, least(i1, i2, coalesce(i3, i1)) // 3 + 1)) as x from (
            select a.token_in as token, a.pool_id || '>' || b.pool_id as cycle, 2 as legs, a.r_in as i1, a.r_out as o1, b.r_in as i2, b.r_out as o2, null as i3, null as o3
            from {SMALL_EDGES_SQL} a join {SMALL_EDGES_SQL} b on a.token_out = b.token_in and b.token_out = a.token_in and a.pool_id <> b.pool_id
            union all
            select a.token_in, a.pool_id || '>' || b.pool_id || '>' || c.pool_id, 3, a.r_in, a.r_out, b.r_in, b.r_out, c.r_in, c.r_out
            from {SMALL_EDGES_SQL} a join {SMALL_EDGES_SQL} b on a.token_out = b.token_in and b.token_out <> a.token_in join {SMALL_EDGES_SQL} c on b.token_out = c.token_in and c.token_out = a.token_in)))))
  group by 1, 2, 3) where profit > 0) where place = 1
""", text="profit amount_in")
def arb_cycles_small(t: Facts):
    # suppliers as pools of 50 to 2999 units: four of them between three tokens, so that every input can be tried
    k, cents = F.col("s_suppkey").cast("bigint"), F.abs((F.col("s_acctbal").cast("decimal(18,2)") * 100).cast("bigint"))
    end = lambda one, two, other: (F.floor(k / 4) * 3 + F.when(k % 4 == 1, one).when(k % 4 == 2, two).otherwise(other)).cast("bigint")
    pools = t.table("supplier").select(k.alias("pool_id"), end(1, 2, 0).alias("base_id"), end(2, 0, 1).alias("quote_id"),
                                       (F.lit(50) + cents % 2950).cast(DEC).alias("base_reserve"), (F.lit(50) + F.floor(cents / 7) % 2950).cast(DEC).alias("quote_reserve"))
    e = routing.pool_edges(pools.select("pool_id", "base_reserve", "quote_reserve"), pools.select("pool_id", "base_id", "quote_id"))
    return routing.arbitrage_cycles(e.select(F.col("token_in").alias("token")).distinct(), e)


# ---------------------------------------------------------------- tokens

CTES["minted"] = "select token, cast(sum(amount) as hugeint) as minted from outputs group by 1"

CTES["token_table"] = f"""
select c.token, name, symbol, cap, mint_amount, creation_height, price_usd, fdv_usd, marketcap_usd, volume_all_time, volume_1d, volume_7d, volume_30d,
       change_1d_bp, change_7d_bp, change_30d_bp, change_all_time_bp, coalesce(holders, 0) as holders, coalesce(supply, 0) as supply,
       coalesce(minted, 0) as minted, btc_price, usd_price, cap * mint_amount as max_supply,
       case when cap * mint_amount > 0 then (coalesce(minted, 0) * 100 + cap * mint_amount - 1) // (cap * mint_amount) end as percent_minted,
       coalesce(minted, 0) < cap * mint_amount as mint_active
from creations c left join token_metrics m on c.token = m.token left join holder_counts h on c.token = h.token left join supply s on c.token = s.token
left join minted i on c.token = i.token left join ({CANON_PRICE_SQL}) p on c.token = p.token
"""

TABLE_TEXT = METRIC_TEXT + " cap mint_amount supply minted btc_price usd_price max_supply percent_minted"


def token_table_of(t: Facts):
    minted = t.outputs.groupBy("token").agg(F.sum("amount").cast(DEC).alias("minted"))
    return views.token_table(t.creations, metrics_of(t), t.holder_counts, t.supply, minted,
                             canonical_pool_prices(t.m10, t.canonical, NOW))


def slim_tokens(t: Facts):
    c = t.creations.select("token", F.col("names")[0].alias("name"), F.col("symbols")[0].alias("symbol"))
    return c.join(t.holder_counts, "token", "left").withColumn("holders", F.coalesce("holders", F.lit(0)).cast("bigint"))


CTES["slim_tokens"] = """
select c.token, name, symbol, coalesce(holders, 0) as holders from creations c left join holder_counts h on c.token = h.token
"""


@query("token_listing", """
select *, (select count(*) from creations) as total from (
  select *, row_number() over (order by marketcap_usd desc nulls last, token) as position from token_table) where position <= 100
""", text=TABLE_TEXT)
def token_listing(t: Facts):
    return views.token_listing(token_table_of(t), "marketcap_usd", True, 100).drop("has_more")


@query("token_details", "select * from token_table", text=TABLE_TEXT)
def token_details(t: Facts):
    return token_table_of(t)


@query("top_holders", """
select token, name, symbol, holders, position from (select *, row_number() over (order by holders desc, token) as position from slim_tokens) where position <= 15
""")
def top_holders(t: Facts):
    return views.top_tokens_by_holders(slim_tokens(t), 15)


@query("search_ranked", f"""
select token, holders, position from (
  select token, holders, row_number() over (order by holders desc, token) as position
  from slim_tokens where token in (select token from ({PREFIX_SQL}) where prefix = 'red')) where position <= 20
""")
def search_ranked(t: Facts):
    p = cat.search_prefixes(t.creations)
    return metrics.search_ranked(p, t.holder_counts, "red", "holders").select("token", "holders", "position")


@query("global_search", f"""
(select 'token' as kind, token as id, name, holders from slim_tokens where lower(name) like 'small%' or lower(symbol) like 'small%' order by holders desc, token limit 20)
union all
(select 'pool', pool_id, pool_name, null from ({CATALOG_SQL}) where lower(pool_name) like 'small%' order by pool_name, pool_id limit 20)
""")
def global_search(t: Facts):
    return views.global_search(slim_tokens(t), amm.pool_catalog(t.pools, pool_names(t)), "Small ")


@query("search_guess", """
(select 'block' as kind, '104' as id, null as rank)
union all (select 'token', cast(token as varchar), holders from slim_tokens where cast(token as varchar) = '104' or lower(name) like '104%' or lower(symbol) like '104%' order by holders desc, token limit 10)
""", ints="rank")
def search_guess(t: Facts):
    txs = t.ev.select(F.lower(F.hex("event_id")).alias("txid"))
    return views.search_guess("104", TIP, slim_tokens(t), txs)


@query("tokens_by_address", """
select b.token, holder_id as address, amount, name, symbol from balances b left join creations c on b.token = c.token where holder_type = 'address'
""", text="amount")
def tokens_by_address(t: Facts):
    from ..operators.ledger import address_balances
    return views.tokens_by_address(address_balances(t.deltas), slim_tokens(t))


@query("token_utxos", """
select address, outpoint, token, amount, name from outputs join creations using (token) where spent_by is null
""", text="amount")
def token_utxos(t: Facts):
    n = t.creations.select("token", F.col("names")[0].alias("name"))
    return t.outputs.filter(F.col("spent_by").isNull()).join(n, "token").select("address", "outpoint", "token", "amount", "name")


# ---------------------------------------------------------------- pools


@query("pool_details", f"""
select pool_id, base_id, quote_id, base_reserve, quote_reserve, m.tvl_usd, lp_supply, created_height, m.tvl_usd * 100000000 // lp_supply as lp_value,
       case when volume_7d_usd = 0 then coalesce(f.volume_7d, 0) else volume_7d_usd end as volume_7d_usd,
       case when volume_all_usd = 0 then coalesce(f.volume_all, 0) else volume_all_usd end as volume_all_usd
from (select pool_id, base_id, quote_id, base_reserve, quote_reserve from pool_values) v join pool_metrics m using (pool_id)
join (select pool_id, min(height) as created_height, cast(count(*) as hugeint) * 100000000 as lp_supply from ev group by 1) l using (pool_id)
left join (select pool_id, sum(case when bucket_ts >= {NOW // 86400 * 86400 - 6 * 86400} then volume else 0 end) as volume_7d, sum(volume) as volume_all from m10 where side = 'quote' group by 1) f using (pool_id)
""", text="base_reserve quote_reserve tvl_usd lp_supply lp_value volume_7d_usd volume_all_usd")
def pool_details(t: Facts):
    lp = t.ev.groupBy("pool_id").agg((F.count(F.lit(1)).cast(DEC) * big(10**8)).cast(DEC).alias("lp_supply"))
    daily = amm.rollup_candles(t.m10.filter(F.col("side") == "quote"), ["pool_id", "side"], {"1d": 86400})
    fb = amm.candle_volume_sums(daily, NOW).drop("side")
    return views.pool_details(pool_values_of(t), pool_metrics_of(t), created_pools(t).select("pool_id", F.col("height").alias("created_height")), lp, fb)


@query("pools_overview", f"""
select pool_id, tvl_usd, apr_bp, position, total_tvl, largest, trending from (
  select pool_id, tvl_usd, apr_bp, row_number() over (order by tvl_usd desc, pool_id) as position, sum(tvl_usd) over () as total_tvl,
         (select pool_id from pool_metrics order by tvl_usd desc, pool_id limit 1) as largest,
         (select pool_id from pool_metrics order by tvl_change_1d_bp desc, pool_id limit 1) as trending from pool_metrics) where position <= 15
""", text="tvl_usd total_tvl")
def pools_overview(t: Facts):
    from ..session import stage
    table = stage(pool_metrics_of(t).join(amm.pool_catalog(t.pools, pool_names(t)), "pool_id"))
    return views.pools_overview(table, limit=15).select("pool_id", "tvl_usd", "apr_bp", "position", "total_tvl", "largest", "trending")


@query("lp_positions", """
select holder_id as address, pool_id, amount, amount * base_tvl_usd // supply as base_value, amount * quote_tvl_usd // supply as quote_value,
       amount * base_tvl_usd // supply + amount * quote_tvl_usd // supply as total_value
from balances b join supply s using (token) join pool_values v on v.pool_id % 10 + 100 = b.token where holder_type = 'address'
""", text="amount base_value quote_value total_value")
def lp_positions(t: Facts):
    from ..operators.ledger import address_balances
    from ..session import stage
    # each pool's shares are represented by one of the ledger tokens
    v = pool_values_of(t).withColumn("lp_token", (F.col("pool_id") % 10 + 100).cast("bigint"))
    p = stage(v.join(t.supply.select(F.col("token").alias("lp_token"), F.col("supply").alias("lp_supply")), "lp_token"))
    return views.lp_positions(address_balances(t.deltas), p)


@query("token_pairs", """
select p.pool_id, base_id, quote_id, b.name as base_name, q.name as quote_name, base_reserve, quote_reserve
from pools p join last_reserves r on p.pool_id = r.pool_id left join creations b on b.token = base_id left join creations q on q.token = quote_id
where contains(lower(b.name || '|' || q.name || '|' || b.symbol || '|' || q.symbol || '|' || base_id || '|' || quote_id), '#1')
""", text="base_reserve quote_reserve")
def token_pairs(t: Facts):
    p = t.pools.join(amm.latest_reserves(t.reserves), "pool_id")
    return views.token_pairs(p, slim_tokens(t), "#1").select("pool_id", "base_id", "quote_id", "base_name", "quote_name", "base_reserve", "quote_reserve")


@query("combined_history", f"""
select kind, ts, seq, address, amount, position, (select count(*) from activity) + (select count(*) from wraps) as total from (
  select *, row_number() over (order by ts desc, seq desc, kind) as position from (
    select kind, ts, seq, address, abs(base_delta) as amount from activity
    union all select kind, height * 86400 + {EPOCH - 1500 * 86400}, seq, address, amount from wraps)) where position > 40 and position <= 240
""", text="amount")
def combined_history(t: Facts):
    a = t.activity.select("kind", "ts", "seq", "address", F.abs("base_delta").alias("amount"))
    w = wraps_of(t).select("kind", (F.col("height") * 86400 + (EPOCH - 1500 * 86400)).alias("ts"), "seq", "address", F.col("amount").cast(DEC).alias("amount"))
    return views.combined_history(a, w, 200, 40).drop("has_more")


@query("utxo_portfolio", """
select address, count(*) as utxos, sum(sats) as total_sats, coalesce(sum(sats) filter (where not (tk or rn or ins or pend)), 0) as spendable_sats,
       coalesce(sum(sats) filter (where tk), 0) as token_sats, coalesce(sum(sats) filter (where rn), 0) as rune_sats,
       coalesce(sum(sats) filter (where ins), 0) as inscription_sats, coalesce(sum(sats) filter (where pend), 0) as pending_sats,
       count(*) filter (where tk and not rn and not ins and not pend) as amm_usable
from (select o_custkey as address, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as sats, o_orderkey in (select tx_id from outputs where spent_by is null) as tk,
             o_orderkey % 11 = 0 as rn, o_orderkey % 13 = 0 as ins, o_orderstatus = 'P' as pend from orders) group by 1
""", ints="total_sats spendable_sats token_sats rune_sats inscription_sats pending_sats")
def utxo_portfolio(t: Facts):
    o = t.table("orders").select(F.col("o_orderkey").alias("outpoint"), F.col("o_custkey").alias("address"),
                                 (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("sats"), "o_orderstatus")
    tk = t.outputs.filter(F.col("spent_by").isNull()).select(F.col("tx_id").alias("outpoint"))
    return views.utxo_portfolio(o.drop("o_orderstatus"), tk, o.filter(F.col("outpoint") % 11 == 0), o.filter(F.col("outpoint") % 13 == 0),
                                o.filter(F.col("o_orderstatus") == "P"))


# ---------------------------------------------------------------- filtered and derived listings


def _entry_sql() -> str:
    return " || ' ' || ".join(["cast(quote as varchar)"] + [f"cast({f} as varchar)" for f in views.DERIVED_FIELDS])


@query("token_listing_derived", f"""
select t.token, name, price_usd, d.entries as derived, position, (select count(*) from creations) as total
from (select *, row_number() over (order by volume_7d desc nulls last, token) as position from token_table) t
left join (select token, string_agg({_entry_sql()}, ',' order by quote) as entries from derived_metrics group by token) d on d.token = t.token
where position <= 40
""", text="price_usd")
def token_listing_derived(t: Facts):
    rows = views.token_listing(views.with_derived(token_table_of(t), derived_metrics_of(t)), "volume_7d", True, 40)
    entry = lambda d: F.concat_ws(" ", *[d[f].cast("string") for f in ("quote", *views.DERIVED_FIELDS)])
    return rows.select("token", "name", "price_usd", F.nullif(F.array_join(F.transform("derived", entry), ","), F.lit("")).alias("derived"), "position", "total")


@query("rank_tokens_derived", """
select quote, token, volume_7d, change_7d_bp, position from (
  select c.quote_id as quote, c.token, volume_7d, change_7d_bp,
         row_number() over (partition by c.quote_id order by volume_7d is null, volume_7d desc, case when volume_7d is null then creation_height end, c.token desc) as position
  from (select * from creations, derived_quotes) c left join derived_metrics m on c.token = m.token and c.quote_id = m.quote) where position <= 40
""", text="volume_7d")
def rank_tokens_derived(t: Facts):
    return metrics.rank_tokens_by_quote(t.creations, derived_metrics_of(t), t.derived_quotes, "volume_7d", True, 40) \
        .select("quote", "token", "volume_7d", "change_7d_bp", "position")


@query("search_scan", """
select token, row_number() over (order by holders desc, token) as position, true as scanned
from slim_tokens where lower(name) like 'brand#1%' or lower(symbol) like 'brand#1%' order by position limit 15
""")
def search_scan(t: Facts):
    # the text is longer than any prefix of the index
    return metrics.search_or_scan(cat.search_prefixes(t.creations), t.creations, t.holder_counts, metrics_of(t), "Brand#1 ", "volume_7d", 15)


@query("search_derived", f"""
select token, row_number() over (order by marketcap_usd desc, token) as position, false as scanned
from derived_metrics where quote = 100 and token in (select token from ({PREFIX_SQL}) where prefix = 'brand')
order by position limit 20
""")
def search_derived(t: Facts):
    return metrics.search_or_scan(cat.search_prefixes(t.creations), t.creations, t.holder_counts, derived_metrics_of(t), "Brand", "marketcap_usd", 20, quote=100)


@query("search_address", """
(select 'block' as kind, '7' as id, null as rank)
union all (select 'address', holder_id, null from balances where holder_type = 'address' and holder_id = '7' limit 1)
union all (select 'token', cast(token as varchar), holders from slim_tokens where cast(token as varchar) = '7' or lower(name) like '7%' or lower(symbol) like '7%' order by holders desc, token limit 10)
""", ints="rank")
def search_address(t: Facts):
    from ..operators.ledger import address_balances
    return views.search_guess("7", TIP, slim_tokens(t), t.ev.select(F.lower(F.hex("event_id")).alias("txid")), addresses=address_balances(t.deltas).select("address"))


@query("pools_filtered", """
select pool_id, apr_bp, row_number() over (order by apr_bp, pool_id) as position, sum(tvl_usd) over () as total_tvl, sum(volume_1d_usd) over () as total_volume_1d,
       arg_max(pool_id, tvl_usd) over () as largest, arg_max(pool_id, tvl_change_1d_bp) over () as trending
from (select m.* from pool_metrics m join pools p using (pool_id) where factory_id = 1 and quote_id = 2
      and pool_id % 10 + 100 in (select token from balances where holder_type = 'address' and amount > 5000000000) order by pool_id desc)
""", text="total_tvl total_volume_1d")
def pools_filtered(t: Facts):
    from ..operators.ledger import address_balances
    from ..session import stage
    table = stage(pool_metrics_of(t).join(amm.pool_catalog(t.pools, pool_names(t)), "pool_id"))
    rich = address_balances(t.deltas).filter(F.col("amount") > 5000000000).select("token").distinct()
    held = t.pools.join(rich, F.col("pool_id") % 10 + 100 == F.col("token"), "left_semi")
    return views.pools_overview(table, "apr_bp", False, 50, holders_of=held, factory=1, pool_or_token=2) \
        .select("pool_id", "apr_bp", "position", "total_tvl", "total_volume_1d", "largest", "trending")


@query("factory_positions", """
select *, row_number() over (partition by address order by total_usd desc, pool_id) as position from (
  select *, base_usd + quote_usd as total_usd, base_sats + quote_sats as total_sats from (
    select holder_id as address, pool_id, amount, base_tvl_usd * amount // supply as base_usd, quote_tvl_usd * amount // supply as quote_usd,
           base_tvl_sats * amount // supply as base_sats, quote_tvl_sats * amount // supply as quote_sats
    from balances b join supply s using (token) join pool_values v on v.pool_id % 10 + 100 = b.token join pools using (pool_id)
    where holder_type = 'address' and amount > 0 and factory_id = 2))
""", text="amount base_usd quote_usd base_sats quote_sats total_usd total_sats")
def factory_positions(t: Facts):
    from ..operators.ledger import address_balances
    from ..session import stage
    v = pool_values_of(t).join(t.pools.select("pool_id", "factory_id"), "pool_id").withColumn("lp_token", (F.col("pool_id") % 10 + 100).cast("bigint"))
    p = stage(v.join(t.supply.select(F.col("token").alias("lp_token"), F.col("supply").alias("lp_supply")), "lp_token"))
    return views.factory_positions(address_balances(t.deltas), p, 2)


@query("factory_token_pairs", """
select pool_id, base_id, quote_id, base_name, quote_name, base_reserve, quote_reserve, tvl_usd, volume_1d_usd, position, total from (
  select p.pool_id, base_id, quote_id, b.name as base_name, q.name as quote_name, base_reserve, quote_reserve, tvl_usd, volume_1d_usd,
         row_number() over (order by tvl_usd desc, p.pool_id) as position, count(*) over () as total
  from pools p join last_reserves using (pool_id) join pool_metrics using (pool_id) left join creations b on b.token = base_id left join creations q on q.token = quote_id
  where factory_id = 0 and (base_id = 1 or quote_id = 1)) where position > 1 and position <= 5
""", text="base_reserve quote_reserve tvl_usd volume_1d_usd")
def factory_token_pairs(t: Facts):
    p = t.pools.join(amm.latest_reserves(t.reserves), "pool_id").join(pool_metrics_of(t).select("pool_id", "tvl_usd", "volume_1d_usd"), "pool_id")
    return views.pair_page(p, slim_tokens(t), 0, 1, None, "tvl", 4, 1) \
        .select("pool_id", "base_id", "quote_id", "base_name", "quote_name", "base_reserve", "quote_reserve", "tvl_usd", "volume_1d_usd", "position", "total")
