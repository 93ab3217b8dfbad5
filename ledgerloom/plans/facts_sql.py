"""The same adapters and shared subqueries in SQL, used by the oracle texts."""

CTES: dict[str, str] = {}

CTES["ev"] = """
select event_id, ts, (ts - 1704067200) // 600 as height, k % 24 as pool_id, k, user_id, event_type, cents
from (select event_id, cast(floor(epoch(ts)) as bigint) as ts,
             cast(json_extract_string(props, '$.k') as int) as k, user_id, event_type,
             cast(cast(value as decimal(18,2)) * 100 as bigint) as cents
      from events)
"""

CTES["flow"] = """
select pool_id, height, ts, event_id as seq, event_id as tx_id, user_id as address, event_id % 7 <> 0 as success,
       cast(cents as hugeint) * 1000000 * (case when event_type in ('view', 'error') then -1 else 1 end) as base_delta,
       cast(cents as hugeint) * 10000 * (45 + 7 * pool_id + event_id % 11)
         * (case when event_type in ('click', 'error') then -1 else 1 end) as quote_delta
from ev where event_type <> 'signup'
"""

CTES["pools"] = """
select pool_id,
       cast(case when pool_id < 20 then 100 + pool_id // 2 when pool_id = 20 then 1 else pool_id + 80 end as bigint) as base_id,
       cast(case when pool_id < 20 and pool_id % 2 = 0 then 1 when pool_id <= 20 then 2 else 100 end as bigint) as quote_id,
       cast(pool_id % 3 as bigint) as factory_id,
       case when pool_id >= 21 then cast(10000000000 as hugeint) else cast(1000000000000 as hugeint) end as base_initial,
       case when pool_id >= 21 then cast(100000000 as hugeint) else cast(10000000000 as hugeint) end * (50 + 7 * pool_id) as quote_initial
from (select distinct pool_id from ev)
"""

CTES["activity"] = """
select *, case when base_delta > 0 and quote_delta < 0 then 'trade_sell' when base_delta < 0 and quote_delta > 0 then 'trade_buy'
               when base_delta > 0 then 'liquidity_add' else 'liquidity_remove' end as kind,
       case when base_delta > 0 and quote_delta < 0 then 'base_in' when base_delta < 0 and quote_delta > 0 then 'quote_in' end as direction
from flow where base_delta <> 0 and quote_delta <> 0
"""

CTES["reserves"] = """
select * exclude (sb, sq, mb, mq), sb - least(0, mb) as base_reserve, sq - least(0, mq) as quote_reserve
from (select *, min(sb) over w as mb, min(sq) over w as mq
      from (select f.*, base_initial + sum(base_delta) over w as sb, quote_initial + sum(quote_delta) over w as sq
            from flow f join pools p using (pool_id)
            window w as (partition by f.pool_id order by height, seq rows unbounded preceding))
      window w as (partition by pool_id order by height, seq rows unbounded preceding))
"""

CTES["trades"] = """
select r.*, a.kind, a.direction,
       case when base_reserve = 0 then 0 else quote_reserve * cast(10000000000000000 as hugeint) // base_reserve end as price_base,
       case when quote_reserve = 0 then 0 else base_reserve * cast(10000000000000000 as hugeint) // quote_reserve end as price_quote
from reserves r join (select seq, kind, direction from activity where kind in ('trade_buy', 'trade_sell')) a using (seq)
"""

CTES["sided"] = """
select pool_id, ts, height, seq, 'base' as side, price_base as price,
       abs(base_delta) * cast(10000000000000000 as hugeint) // 100000000 as vol from trades
union all
select pool_id, ts, height, seq, 'quote', price_quote, abs(quote_delta) * cast(10000000000000000 as hugeint) // 100000000 from trades
"""

CTES["m10"] = """
select pool_id, ts // 600 * 600 as bucket_ts, side, arg_min(price, seq) as open, max(price) as high, min(price) as low,
       arg_max(price, seq) as close, cast(sum(vol) as hugeint) as volume
from sided group by 1, 2, 3
"""

CTES["btc"] = """
select height, height * 600 + 1704067200 as ts,
       cast(40000 + arg_max(cents, event_id) as hugeint) * 10000000000000000 as price
from ev where event_type = 'signup' group by height
"""

CTES["quotes"] = """
select distinct quote_id, case when quote_id = 1 then 'btc' else 'usd' end as unit from pools where quote_id in (1, 2)
"""

CTES["canonical"] = """
select pool_id, base_id as token, quote_id as quote, true as token_is_base, unit from pools join quotes using (quote_id)
union all
select p.pool_id, p.quote_id, p.base_id, false, q.unit from pools p join quotes q on p.base_id = q.quote_id
"""

CTES["m10_wide"] = """
select b.pool_id, b.bucket_ts, b.open as base_open, b.high as base_high, b.low as base_low, b.close as base_close, b.volume as base_volume,
       q.open as quote_open, q.high as quote_high, q.low as quote_low, q.close as quote_close, q.volume as quote_volume
from m10 b join m10 q on b.pool_id = q.pool_id and b.bucket_ts = q.bucket_ts and b.side = 'base' and q.side = 'quote'
"""


def _usd_fields() -> str:
    from .sqltext import muldiv
    out = []
    for f in ("open", "high", "low", "close"):
        out.append(f"""case when unit = 'usd' then p_{f} when p_{f} <> 0 then {muldiv(f'p_{f}', 'btc_price', 10**16)}
            when i_{f} <> 0 then btc_price * 10000000000000000 // i_{f} else 0 end as {f}""")
    out.append(f"case when unit = 'usd' then vol else {muldiv('vol', 'btc_price', 10**16)} end as volume")
    return ",\n".join(out)


CTES["token_pool_usd"] = f"""
select token, unit, pool_id, bucket_ts, {_usd_fields()}
from (select c.token, c.unit, w.pool_id, w.bucket_ts, b.price as btc_price,
             {", ".join(f"case when token_is_base then base_{f} else quote_{f} end as p_{f}, case when token_is_base then quote_{f} else base_{f} end as i_{f}" for f in ("open", "high", "low", "close"))},
             case when token_is_base then quote_volume else base_volume end as vol
      from m10_wide w join canonical c using (pool_id)
      asof left join btc b on w.bucket_ts + 599 >= b.ts)
where unit = 'usd' or btc_price is not null
"""

CTES["token_usd"] = f"""
select token, bucket_ts, case when adj then p_close else open end as open,
       case when adj then greatest(high, p_close) else greatest(high, open) end as high,
       case when adj then least(low, p_close) else least(low, open) end as low, close, volume
from (select *, coalesce(lag(bucket_ts) over w = bucket_ts - 600 and lag(close) over w <> 0, false) as adj,
             lag(close) over w as p_close
      from (select token, bucket_ts,
                   {", ".join(f"case when b.{f} is not null and u.{f} is not null then {'b.volume + u.volume' if f == 'volume' else f'(b.{f} + u.{f}) // 2'} else coalesce(b.{f}, u.{f}) end as {f}" for f in ("open", "high", "low", "close", "volume"))}
            from (select * from token_pool_usd where unit = 'btc' qualify row_number() over (partition by token, bucket_ts order by pool_id desc) = 1) b
            full join (select * from token_pool_usd where unit = 'usd' qualify row_number() over (partition by token, bucket_ts order by pool_id desc) = 1) u
            using (token, bucket_ts))
      window w as (partition by token order by bucket_ts))
"""

CTES["outputs"] = """
select l_orderkey as tx_id,
       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'),
                 cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint)) as outpoint,
       l_suppkey % 10 + 100 as token, o_custkey as address, cast(cast(l_quantity as bigint) as hugeint) * 100000000 as amount,
       date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as created_height,
       case when l_returnflag = 'R' then date_diff('day', date '1995-01-01', cast(l_shipdate as date)) + 30 end as spent_height,
       case when l_returnflag = 'R' then l_orderkey + 1000000000 end as spent_by
from lineitem join orders on l_orderkey = o_orderkey
"""

CTES["supply"] = """
select token, cast(sum(amount) as hugeint) as supply from outputs where spent_height is null group by token
"""

CTES["creations"] = """
select p_partkey as token, p_name as name, p_brand as symbol, cast(p_size as hugeint) as cap,
       cast(cast(p_retailprice as decimal(18,2)) * 100 as hugeint) as mint_amount, p_partkey as creation_height,
       cast(p_size % 5 as bigint) as template
from part
"""

CTES["contract_deltas"] = """
select pool_id as owner, base_id as token, height, seq, tx_id, base_delta as delta from flow join pools using (pool_id)
union all select pool_id, quote_id, height, seq, tx_id, quote_delta from flow join pools using (pool_id)
"""

CTES["deltas"] = """
select token, holder_type, holder_id, height, cast(sum(delta) as hugeint) as delta from (
  select token, 'address' as holder_type, cast(address as varchar) as holder_id, created_height as height, amount as delta from outputs
  union all select token, 'address', cast(address as varchar), spent_height, -amount from outputs where spent_height is not null
  union all select token, 'contract', cast(owner as varchar), height, delta from contract_deltas where owner <> token)
group by 1, 2, 3, 4 having sum(delta) <> 0
"""

CTES["balances"] = """
select token, holder_type, holder_id, cast(sum(delta) as hugeint) as amount from deltas group by 1, 2, 3 having sum(delta) <> 0
"""

CTES["holder_counts"] = """
select token, count(*) as holders from balances where amount > 0 group by token
"""

CTES["mempool"] = """
select event_id as txid, ts as first_seen, user_id as address, cents // (k + 1) as fee_rate, event_type = 'purchase' as confirmed from ev
"""

CTES["writes"] = """
select user_id as contract, ['/name', '/symbol', '/cap', '/value-per-mint', '/other'][k % 5 + 1] as key,
       case when k % 5 < 2 then 'n' || cast(cents % 7 as varchar) else cast(cents as varchar) end as value,
       height, event_id as tx_idx, height as txid from ev
"""

CTES["contracts"] = "select user_id as contract, min(height) as txid from ev group by 1"

CTES["contract_history"] = """
select owner, token, height, s - least(0, min(s) over w) as amount
from (select *, sum(delta) over (partition by owner, token order by height rows unbounded preceding) as s
      from (select owner, token, height, sum(delta) as delta from contract_deltas group by 1, 2, 3))
window w as (partition by owner, token order by height rows unbounded preceding)
"""
