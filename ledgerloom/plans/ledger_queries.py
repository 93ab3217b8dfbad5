"""Plans over outpoints, balances, holders and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exact import DEC, big
from ..operators import ledger
from .facts import Facts
from .facts_sql import CTES
from .registry import query

HOLDER = "token, holder_type, holder_id"


@query("outpoint_spends", "select outpoint, token, address, amount, created_height, spent_height, spent_by from outputs", text="amount")
def outpoint_spends(t: Facts):
    inputs = t.outputs.filter(F.col("spent_by").isNotNull()).select("outpoint", "spent_by", "spent_height", F.lit(0).alias("tx_idx"))
    # a later double spend of every spent outpoint must not replace the first one
    late = inputs.withColumn("spent_by", F.col("spent_by") + 1).withColumn("spent_height", F.col("spent_height") + 5)
    return ledger.outpoint_spends(t.outputs, inputs.unionByName(late)).select(
        "outpoint", "token", "address", "amount", "created_height", "spent_height", "spent_by")


@query("outpoint_balances", """
select outpoint, token, sum(amount) as amount, max(spent_by) as spent_by, max(spent_by) is not null as spent from outputs group by 1, 2
""", text="amount")
def outpoint_balances(t: Facts):
    return ledger.outpoint_balances(t.outputs, t.outputs.select("outpoint").distinct())


@query("address_outpoints", """
select address, outpoint, string_agg(cast(token as varchar) || '=' || cast(amount as varchar), ',' order by token) as tokens
from outputs where spent_by is null group by 1, 2
""")
def address_outpoints(t: Facts):
    return ledger.address_outpoints(t.outputs)


@query("holder_deltas", "select * from deltas", text="delta")
def holder_deltas(t: Facts):
    return t.deltas


@query("holder_balances", "select * from balances", text="amount")
def holder_balances(t: Facts):
    return t.balances


@query("holder_balances_at", f"select {HOLDER}, sum(delta) as amount from deltas where height <= 1500 group by 1, 2, 3 having sum(delta) <> 0", text="amount")
def holder_balances_at(t: Facts):
    return ledger.holder_balances(t.deltas, 1500)


@query("balance_history", f"""
select {HOLDER}, height, delta, sum(delta) over (partition by {HOLDER} order by height rows unbounded preceding) as amount from deltas
""", text="delta amount")
def balance_history(t: Facts):
    return ledger.balance_history(t.deltas)


@query("holders_page", f"""
select {HOLDER}, amount, rank, total, supply, cast(amount * 1000000 // supply as bigint) as percent_bp from (
  select *, row_number() over (partition by token order by amount desc,
              case when holder_type = 'address' then 'addr:' || holder_id else 'contract:' || lpad(holder_id, 20, '0') end) as rank,
         count(*) over (partition by token) as total, sum(amount) over (partition by token) as supply
  from balances where amount > 0) where rank > 10 and rank <= 60
""", text="amount supply")
def holders_page(t: Facts):
    return ledger.holders(t.balances, 50, 10)


@query("holder_counts", "select c.token, coalesce(holders, 0) as holders from creations c left join holder_counts h on c.token = h.token")
def holder_counts(t: Facts):
    return ledger.holder_counts(t.balances, t.creations)


@query("supply_by_height", """
select token, height, sum(delta) over (partition by token order by height rows unbounded preceding) as supply
from (select token, height, sum(delta) as delta from deltas group by 1, 2) where delta <> 0
""", text="supply")
def supply_by_height(t: Facts):
    return ledger.supply_by_height(t.deltas)


@query("total_minted", """
select token, height, minted, sum(minted) over (partition by token order by height rows unbounded preceding) as total_minted
from (select token, created_height as height, sum(amount) as minted from outputs group by 1, 2)
""", text="minted total_minted")
def total_minted(t: Facts):
    return ledger.total_minted(t.outputs.select("token", F.col("created_height").alias("height"), "amount"))


@query("address_balances", "select holder_id as address, token, amount from balances where holder_type = 'address'", text="amount")
def address_balances(t: Facts):
    return ledger.address_balances(t.deltas)


@query("contract_balances", """
select owner, token, arg_max(amount, height) as amount from contract_history group by 1, 2 having arg_max(amount, height) <> 0
""", text="amount")
def contract_balances(t: Facts):
    return ledger.contract_balances(ledger.contract_balance_history(t.contract_deltas))


@query("balance_at_height", """
select owner, token, arg_max(amount, height) as amount, max(height) as resolved_height from contract_history where height <= 2000 group by 1, 2
""", text="amount")
def balance_at_height(t: Facts):
    return ledger.contract_balance_at(ledger.contract_balance_history(t.contract_deltas), 2000)


def moving(t: Facts):
    """Outputs that are spent by the next transaction, so that addresses also send."""
    return t.outputs.withColumn("spent_by", F.when(F.col("spent_by").isNotNull(), F.col("tx_id") + 1))


VOLUME_SQL = """
select token, address, sum(amount) as volume from (select tx_id, token, address from outputs
  union select tx_id + 1, token, address from outputs where spent_by is not null)
join (select tx_id, token, sum(amount) as amount from outputs group by 1, 2) using (tx_id, token) group by 1, 2
"""


@query("transfer_volume", f"""
select token, address, volume, position from (select *, row_number() over (partition by token order by volume desc, address) as position
  from ({VOLUME_SQL})) where position <= 100
""", text="volume")
def transfer_volume(t: Facts):
    return ledger.ranked_by_amount(ledger.transfer_volume(moving(t)), "volume", 100)


@query("total_received", """
select token, address, received, position from (select *, row_number() over (partition by token order by received desc, address) as position
  from (select token, address, sum(amount) as received from outputs group by 1, 2)) where position <= 100
""", text="received")
def total_received(t: Facts):
    return ledger.ranked_by_amount(ledger.total_received(t.outputs), "received", 100)


@query("address_activity", f"""
select address, token, volume, received from ({VOLUME_SQL}) join (select token, address, sum(amount) as received from outputs group by 1, 2) using (token, address)
""", text="volume received")
def address_activity(t: Facts):
    return ledger.address_activity(ledger.transfer_volume(moving(t)), ledger.total_received(t.outputs))


@query("balance_log", """
select owner, height, seq, tx_id, outflow, position from (
  select *, row_number() over (partition by owner order by height desc, seq desc) as position from (
    select owner, height, seq, tx_id, string_agg(cast(token as varchar) || '=' || cast(delta as varchar), ',' order by cast(token as varchar) || '=' || cast(delta as varchar)) as outflow
    from contract_deltas where delta <> 0 group by 1, 2, 3, 4)) where position > 5 and position <= 45
""")
def balance_log(t: Facts):
    return ledger.balance_log(t.contract_deltas, 40, 5)


@query("balance_log_token", """
select owner, token, height, seq, tx_id, delta, position from (
  select *, row_number() over (partition by owner, token order by height desc, seq desc) as position from contract_deltas where delta <> 0)
where position <= 30
""", text="delta")
def balance_log_token(t: Facts):
    return ledger.balance_log(t.contract_deltas, 30, per_token=True)


@query("tx_summary", """
select tx_id, o.height, coalesce(outflows, 0) as outflows, coalesce(traces, 0) as traces
from (select tx_id, height, count(*) as outflows from contract_deltas group by 1, 2) o
full join (select event_id as tx_id, count(*) as traces from ev group by 1) n using (tx_id)
""")
def tx_summary(t: Facts):
    return ledger.tx_summary(t.contract_deltas, t.ev.select(F.col("event_id").alias("tx_id")))


@query("block_txs", """
select height, tx_idx, tx_id, position from (select height, seq as tx_idx, tx_id, row_number() over (partition by height order by seq) as position from flow)
where position <= 3
""")
def block_txs(t: Facts):
    return ledger.block_txs(t.flow.select("height", F.col("seq").alias("tx_idx"), "tx_id"), 3)


@query("latest_traced", """
select height, event_id as tx_idx, row_number() over (order by height desc, event_id desc) as position from ev order by position limit 20
""")
def latest_traced(t: Facts):
    return ledger.latest_traced(t.ev.select("height", F.col("event_id").alias("tx_idx")))


@query("address_txs", f"""
select address, tx_id, height, is_pending, position, (select greatest(max(created_height), max(spent_height)) from outputs) - height + 1 as confirmations from (
  select *, row_number() over (partition by address order by is_pending desc, height desc nulls last, tx_id desc) as position from (
    select c.address, c.tx_id, c.height, false as is_pending from (
      select address, tx_id, max(height) as height from (select address, tx_id, created_height as height from outputs
        union all select address, spent_by, spent_height from outputs where spent_by is not null) group by 1, 2) c
    anti join (select distinct address, txid as tx_id from mempool where not confirmed) p on c.address = p.address and c.tx_id = p.tx_id
    union all select distinct address, txid, null, true from mempool where not confirmed)) where position <= 20
""", ints="confirmations height")
def address_txs(t: Facts):
    pending = t.mempool.filter(~F.col("confirmed")).select("address", F.col("txid").alias("tx_id"))
    tip = t.outputs.agg(F.greatest(F.max("created_height"), F.max("spent_height")).alias("tip")).scalar()
    return ledger.address_txs(t.outputs, pending, tip, 20)



@query("reconcile_balances", """
select owner, token, coalesce(l.amount, 0) as local, coalesce(a.amount, 0) as authority, tx_count, last_tx
from (select owner, token, arg_max(amount, height) as amount from contract_history group by 1, 2 having arg_max(amount, height) <> 0) l
full join (select owner, token, case when owner % 4 = 1 then v + 5 else v end as amount
           from (select owner, token, arg_max(amount, height) as v from contract_history group by 1, 2 having arg_max(amount, height) <> 0) where owner % 7 <> 3) a
using (owner, token)
join (select owner, token, count(distinct tx_id) as tx_count, max(tx_id) as last_tx from contract_deltas group by 1, 2) using (owner, token)
where coalesce(l.amount, 0) <> coalesce(a.amount, 0)
""", text="local authority")
def reconcile_balances(t: Facts):
    local = ledger.contract_balances(ledger.contract_balance_history(t.contract_deltas))
    # the authority lacks some owners and disagrees on others
    authority = local.filter(F.col("owner") % 7 != 3).withColumn(
        "amount", F.when(F.col("owner") % 4 == 1, F.col("amount") + 5).otherwise(F.col("amount")).cast(DEC))
    return ledger.reconcile(local, authority, t.contract_deltas)


@query("mismatch_origin", """
select owner, token, coalesce(max(nxt) filter (where l = a), min(height)) as origin_height, max(nxt) filter (where l = a) is not null as exact from (
  select *, lead(height) over (partition by owner, token order by height) as nxt from (
    select owner, token, height, amount as l, case when height >= 1000 + owner * 50 and owner % 3 = 0 then amount + 1 else amount end as a from contract_history))
group by 1, 2 having arg_max(l = a, height) = false
""")
def mismatch_origin(t: Facts):
    h = ledger.contract_balance_history(t.contract_deltas).select("owner", "token", "height", "amount")
    off = (F.col("height") >= F.col("owner") * 50 + 1000) & (F.col("owner") % 3 == 0)
    return ledger.mismatch_origin(h, h.withColumn("amount", F.when(off, F.col("amount") + 1).otherwise(F.col("amount")).cast(DEC)))


@query("tx_fees", """
select tx_id, case when missing = 0 and vin >= vout then vin - vout end as fee
from (select tx_id, sum(amount) as vout from outputs group by 1)
left join (select i.tx_id, sum(o.amount) as vin, count(*) - count(o.amount) as missing
           from (select tx_id, tx_id - 1 as prev from outputs) i left join (select tx_id, sum(amount) as amount from outputs group by 1) o on i.prev = o.tx_id
           group by 1) using (tx_id)
""", text="fee")
def tx_fees(t: Facts):
    # every output of a transaction spends the whole of the transaction before it
    outs = t.outputs.groupBy("tx_id").agg(F.sum("amount").cast(DEC).alias("value")).withColumn("outpoint", F.col("tx_id"))
    return ledger.tx_fees(outs, t.outputs.select("tx_id", (F.col("tx_id") - 1).alias("outpoint")))


FEES_SQL = """
select tx_id, case when missing = 0 and vin >= vout then vin - vout end as fee
from (select tx_id, sum(amount) as vout from outputs group by 1)
left join (select i.tx_id, sum(o.amount) as vin, count(*) - count(o.amount) as missing
           from (select tx_id, tx_id - 1 as prev from outputs) i left join (select tx_id, sum(amount) as amount from outputs group by 1) o on i.prev = o.tx_id
           group by 1) using (tx_id)
"""


@query("fee_rates", f"select tx_id, fee, tx_id % 5 * 40 as vsize, case when tx_id % 5 > 0 then cast(fee as double) / (tx_id % 5 * 40) end as fee_rate from ({FEES_SQL})", text="fee")
def fee_rates(t: Facts):
    return ledger.fee_rates(tx_fees(t), t.outputs.select("tx_id", (F.col("tx_id") % 5 * 40).alias("vsize")).distinct())


@query("block_fees", f"""
select height, case when count(fee) > 0 then sum(fee) // count(fee) end as avg_fee, count(fee) as n
from (select tx_id, min(created_height) as height from outputs group by 1) left join ({FEES_SQL}) using (tx_id) group by 1
""", text="avg_fee", ints="height")
def block_fees(t: Facts):
    return ledger.block_fees(tx_fees(t), t.outputs.groupBy("tx_id").agg(F.min("created_height").alias("height")))


@query("balance_line_chart", """
select g.token, g.sample_height, coalesce(s.supply, 0) as supply
from (select token, unnest(list_distinct(list_append(generate_series(0, last, 30), last))) as sample_height from (select distinct token from deltas), (select max(height) as last from (select height from deltas group by token, height having sum(delta) <> 0))) g
asof left join (select token, height, sum(delta) over (partition by token order by height rows unbounded preceding) as supply
                from (select token, height, sum(delta) as delta from deltas group by 1, 2) where delta <> 0) s
on g.token = s.token and g.sample_height >= s.height
""", text="supply")
def balance_line_chart(t: Facts):
    return ledger.sample_series(ledger.supply_by_height(t.deltas), ["token"], "supply", 0, None, 30)


CTES["own_balances"] = """
select token, holder_type, holder_id, amount from balances where not (holder_type = 'contract' and holder_id = cast(token as varchar))
union all select token, 'contract', cast(token as varchar), cast(700 as hugeint) from (select distinct token from balances) where token % 2 = 1 and token % 5 <> 0 or token % 2 = 0 and token not in (select token from supply)
union all select token, 'contract', cast(token as varchar), supply // 3 from supply where token % 2 = 0
"""


@query("holders_authority", f"""
select {HOLDER}, amount, rank, total, supply, cast(amount * 1000000 // supply as bigint) as percent_bp from (
  select *, row_number() over (partition by token order by amount desc,
              case when holder_type = 'address' then 'addr:' || holder_id else 'contract:' || lpad(holder_id, 20, '0') end) as rank,
         count(*) over (partition by token) as total, sum(amount) over (partition by token) as supply
  from own_balances where amount > 0) where rank <= 25
""", text="amount supply")
def holders_authority(t: Facts):
    # every contract holds 700 of its own token; the authority knows better for even ones and says 0 for multiples of 5
    tokens = t.balances.select("token").distinct()
    own = tokens.select("token", F.lit("contract").alias("holder_type"), F.col("token").cast("string").alias("holder_id"), big(700).cast(DEC).alias("amount"))
    even = t.supply.filter(F.col("token") % 2 == 0).select("token", F.floor(F.col("supply") / 3).cast(DEC).alias("amount"))
    none = tokens.filter((F.col("token") % 5 == 0) & (F.col("token") % 2 == 1)).select("token", big(0).cast(DEC).alias("amount"))
    return ledger.holders(ledger.with_authority(t.balances.unionByName(own), even.unionByName(none)), 25)


@query("balance_violations", f"""
select {HOLDER}, min(height) filter (amount < 0) as first_height, min(amount) as lowest, count(*) filter (amount < 0) as heights, arg_max(amount, height) as amount
from (select {HOLDER}, height, sum(delta) over (partition by {HOLDER} order by height rows unbounded preceding) as amount from deltas)
group by {HOLDER} having count(*) filter (amount < 0) > 0
""", text="lowest amount")
def balance_violations(t: Facts):
    return ledger.balance_violations(t.deltas)


@query("balance_log_cursor", """
select owner, height, seq, tx_id, outflow, position, left_over > 35 as has_more,
       case when left_over > 35 then arg_max(height, position) over (partition by owner) end as next_height,
       case when left_over > 35 then arg_max(seq, position) over (partition by owner) end as next_seq
from (select l.*, row_number() over (partition by owner order by height desc, seq desc) as position, count(*) over (partition by owner) as left_over from (
    select owner, height, seq, tx_id, string_agg(cast(token as varchar) || '=' || cast(delta as varchar), ',' order by cast(token as varchar) || '=' || cast(delta as varchar)) as outflow
    from contract_deltas where delta <> 0 group by 1, 2, 3, 4) l
  join (select owner, arg_max(height, seq) as ch, max(seq) as cs from contract_deltas where seq % 4 = 1 group by 1) c using (owner)
  where l.height < ch or l.height = ch and l.seq < cs) where position <= 35
""")
def balance_log_cursor(t: Facts):
    seen = t.contract_deltas.filter(F.col("seq") % 4 == 1).groupBy("owner").agg(F.max_by("height", "seq").alias("height"), F.max("seq").alias("seq"))
    return ledger.balance_log_after(t.contract_deltas, seen, 35)


@query("address_protocol_txs", """
select address, tx_id, height, is_pending, position, (select greatest(max(created_height), max(spent_height)) from outputs) - height + 1 as confirmations from (
  select *, row_number() over (partition by address order by is_pending desc, height desc nulls last, tx_id desc) as position from (
    select c.address, c.tx_id, c.height, false as is_pending from (
      select address, tx_id, max(height) as height from (select address, tx_id, created_height as height from outputs where token % 10 <> 3
        union all select address, spent_by, spent_height from outputs where spent_by is not null) where tx_id % 3 = 0 group by 1, 2) c
    anti join (select distinct address, txid as tx_id from mempool where not confirmed and txid % 3 = 0) p on c.address = p.address and c.tx_id = p.tx_id
    union all select distinct address, txid, null, true from mempool where not confirmed and txid % 3 = 0)) where position <= 20
""", ints="confirmations height")
def address_protocol_txs(t: Facts):
    # outputs of one token are data-only, every third transaction has a protocol message
    outs = t.outputs.select("tx_id", "address", F.col("created_height").alias("height"), (F.col("token") % 10 == 3).alias("is_data"))
    ins = t.outputs.filter(F.col("spent_by").isNotNull()).select(F.col("spent_by").alias("tx_id"), "address", F.col("spent_height").alias("height"))
    messages = outs.select("tx_id").unionByName(ins.select("tx_id")).filter(F.col("tx_id") % 3 == 0)
    pending = t.mempool.filter(~F.col("confirmed") & (F.col("txid") % 3 == 0)).select("address", F.col("txid").alias("tx_id"))
    tip = t.outputs.agg(F.greatest(F.max("created_height"), F.max("spent_height")).alias("tip")).scalar()
    return ledger.indexed_txs(ledger.address_index(outs, ins, messages), pending, tip, 20)


@query("balance_charts", """
select g.span, g.token, g.sample_height, coalesce(s.supply, 0) as supply
from (select token, span, unnest(list_distinct(list_append(generate_series(case when back is null then 0 else 2400 - back end, 2400, step), 2400))) as sample_height
      from (select distinct token from deltas where height <= 2400), (values ('1d', 144, 1), ('1w', 1008, 7), ('all', null, 500)) as r(span, back, step)) g
asof left join (select token, height, sum(delta) over (partition by token order by height rows unbounded preceding) as supply
                from (select token, height, sum(delta) as delta from deltas group by 1, 2) where delta <> 0) s
on g.token = s.token and g.sample_height >= s.height
""", text="supply")
def balance_charts(t: Facts):
    s = ledger.supply_by_height(t.deltas)
    charts = [ledger.chart_series(s, ["token"], "supply", span, 0, 2400).withColumn("span", F.lit(name))
              for span, name in (("24h", "1d"), ("1W", "1w"), ("max", "all"))]
    return charts[0].unionByName(charts[1]).unionByName(charts[2])
