"""Plans over execution traces and the bridge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exact import DEC
from ..operators import bridge, traces
from .facts import Facts
from .facts_sql import CTES
from .registry import query
from .trace_facts import BRIDGE, FACTORY, trace_events

# Frames in SQL: the n-th invoke of a depth pairs with the n-th return of that depth.
def _levels(source: str) -> str:
    return f"""
select *, case when event = 'invoke' then up else up + 1 end as depth, min(up) over (partition by trace_id) >= 0 and net = 0 as balanced
from (select *, sum(case event when 'invoke' then 1 else -1 end) over (partition by trace_id order by idx rows unbounded preceding) as up,
             sum(case event when 'invoke' then 1 else -1 end) over (partition by trace_id) as net
      from {source} where event <> 'create')
"""


def _paired(levels: str) -> str:
    return f"""
select i.*, r.idx as end_idx, r.status as r_status, r.out_tok as r_tok, r.out_amt as r_amt, r.extra_amt as r_extra,
       case i.ctype when 'delegatecall' then 'delegate' when 'staticcall' then 'static' else 'normal' end as kind
from (select *, row_number() over (partition by trace_id, depth order by idx) as n from {levels} where event = 'invoke') i
left join (select *, row_number() over (partition by trace_id, depth order by idx) as n from {levels} where event = 'return') r
on i.trace_id = r.trace_id and i.depth = r.depth and i.n = r.n and r.idx > i.idx
"""


CTES["tclean"] = "select * from tev where shape <> 'open' and not (shape = 'surplus' and idx = 1)"
CTES["tlev"], CTES["clev"] = _levels("tev"), _levels("tclean")
CTES["frames"], CTES["clean_frames"] = _paired("tlev"), _paired("clev")

CTES["eff"] = """
select f.*, p.owner as parent from clean_frames f
left join (select c.trace_id, c.idx, arg_max(a.owner, a.idx) as owner from clean_frames c join clean_frames a
           on a.trace_id = c.trace_id and a.idx < c.idx and a.end_idx > c.end_idx and a.kind = 'normal' group by 1, 2) p using (trace_id, idx)
where f.balanced and f.r_status <> 'failure' and f.kind <> 'static'
  and not exists (select 1 from clean_frames a where a.trace_id = f.trace_id and a.idx < f.idx and a.end_idx > f.end_idx and (a.r_status = 'failure' or a.kind = 'static'))
"""


def frames_of(t: Facts):
    """Frames of cleaned traces."""
    return traces.call_frames(traces.clean_traces(trace_events(t), host_values(t)))


def host_values(t: Facts):
    return t.ev.select("height").distinct().withColumn("host_data", F.array(F.lit("aa" * 16)))


@query("clean_traces", """
select trace_id, idx from tclean
""", ints="idx")
def clean_traces(t: Facts):
    return traces.clean_traces(trace_events(t), host_values(t)).select("trace_id", "idx")


@query("call_frames", """
select trace_id, idx as start, end_idx as "end", depth, kind, r_status as status, balanced from frames
""", ints='start depth "end"')
def call_frames(t: Facts):
    return traces.call_frames(trace_events(t)).select("trace_id", "start", "end", "depth", "kind", "status", "balanced") \
        .withColumn("depth", F.col("depth").cast("bigint"))


@query("effective_frames", "select trace_id, idx as start, owner, kind, parent from eff", ints="start owner parent")
def effective_frames(t: Facts):
    return traces.effective_frames(frames_of(t)).select("trace_id", "start", "owner", "kind", "parent")


CTES["tdeltas"] = """
select trace_id, owner, token, sum(delta) as delta from (
  select trace_id, idx, owner, in_tok as token, in_amt as delta from eff union all select trace_id, idx, parent, in_tok, -in_amt from eff
  union all select trace_id, idx, owner, r_tok, -r_amt from eff union all select trace_id, idx, parent, r_tok, r_amt from eff
  union all select trace_id, idx, owner, r_tok, -r_extra from eff union all select trace_id, idx, parent, r_tok, r_extra from eff)
where owner is not null and token is not null and trace_id not in (select trace_id from clean_frames where depth = 1 and kind = 'normal' and r_status = 'failure')
group by 1, 2, 3 having sum(delta) <> 0
"""


@query("trace_deltas", "select * from tdeltas", text="delta", ints="owner token")
def trace_deltas(t: Facts):
    return traces.trace_balance_deltas(frames_of(t)).select("trace_id", "owner", "token", "delta")


@query("mint_deltas", """
select trace_id, owner, coalesce(r_extra, r_amt) as minted from clean_frames
where opcode = 77 and kind <> 'static' and balanced and r_status = 'success' and r_tok = owner
""", text="minted", ints="owner")
def mint_deltas(t: Facts):
    return traces.mint_deltas(frames_of(t)).select("trace_id", "owner", "minted")


@query("trace_nets", """
select trace_id, class, side, token, sum(value) as amount from (
  select trace_id, 'in' as side, in_tok as token, in_amt as value from tev where idx = 0
  union all select trace_id, 'out', out_tok, out_amt from tev qualify idx = max(idx) over (partition by trace_id)
  union all select trace_id, 'out', out_tok, extra_amt from tev qualify idx = max(idx) over (partition by trace_id))
join (select trace_id, case when arg_max(status, idx) = 'failure' then 'revert' else 'success' end as class from tev where event = 'return' group by 1) using (trace_id)
where token is not null and value is not null group by 1, 2, 3, 4
""", text="amount", ints="token")
def trace_nets(t: Facts):
    return traces.net_entries(traces.trace_nets(trace_events(t))).select("trace_id", "class", "side", "token", "amount")


@query("trace_storage", f"""
select trace_id, cast(100000 + trace_id as bigint) as contract, key, case key when '{traces.BASE_KEY}' then base_id when '{traces.QUOTE_KEY}' then quote_id else 9004 end as value
from tev, (values ('{traces.BASE_KEY}'), ('{traces.QUOTE_KEY}'), ('{traces.FACTORY_KEY}')) k(key) where mark = 'keys'
""", text="value")
def trace_storage(t: Facts):
    return traces.storage_writes(frames_of(t)).select("trace_id", "contract", "key", "value")


@query("created_contracts", """
select cast(100000 + trace_id as bigint) as contract, height, tx_idx from tev where mark = 'created'
union select 9004, 0, -1
""")
def created_contracts(t: Facts):
    genesis = t.ev.agg(F.lit(FACTORY).cast("bigint").alias("contract"), F.lit(0).cast("bigint").alias("height"), F.lit(-1).cast("bigint").alias("tx_idx"))
    return traces.created_contracts(trace_events(t), genesis)


@query("mint_spam", """
select height, count(*) as txs, count(*) filter (where shape in ('mint', 'mint_in', 'surplus') and user_id % 10 = 0) as spam
from (select *, """ + "case event_type when 'purchase' then 'mint' else '' end as shape from ev) group by 1")
def mint_spam(t: Facts):
    return traces.mint_spam(trace_events(t), 7000)


@query("discover_pools", """
select 100000 + trace_id as pool_id, base_id, quote_id, 9004 as factory, height, tx_idx from tev where mark = 'created'
""", ints="pool_id factory")
def discover_pools(t: Facts):
    f = t.ev.select(F.lit(FACTORY).cast("bigint").alias("factory")).distinct()
    return traces.discover_pools(trace_events(t), frames_of(t), f)


@query("pool_creation_info", """
select 100000 + event_id as pool_id, event_id as tx_idx, height, case when event_id % 2 = 0 then user_id else user_id + 1000 end as creator,
       cents as base_amount, cents * 2 as quote_amount, cents * 3 as lp_supply
from ev where event_type = 'signup' and event_id % 3 = 2
""", ints="pool_id")
def pool_creation_info(t: Facts):
    f = t.ev.select(F.lit(FACTORY).cast("bigint").alias("factory")).distinct()
    pools = traces.discover_pools(trace_events(t), frames_of(t), f)
    e = t.ev.select(F.col("event_id").alias("tx_id"), "user_id", "cents")
    outs = e.select("tx_id", F.col("user_id").alias("address"), (F.col("tx_id") % 2 == 0).alias("is_pointer"))
    ins = e.select("tx_id", F.explode(F.array(*[F.struct(F.lit(i).alias("vin"), (F.col("user_id") + 1000 * (2 - i)).alias("address"),
                                                         (F.col("cents") + 10 - i).alias("value")) for i in (0, 1)])).alias("x")).select("tx_id", "x.*")
    amounts = e.select((F.col("tx_id") + 100000).alias("pool_id"), F.col("cents").alias("base_amount"),
                       (F.col("cents") * 2).alias("quote_amount"), (F.col("cents") * 3).alias("lp_supply"))
    return traces.pool_creation_info(pools, traces.tx_owner(outs, ins), amounts).select(
        "pool_id", "tx_idx", "height", "creator", "base_amount", "quote_amount", "lp_supply")


@query("swap_reserves", """
select trace_id, 5000 + pool_id as pool_id, base_initial as prev_base, quote_initial as prev_quote,
       base_initial * quote_initial // (quote_initial + in_amt) as new_base, quote_initial + in_amt as new_quote, 0 as volume_base, 0 as volume_quote
from tev where shape = 'anchored' and idx = 5
  and abs((base_initial * quote_initial // (quote_initial + in_amt)) * (quote_initial + in_amt) - base_initial * quote_initial) * 10000 <= base_initial * quote_initial * 10
""", text="prev_base prev_quote new_base new_quote volume_base volume_quote", ints="pool_id")
def swap_reserves(t: Facts):
    p = t.pools.select((F.col("pool_id") + 5000).cast("bigint").alias("pool_id"), "base_id", "quote_id")
    return traces.swap_reserves(trace_events(t), p, FACTORY).drop("height", "tx_idx")


CTES["wraps"] = """
select o_orderkey as seq, case when o_orderpriority < '3' then 'wrap' else 'unwrap' end as kind, o_custkey as address,
       cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as amount, o_orderstatus <> 'P' as success,
       date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as height
from orders
"""


def wraps_of(t: Facts):
    o = t.table("orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderpriority") < "3", "wrap").otherwise("unwrap").alias("kind"),
                    F.col("o_custkey").alias("address"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("amount"),
                    (F.col("o_orderstatus") != "P").alias("success"),
                    F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("height"))


@query("wrap_events", """
select height, tx_idx, case when shape = 'wrap' then 'wrap' else 'unwrap' end as kind, coalesce(in_amt, r_amt) as amount, e.user_id as address, r_status = 'success' as success
from frames f join (select event_id, user_id from ev) e on f.tx_idx = e.event_id where shape in ('wrap', 'unwrap')
""", text="amount")
def wrap_events(t: Facts):
    owners = t.ev.select(F.col("event_id").alias("tx_idx"), F.col("user_id").alias("address"))
    return traces.wrap_events(frames_of(t), BRIDGE, owners)


@query("wrap_history", """
select seq, kind, address, amount, success, height, position, (select count(*) from wraps where kind = 'unwrap' and success) as total
from (select *, row_number() over (order by height desc, seq desc) as position from wraps where kind = 'unwrap' and success)
where position > 10 and position <= 110
""")
def wrap_history(t: Facts):
    return bridge.wrap_history(wraps_of(t), "unwrap", successful=True, limit=100, offset=10).drop("has_more")


CTES["unwraps"] = """
select height, sum(a) over (order by height) as total_all, sum(s) over (order by height) as total_successful
from (select height, sum(amount) as a, sum(case when success then amount else 0 end) as s from wraps where kind = 'unwrap' group by 1)
"""


@query("unwrap_totals", "select * from unwraps", ints="total_all total_successful")
def unwrap_totals(t: Facts):
    return bridge.unwrap_totals(wraps_of(t))


@query("unwrap_total_at", """
select h.height, u.total_all, u.total_successful from (select distinct height - 700 as height from wraps) h asof left join unwraps u on h.height >= u.height
""", ints="total_all total_successful")
def unwrap_total_at(t: Facts):
    want = wraps_of(t).select((F.col("height") - 700).alias("height")).distinct()
    return bridge.unwrap_total_at(bridge.unwrap_totals(wraps_of(t)), want)


# ---------------------------------------------------------------- allocation over generated transactions

DIRECTIVE = ("struct<pointer:int,refund:int,status:string,net_in:array<struct<id:bigint,value:decimal(38,0)>>,"
             "net_out:array<struct<id:bigint,value:decimal(38,0)>>,edicts:array<struct<token:bigint,amount:decimal(38,0),output:int>>>")


def tx_plans(t: Facts):
    """Orders as transactions: three outputs (the second unspendable), one directive."""
    o = t.table("orders").select(F.col("o_orderkey").alias("tx_id"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast(DEC).alias("cents"))
    tok = (F.col("tx_id") % 3 + 100).cast("bigint")
    third = F.when(F.col("tx_id") % 4 == 0, 3).when(F.col("tx_id") % 4 == 1, 2).otherwise(0)
    d = F.struct(F.when(F.col("tx_id") % 2 == 0, 0).alias("pointer"), F.lit(2).alias("refund"), F.lit("notrace").alias("status"),
                 F.array().alias("net_in"), F.array().alias("net_out"),
                 F.array(F.struct(tok.alias("token"), F.floor(F.col("cents") / 3).cast(DEC).alias("amount"), third.alias("output"))).alias("edicts"))
    return o.select("tx_id", F.array(F.lit(True), F.lit(False), F.lit(True)).alias("spendable"),
                    F.array(d).cast(f"array<{DIRECTIVE}>").alias("directives"), tok.alias("token"), "cents")


ALLOC_SQL = """
select tx_id, vout, token, sum(amount) as amount from (
  select *, case when tx_id % 4 = 0 then least(have, 2 * want) else least(have, want) end as used from
    (select o_orderkey as tx_id, 100 + o_orderkey % 3 as token, cast(cast(o_totalprice as decimal(18,2)) * 100 as hugeint) as have,
            cast(cast(o_totalprice as decimal(18,2)) * 100 as hugeint) // 3 as want from orders)) x,
  lateral (select 0 as vout, case when tx_id % 4 = 0 then least(have, want) when tx_id % 4 in (2, 3) then used else 0 end + (have - used) as amount
           union all select 2, case when tx_id % 4 = 0 then least(greatest(have - want, 0), want) when tx_id % 4 = 1 then used else 0 end) y
where amount > 0 group by 1, 2, 3
"""


@query("allocate_edicts", ALLOC_SQL, text="amount", ints="vout")
def allocate_edicts(t: Facts):
    txs = tx_plans(t).withColumn("seed", F.array(F.struct(F.col("token").alias("id"), F.col("cents").alias("value"))))
    return traces.allocate_edicts(txs).withColumn("vout", F.col("vout").cast("bigint"))


ALLOC_CHAIN_SQL = """
select tx_id, vout, token, sum(amount) as amount from (
  select tx_id, tok, kind, routed, a, gold, least(have, w) as one, least(greatest(have - w, 0), w) as two, greatest(have - 2 * w, 0) as rest, refunds from (
    select o_orderkey as tx_id, 100 + o_orderkey % 3 as tok, o_orderkey % 3 as kind, o_orderkey % 2 = 0 as routed, o_orderkey % 5 <> 0 as refunds, cents // 2 as a, cents // 3 as w,
      case o_orderkey % 3 when 0 then cents when 1 then cents // 5 else 0 end as have, case o_orderkey % 3 when 1 then 7 else 0 end as gold
    from (select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) * 100 as hugeint) as cents from orders))) x,
  lateral (select greatest(rest - 5, 0) as next) z,
  lateral (select 2 as vout, tok as token, case when kind = 2 and refunds then a else 0 end as amount
    union all select 0, tok, case when kind <> 2 then one else 0 end union all select 2, tok, case when kind <> 2 then two else 0 end
    union all select 0, tok, case when kind <> 2 and not routed then rest else 0 end union all select 0, 900, case when not routed then gold else 0 end
    union all select 2, 900, case when routed then gold else 0 end
    union all select 0, tok, case when kind <> 2 and routed then next - next // 2 else 0 end union all select 2, tok, case when kind <> 2 and routed then next // 2 else 0 end) y
where amount > 0 group by 1, 2, 3
"""


@query("allocate_directives", ALLOC_CHAIN_SQL, text="amount", ints="vout")
def allocate_directives(t: Facts):
    # two directives, the first in each status: it sends each output a third of the order, and what is left to the second one's sheet or to the first output;
    # the second burns five on an unspendable output, takes one token whole and deals out the rest
    o = tx_plans(t).withColumn("third", F.floor(F.col("cents") / 3).cast(DEC))
    pair = lambda i, v: F.struct(F.lit(i).cast("bigint").alias("id") if isinstance(i, int) else i.alias("id"), v.cast(DEC).alias("value"))
    edict = lambda token, amount, to: F.struct(token.cast("bigint").alias("token"), amount.cast(DEC).alias("amount"), F.lit(to).alias("output"))
    status = F.element_at(F.array(F.lit("notrace"), F.lit("success"), F.lit("revert")), (F.col("tx_id") % 3 + 1).cast("int"))
    part = lambda k: F.floor(F.col("cents") / k)
    first = F.struct(F.when(F.col("tx_id") % 2 == 0, 5).alias("pointer"), F.when(F.col("tx_id") % 5 != 0, 2).alias("refund"), status.alias("status"),
                     F.array(pair(F.col("token"), part(2))).alias("net_in"), F.array(pair(F.col("token"), part(5)), pair(900, F.lit(7))).alias("net_out"),
                     F.array(edict(F.col("token"), F.col("third"), 3)).alias("edicts"))
    second = F.struct(F.lit(None).cast("int").alias("pointer"), F.lit(None).cast("int").alias("refund"), F.lit("notrace").alias("status"), F.array().alias("net_in"), F.array().alias("net_out"),
                      F.array(edict(F.col("token"), F.lit(5), 1), edict(F.lit(900), F.lit(0), 2), edict(F.col("token"), F.lit(0), 3)).alias("edicts"))
    d = F.concat(F.array(first).cast(f"array<{DIRECTIVE}>"), F.array(second).cast(f"array<{DIRECTIVE}>"))
    txs = o.select("tx_id", "spendable", d.alias("directives"), F.array(F.struct(F.col("token").alias("id"), F.col("cents").alias("value"))).alias("seed"))
    return traces.allocate_edicts(txs).withColumn("vout", F.col("vout").cast("bigint"))


WAVES_SQL = """
select * from (
with recursive o as (
  select o_orderkey as tx, 100 + o_orderkey % 3 as tok, cast(cast(o_totalprice as decimal(18,2)) * 100 as hugeint) // 3 as want, cast(cast(o_totalprice as decimal(18,2)) * 100 as hugeint) as cents from orders),
held as (
  select tx, token, have, tok, want from (select tx, tok as token, cents as have, tok, want from o where tx % 6 = 0)
  union all
  select n.tx, h.token, h.have - case when h.token <> h.tok then 0 when h.tx % 4 = 0 then least(greatest(h.have - h.want, 0), h.want) when h.tx % 4 = 1 then least(h.have, h.want) else 0 end, n.tok, n.want
  from held h join o n on n.tx = h.tx + 1 where n.tx % 6 <> 0
    and h.have > case when h.token <> h.tok then 0 when h.tx % 4 = 0 then least(greatest(h.have - h.want, 0), h.want) when h.tx % 4 = 1 then least(h.have, h.want) else 0 end),
split as (select *, case when token <> tok then 0 when tx % 4 = 0 then least(greatest(have - want, 0), want) when tx % 4 = 1 then least(have, want) else 0 end as away from held)
select tx as tx_id, 0 as vout, token, have - away as amount from split where have > away
union all select tx, 2, token, away from split where away > 0) w
"""


@query("utxo_waves", WAVES_SQL, text="amount", ints="vout")
def utxo_waves(t: Facts):
    # each order spends the first output of the one before, in chains of six; chain heads spend earlier outpoints
    txs = tx_plans(t)
    inputs = txs.select("tx_id", (F.col("tx_id") - 1).alias("prev_tx"), F.lit(0).alias("prev_vout")) \
        .withColumn("prev_tx", F.when(F.col("tx_id") % 6 == 0, -F.col("tx_id") - 1).otherwise(F.col("prev_tx")))
    prior = txs.filter(F.col("tx_id") % 6 == 0).select((-F.col("tx_id") - 1).alias("prev_tx"), F.lit(0).alias("prev_vout"),
                                                       "token", F.col("cents").alias("amount"))
    return traces.utxo_waves(txs.select("tx_id", "spendable", "directives"), inputs, prior).withColumn("vout", F.col("vout").cast("bigint"))
