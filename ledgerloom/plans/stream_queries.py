"""Plans over sources, streams, pending state and scalar formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.exact import DEC, invert_price, percent_change_bp, apr_bp_30d
from ..session import ensure_checkpoint_dir
from ..sources import blocks, upsert, versions
from ..streaming import chain, incremental, mempool
from .facts import TIP, Facts
from .registry import query
from .sqltext import bp_text, pct


def scratch(t: Facts) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


@query("block_summary", """
select b.height, coalesce(n, 0) as traces from (select distinct height from ev) b left join (select height, count(*) as n from flow where success group by 1) f using (height)
""")
def block_summary(t: Facts):
    return blocks.block_summary(t.ev.select("height").distinct(), t.flow.filter("success"))


@query("recent_blocks", """
select h.height, coalesce(n, 0) as traces from (select unnest(generate_series((select greatest(max(height) - 50, 0) from ev), (select max(height) from ev))) as height) h
left join (select height, count(*) as n from flow where success group by 1) f using (height)
""")
def recent_blocks(t: Facts):
    return blocks.recent_blocks(blocks.block_summary(t.ev.select("height").distinct(), t.flow.filter("success")), radius=50)


@query("attach_traces", """
select event_id, case when event_type <> 'signup' then event_id % 4 end as vout from ev
""")
def attach_traces(t: Facts):
    txid = F.lower(F.lpad(F.hex("event_id"), 64, "0"))
    txs = t.ev.select("event_id", txid.alias("txid"))
    given = F.when(F.col("event_id") % 2 == 0, txid).otherwise(blocks.reversed_hex(txid))
    tr = t.ev.filter(F.col("event_type") != "signup").select(given.alias("txid"), (F.col("event_id") % 4).alias("vout"))
    return blocks.attach_traces(txs, tr).select("event_id", "vout")


@query("dedupe_last_op", """
select contract, key, case when bool_or(cents % 3 <> 0) then 'put' else 'delete' end as op,
       case when bool_or(cents % 3 <> 0) then arg_max(value, event_id) filter (where cents % 3 <> 0) else arg_max(value, event_id) end as value
from (select user_id as contract, k as key, cents, event_id, cast(cents as varchar) as value from ev) group by 1, 2
""")
def dedupe_last_op(t: Facts):
    ops = t.ev.select(F.col("user_id").alias("contract"), F.col("k").cast("bigint").alias("key"),
                      F.when(F.col("cents") % 3 != 0, "put").otherwise("delete").alias("op"), "event_id", F.col("cents").cast("string").alias("value"))
    return upsert.last_op(ops, ["contract", "key"], ["event_id"]).select("contract", F.col("key").cast("int").alias("key"), "op", "value")


@query("stream_candles", "select * from m10", text="open high low close volume")
def stream_candles(t: Facts):
    from ..session import stage
    trades = stage(t.trades)
    where = scratch(t)
    source = t.spark.readStream.schema(trades.schema).parquet(trades.inputFiles()[0].rsplit("/", 1)[0])
    q = incremental.candles_to_table(incremental.stream_candles(source), f"{where}/candles", f"{where}/state")
    q.awaitTermination()
    return versions.read_table(t.spark, f"{where}/candles").drop("part", "epoch")


@query("run_incremental", """
select height, count(*) as events, sum(cents) as cents from ev where height >= 10 group by 1
""", ints="cents height")
def run_incremental(t: Facts):
    where = scratch(t)
    t.ev.select("height", F.concat(F.lit("h"), F.col("height")).alias("block_hash"), "cents").write.parquet(f"{where}/in")
    per_height = lambda df: df.groupBy("height").agg(F.count(F.lit(1)).alias("events"), F.sum("cents").alias("cents"))
    # the second run finds every block in the ledger and adds nothing
    for run in ("first", "again"):
        src = t.spark.readStream.schema("height bigint, block_hash string, cents bigint").parquet(f"{where}/in")
        incremental.run_incremental(t.spark, src, f"{where}/ledger", f"{where}/out", [("totals", 10, per_height)], f"{where}/{run}").awaitTermination()
    return versions.read_table(t.spark, f"{where}/out/totals").select(F.col("height").cast("bigint").alias("height"), "events", "cents")


@query("reprocess_from", "select height, sum(cents) * 2 as cents from ev where height >= 2000 group by 1 union all select height, sum(cents) from ev where height < 2000 group by 1",
       ints="cents height")
def reprocess_from(t: Facts):
    path = f"{scratch(t)}/derived"
    per = lambda k: lambda df: df.groupBy("height").agg((F.sum("cents") * k).alias("cents"))
    incremental.reprocess_from(t.ev, path, per(1), 0)
    incremental.reprocess_from(t.ev, path, per(2), 2000)
    return versions.read_table(t.spark, path).select(F.col("height").cast("bigint").alias("height"), "cents")


@query("reorg_point", "select max(height) + 1 as reorg_height from ev where height < 4000")
def reorg_point(t: Facts):
    h = t.ev.select("height").distinct()
    local = h.withColumn("block_hash", F.concat(F.lit("m"), F.col("height")))
    remote = h.withColumn("block_hash", F.concat(F.when(F.col("height") < 4000, "m").otherwise("x"), F.col("height")))
    return chain.reorg_point(local, remote)


@query("canonical_chain", "select height, 'm' || cast(rn as varchar) as block_hash from (select height, row_number() over (order by height) as rn from (select distinct height from ev))")
def canonical_chain(t: Facts):
    from ..functions.scan import ordinal
    h = ordinal(t.ev.select("height").distinct(), [], [F.col("height")], F.floor(F.col("height") / 1000).cast("bigint"), "rn")
    main = h.select("height", F.concat(F.lit("m"), F.col("rn")).alias("block_hash"), F.concat(F.lit("m"), F.col("rn") - 1).alias("prev_hash"))
    forks = h.filter(F.col("rn") % 50 == 0).select("height", F.concat(F.lit("f"), F.col("rn")).alias("block_hash"),
                                                   F.concat(F.lit("m"), F.col("rn") - 1).alias("prev_hash"))
    tip = main.agg(F.max_by("block_hash", "height").alias("block_hash"))
    return chain.canonical_chain(main.unionByName(forks), tip).select("height", "block_hash")


# ---------------------------------------------------------------- pending state


def seen(t: Facts):
    again = t.mempool.withColumn("first_seen", F.col("first_seen") + 60)
    return t.mempool.unionByName(again)


@query("mempool_state", "select txid, address, first_seen, fee_rate from mempool where fee_rate >= 1")
def mempool_state(t: Facts):
    return mempool.mempool_state(seen(t), mempool.MIN_FEE_RATE)


@query("mempool_prune", """
select txid, address, first_seen, fee_rate from mempool where fee_rate >= 1 order by first_seen desc, txid desc limit 5000
""")
def mempool_prune(t: Facts):
    return mempool.mempool_prune(mempool.mempool_state(seen(t), mempool.MIN_FEE_RATE), 5000)


@query("mempool_confirmed", "select txid, address, first_seen, fee_rate from mempool where fee_rate >= 1 and not confirmed")
def mempool_confirmed(t: Facts):
    return mempool.mempool_confirmed(mempool.mempool_state(seen(t), mempool.MIN_FEE_RATE), t.mempool.filter("confirmed"))


@query("pending_for_address", """
select txid, address, first_seen, position from (select *, row_number() over (partition by address order by first_seen desc, txid desc) as position
  from mempool where fee_rate >= 1 and not confirmed) where position <= 15
""")
def pending_for_address(t: Facts):
    p = mempool.mempool_confirmed(mempool.mempool_state(seen(t), mempool.MIN_FEE_RATE), t.mempool.filter("confirmed"))
    return mempool.pending_for_address(p, 15).select("txid", "address", "first_seen", "position")


@query("pending_traces", """
select txid, position, total from (select txid, row_number() over (order by first_seen desc, txid desc) as position, count(*) over () as total
  from mempool where fee_rate >= 1 and txid in (select tx_id from flow)) where position <= 50
""")
def pending_traces(t: Facts):
    p = mempool.pending_traces(mempool.mempool_state(seen(t), mempool.MIN_FEE_RATE), t.flow.select(F.col("tx_id").alias("txid")), 50)
    return p.select("txid", "position", "total")


# ---------------------------------------------------------------- scalar formats


@query("amount_formats", """
select event_id, format('{:,}', c // 100000000) || case when c % 100000000 = 0 then '' else '.' || rtrim(lpad(cast(c % 100000000 as varchar), 8, '0'), '0') end as amount,
       cast(c as double) / 1e8 as scaled, cast(c as double) / 1e16 as price, case when max(c) over (partition by k) > 9007199254740991 then '"' || c || '"' else cast(c as varchar) end as json,
       case when cents % 2 = 0 then -1 else 1 end * (cents * 10000 + 1235) as bp
from (select event_id, cents, k, cast(cents as hugeint) * 1000003 * (k + 1) as c from ev)
""", ints="bp")
def amount_formats(t: Facts):
    e = t.ev.withColumn("c", (F.col("cents").cast(DEC) * 1000003 * (F.col("k") + 1)).cast(DEC))
    e = tx.json_series(e, ["k"], "c", "json")
    sign = F.when(F.col("cents") % 2 == 0, "-").otherwise("+")
    return e.select("event_id", tx.short_amount(F.col("c")).alias("amount"), tx.scale_amount(F.col("c")).alias("scaled"), tx.scale_price(F.col("c")).alias("price"), "json",
                    tx.parse_bp(F.concat(F.lit(" "), sign, F.col("cents").cast("string"), F.lit(".123459"))).alias("bp"))


@query("number_formats", f"""
select event_id, {pct('cents', 'k')} as change_bp, {bp_text('(cents - 5000)')} as bp_text,
       case when cents = 0 then null else cast(cast(100000000000000000000000000000000 as hugeint) // cents as varchar) end as inverse,
       case when k = 0 then 0 else cents * 36000 // k end as apr, strftime(to_timestamp(ts) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as iso,
       {TIP} - height + 1 as confirmations, k as path_value, '0x' || lower(hex(event_type)) as hex_text, cents as parsed_hex, cents as parsed_dec
from ev
""", ints="apr change_bp confirmations path_value")
def number_formats(t: Facts):
    props = t.table("events").select("event_id", "props")
    e = t.ev.join(props, "event_id")
    c, k = F.col("cents").cast(DEC), F.col("k").cast(DEC)
    return e.select(
        "event_id", percent_change_bp(c, k).alias("change_bp"), tx.format_bp(F.col("cents") - 5000).alias("bp_text"),
        invert_price(c).alias("inverse"), apr_bp_30d(c, k).alias("apr"), tx.iso_timestamp(F.col("ts")).alias("iso"),
        tx.confirmations(F.lit(TIP), F.col("height")).cast("bigint").alias("confirmations"),
        tx.json_path(F.col("props"), "k").cast("bigint").alias("path_value"), tx.hex0x(F.col("event_type").cast("binary")).alias("hex_text"),
        tx.parse_num(F.concat(F.lit("0x"), F.lower(F.hex("cents")))).cast("bigint").alias("parsed_hex"),
        tx.parse_num(F.col("cents").cast("string")).cast("bigint").alias("parsed_dec"))
