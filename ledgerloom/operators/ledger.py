"""Balances, holders, supply and flows.

outputs   tx_id, outpoint, token, address, amount, created_height, spent_height, spent_by
deltas    token, holder_type, holder_id, height, delta
The running forms first sum to one row per (key, height), which bounds a key's
series by the number of blocks whatever its share of the transactions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exact import DEC, big, div_floor
from ..functions.paging import page, top_per_key
from ..functions.scan import clamped_sums
from ..session import spread
from .amm import height_chunk


def total(c: str | Column) -> Column:
    return F.sum(c).cast(DEC)


# ---------------------------------------------------------------- outpoints

def outpoint_spends(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outputs with their spender; the first spender in chain order wins.

    ``inputs``: outpoint, spent_by, spent_height, tx_idx.  Spends are reduced to one
    row per outpoint before the join.
    """
    first = inputs.groupBy("outpoint").agg(
        F.min_by(F.struct("spent_by", "spent_height"), F.struct("spent_height", "tx_idx")).alias("s"))
    first = first.select("outpoint", F.col("s.spent_by").alias("spent_by"), F.col("s.spent_height").alias("spent_height"))
    return outputs.drop("spent_by", "spent_height").join(first, "outpoint", "left")


def outpoint_balances(outputs: DataFrame, requested: DataFrame) -> DataFrame:
    """Token entries and spent flag of the requested outpoints; unknown ones keep nulls."""
    b = outputs.groupBy("outpoint", "token").agg(total("amount").alias("amount"),
                                                 F.max("spent_by").alias("spent_by"))
    return requested.join(b, "outpoint", "left").withColumn("spent", F.col("spent_by").isNotNull())


def address_outpoints(outputs: DataFrame, address=None) -> DataFrame:
    """Unspent outpoints per address with their token list."""
    u = outputs.filter(F.col("spent_by").isNull())
    if address is not None:
        u = u.filter(F.col("address") == address)
    per = u.groupBy("address", "outpoint", "token").agg(total("amount").alias("amount"))
    entry = F.concat(F.col("token").cast("string"), F.lit("="), F.col("amount").cast("string"))
    return per.groupBy("address", "outpoint").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("tokens"))


# ---------------------------------------------------------------- deltas and balances

def holder_deltas(outputs: DataFrame, contract_deltas: DataFrame | None = None) -> DataFrame:
    """Signed change per token, holder and height; zero changes drop out.

    ``contract_deltas``: owner, token, height, delta; a contract's own token is left out.
    Outputs are read once, and rows are dealt by holder, so that balances are summed up where the changes are.
    """
    made = F.struct(F.col("created_height").alias("height"), F.col("amount").cast(DEC).alias("delta"))
    gone = F.struct(F.col("spent_height").alias("height"), (-F.col("amount")).cast(DEC).alias("delta"))
    moves = F.explode(F.when(F.col("spent_height").isNotNull(), F.array(made, gone)).otherwise(F.array(made))).alias("m")
    u = outputs.select("token", "address", moves).select(
        "token", F.lit("address").alias("holder_type"), F.col("address").cast("string").alias("holder_id"), "m.height", "m.delta")
    if contract_deltas is not None:
        # few contracts hold most rows: they are summed up before they are dealt
        c = contract_deltas.filter(F.col("owner") != F.col("token")).groupBy("token", "owner", "height").agg(total("delta").alias("delta"))
        u = u.unionByName(c.select("token", F.lit("contract").alias("holder_type"), F.col("owner").cast("string").alias("holder_id"), "height", "delta"))
    k = ["token", "holder_type", "holder_id", "height"]
    return spread(u, "token", "holder_id").groupBy(*k).agg(total("delta").alias("delta")).filter(F.col("delta") != 0)


def holder_balances(deltas: DataFrame, height: int | None = None) -> DataFrame:
    """Balance per token and holder at a height (latest if none); zeros drop out."""
    d = deltas if height is None else deltas.filter(F.col("height") <= height)
    return d.groupBy("token", "holder_type", "holder_id").agg(total("delta").alias("amount")).filter(F.col("amount") != 0)


def balance_history(deltas: DataFrame) -> DataFrame:
    """Balance of every holder after each height it changed at."""
    per = spread(deltas, "token", "holder_type", "holder_id").groupBy("token", "holder_type", "holder_id", "height").agg(total("delta").alias("delta"))
    w = Window.partitionBy("token", "holder_type", "holder_id").orderBy("height").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("amount", F.sum("delta").over(w).cast(DEC))


def balance_violations(deltas: DataFrame) -> DataFrame:
    """Holders whose balance was ever below zero: first such height, lowest balance, number of heights, and the balance in the end.

    Balances themselves go on, so that one broken key holds up no others; a caller that must stop counts these rows.
    """
    below = F.col("amount") < 0
    g = balance_history(deltas).groupBy("token", "holder_type", "holder_id").agg(
        F.min(F.when(below, F.col("height"))).alias("first_height"), F.min("amount").alias("lowest"),
        F.count_if(below).alias("heights"), F.max_by("amount", "height").alias("amount"))
    return g.filter(F.col("heights") > 0)


def holder_sort_key() -> Column:
    """Order among equal amounts: addresses by text, contracts zero-padded."""
    return F.when(F.col("holder_type") == "address", F.concat(F.lit("addr:"), F.col("holder_id"))) \
        .otherwise(F.concat(F.lit("contract:"), F.lpad("holder_id", 20, "0")))


def with_authority(balances: DataFrame, authority: DataFrame) -> DataFrame:
    """Replace contracts' own-token rows by authoritative values; 0 removes the row.
    ``authority``: token, amount."""
    a = authority.select("token", F.col("amount").alias("__auth"))
    own = (F.col("holder_type") == "contract") & (F.col("holder_id") == F.col("token").cast("string"))
    kept = balances.join(a.withColumn("__has", F.lit(True)), "token", "left").filter(~(own & F.coalesce("__has", F.lit(False)))) \
        .drop("__auth", "__has")
    new = authority.filter(F.col("amount") != 0).select(
        "token", F.lit("contract").alias("holder_type"), F.col("token").cast("string").alias("holder_id"), "amount")
    return kept.unionByName(new)


def holders(balances: DataFrame, limit: int = 50, offset: int = 0, token=None) -> DataFrame:
    """Holders by amount with rank, holder count, supply and share of supply (bp of a percent)."""
    b = balances.filter(F.col("amount") > 0)
    if token is not None:
        b = b.filter(F.col("token") == token)
    sums = b.groupBy("token").agg(F.count(F.lit(1)).alias("total"), total("amount").alias("supply"))
    top = top_per_key(b.withColumn("__k", holder_sort_key()), ["token"], [F.desc("amount"), F.asc("__k")], limit, offset, "rank")
    j = top.drop("__k").join(sums, "token")
    share = ((F.col("amount") * big(1000000) - (F.col("amount") * big(1000000)) % F.col("supply")) / F.col("supply")).cast("bigint")
    return j.withColumn("percent_bp", share)


def holder_counts(balances: DataFrame, creations: DataFrame | None = None) -> DataFrame:
    """Holders with a positive balance per token; 0 for tokens never held."""
    c = balances.filter(F.col("amount") > 0).groupBy("token").agg(F.count(F.lit(1)).alias("holders"))
    if creations is None:
        return c
    return creations.select("token").distinct().join(c, "token", "left").withColumn("holders", F.coalesce("holders", F.lit(0)).cast("bigint"))


def supply_by_height(deltas: DataFrame) -> DataFrame:
    """Circulating supply after each height at which it changed."""
    d = deltas.groupBy("token", "height").agg(total("delta").alias("delta")).filter(F.col("delta") != 0)
    w = Window.partitionBy("token").orderBy("height").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("supply", F.sum("delta").over(w).cast(DEC)).drop("delta")


def total_minted(mints: DataFrame) -> DataFrame:
    """Cumulative minted amount per token and height.  ``mints``: token, height, amount."""
    d = mints.groupBy("token", "height").agg(total("amount").alias("minted"))
    w = Window.partitionBy("token").orderBy("height").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("total_minted", F.sum("minted").over(w).cast(DEC))


def address_balances(deltas: DataFrame, address=None, height: int | None = None) -> DataFrame:
    d = deltas.filter(F.col("holder_type") == "address")
    if address is not None:
        d = d.filter(F.col("holder_id") == str(address))
    return holder_balances(d, height).select(F.col("holder_id").alias("address"), "token", "amount")


def contract_balance_history(deltas: DataFrame) -> DataFrame:
    """Contract holdings after each block; a block's net change clamps at zero.
    ``deltas``: owner, token, height, delta."""
    per = deltas.groupBy("owner", "token", "height").agg(total("delta").alias("delta"))
    return clamped_sums(per, ["owner", "token"], [F.col("height")], height_chunk("height", 100_000),
                        {"amount": (F.col("delta"), big(0))})


def contract_balances(history: DataFrame) -> DataFrame:
    """Latest non-zero holdings."""
    return history.groupBy("owner", "token").agg(F.max_by("amount", "height").alias("amount")).filter(F.col("amount") != 0)


def contract_balance_at(history: DataFrame, height: int) -> DataFrame:
    """Holdings at a height and the height each value dates from."""
    return history.filter(F.col("height") <= height).groupBy("owner", "token").agg(
        F.max_by("amount", "height").alias("amount"), F.max("height").alias("resolved_height"))


# ---------------------------------------------------------------- flows

def transfer_volume(outputs: DataFrame) -> DataFrame:
    """Amount moved per token and address.  A transaction's output total of a token
    counts in full for every address on either side of it, once each."""
    per_tx = spread(outputs.select("tx_id", "token", "amount"), "tx_id", "token").groupBy("tx_id", "token").agg(total("amount").alias("amount"))
    receivers = outputs.select("tx_id", "token", "address")
    senders = outputs.filter(F.col("spent_by").isNotNull()).select(F.col("spent_by").alias("tx_id"), "token", "address")
    parties = spread(receivers.unionByName(senders), "tx_id", "token").distinct()
    return parties.join(per_tx, ["tx_id", "token"]).groupBy("token", "address").agg(total("amount").alias("volume"))


def total_received(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("token", "address").agg(total("amount").alias("received"))


def ranked_by_amount(df: DataFrame, column: str, limit: int, offset: int = 0) -> DataFrame:
    return top_per_key(df, ["token"], [F.desc(column), F.asc("address")], limit, offset)


def address_activity(volume: DataFrame, received: DataFrame) -> DataFrame:
    j = volume.join(spread(received, "token", "address"), ["token", "address"], "full_outer")
    return j.select("address", "token", F.coalesce("volume", big(0)).alias("volume"), F.coalesce("received", big(0)).alias("received"))


def balance_log(deltas: DataFrame, limit: int = 50, offset: int = 0, owner=None, per_token: bool = False) -> DataFrame:
    """Newest-first transaction log per contract with its outflow, one entry per
    (owner, transaction), or per (owner, token, transaction)."""
    d = deltas if owner is None else deltas.filter(F.col("owner") == owner)
    keys = ["owner", "token"] if per_token else ["owner"]
    t = d.groupBy("owner", "token", "height", "seq", "tx_id").agg(total("delta").alias("delta")).filter(F.col("delta") != 0)
    if not per_token:
        entry = F.concat(F.col("token").cast("string"), F.lit("="), F.col("delta").cast("string"))
        t = t.groupBy("owner", "height", "seq", "tx_id").agg(
            F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("outflow"))
    return top_per_key(t, keys, [F.desc("height"), F.desc("seq")], limit, offset)


def balance_log_after(deltas: DataFrame, cursors: DataFrame, limit: int = 100) -> DataFrame:
    """Next ``limit`` log entries of each owner that lie before its cursor, newest first.  ``cursors``: owner, height, seq of the last entry seen.

    ``has_more`` tells whether entries are left; if so, ``next_height`` and ``next_seq`` of an owner's rows are its next cursor.  Entries past the
    cursor are dropped before they are grouped, and an owner sends at most ``limit + 1`` of them per map task.
    """
    at = cursors.select("owner", F.struct(F.col("height").cast("bigint").alias("height"), F.col("seq").cast("bigint").alias("seq")).alias("__at"))
    d = deltas.join(at, "owner").filter(F.struct(F.col("height").cast("bigint").alias("height"), F.col("seq").cast("bigint").alias("seq")) < F.col("__at")).drop("__at")
    rows = balance_log(d, limit + 1)
    own = Window.partitionBy("owner")
    rows = rows.withColumn("has_more", F.max("position").over(own) > limit).filter(F.col("position") <= limit)
    last = F.max(F.struct("position", "height", "seq")).over(own)
    return rows.withColumns({f"next_{c}": F.when(F.col("has_more"), last[c]) for c in ("height", "seq")})


def tx_summary(deltas: DataFrame, traces: DataFrame) -> DataFrame:
    """Outflow entries and trace count per transaction."""
    o = deltas.groupBy("tx_id", "height").agg(F.count(F.lit(1)).alias("outflows"))
    n = traces.groupBy("tx_id").agg(F.count(F.lit(1)).alias("traces"))
    return o.join(n, "tx_id", "full_outer").select(
        "tx_id", "height", F.coalesce("outflows", F.lit(0)).cast("bigint").alias("outflows"),
        F.coalesce("traces", F.lit(0)).cast("bigint").alias("traces"))


def block_txs(txs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Protocol transactions of each block in order."""
    return top_per_key(txs, ["height"], [F.asc("tx_idx")], limit, offset)


def latest_traced(txs: DataFrame, n: int = 20) -> DataFrame:
    return page(txs, [F.desc("height"), F.desc("tx_idx")], n, total=False)


def address_index(outs: DataFrame, ins: DataFrame, protocol: DataFrame | None = None) -> DataFrame:
    """(address, tx_id, height): transactions by the owners of their inputs and of their outputs, once each; a data-only output has no owner.

    ``outs``: tx_id, address, height, is_data; ``ins``: tx_id, address, height.  ``protocol`` (tx_id) keeps only the transactions it names.
    """
    both = outs.filter(~F.coalesce("is_data", F.lit(False))).select("address", "tx_id", "height").unionByName(ins.select("address", "tx_id", "height"))
    if protocol is not None:
        both = both.join(protocol.select("tx_id").distinct(), "tx_id", "left_semi")
    return both.filter(F.col("address").isNotNull()).groupBy("address", "tx_id").agg(F.max("height").alias("height"))


def indexed_txs(index: DataFrame, pending: DataFrame, tip: int | Column, limit: int, offset: int = 0) -> DataFrame:
    """Transactions per address: pending ones first, then confirmed newest first.
    ``pending``: address, tx_id; a pending transaction is not listed again."""
    p = pending.select("address", "tx_id").distinct()
    u = index.join(p, ["address", "tx_id"], "left_anti").withColumn("is_pending", F.lit(False)) \
        .unionByName(p.withColumn("height", F.lit(None).cast("bigint")).withColumn("is_pending", F.lit(True)))
    order = [F.desc("is_pending"), F.desc("height"), F.desc("tx_id")]
    return top_per_key(u, ["address"], order, limit, offset).withColumn("confirmations", F.lit(tip) - F.col("height") + 1)


def address_txs(outputs: DataFrame, pending: DataFrame, tip: int | Column, limit: int, offset: int = 0) -> DataFrame:
    """Transactions per address from token outputs and their spends."""
    made = outputs.select("address", "tx_id", F.col("created_height").alias("height"), F.lit(False).alias("is_data"))
    spent = outputs.filter(F.col("spent_by").isNotNull()).select(
        "address", F.col("spent_by").alias("tx_id"), F.col("spent_height").alias("height"))
    return indexed_txs(address_index(made, spent), pending, tip, limit, offset)


# ---------------------------------------------------------------- checks

def reconcile(local: DataFrame, authority: DataFrame, changed: DataFrame) -> DataFrame:
    """Balances of changed (owner, token) pairs that differ from the authority or are
    negative, with the transactions that changed the pair.  Missing counts as 0."""
    k = ["owner", "token"]
    txs = changed.groupBy(*k).agg(F.count_distinct("tx_id").alias("tx_count"), F.max("tx_id").alias("last_tx"))
    l = local.select(*k, F.col("amount").alias("local"))
    a = authority.select(*k, F.col("amount").alias("authority"))
    j = l.join(a, k, "full_outer").join(txs, k)
    j = j.withColumn("local", F.coalesce("local", big(0))).withColumn("authority", F.coalesce("authority", big(0)))
    return j.filter((F.col("local") != F.col("authority")) | (F.col("local") < 0))


def mismatch_origin(local: DataFrame, authority: DataFrame) -> DataFrame:
    """First height at which two balance histories part for good, per (owner, token).

    Both step functions are put on their common change points; the origin is the
    change point after the last agreement.  ``exact`` tells whether an agreement
    exists before it.
    """
    k = ["owner", "token"]
    u = local.select(*k, "height", F.col("amount").alias("l"), F.lit(None).cast(DEC).alias("a")).unionByName(
        authority.select(*k, "height", F.lit(None).cast(DEC).alias("l"), F.col("amount").alias("a")))
    p = u.groupBy(*k, "height").agg(F.max("l").alias("l"), F.max("a").alias("a"))
    w = Window.partitionBy(*k).orderBy("height").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("l", F.coalesce(F.last("l", ignorenulls=True).over(w), big(0))) \
        .withColumn("a", F.coalesce(F.last("a", ignorenulls=True).over(w), big(0)))
    same = F.col("l") == F.col("a")
    g = p.withColumn("next_height", F.lead("height").over(Window.partitionBy(*k).orderBy("height"))).groupBy(*k).agg(
        F.max_by(same, "height").alias("ends_equal"), F.max(F.when(same, F.col("next_height"))).alias("after"),
        F.min("height").alias("first"))
    return g.filter(~F.col("ends_equal")).select(*k, F.coalesce("after", "first").alias("origin_height"),
                                                 F.col("after").isNotNull().alias("exact"))


def tx_fees(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Fee per transaction: inputs minus outputs; null if a previous output is unknown
    or the result negative.  ``outputs``: tx_id, outpoint, value; ``inputs``: tx_id, outpoint."""
    prev = outputs.select("outpoint", F.col("value").alias("prev_value"))
    i = inputs.join(spread(prev, "outpoint"), "outpoint", "left").groupBy("tx_id").agg(
        total("prev_value").alias("value_in"), F.count_if(F.col("prev_value").isNull()).alias("missing"))
    o = spread(outputs.groupBy("tx_id").agg(total("value").alias("value_out")), "tx_id")
    fee = F.col("value_in") - F.col("value_out")
    return o.join(i, "tx_id", "left").select(
        "tx_id", F.when((F.col("missing") == 0) & (fee >= 0), fee).cast(DEC).alias("fee"))


def fee_rates(fees: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fees with the fee per virtual byte; null without a fee or a size.  ``sizes``: tx_id, vsize."""
    rate = F.when(F.col("vsize") > 0, F.col("fee").cast("double") / F.col("vsize"))
    return fees.join(sizes, "tx_id", "left").select("tx_id", "fee", "vsize", rate.alias("fee_rate"))


def block_fees(fees: DataFrame, txs: DataFrame) -> DataFrame:
    """Average fee of each block over its transactions with a known fee, rounded down; null if it has none.  ``txs``: tx_id, height."""
    g = txs.join(fees, "tx_id", "left").groupBy("height").agg(total("fee").alias("fees"), F.count("fee").alias("n"))
    return g.select("height", F.when(F.col("n") > 0, div_floor(F.col("fees"), F.col("n").cast(DEC))).alias("avg_fee"), "n")


def sample_series(metric: DataFrame, keys: Sequence[str], value: str, lo: int, hi: int | None, step: int) -> DataFrame:
    """A step metric at heights lo, lo+step, … and always hi; 0 before its first value.  Without ``hi`` it ends at the last height of all.

    Each stored value covers the heights up to the next change, so the samples inside
    that span are generated beside it; no range join.
    """
    w = Window.partitionBy(*keys).orderBy("height")
    end = metric.agg(F.max("height").cast("bigint").alias("hi")).scalar() if hi is None else F.lit(hi).cast("bigint")
    hi = F.col("__hi")
    m = metric.select(*keys, "height", value).withColumn("__hi", end).filter(F.col("height") <= hi)
    m = m.withColumn("__to", F.coalesce(F.lead("height").over(w) - 1, hi))
    start = metric.select(*keys).distinct().withColumn("__hi", end)
    first = F.greatest(F.col("height"), F.lit(lo))
    k0 = F.ceil((first - lo) / step).cast("bigint")
    k1 = F.floor((F.col("__to") - lo) / step).cast("bigint")
    grid = F.when((k1 >= k0) & (F.col("__to") >= lo), F.transform(F.sequence(k0, F.greatest(k0, k1)), lambda i: i * step + lo)).otherwise(F.array().cast("array<bigint>"))
    last = F.when((F.col("__to") >= hi) & ((hi - lo) % step != 0), F.array(hi)).otherwise(F.array().cast("array<bigint>"))
    hit = m.select(*keys, F.explode(F.concat(grid, last)).alias("sample_height"), F.col(value))
    heights = F.array_distinct(F.concat(F.sequence(F.lit(lo).cast("bigint"), hi, F.lit(step).cast("bigint")), F.array(hi)))
    every = start.withColumn("sample_height", F.explode(heights)).drop("__hi")
    return every.join(hit, [*keys, "sample_height"], "left").withColumn(value, F.coalesce(value, big(0)))


#: Blocks that a chart looks back and its step; no lookback starts at the first block.  Fixed values.
CHART_RANGES = {"1d": (144, 1), "1w": (1008, 7), "1m": (4320, 30), "all": (None, 500)}
CHART_NAMES = {"24h": "1d", "7d": "1w", "30d": "1m", "max": "all", "3m": "all", "90d": "all"}


def chart_series(metric: DataFrame, keys: Sequence[str], value: str, span: str, lo: int, hi: int) -> DataFrame:
    """A step metric sampled for a named range that ends at ``hi`` and starts at ``lo`` or later; unknown names show everything."""
    name = span.strip().lower()
    back, step = CHART_RANGES.get(CHART_NAMES.get(name, name), CHART_RANGES["all"])
    return sample_series(metric, keys, value, lo if back is None else max(hi - back, lo), hi, step)
