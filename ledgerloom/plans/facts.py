"""Fact tables derived from the star-schema parquet files.

Each property is a lazy adapter: it maps rows of one file to the fact table an
operator expects, with no row filter beyond the row kind.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exact import DEC, big
from ..session import stage

EPOCH = 1704067200
NOW = EPOCH + 30 * 86400
TIP = 30 * 144 - 1


class Facts:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._kept = spark, sf_dir, False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ------------------------------------------------------------ events
    @cached_property
    def ev(self) -> DataFrame:
        """Events with typed columns as a staged table: most plans read them several times, and a column made from ``k`` would parse the text at each use."""
        ts = F.unix_seconds(F.col("ts").cast("timestamp"))
        k = F.get_json_object("props", "$.k").cast("int")
        return stage(self.table("events").select(
            "event_id", ts.alias("ts"), F.floor((ts - EPOCH) / 600).cast("bigint").alias("height"),
            (k % 24).alias("pool_id"), k.alias("k"), "user_id", "event_type",
            (F.col("value").cast("decimal(18,2)") * 100).cast("bigint").alias("cents")))

    @cached_property
    def flow(self) -> DataFrame:
        c = F.col("cents").cast(DEC)
        base = (c * big(1000000)).cast(DEC)
        quote = (c * big(10000) * (F.lit(45) + F.col("pool_id") * 7 + F.col("event_id") % 11).cast(DEC)).cast(DEC)
        t = F.col("event_type")
        bs = F.when(t.isin("view", "error"), -1).otherwise(1)
        qs = F.when(t.isin("click", "error"), -1).otherwise(1)
        return self.ev.filter(t != "signup").select(
            "pool_id", "height", "ts", F.col("event_id").alias("seq"), F.col("event_id").alias("tx_id"),
            F.col("user_id").alias("address"), (F.col("event_id") % 7 != 0).alias("success"),
            (base * bs).cast(DEC).alias("base_delta"), (quote * qs).cast(DEC).alias("quote_delta"))

    @cached_property
    def flow_legs(self) -> DataFrame:
        """The pool flow as signed (owner, token) legs."""
        f = self.flow.join(self.pools.select("pool_id", "base_id", "quote_id"), "pool_id")
        leg = F.explode(F.array(F.struct(F.col("base_id").alias("token"), F.col("base_delta").alias("delta")),
                                F.struct(F.col("quote_id").alias("token"), F.col("quote_delta").alias("delta")))).alias("l")
        return f.select(F.col("pool_id").alias("owner"), "height", "ts", "seq", "tx_id", "address", "success", leg) \
            .select("owner", "height", "ts", "seq", "tx_id", "address", "success", "l.*")

    @cached_property
    def pools(self) -> DataFrame:
        """Pools as a staged table: a few rows out of all events, joined often."""
        p = F.col("pool_id")
        half = F.floor(p / 2).cast("int")
        base = F.when(p < 20, half + 100).when(p == 20, 1).otherwise(p + 80)
        quote = F.when((p < 20) & (p % 2 == 0), 1).when(p <= 20, 2).otherwise(100)
        small = p >= 21
        return stage(self.ev.select("pool_id").distinct().select(
            "pool_id", base.cast("bigint").alias("base_id"), quote.cast("bigint").alias("quote_id"),
            (p % 3).cast("bigint").alias("factory_id"),
            F.when(small, big(10**10)).otherwise(big(10**12)).alias("base_initial"),
            F.when(small, (big(10**8) * (p * 7 + 50).cast(DEC)).cast(DEC))
            .otherwise((big(10**10) * (p * 7 + 50).cast(DEC)).cast(DEC)).alias("quote_initial")))

    @cached_property
    def initial(self) -> DataFrame:
        return self.pools.select("pool_id", "base_initial", "quote_initial")

    @cached_property
    def activity(self) -> DataFrame:
        from ..operators.amm import classify_activity
        return classify_activity(self.flow)

    @cached_property
    def reserves(self) -> DataFrame:
        from ..operators.amm import running_reserves
        return running_reserves(self.flow, self.initial)

    def keep_reserves(self) -> None:
        """Stage the reserves and the BTC prices, for plans that read them several times; to be called before anything is derived from them."""
        if not self._kept:
            self.reserves, self.btc, self._kept = stage(self.reserves), stage(self.btc), True

    @cached_property
    def trades(self) -> DataFrame:
        from ..operators.amm import trade_prices
        return trade_prices(self.reserves)

    @cached_property
    def m10_plan(self) -> DataFrame:
        from ..operators.amm import candles
        return candles(self.trades)

    @cached_property
    def m10(self) -> DataFrame:
        """Ten-minute candles as a staged table: far smaller than the trades, read often."""
        return stage(self.m10_plan)

    @cached_property
    def btc(self) -> DataFrame:
        """BTC/USD by height: the last price event of each block."""
        return self.ev.filter(F.col("event_type") == "signup").groupBy("height").agg(
            F.max_by("cents", "event_id").alias("c")).select(
            "height", (F.col("height") * 600 + EPOCH).alias("ts"),
            ((F.col("c") + 40000).cast(DEC) * big(10**16)).cast(DEC).alias("price"))

    @cached_property
    def quotes(self) -> DataFrame:
        """Canonical quote units found among the pools."""
        return self.pools.filter(F.col("quote_id").isin(1, 2)).select("quote_id").distinct() \
            .withColumn("unit", F.when(F.col("quote_id") == 1, "btc").otherwise("usd"))

    @cached_property
    def derived_quotes(self) -> DataFrame:
        return self.pools.filter(~F.col("quote_id").isin(1, 2)).select("quote_id").distinct() \
            .withColumn("strategy", F.lit("neutral"))

    @cached_property
    def canonical(self) -> DataFrame:
        from ..operators.prices import canonical_pools
        return canonical_pools(self.pools, self.quotes)

    @cached_property
    def token_usd(self) -> DataFrame:
        from ..operators.prices import token_usd_candles
        return stage(token_usd_candles(self.m10, self.canonical, self.btc))

    # ------------------------------------------------------------ lineitem / orders
    @cached_property
    def outputs(self) -> DataFrame:
        """Token outputs: one row per (outpoint, token)."""
        li = self.table("lineitem").join(
            self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")
        key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                          F.date_format("l_shipdate", "yyyyMMdd"),
                          (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint"))
        spent = F.col("l_returnflag") == "R"
        return li.select(
            F.col("l_orderkey").alias("tx_id"), key.alias("outpoint"), (F.col("l_suppkey") % 10 + 100).alias("token"),
            F.col("o_custkey").alias("address"),
            (F.col("l_quantity").cast("bigint").cast(DEC) * big(10**8)).cast(DEC).alias("amount"),
            day.alias("created_height"), F.when(spent, day + 30).alias("spent_height"),
            F.when(spent, F.col("l_orderkey") + 1000000000).alias("spent_by"))

    @cached_property
    def supply(self) -> DataFrame:
        """Supply as a staged table: one row per token out of all outputs, joined to tokens, metrics and pools."""
        return stage(self.outputs.filter(F.col("spent_height").isNull()).groupBy("token")
                     .agg(F.sum("amount").cast(DEC).alias("supply")))

    # ------------------------------------------------------------ part
    @cached_property
    def creations(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("token"), F.array("p_name").alias("names"), F.array("p_brand").alias("symbols"),
            F.col("p_size").cast(DEC).alias("cap"),
            (F.col("p_retailprice").cast("decimal(18,2)") * 100).cast(DEC).alias("mint_amount"),
            F.col("p_partkey").alias("creation_height"), (F.col("p_size") % 5).cast("bigint").alias("template"))

    @cached_property
    def contract_deltas(self) -> DataFrame:
        return self.flow_legs.select("owner", "token", "height", "seq", "tx_id", "delta")

    @cached_property
    def deltas(self) -> DataFrame:
        from ..operators.ledger import holder_deltas
        return holder_deltas(self.outputs, self.contract_deltas)

    @cached_property
    def balances(self) -> DataFrame:
        from ..operators.ledger import holder_balances
        return holder_balances(self.deltas)

    @cached_property
    def holder_counts(self) -> DataFrame:
        from ..operators.ledger import holder_counts
        return holder_counts(self.balances)

    @cached_property
    def mempool(self) -> DataFrame:
        rate = F.col("cents").cast("decimal(18,0)") / (F.col("k") + 1)
        return self.ev.select(F.col("event_id").alias("txid"), F.col("ts").alias("first_seen"), F.col("user_id").alias("address"),
                              F.floor(rate).cast("bigint").alias("fee_rate"), (F.col("event_type") == "purchase").alias("confirmed"))

    @cached_property
    def writes(self) -> DataFrame:
        """Storage writes: contract state keyed by a small set of names."""
        names = F.array(*[F.lit(x) for x in ("/name", "/symbol", "/cap", "/value-per-mint", "/other")])
        key = F.element_at(names, F.col("k") % 5 + 1)
        text = F.when(F.col("k") % 5 < 2, F.concat(F.lit("n"), (F.col("cents") % 7).cast("string"))) \
            .otherwise(F.col("cents").cast("string"))
        return self.ev.select(F.col("user_id").alias("contract"), key.alias("key"), text.alias("value"),
                              "height", F.col("event_id").alias("tx_idx"), F.lit(0).cast("bigint").alias("ev_idx"),
                              F.col("height").alias("txid"))

    @cached_property
    def contracts(self) -> DataFrame:
        """Contracts with the transaction (here: block) that created them."""
        return self.ev.groupBy(F.col("user_id").alias("contract")).agg(F.min("height").alias("txid"))
