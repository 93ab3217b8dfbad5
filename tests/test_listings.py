"""Pages, cursors, searches and histories on small fixtures."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, metrics, prices, views

CANDLES = "token bigint, bucket_ts bigint, open decimal(38,0), high decimal(38,0), low decimal(38,0), close decimal(38,0), volume decimal(38,0)"


def candles_df(spark):
    rows = [(1, 600, 10, 12, 9, 11), (1, 1200, 11, 15, 11, 14), (1, 6000, 13, 13, 8, 9), (2, 4800, 5, 7, 5, 6)]
    return spark.createDataFrame([(t, b, *map(Decimal, v), Decimal(1)) for t, b, *v in rows], CANDLES)


def key(r):
    return r.token, r.tf, r.position


def test_pages_of_candles_make_up_the_whole_series(spark):
    c = candles_df(spark)
    frames = {"10m": 600, "1h": 3600}
    whole = sorted(prices.candle_pages(c, ["token"], 9000, 100, 0, frames).collect(), key=key)
    parts = [r for k in range(0, 18, 6) for r in prices.candle_pages(c, ["token"], 9000, 6, k, frames).collect()]
    assert sorted(parts, key=key) == whole
    dense = [r for r in whole if r.token == 1 and r.tf == "10m"]
    assert [r.bucket_ts for r in dense] == list(range(9000, 0, -600)) and {r.total for r in whole if r.token == 1 and r.tf == "10m"} == {15}
    at = {r.bucket_ts: r for r in dense}
    assert [int(at[3000][f]) for f in ("open", "high", "low", "close", "volume")] == [14, 14, 14, 14, 0]
    assert [int(at[6000][f]) for f in ("open", "high", "low", "close")] == [14, 14, 8, 9]
    # the newest candle of every timeframe closes at the last ten-minute close
    assert {int(r.close) for r in whole if r.token == 1 and r.position == 1} == {9}


def test_sats_open_at_the_close_before_at_its_own_price(spark):
    c = candles_df(spark).withColumns({f: (F.col(f) * Decimal(10**16)).cast("decimal(38,0)") for f in ("open", "high", "low", "close", "volume")})
    btc = spark.createDataFrame([(1200, 2, Decimal(2 * 10**16)), (6000, 10, Decimal(4 * 10**16))], "ts bigint, height bigint, price decimal(38,0)")
    rows = {(r.token, r.bucket_ts): r for r in prices.candle_pages(c, ["token"], 6000, 50, 0, {"10m": 600}, btc).collect()}
    one = 10**24
    # before the price line its first price counts
    assert int(rows[1, 600].close) == 11 * one // 2
    assert int(rows[1, 6000].open) == 14 * one // 2 and int(rows[1, 6000].close) == 9 * one // 4 and int(rows[1, 6000].high) == 14 * one // 2


def test_no_candles_no_pages(spark):
    assert prices.candle_pages(candles_df(spark).limit(0), ["token"], 9000).count() == 0


def test_cursor_walks_the_whole_log(spark):
    rows = [(o, t, h, h * 10 + o, h * 100 + t, Decimal(t - 2)) for o in (1, 2) for h in range(9) for t in (1, 2, 3)]
    d = spark.createDataFrame(rows, "owner bigint, token bigint, height bigint, seq bigint, tx_id bigint, delta decimal(38,0)")
    whole = {(r.owner, r.height, r.tx_id) for r in ledger.balance_log(d, 100).collect()}
    at, seen = [(1, 99, 0), (2, 99, 0), (3, 99, 0)], []
    while at:
        page = ledger.balance_log_after(d, spark.createDataFrame(at, "owner bigint, height bigint, seq bigint"), 4).collect()
        seen += [(r.owner, r.height, r.tx_id) for r in page]
        at = list({(r.owner, r.next_height, r.next_seq) for r in page if r.has_more})
    assert len(seen) == len(set(seen)) and set(seen) == whole


def test_violations_name_the_first_height(spark):
    d = spark.createDataFrame([(1, "address", "a", h, Decimal(v)) for h, v in ((1, 5), (4, -7), (6, 3), (9, -2))] + [(1, "address", "b", 1, Decimal(2))],
                              "token bigint, holder_type string, holder_id string, height bigint, delta decimal(38,0)")
    (r,) = ledger.balance_violations(d).collect()
    assert (r.holder_id, r.first_height, int(r.lowest), r.heights, int(r.amount)) == ("a", 4, -2, 2, -1)


def test_index_of_addresses(spark):
    outs = spark.createDataFrame([(1, "a", 10, False), (1, "b", 10, True), (2, "a", 11, None), (3, None, 12, False)], "tx_id bigint, address string, height bigint, is_data boolean")
    ins = spark.createDataFrame([(2, "b", 11), (3, "b", 12)], "tx_id bigint, address string, height bigint")
    rows = lambda protocol: {(r.address, r.tx_id) for r in ledger.address_index(outs, ins, protocol).collect()}
    assert rows(None) == {("a", 1), ("a", 2), ("b", 2), ("b", 3)}
    assert rows(spark.createDataFrame([(2,), (2,)], "tx_id bigint")) == {("a", 2), ("b", 2)}


@pytest.mark.parametrize("name, first, step", [("1D", 2856, 1), ("7d", 1992, 7), ("30d", 100, 30), ("90d", 100, 500), ("?", 100, 500)])
def test_chart_ranges(spark, name, first, step):
    m = spark.createDataFrame([(1, 50, Decimal(3)), (1, 2900, Decimal(8))], "token bigint, height bigint, supply decimal(38,0)")
    rows = {r.sample_height: int(r.supply) for r in ledger.chart_series(m, ["token"], "supply", name, 100, 3000).collect()}
    assert sorted(rows) == sorted({*range(first, 3001, step), 3000})
    assert all(v == (8 if h >= 2900 else 3) for h, v in rows.items())


def test_search_scans_only_if_the_index_has_nothing(spark):
    made = spark.createDataFrame([(1, ["Red fox"], ["RF"]), (2, ["blue"], ["redder"]), (3, [], [])], "token bigint, names array<string>, symbols array<string>")
    prefixes = spark.createDataFrame([(1, "red"), (2, "red")], "token bigint, prefix string")
    holders = spark.createDataFrame([(2, 9)], "token bigint, holders bigint")
    vol = spark.createDataFrame([(1, 100, 4)], "token bigint, quote bigint, volume bigint")
    found = lambda text, m=vol.drop("quote"), **k: [(r.token, r.scanned) for r in metrics.search_or_scan(prefixes, made, holders, m, text, "volume", **k).orderBy("position").collect()]
    assert found("red") == [(1, False), (2, False)]
    assert found(" RED", offset=1) == [(2, False)]
    assert found("re") == [(2, True), (1, True)]
    assert found("red fox") == [(1, True)]
    assert found("red", vol, quote=100) == [(1, False)] and found("re", vol, quote=100) == [(1, True)]
    assert found("red", vol, quote=7) == [] and found("zzz") == []


def test_positions_of_a_pool_without_shares_are_worth_nothing(spark):
    held = spark.createDataFrame([("a", 7, Decimal(5)), ("a", 8, Decimal(1))], "address string, token bigint, amount decimal(38,0)")
    cols = ["base_tvl_usd", "quote_tvl_usd", "base_tvl_sats", "quote_tvl_sats"]
    pools = spark.createDataFrame([(1, 2, 7, Decimal(0), *[Decimal(9)] * 4), (2, 2, 8, Decimal(3), *[Decimal(10)] * 4), (3, 5, 7, Decimal(1), *[Decimal(1)] * 4)],
                                  "pool_id bigint, factory_id bigint, lp_token bigint, lp_supply decimal(38,0), " + ", ".join(f"{c} decimal(38,0)" for c in cols))
    rows = views.factory_positions(held, pools, 2).orderBy("position").collect()
    assert [(r.pool_id, int(r.total_usd), int(r.total_sats), r.position) for r in rows] == [(2, 6, 6, 1), (1, 0, 0, 2)]
