"""Plans against their SQL on the smallest tables.  ALL_PLANS=1 checks every plan."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries

QUICK = """candles_10m candles_rollup candles_filled pool_flow running_reserves activity_counts swap_history btc_price_asof nearest_price
token_usd_candles holder_balances holders_page supply_by_height transfer_volume balance_line_chart mismatch_origin contract_metadata
proxy_target series_ids search_prefixes call_frames trace_deltas mint_deltas trace_nets swap_reserves route_exact_in unwrap_totals
dedupe_last_op canonical_chain mempool_prune number_formats allocate_edicts""".split()


@pytest.mark.parametrize("name", sorted(queries()) if os.environ.get("ALL_PLANS") else QUICK)
def test_plan_matches_sql(spark, con, sf, name):
    from compare import compare
    ok, message = compare(spark, con, sf, name, queries()[name], oracle_sql().get(name))
    assert ok, message


def test_every_sql_belongs_to_a_plan():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    from __spark_entry__ import entry
    assert entry(spark).limit(1).count() == 1
