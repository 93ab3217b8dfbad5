"""Steps that read a large input once, however often their plan uses it, and still give the same rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, traces
from ledgerloom.plans.facts import Facts
from ledgerloom.plans.price_queries import pool_values_of, tvl_history_of

DEC = "decimal(38,0)"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def kept(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


def test_outputs_are_read_once(spark, tmp_path):
    o = kept(spark, tmp_path, [(1, 7, Decimal(5), 10, None), (1, 7, Decimal(3), 10, 12), (1, 8, Decimal(4), 11, 11), (2, 7, Decimal(6), None, 9), (1, None, Decimal(2), 10, None)],
             f"token bigint, address bigint, amount {DEC}, created_height bigint, spent_height bigint")
    c = spark.createDataFrame([(20, 1, 10, Decimal(9)), (20, 1, 10, Decimal(-2)), (20, 1, 11, Decimal(1)), (20, 1, 11, Decimal(-1)), (1, 1, 10, Decimal(4))],
                              f"owner bigint, token bigint, height bigint, delta {DEC}")
    d = ledger.holder_deltas(o, c)
    assert plan(d).count("Relation [") == 1  # two before
    rows = {(r.token, r.holder_type, r.holder_id, r.height, int(r.delta)) for r in d.collect()}
    assert rows == {(1, "address", "7", 10, 8), (1, "address", "7", 12, -3), (2, "address", "7", None, 6), (2, "address", "7", 9, -6),
                    (1, "address", None, 10, 2), (1, "contract", "20", 10, 7)}


def test_balances_need_no_further_exchange_of_changes(spark, tmp_path):
    o = kept(spark, tmp_path, [(1, 7, Decimal(5), 10, None), (1, 7, Decimal(3), 10, 12)],
             f"token bigint, address bigint, amount {DEC}, created_height bigint, spent_height bigint")
    c = spark.createDataFrame([(20, 1, 10, Decimal(9)), (20, 1, 11, Decimal(-2))], f"owner bigint, token bigint, height bigint, delta {DEC}")
    b = ledger.holder_balances(ledger.holder_deltas(o, c))
    assert b._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # one of them for the sums of contracts
    assert {(r.holder_id, int(r.amount)) for r in b.collect()} == {("7", 5), ("20", 7)}
    a = ledger.address_balances(ledger.holder_deltas(o, c))
    assert a._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


FRAME = ("trace_id bigint, height bigint, tx_idx bigint, start bigint, owner bigint, inputs array<decimal(38,0)>, "
         "storage array<struct<key:string,value:string>>")


def test_frames_are_read_once(spark, tmp_path):
    keys = [(traces.BASE_KEY, "100"), (traces.QUOTE_KEY, "1")]
    one, none = [Decimal(traces.FACTORY_CREATE_OPCODE)], []
    frames = kept(spark, tmp_path, [
        (1, 5, 0, 0, 50, one, None), (1, 5, 0, 1, 51, one, None), (1, 5, 0, 2, 900, none, keys),     # the later of two factories
        (1, 5, 0, 3, 52, one, None),                                                                 # called after the pool was made
        (2, 5, 1, 0, 50, none, None), (2, 5, 1, 1, 901, none, [*keys, (traces.FACTORY_KEY, "52")]),   # no create call: the factory it writes
        (3, 6, 0, 0, 77, one, None), (3, 6, 0, 1, 902, none, keys),                                  # not a known factory
        (4, 6, 1, 0, 50, one, None), (4, 6, 1, 1, 903, none, keys),                                  # not created there
        (5, 7, 0, 0, 50, one, None), (5, 7, 0, 1, 900, none, keys)], FRAME)                          # found before
    made = spark.createDataFrame([("create", 5, 0, 900), ("create", 5, 1, 901), ("create", 6, 0, 902), ("create", 7, 0, 900)],
                                 "event string, height bigint, tx_idx bigint, created bigint")
    known = spark.createDataFrame([(50,), (51,), (52,), (50,)], "factory bigint")
    found = traces.discover_pools(made, frames, known)
    assert plan(found).count("Relation [") == 1  # two before
    assert {tuple(r) for r in found.collect()} == {(900, 100, 1, 51, 5, 0), (901, 100, 1, 52, 5, 1)}


@pytest.mark.parametrize("name", ["values", "history", "balances"])
def test_events_are_parsed_once(spark, sf, name):
    t = Facts(spark, sf)
    df = {"values": pool_values_of, "history": lambda t: (pool_values_of(t), tvl_history_of(t))[1], "balances": lambda t: t.balances}[name](t)
    assert not any("/events.parquet" in f for f in df.inputFiles())  # read and parsed anew by each step before
    assert "get_json_object" not in plan(df)


def test_reserves_are_kept(spark, sf):
    t = Facts(spark, sf)
    before = t.reserves
    pool_values_of(t)
    pool_values_of(t)
    assert "Window" in plan(before) and "Window" not in plan(t.reserves) and t.reserves.columns == before.columns
    assert before.exceptAll(t.reserves).count() == 0 and t.reserves.exceptAll(before).count() == 0
    assert "Window" not in plan(t.supply.join(t.btc, F.lit(True)))


@pytest.mark.parametrize("name", ["lp_positions", "factory_positions"])
def test_balances_are_not_dealt_by_token(spark, sf, name):
    from ledgerloom.plans import view_queries
    executed = getattr(view_queries, name)(Facts(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [token" not in executed and "Exchange hashpartitioning(token#" in executed  # a join of all balances by their few tokens before
