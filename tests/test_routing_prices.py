"""Routes and derived series against brute force."""

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import prices, routing


def out(amount, ri, ro, fee=50):
    x = amount * (10000 - fee) // 10000
    return x * ro // (ri + x)


def graph(seed=2, n=12):
    r = random.Random(seed)
    pools = [(i, *r.sample(range(5), 2), r.randrange(10**6, 10**9), r.randrange(10**6, 10**9)) for i in range(n)]
    return [(p, a, b, x, y) for p, a, b, x, y in pools] + [(p, b, a, y, x) for p, a, b, x, y in pools]


def edges_df(spark, g):
    return spark.createDataFrame([(p, a, b, Decimal(x), Decimal(y)) for p, a, b, x, y in g],
                                 "pool_id bigint, token_in bigint, token_out bigint, r_in decimal(38,0), r_out decimal(38,0)")


def paths(g, source, target, hops):
    stack = [(source, (source,), ())]
    while stack:
        at, seen, legs = stack.pop()
        if at == target and legs:
            yield legs
            continue
        if len(legs) < hops:
            for e in g:
                if e[1] == at and e[2] not in seen:
                    stack.append((e[2], seen + (e[2],), legs + (e,)))


def test_best_routes_match_enumeration(spark):
    g = graph()
    reqs = [(i, a, b, 10**5 * (i + 1)) for i, (a, b) in enumerate(itertools.permutations(range(5), 2))]
    df = spark.createDataFrame([(i, a, b, Decimal(x)) for i, a, b, x in reqs], "request_id bigint, source bigint, target bigint, amount decimal(38,0)")
    got = {r.request_id: int(r.amount) for r in routing.best_route_exact_in(df, edges_df(spark, g)).collect()}
    for i, a, b, x in reqs:
        best = 0
        for legs in paths(g, a, b, 3):
            v = x
            for _, _, _, ri, ro in legs:
                v = out(v, ri, ro)
            best = max(best, v)
        assert got.get(i, 0) == best


def dealt_requests(spark, n=2000):
    """All in one partition, as a small file is read."""
    return spark.range(0, n, 1, 1).select(F.col("id").alias("request_id"), F.lit(0).cast("long").alias("source"), F.lit(1).cast("long").alias("target"), (F.col("id") + 10**5).cast("decimal(38,0)").alias("amount"))


def test_requests_of_one_file_are_dealt_out_exact_out(spark):
    g = graph()
    r = routing.best_route_exact_out(dealt_requests(spark), edges_df(spark, g)).withColumn("part", F.spark_partition_id())
    assert r.select("part").distinct().count() > 1
    for x in r.filter("request_id % 500 = 0").collect():
        least = None
        for legs in paths(g, 0, 1, 3):
            v = x.request_id + 10**5
            for _, _, _, ri, ro in reversed(legs):
                v = None if v is None or v >= ro else -(-(-(-v * ri // (ro - v))) * 10000 // 9950)
            least = v if least is None or v is not None and v < least else least
        assert int(x.amount) == least


def test_steps_in_workers_equal_columns(spark):
    """Small, wide, saturating and impossible steps."""
    r = random.Random(3)
    rows = [(Decimal(r.randrange(1, 10**a)), Decimal(r.randrange(1, 10**b)), Decimal(r.randrange(1, 10**c))) for a in (4, 18, 28, 37) for b in (4, 18, 28, 37) for c in (4, 18, 28, 37)]
    df = spark.createDataFrame(rows, "r_in decimal(38,0), r_out decimal(38,0), amount decimal(38,0)")
    both = routing.with_xyk_in(routing.with_xyk_out(df, "r_in", "r_out", "amount", "got"), "r_in", "r_out", "amount", "needed").collect()
    for x in both:
        a, b, c = int(x.r_in), int(x.r_out), int(x.amount)
        assert routing._step_out(a, b, c, 50) == int(x.got) and routing._step_in(a, b, c, 50) == int(x.needed or 0)


def test_arbitrage_profit_is_real(spark):
    g = graph(5)
    e = edges_df(spark, g)
    legs = {(p, a): (b, x, y) for p, a, b, x, y in g}
    rows = routing.arbitrage_cycles(e.select(F.col("token_in").alias("token")).distinct(), e).collect()
    assert rows
    for r in rows:
        at, v = r.token, int(r.amount_in)
        for p in map(int, r.cycle.split(">")):
            b, x, y = legs[p, at]
            at, v = b, out(v, x, y)
        assert at == r.token and v - int(r.amount_in) == int(r.profit) > 0


def test_best_inputs_equal_trying_all():
    """Random cycles of small pools: the best profit, and the smallest input that reaches it."""
    r = random.Random(1)
    for _ in range(400):
        legs = [(r.randrange(50, 3000), r.randrange(50, 3000)) for _ in range(r.choice([2, 2, 3, 4]))]
        pay, limit = r.choice([10000, 9950, 9000]), min(x for x, _ in legs) // 3
        best = max(((routing.cycle_output(legs, x, pay) - x, -x) for x in range(1, limit + 1)), default=(0, 0))
        assert routing.best_input(legs, limit, pay) == ((best[0], -best[1]) if best[0] > 0 else (0, 0))


def test_best_input_of_large_pools():
    """No input nearby is better, and none that is smaller is as good."""
    legs = [(3 * 10**11, 9 * 10**11), (8 * 10**11, 5 * 10**11)]
    profit, x = routing.best_input(legs, 10**11, 9950)
    got = lambda v: routing.cycle_output(legs, v, 9950) - v
    assert got(x) == profit and max(got(v) for v in range(x - 20000, x)) < profit and max(got(v) for v in range(x, x + 200_000)) <= profit


def test_hops_out_of_range_are_refused(spark):
    e = edges_df(spark, graph())
    pairs = spark.createDataFrame([(0, 1)], "source bigint, target bigint")
    for hops in (0, routing.MAX_HOPS + 1):
        with pytest.raises(ValueError):
            routing.path_index(pairs, e, hops)


@pytest.mark.parametrize("hops", [1, 2, 4, 5])
def test_path_index_equals_enumeration(spark, hops):
    g = graph(4)
    pairs = list(itertools.permutations(range(5), 2))
    rows = routing.path_index(spark.createDataFrame(pairs, "source bigint, target bigint"), edges_df(spark, g), hops).collect()
    found = {(r.source, r.target): sorted(tuple(p.tokens) for p in r.paths) for r in rows}
    for a, b in pairs:
        want = {tuple([a] + [leg[2] for leg in legs]) for legs in paths(g, a, b, hops)}
        assert found.get((a, b), []) == sorted(want)


def test_price_from_square_root(spark):
    s = int((40000 * 100) ** 0.5 * 2**96) // 100
    df = spark.createDataFrame([(str(s), False), (str(2**200), True), ("0", False)], "s string, inv boolean")
    got = [r.p for r in df.select(prices.price_from_sqrt(F.col("s"), F.col("inv"), F.lit(10**12)).alias("p")).collect()]
    assert [g is None or int(g) for g in got] == [s * s * 10**12 // 2**192, 2**192 * 10**12 // 2**400, True]


def test_derived_series_carries_its_own_close(spark):
    base = dict(token=1, quote=2, has_pool=True, strategy="neutral", p_real=None, last_p_close=None, last_q_close=None, prev_q_close=None)
    for p in "ptq":
        base.update({f"{p}_{f}": None for f in ("open", "high", "low", "close", "volume")})
    one = 10**16
    price = lambda p, v: {f"{p}_{f}": Decimal(v) for f in ("open", "high", "low", "close")} | {f"{p}_volume": Decimal(0)}
    rows = [{**base, "bucket_ts": 0, **price("t", 4 * one)},
            {**base, "bucket_ts": 600, **price("t", 8 * one)},                                    # only the token: averaged with the last close
            {**base, "bucket_ts": 1200, **price("q", 3 * one), "prev_q_close": Decimal(2 * one), "last_q_close": Decimal(3 * one)}]
    kinds = {"token": "bigint", "quote": "bigint", "bucket_ts": "bigint", "has_pool": "boolean", "p_real": "boolean", "strategy": "string"}
    names = list(rows[0])
    given = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'decimal(38,0)')}" for n in names))
    got = prices.derived_candles(given).orderBy("bucket_ts").collect()
    closes = [int(r.close) for r in got]
    # third bucket: 6 at quote 2 -> 9 at quote 3, averaged with the anchor 6
    assert closes == [4 * one, 6 * one, (9 * one + 6 * one) // 2]
    assert [int(r.open) for r in got] == [4 * one, 4 * one, 6 * one]


def test_cycle_input_keeps_to_the_cap(spark):
    """Two pools with a cap of 10: the best input within it, by trying all."""
    pools = {1: (30, 3000), 2: (3000, 60)}
    rows = [(1, 10, 20, 30, 3000), (2, 20, 10, 3000, 60)]
    edges = spark.createDataFrame([(p, a, b, Decimal(x), Decimal(y)) for p, a, b, x, y in rows],
                                  "pool_id bigint, token_in bigint, token_out bigint, r_in decimal(38,0), r_out decimal(38,0)")
    got = routing.arbitrage_cycles(spark.createDataFrame([(10,)], "token bigint"), edges, fee_bps=0).collect()

    def out(x, leg):
        return x * pools[leg][1] // (pools[leg][0] + x)
    best = max((out(out(x, 1), 2) - x, -x) for x in range(1, 11))
    assert [(int(r.profit), int(r.amount_in)) for r in got] == [(best[0], -best[1])]
