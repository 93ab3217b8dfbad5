"""Routes over the pool graph for batches of quote requests.

edges     pool_id, token_in, token_out, r_in, r_out
requests  request_id, source, target, amount

Token paths are found once per distinct (source, target) and kept with the pools of each step; a request is one
join with its pair's row and one fold over its paths in whole numbers, so nothing is shuffled or written per hop and request.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.exact import BPS, CAP, DEC, U128_MAX, big, mul_div_ceil, mul_div_floor
from ..session import stage

DEFAULT_FEE_BPS = 50
DEFAULT_HOPS = 3
MAX_HOPS = 6
#: Shares over which the requests of one pair are dealt.
PAIR_SHARES = 16
POOL = "struct<pool_id:bigint,r_in:decimal(38,0),r_out:decimal(38,0)>"
LEG = f"array<{POOL}>"


def pool_edges(reserves: DataFrame, pools: DataFrame) -> DataFrame:
    """Both directions of every pool that has reserves on both sides."""
    j = reserves.join(pools.select("pool_id", "base_id", "quote_id"), "pool_id") \
        .filter((F.col("base_reserve") > 0) & (F.col("quote_reserve") > 0))
    both = F.explode(F.array(
        F.struct(F.col("base_id").alias("token_in"), F.col("quote_id").alias("token_out"), F.col("base_reserve").alias("r_in"), F.col("quote_reserve").alias("r_out")),
        F.struct(F.col("quote_id").alias("token_in"), F.col("base_id").alias("token_out"), F.col("quote_reserve").alias("r_in"), F.col("base_reserve").alias("r_out"))))
    return j.select("pool_id", both.alias("e")).select("pool_id", "e.*")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def xyk_out(r_in: Column, r_out: Column, amount: Column, fee_bps: int = DEFAULT_FEE_BPS) -> Column:
    """Constant-product output for an exact input, fee taken first; null on an empty pool."""
    paid = mul_div_floor(amount, big(BPS - fee_bps), BPS)
    return F.when((r_in > 0) & (r_out > 0), _let(paid, lambda x: mul_div_floor(x, r_out, (r_in + x).cast(DEC))))


def xyk_in(r_in: Column, r_out: Column, amount: Column, fee_bps: int = DEFAULT_FEE_BPS) -> Column:
    """Least input for an exact output, rounded up; null when the pool cannot give it."""
    ok = (r_in > 0) & (r_out > 0) & (amount > 0) & (amount < r_out)
    return F.when(ok, mul_div_ceil(mul_div_ceil(amount, r_in, (r_out - amount).cast(DEC)), big(BPS), BPS - fee_bps))


def with_xyk_out(df: DataFrame, r_in: str, r_out: str, amount: str, out: str, fee_bps: int = DEFAULT_FEE_BPS) -> DataFrame:
    return df.withColumn(out, xyk_out(F.col(r_in), F.col(r_out), F.col(amount), fee_bps))


def with_xyk_in(df: DataFrame, r_in: str, r_out: str, amount: str, out: str, fee_bps: int = DEFAULT_FEE_BPS) -> DataFrame:
    return df.withColumn(out, xyk_in(F.col(r_in), F.col(r_out), F.col(amount), fee_bps))


# ---------------------------------------------------------------- paths

def checked_hops(max_hops: int, least: int = 1) -> int:
    if not least <= max_hops <= MAX_HOPS:
        raise ValueError(f"hops must be {least} to {MAX_HOPS}, not {max_hops}")
    return max_hops


def path_index(pairs: DataFrame, edges: DataFrame, max_hops: int = DEFAULT_HOPS) -> DataFrame:
    """(source, target, paths): the simple token paths of each distinct pair, with the pools that serve each step.

    Half paths grow from both ends over the pair's own neighbours and meet in an equi-join on the two tokens of a middle step, so no hub's pools are spread out
    and no path is grown that does not arrive. One row a pair: ``paths`` is an array of (tokens, legs), ``legs`` one array of (pool_id, r_in, r_out) a step.
    """
    hops = checked_hops(max_hops)
    pool = F.struct(F.col("pool_id").cast("bigint").alias("pool_id"), "r_in", "r_out")
    steps = stage(edges.groupBy("token_in", "token_out").agg(F.sort_array(F.collect_list(pool)).alias("leg")))
    wanted = pairs.filter(F.col("source") != F.col("target")).select("source", "target").distinct()
    half = {}
    for side, here, there in (("source", "token_in", "token_out"), ("target", "token_out", "token_in")):
        ends = wanted.select(F.col(side).alias("end")).distinct()
        grown = [ends.select("end", F.col("end").alias("token"), F.array("end").alias("tokens"), F.array().cast(f"array<{LEG}>").alias("legs"))]
        for _ in range((hops - (side == "target")) // 2):
            n = grown[-1].join(steps.withColumnsRenamed({here: "token", there: "next"}), "token").filter(~F.array_contains("tokens", F.col("next")))
            pair = lambda a, b: F.concat(a, b) if side == "source" else F.concat(b, a)  # noqa: B023, E731
            grown.append(n.select("end", F.col("next").alias("token"), pair(F.col("tokens"), F.array("next")).alias("tokens"), pair(F.col("legs"), F.array("leg")).alias("legs")))
        half[side] = grown
    found = []
    for length in range(1, hops + 1):
        first = half["source"][length // 2].select(F.col("end").alias("source"), F.col("token").alias("token_in"), F.col("tokens").alias("t0"), F.col("legs").alias("l0"))
        last = half["target"][length - 1 - length // 2].select(F.col("end").alias("target"), F.col("token").alias("token_out"), F.col("tokens").alias("t1"), F.col("legs").alias("l1"))
        met = wanted.join(first, "source").join(last, "target").filter(~F.arrays_overlap("t0", "t1")).join(steps, ["token_in", "token_out"])
        found.append(met.select("source", "target", F.struct(F.concat("t0", "t1").alias("tokens"), F.concat("l0", F.array("leg"), "l1").alias("legs")).alias("p")))
    return reduce(DataFrame.unionByName, found).groupBy("source", "target").agg(F.collect_list("p").alias("paths"))


def _step_out(r_in: int, r_out: int, amount: int, fee_bps: int) -> int:
    """xyk_out() in whole numbers of a worker."""
    paid = _scaled(amount, BPS - fee_bps, BPS)
    return _scaled(paid, r_out, r_in + paid)


def _step_in(r_in: int, r_out: int, amount: int, fee_bps: int) -> int:
    """xyk_in() in whole numbers of a worker; 0 when the pool cannot give it."""
    if not 0 < amount < r_out:
        return 0
    return _scaled(_scaled(amount, r_in, r_out - amount, True), BPS, BPS - fee_bps, True)


def _scaled(a: int, b: int, c: int, up: bool = False) -> int:
    """mul_div_floor() or mul_div_ceil() in whole numbers of a worker."""
    p = a * b
    if p > U128_MAX:
        p = U128_MAX
    if not c:
        return 0
    if p < 0 or c < 0:  # toward zero
        q = abs(p) // abs(c)
        q = -q if (p < 0) != (c < 0) else q
    else:
        q = -(-p // c) if up else p // c
    return q if q <= CAP else CAP


def _parsed(text: str, forward: bool) -> list[tuple]:
    """(hops, tokens, legs in the order of the fold) of a pair's paths; a leg is its pools with reserves on both sides, by pool_id."""
    at = lambda x: (x is not None, x or 0)
    out = []
    for p in json.loads(text):
        legs = [sorted(((x.get("pool_id"), x["r_in"], x["r_out"]) for x in leg if x.get("r_in", 0) > 0 and x.get("r_out", 0) > 0), key=lambda x: at(x[0])) for leg in p["legs"]]
        if all(legs):
            out.append((len(legs), p["tokens"], legs if forward else legs[::-1]))
    return out


def _best_path(paths: list[tuple], asked: int, fee_bps: int, forward: bool) -> tuple | None:
    """(amount, hops, tokens, pools) of the best path: most output or least input, then fewer hops, the smaller pools and tokens.

    Each step takes the best of its parallel pools, which is exact because outputs grow with inputs.
    """
    best = rank = None
    for hops, tokens, legs in paths:
        amount, pools = asked, []
        for leg in legs:
            value = via = None
            for pool, r_in, r_out in leg:
                v = _step_out(r_in, r_out, amount, fee_bps) if forward else _step_in(r_in, r_out, amount, fee_bps)
                if v > 0 and (value is None or (v > value if forward else v < value)):
                    value, via = v, pool
            if value is None:
                break
            amount = value
            pools.append(via)
        else:
            if best is not None and (amount < best[0] if forward else amount > best[0]):
                continue
            pools = pools if forward else pools[::-1]
            mine = (hops, [(x is not None, x or 0) for x in pools], tokens)
            if best is None or amount != best[0] or mine < rank:
                best, rank = (amount, hops, tokens, pools), mine
    return best


#: Parsed pairs that a worker keeps at once.
PARSED = 64


def _search(requests: DataFrame, edges: DataFrame, max_hops: int, fee_bps: int, forward: bool) -> DataFrame:
    paths = path_index(requests, edges, max_hops)
    tokens = paths.schema["paths"].dataType.elementType["tokens"].dataType
    tokens_type = to_arrow_type(tokens)
    index = stage(paths.select("source", "target", F.to_json("paths").alias("paths")))
    # one pair may have most of the requests: they are dealt over all tasks, its one row is copied to the shares
    asked = requests.select("request_id", "source", "target", F.col("amount").cast(DEC).alias("asked"), F.pmod(F.xxhash64("request_id"), F.lit(PAIR_SHARES)).alias("share"))
    asked = asked.filter(F.col("asked").isNotNull()).repartition(parallelism(requests.sparkSession))
    copies = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_SHARES - 1).cast("long"))).alias("share"))
    r = asked.join(copies, ["source", "target", "share"]).select("request_id", "asked", "paths")
    schema = f"request_id {r.schema['request_id'].dataType.simpleString()}, amount decimal(38,0), hops int, tokens {tokens.simpleString()}, pools array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple]] = {}
        for b in batches:
            places, rows = [], []
            texts = b.column(2).dictionary_encode()
            names = texts.dictionary.to_pylist()
            for k, (amount, name) in enumerate(zip(b.column(1).to_pylist(), texts.indices.to_pylist())):
                text = names[name]
                if text not in known:
                    if len(known) >= PARSED:
                        known.clear()
                    known[text] = _parsed(text, forward)
                found = _best_path(known[text], int(amount), fee_bps, forward)
                if found:
                    places.append(k)
                    rows.append(found)
            amounts = pa.array([Decimal(x[0]) for x in rows], pa.decimal128(38, 0))
            columns = [b.column(0).take(pa.array(places, pa.int64())), amounts, pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], tokens_type), pa.array([x[3] for x in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["request_id", "amount", "hops", "tokens", "pools"])
    return r.mapInArrow(run, schema)


def best_route_exact_in(requests: DataFrame, edges: DataFrame, max_hops: int = DEFAULT_HOPS, min_out: int = 0,
                        fee_bps: int = DEFAULT_FEE_BPS) -> DataFrame:
    """Path with the most output per request; no token repeats.  Ties take fewer hops,
    then the smaller pool path.  Results below ``min_out`` drop out."""
    r = _search(requests, edges, max_hops, fee_bps, True)
    return r.filter(F.col("amount") >= min_out) if min_out else r


def best_route_exact_out(requests: DataFrame, edges: DataFrame, max_hops: int = DEFAULT_HOPS, max_in: int | None = None,
                         fee_bps: int = DEFAULT_FEE_BPS) -> DataFrame:
    """Path with the least input for an exact output per request."""
    r = _search(requests, edges, max_hops, fee_bps, False)
    return r.filter(F.col("amount") <= max_in) if max_in is not None else r


# ---------------------------------------------------------------- cycles

def parallelism(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cycle_output(legs: list[tuple[int, int]], x: int, pay: int) -> int:
    """Output of (r_in, r_out) legs for an exact input; products are not bounded here."""
    for r_in, r_out in legs:
        x = x * pay // BPS
        x = x * r_out // (r_in + x)
    return x


def cycle_input(legs: list[tuple[int, int]], y: int, pay: int) -> int | None:
    """Least input that gives at least ``y``; null when the legs cannot give it."""
    for r_in, r_out in reversed(legs):
        if y >= r_out:
            return None
        x = -(-y * r_in // (r_out - y))
        y = -(-x * BPS // pay)
    return y


def _curve(legs: list[tuple[int, int]], pay: int) -> tuple[int, int, int]:
    """(a, b, c) of the smooth output a x / (b + c x) of the legs; floors only lower it."""
    a, b, c = 1, 1, 0
    for r_in, r_out in legs:
        a, b, c = a * pay * r_out, b * r_in * BPS, c * r_in * BPS + a * pay
    return a, b, c


def profit_bounds(legs: list[tuple[int, int]], limit: int, pay: int) -> tuple[int, int]:
    """(a profit that some whole input up to ``limit`` reaches, one that none exceeds): scored near the smooth top, and (sqrt(a) - sqrt(b))^2 / c."""
    a, b, c = _curve(legs, pay)
    if a <= b or limit < 1:
        return 0, 0
    near = max(1, min(limit, (isqrt(a * b) - b) // c))
    low = max([0, *(cycle_output(legs, x, pay) - x for x in range(max(1, near - 2), min(limit, near + 2) + 1))])
    return low, (a + b - 2 * isqrt(a * b)) // c + 1


def _first_reaching(legs: list[tuple[int, int]], p: int, limit: int, pay: int) -> int | None:
    """The smallest whole input up to ``limit`` with a profit of ``p`` or more.

    Only inputs between the roots of the smooth curve can have it. From an input x none below the least input for an output of p + x has it, which steps over
    coarse legs; the stretch after it is scored in extended precision, and exactly wherever a floor is too close to call.
    """
    a, b, c = _curve(legs, pay)
    lead = a - b - p * c
    spread = lead * lead - 4 * c * p * b
    if lead < 0 or spread < 0:
        return None
    x = max(1, (lead - isqrt(spread) - 1) // (2 * c))
    last, block = min(limit, (lead + isqrt(spread) + 1) // (2 * c) + 1), 256
    while x <= last:
        least = cycle_input(legs, p + x, pay)
        if least is None or least > last:
            return None
        if least <= x:
            return x
        x = least
        n = min(block, last - x + 1)
        paid = np.arange(n, dtype=np.longdouble) + np.longdouble(x)
        value, unsure = paid, np.zeros(n, dtype=bool)
        for r_in, r_out in legs:
            for top, under in ((pay, BPS), (r_out, None)):
                raw = value * np.longdouble(top) / (np.longdouble(under) if under else value + np.longdouble(r_in))
                value = np.floor(raw)
                near = np.abs(raw - np.rint(raw))
                unsure |= near <= raw * np.longdouble(2e-18) + np.longdouble(1e-12)
        for i in np.flatnonzero(unsure | (value - paid >= np.longdouble(p))).tolist():
            if cycle_output(legs, x + i, pay) - x - i >= p:
                return x + i
        x, block = x + n, min(block * 2, 1 << 17)
    return None


def best_input(legs: list[tuple[int, int]], limit: int, pay: int) -> tuple[int, int]:
    """(profit, input) of the most profitable whole input up to ``limit``, the smallest of equal ones; (0, 0) without profit.

    What can be reached is monotone in the profit, so it is bisected between its bounds.
    """
    low, high = profit_bounds(legs, limit, pay)
    best = None
    while low < high:
        mid = (low + high + 1) // 2
        found = _first_reaching(legs, mid, limit, pay)
        if found is None:
            high = mid - 1
        else:
            low, best = cycle_output(legs, found, pay) - found, found
    if low <= 0:
        return 0, 0
    return low, best if best is not None else _first_reaching(legs, low, limit, pay)


def arbitrage_cycles(tokens: DataFrame, edges: DataFrame, max_hops: int = DEFAULT_HOPS, fee_bps: int = DEFAULT_FEE_BPS) -> DataFrame:
    """Most profitable simple cycle from each token, with the exact whole input: at most a third of the smallest input reserve, the smallest of equally good ones.
    ``tokens``: token. Ties between cycles take fewer legs, then the larger path text.

    Cycles come from the path index: a path from a token to each neighbour and the pools that lead back. Each cycle is a row that is solved by itself.
    """
    hops = checked_hops(max_hops, 2)
    back = edges.join(tokens.select(F.col("token").alias("token_out")), "token_out", "left_semi").select(
        F.col("token_out").alias("source"), F.col("token_in").alias("target"), F.struct(F.col("pool_id").cast("bigint").alias("pool_id"), "r_in", "r_out").alias("back"))
    index = path_index(back, edges, hops - 1)
    c = back.join(index, ["source", "target"]).select("source", "back", F.explode("paths").alias("p"))
    # one row for each choice of parallel pools
    c = c.select("source", "back", F.col("p.legs").alias("open"), F.array().cast(f"array<{POOL}>").alias("legs"))
    for k in range(hops - 1):
        c = c.withColumn("choice", F.explode(F.coalesce(F.try_element_at("open", F.lit(k + 1)), F.array(F.lit(None).cast(POOL)))))
        c = c.withColumn("legs", F.when(F.col("choice").isNull(), F.col("legs")).otherwise(F.concat("legs", F.array("choice")))).drop("choice")
    c = c.filter(~F.exists("legs", lambda l: l["pool_id"] == F.col("back.pool_id"))).select(F.col("source").alias("token"), F.concat("legs", F.array("back")).alias("legs"))
    pay = BPS - fee_bps

    def rows(batches, fn, names):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                pairs = [(int(x["r_in"]), int(x["r_out"])) for x in r.legs]
                out += fn(r.token, r.legs, pairs, min(x for x, _ in pairs) // 3)
            yield pd.DataFrame(out, columns=names)

    def bounds(token, legs, pairs, limit):
        low, high = profit_bounds(pairs, limit, pay)
        return [(token, legs, Decimal(low), Decimal(high))] if high > 0 else []

    def solve(token, legs, pairs, limit):
        profit, amount = best_input(pairs, limit, pay)
        return [(token, Decimal(profit), Decimal(amount), ">".join(str(x["pool_id"]) for x in legs), -len(legs))] if profit else []
    bounded = stage(c.mapInPandas(lambda b: rows(b, bounds, ["token", "legs", "low", "high"]), f"token bigint, legs {LEG}, low decimal(38,0), high decimal(38,0)"))
    # only cycles that may beat what another one of the token surely reaches are solved
    hopeful = bounded.join(bounded.groupBy("token").agg(F.max("low").alias("sure")), "token").filter((F.col("high") >= F.col("sure"))).select("token", "legs")
    solved = hopeful.repartition(parallelism(tokens.sparkSession)).mapInPandas(
        lambda b: rows(b, solve, ["token", "profit", "amount_in", "cycle", "h"]), "token bigint, profit decimal(38,0), amount_in decimal(38,0), cycle string, h int")
    top = F.max(F.struct("profit", "h", "cycle", "amount_in")).alias("t")
    return solved.groupBy("token").agg(top).select("token", F.col("t.profit").alias("profit"), F.col("t.amount_in").alias("amount_in"), F.col("t.cycle").alias("cycle"))


def pair_route(pairs: DataFrame, edges: DataFrame, pools: DataFrame, amount: int = 1, max_hops: int = DEFAULT_HOPS,
               fee_bps: int = 0) -> DataFrame:
    """Best route between token pairs with the details of each pool on it.
    ``pairs``: request_id, source, target."""
    r = best_route_exact_in(pairs.withColumn("amount", big(amount)), edges, max_hops, fee_bps=fee_bps)
    x = r.select("request_id", "amount", "hops", F.posexplode("pools").alias("step", "pool_id"))
    return x.join(pools.select(F.col("pool_id").cast("bigint").alias("pool_id"), "base_id", "quote_id", "factory_id"), "pool_id")
