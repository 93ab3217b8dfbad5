"""Chunked scans against plain loops, with one hot key."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions.asof import asof_backward, asof_nearest
from ledgerloom.functions.scan import carry_last, clamped_sums, ordinal, running_sums


def rows_with_hot_key(n=1500, seed=3):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.4 else f"k{r.randrange(20)}", h, r.randrange(-50, 50)) for h in range(n)]


def by_key(rows):
    out = {}
    for k, h, d in rows:
        out.setdefault(k, []).append((h, d))
    return out


def test_running_and_clamped_sums(spark):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "k string, h bigint, d bigint").repartition(8)
    chunk = F.floor(F.col("h") / 37).cast("bigint")
    plain = {(r.k, r.h): (r.s, r.n) for r in ordinal(running_sums(df, ["k"], [F.col("h")], chunk, {"s": F.col("d")}), ["k"], [F.col("h")], chunk, "n").collect()}
    clamped = {(r.k, r.h): int(r.x) for r in clamped_sums(df, ["k"], [F.col("h")], chunk, {"x": (F.col("d"), F.lit(Decimal(20)))}).collect()}
    for k, items in by_key(rows).items():
        total, x = 0, 20
        for i, (h, d) in enumerate(items):
            total, x = total + d, max(0, x + d)
            assert plain[k, h] == (total, i + 1)
            assert clamped[k, h] == x


def test_carry_last(spark):
    rows = [(k, h, d if d > 20 else None) for k, h, d in rows_with_hot_key(800, 5)]
    df = spark.createDataFrame(rows, "k string, h bigint, d bigint").repartition(8)
    got = {(r.k, r.h): r.last for r in carry_last(df, ["k"], [F.col("h")], F.floor(F.col("h") / 10).cast("bigint"), {"last": F.col("d")}).collect()}
    for k, items in by_key(rows).items():
        last = None
        for h, d in items:
            last = d if d is not None else last
            assert got[k, h] == last


def test_asof_backward_and_nearest(spark):
    r = random.Random(11)
    right = sorted(r.sample(range(3000), 60))
    left = [r.randrange(3000) for _ in range(300)]
    rdf = spark.createDataFrame([(x, x * 10) for x in right], "at bigint, v bigint")
    ldf = spark.createDataFrame([(i, x) for i, x in enumerate(left)], "i bigint, at bigint")
    back = {g.i: g.v for g in asof_backward(ldf, rdf, [], "at", ["v"], 100).collect()}
    near = {g.i: g.v for g in asof_nearest(ldf, rdf, [], "at", ["v"], 100).collect()}
    for i, x in enumerate(left):
        before = [y for y in right if y <= x]
        assert back[i] == (before[-1] * 10 if before else None)
        assert near[i] == min(right, key=lambda y: (abs(y - x), y)) * 10
