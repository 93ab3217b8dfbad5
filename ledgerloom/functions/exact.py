"""Exact integer arithmetic on DECIMAL(38,0).

Amounts carry 8 implied decimals and prices 16.  Spark's ``div`` returns BIGINT
and ``/`` rounds, so floor division is written as ``(a - a % b) / b``, which is
exact.  Sums and products that leave 38 digits saturate at ``CAP``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

DEC = "decimal(38,0)"
CAP = 10**38 - 1
U128_MAX = 2**128 - 1

# Fixed values of the data model.
PRICE_SCALE = 10**16
AMOUNT_SCALE = 10**8
K_TOLERANCE_BPS = 10
BPS = 10_000
APR_FACTOR = 36_000
I64_MAX = 2**63 - 1


def big(value: int) -> Column:
    """Integer literal as DECIMAL(38,0)."""
    return F.lit(Decimal(value)).cast(DEC)


def dec(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(DEC)


def sat_mul(a: Column, b: Column) -> Column:
    """Product, capped when it does not fit 38 digits (non-negative operands)."""
    return F.coalesce(F.try_multiply(a.cast(DEC), b.cast(DEC)),
                      F.when(a.isNotNull() & b.isNotNull(), big(CAP))).cast(DEC)


def sat_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a.cast(DEC), b.cast(DEC)),
                      F.when(a.isNotNull() & b.isNotNull(), big(CAP))).cast(DEC)


def sat_sum(c: Column) -> Column:
    """Aggregate sum that saturates instead of failing; empty input gives 0."""
    total = F.try_sum(c)
    return F.coalesce(total, F.when(F.count(c) > 0, big(CAP)).otherwise(big(0))).cast(DEC)


def _sql_big(v: int) -> str:
    return f"CAST('{v}' AS DECIMAL(38,0))"


def _sql_quotient(a: str, b: str) -> str:
    return f"CAST(try_divide({a} - {a} % {b}, {b}) AS DECIMAL(38,0))"


def _sql_long_quotient(a: str, b: str) -> str:
    """Quotients of 1e32 and more: divide by ``b * 1e6`` first, then the remainder."""
    step = f"COALESCE(CAST(try_multiply({b}, 1000000) AS DECIMAL(38,0)), {_sql_big(CAP)})"
    head = f"CAST({_sql_quotient(a, step)} * 1000000 AS DECIMAL(38,0))"
    return f"CAST({head} + {_sql_quotient(f'({a} % {step})', b)} AS DECIMAL(38,0))"


def _rare(args: dict[str, Column], body: str) -> Column:
    """Evaluate the SQL text ``body`` over ``s.<name>`` in a lambda.  Lambdas are
    interpreted, so a long formula that is seldom needed adds next to nothing to
    generated code, and as text it costs the driver one parse."""
    packed = F.array(F.struct(*[c.alias(n) for n, c in args.items()]))
    return F.get(F.call_function("transform", packed, F.expr(f"s -> {body}")), F.lit(0))


def _quotient(a: Column, b: Column) -> Column:
    return F.try_divide(a - a % b, b).cast(DEC)


def _nonzero(c: Column | int) -> Column:
    return big(c) if isinstance(c, int) else F.nullif(c.cast(DEC), big(0))


def div_floor(a: Column, b: Column | int) -> Column:
    """Integer quotient truncated toward zero; 0 when the divisor is 0."""
    a = a.cast(DEC)
    if isinstance(b, int) and b >= 10**6:
        return _quotient(a, big(b))
    d = big(b) if isinstance(b, int) else b.cast(DEC)
    body = f"CASE WHEN s.b = 0 THEN {_sql_big(0)} ELSE {_sql_long_quotient('s.a', 's.b')} END"
    return F.coalesce(_quotient(a, _nonzero(b)), _rare({"a": a, "b": d}, body)).cast(DEC)


_HALF = 10**19


def _sql_let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _wide_body(up: bool) -> str:
    """The quotient of a product past 38 digits, exactly: the product as two parts of 19 digits, held at 2^128 - 1, then long division.

    ``up`` rounds up. A divisor below 10^28 takes the lower part in two steps; for a larger one the quotient has at most 11 digits and follows from the leading digits,
    give or take two, which is settled by multiplying back.
    """
    half, zero, one = _sql_big(_HALF), _sql_big(0), _sql_big(1)
    dec_ = lambda x: f"CAST({x} AS DECIMAL(38,0))"
    mul = lambda x, y: f"CAST(try_multiply({x}, {y}) AS DECIMAL(38,0))"
    add = lambda x, y: f"CAST(try_add({x}, {y}) AS DECIMAL(38,0))"
    high = lambda x: _sql_quotient(x, half)
    parts = (f"named_struct('a', {high('s.a')}, 'x', {dec_(f's.a % {half}')}, 'b', {high('s.b')}, 'y', {dec_(f's.b % {half}')})")
    cross = add(mul("p.a", "p.y"), mul("p.x", "p.b"))
    low = mul("p.x", "p.y")
    product = f"named_struct('h', {add(add(mul(mul('p.a', 'p.b'), half), cross), high(low))}, 'l', {dec_(f'{low} % {half}')})"
    most_h, most_l = _sql_big(U128_MAX // _HALF), _sql_big(U128_MAX % _HALF)
    held = f"CASE WHEN r.h IS NULL OR r.h > {most_h} OR (r.h = {most_h} AND r.l > {most_l}) THEN named_struct('h', {most_h}, 'l', {most_l}) ELSE r END"
    less = (f"CASE WHEN t.l > 0 THEN named_struct('h', t.h, 'l', {dec_(f't.l - {one}')}) ELSE named_struct('h', {dec_(f't.h - {one}')}, 'l', {_sql_big(_HALF - 1)}) END")
    ten, nine = _sql_big(10**10), _sql_big(10**9)
    step = f"named_struct('q', {_sql_long_quotient('w.h', 's.c')}, 'cur', {dec_(f'(w.h % s.c) * {ten} + {_sql_quotient('w.l', nine)}')})"
    step2 = f"named_struct('q', {add(mul('u.q', ten), _sql_long_quotient('u.cur', 's.c'))}, 'cur', {dec_(f'(u.cur % s.c) * {nine} + (w.l % {nine})')})"
    small = _sql_let("u", step, _sql_let("v", step2, add(mul("v.q", nine), _sql_long_quotient("v.cur", "s.c"))))
    guess = _sql_quotient(dec_(f"w.h * {nine} + {_sql_quotient('w.l', ten)}"), _sql_quotient("s.c", ten))
    back_low = dec_(f"k * (s.c % {half})")
    back = f"named_struct('h', {dec_(f'k * {high('s.c')} + {high(back_low)}')}, 'l', {dec_(f'{back_low} % {half}')})"
    fits = _sql_let("z", back, "z.h < w.h OR (z.h = w.h AND z.l <= w.l)")
    large = _sql_let("g", guess, f"filter(array(g, {dec_(f'g - {one}')}, {dec_(f'g - {_sql_big(2)}')}), k -> {fits})[0]")
    quotient = f"COALESCE(CASE WHEN s.c < {_sql_big(10**28)} THEN {small} ELSE {large} END, {_sql_big(CAP)})"
    if up:
        whole = _sql_let("t", _sql_let("r", product, held), f"CASE WHEN t.h = 0 AND t.l = 0 THEN {zero} ELSE {_sql_let('w', less, f'COALESCE({add(quotient, one)}, {_sql_big(CAP)})')} END")
    else:
        whole = _sql_let("w", _sql_let("r", product, held), quotient)
    return f"CASE WHEN s.a IS NULL OR s.b IS NULL OR s.c IS NULL THEN NULL WHEN s.c = 0 THEN {zero} ELSE {_sql_let('p', parts, whole)} END"


WIDE_DOWN, WIDE_UP = _wide_body(False), _wide_body(True)


def mul_div_floor(a: Column, b: Column, c: Column | int) -> Column:
    """``a * b / c`` where the product saturates at 2^128 - 1; 0 when ``c`` is 0."""
    a, b = a.cast(DEC), b.cast(DEC)
    p = F.try_multiply(a, b).cast(DEC)
    d = big(c) if isinstance(c, int) else c.cast(DEC)
    return F.coalesce(_quotient(p, _nonzero(c)), _rare({"a": a, "b": b, "c": d}, WIDE_DOWN)).cast(DEC)


def mul_div_ceil(a: Column, b: Column, c: Column | int) -> Column:
    """As mul_div_floor(), rounded up."""
    a, b = a.cast(DEC), b.cast(DEC)
    p = F.try_multiply(a, b).cast(DEC)
    d = big(c) if isinstance(c, int) else c.cast(DEC)
    short = F.when(p == 0, big(0)).otherwise((_quotient((p - 1).cast(DEC), _nonzero(c)) + 1).cast(DEC))
    return F.coalesce(short, _rare({"a": a, "b": b, "c": d}, WIDE_UP)).cast(DEC)


def invert_price(p: Column) -> Column:
    """Reciprocal of a 1e16-scaled price; null for 0."""
    return F.when(p != 0, div_floor(big(PRICE_SCALE**2), p))


def percent_change_bp(now: Column, prev: Column) -> Column:
    """Change in 1/10000 of a percent, toward zero, clamped to BIGINT; 0 if prev is 0."""
    delta = now.cast(DEC) - prev.cast(DEC)
    size = F.least(mul_div_floor(F.abs(delta), big(1_000_000), prev), big(I64_MAX)).cast("bigint")
    return F.when(prev == 0, F.lit(0).cast("bigint")).when(delta < 0, -size).otherwise(size)


def apr_bp_30d(volume: Column, tvl: Column) -> Column:
    """Fee yield per year from 30-day volume, in 1/10000 of a percent."""
    raw = mul_div_floor(volume, big(APR_FACTOR), tvl)
    return F.least(raw, big(I64_MAX)).cast("bigint")


def bucket_start(ts: Column, seconds: int | Column) -> Column:
    return (ts - ts % seconds).cast("bigint")
