"""Small text builders for the SQL side."""

from __future__ import annotations

U128_MAX = 2**128 - 1
S16 = "cast(10000000000000000 as hugeint)"


def muldiv(a: str, b: str, c: int) -> str:
    """a * b / c with a product that saturates at 2^128 - 1, in 128-bit integers."""
    return f"least(({a}) // {c} * ({b}) + (({a}) % {c}) * ({b}) // {c}, {U128_MAX // c})"


def muldiv_wide(a: str, b: str, c: int) -> str:
    """As :func:`muldiv`, with both factors split, for factors that are large against ``c``."""
    return f"least(({a}) // {c} * ({b}) + ({a}) % {c} * (({b}) // {c}) + ({a}) % {c} * (({b}) % {c}) // {c}, {U128_MAX // c})"


def pct(now: str, prev: str) -> str:
    return (f"cast(case when ({prev}) = 0 then 0 else (case when ({now}) < ({prev}) then -1 else 1 end) * "
            f"least(abs(({now}) - ({prev})) * 1000000 // ({prev}), 9223372036854775807) end as bigint)")


def bp_text(c: str) -> str:
    return (f"(case when {c} < 0 then '-' else '' end || cast(abs({c}) // 10000 as varchar) || '.' || "
            f"lpad(cast(abs({c}) % 10000 as varchar), 4, '0'))")


TF_VALUES = "(values ('10m', 600), ('1h', 3600), ('4h', 14400), ('1d', 86400), ('1w', 604800), ('1M', 2592000)) as t(tf, dur)"
HIGHER_VALUES = "(values ('1h', 3600), ('4h', 14400), ('1d', 86400), ('1w', 604800), ('1M', 2592000)) as t(tf, dur)"
