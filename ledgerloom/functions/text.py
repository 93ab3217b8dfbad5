"""Names, number formats and small parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .exact import CAP, DEC, I64_MAX, big

JSON_SAFE_MAX = 2**53 - 1


def normalize_name(c: Column) -> Column:
    """Trim blanks and NULs, lower-case."""
    return F.lower(F.regexp_replace(c, r"^[\s\x00]+|[\s\x00]+$", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(normalize_name(c), r"\s+", "-")


def strip_lp_suffix(c: Column) -> Column:
    return F.regexp_replace(F.rtrim(c), r"(?i)\s*LP$", "")


def format_bp(c: Column) -> Column:
    """Percent text with four decimals from 1/10000-percent units."""
    a = F.abs(c.cast(DEC))
    whole = ((a - a % 10000) / 10000).cast(DEC)
    return F.concat(F.when(c < 0, "-").otherwise(""), whole.cast("string"), F.lit("."),
                    F.lpad((a % 10000).cast("int").cast("string"), 4, "0"))


def parse_bp(c: Column) -> Column:
    """Inverse of :func:`format_bp`: the fifth digit after the point rounds half away from zero, later ones do not count; held within BIGINT.  Empty or unreadable text is 0."""
    t = F.trim(c)
    part = lambda k: F.regexp_extract(t, r"^[+-]?([0-9]*)(?:\.([0-9]*))?$", k)
    whole = F.coalesce(F.nullif(part(1), F.lit("")).try_cast(DEC), F.when(F.length(part(1)) > 30, big(CAP)).otherwise(big(0)))
    four = F.rpad(F.substring(part(2), 1, 4), 4, "0").cast("int")
    up = F.when(F.substring(part(2), 5, 1) >= "5", 1).otherwise(0)
    size = F.coalesce(F.try_add(F.try_multiply(whole, big(10000)).cast(DEC), (four + up).cast(DEC)).cast(DEC), big(CAP))
    value = F.when(t.startswith("-"), -F.least(size, big(I64_MAX + 1))).otherwise(F.least(size, big(I64_MAX)))
    return F.when(c.isNotNull(), value.cast("bigint"))


def hex_to_dec(h: Column) -> Column:
    """Up to 32 hex digits as DECIMAL(38,0); saturates past 38 digits."""
    p = F.lpad(F.lower(h), 32, "0")
    out = None
    for i in range(4):
        part = F.conv(F.substring(p, 8 * i + 1, 8), 16, 10).cast(DEC)
        term = F.try_multiply(part, big(2 ** (32 * (3 - i)))).cast(DEC)
        out = term if out is None else F.try_add(out, term).cast(DEC)
    return F.coalesce(out, F.when(h.isNotNull(), big(CAP)))


def parse_num(c: Column, bare_hex: bool = False) -> Column:
    """Unsigned number text: ``0x`` marks hex; bare text is decimal, or hex when
    ``bare_hex``.  Unreadable text gives null."""
    is_hex = c.rlike(r"^0x[0-9a-fA-F]{1,32}$")
    as_hex = hex_to_dec(F.substring(c, 3, 40))
    if bare_hex:
        return F.when(is_hex, as_hex).when(c.rlike(r"^[0-9a-fA-F]{1,32}$"), hex_to_dec(c))
    return F.when(is_hex, as_hex).when(c.rlike(r"^[0-9]{1,38}$"), c.try_cast(DEC))


def u128_le(b: Column) -> Column:
    """Little-endian unsigned integer of up to 16 bytes; null for empty input."""
    h = F.hex(F.substring(b, 1, 16))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(h) / 2, F.lit(1)).cast("int")),
                        lambda i: F.substring(h, (i * 2 - 1).cast("int"), F.lit(2)))
    return F.when(F.length(b) > 0, hex_to_dec(F.array_join(F.reverse(pairs), "")))


def utf8_or_null(b: Column) -> Column:
    """Text of valid UTF-8 bytes without control characters, else null."""
    t = F.try_validate_utf8(b.cast("string"))
    return F.when(~t.rlike(r"[\x00-\x1f\x7f]"), t)


def hex0x(b: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(b)))


def short_amount(c: Column) -> Column:
    """Amount in whole units with thousands separators and no closing zeros."""
    a = c.cast(DEC)
    rest = (a % 100000000).cast(DEC)
    frac = F.regexp_replace(F.lpad(rest.cast("string"), 8, "0"), "0+$", "")
    whole = F.format_number(((a - rest) / 100000000).cast(DEC), 0)
    return F.when(rest == 0, whole).otherwise(F.concat(whole, F.lit("."), frac))


def scale_amount(c: Column) -> Column:
    return c.cast("double") / F.lit(1e8)


def scale_price(c: Column) -> Column:
    return c.cast("double") / F.lit(1e16)


def beyond_json(c: Column) -> Column:
    """Whether a value exceeds the safe JSON integer range."""
    return F.abs(c) > big(JSON_SAFE_MAX)


def json_series(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``name``: each value as JSON text, quoted in the whole series of ``keys`` if any of its values exceeds the safe integer range."""
    wide = df.groupBy(*keys).agg(F.max(beyond_json(F.col(column))).alias("__wide"))
    text = F.col(column).cast("string")
    return df.join(wide, list(keys)).withColumn(name, F.when(F.col("__wide"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)).drop("__wide")


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def confirmations(tip: Column, height: Column) -> Column:
    return tip - height + 1


def json_path(c: Column, path: str) -> Column:
    """Value at a dotted path of a JSON text; numeric parts index arrays."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    return F.get_json_object(c, f"${steps}")
