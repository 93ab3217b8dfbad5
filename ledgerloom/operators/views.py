"""Product-level listings joined from the ledger, price and catalogue operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exact import DEC, big, div_floor, mul_div_floor, sat_add, sat_mul
from ..functions.paging import page, top_per_key
from ..functions.text import normalize_name


def token_table(creations: DataFrame, metrics: DataFrame, holder_counts: DataFrame, supply: DataFrame,
                minted: DataFrame, canonical_prices: DataFrame) -> DataFrame:
    """One row per token with everything the listings show.  ``minted``: token, minted."""
    c = creations.select("token", F.try_element_at("names", F.lit(1)).alias("name"), F.try_element_at("symbols", F.lit(1)).alias("symbol"),
                         "cap", "mint_amount", "creation_height")
    for side in (metrics, holder_counts, supply, minted, canonical_prices):
        c = c.join(side, "token", "left")
    c = c.withColumns({"holders": F.coalesce("holders", F.lit(0)).cast("bigint"), "supply": F.coalesce("supply", big(0)),
                       "minted": F.coalesce("minted", big(0)), "max_supply": sat_mul(F.col("cap"), F.col("mint_amount"))})
    exact = div_floor((F.col("minted") * 100 + F.col("max_supply") - 1).cast(DEC), F.col("max_supply"))
    return c.withColumn("percent_minted", F.when(F.col("max_supply") > 0, exact)) \
        .withColumn("mint_active", F.col("minted") < F.col("max_supply"))


DERIVED_FIELDS = ("price_usd", "fdv_usd", "marketcap_usd", "volume_1d", "volume_7d", "volume_30d", "volume_all_time",
                  "change_1d_bp", "change_7d_bp", "change_30d_bp", "change_all_time_bp")


def with_derived(table: DataFrame, derived: DataFrame) -> DataFrame:
    """Listing rows with ``derived``: one entry per quote for which the token has derived metrics, by quote; an empty list if none.

    A list, not columns per quote, so that the schema does not depend on the configured quotes.  ``derived``: token, quote, metrics.
    """
    entry = F.struct(F.col("quote"), *[F.col(f) for f in DERIVED_FIELDS])
    per = derived.groupBy("token").agg(F.array_sort(F.collect_list(entry)).alias("derived"))
    return table.join(per, "token", "left").withColumn("derived", F.coalesce("derived", F.array().cast(per.schema["derived"].dataType)))


def token_listing(table: DataFrame, sort: str = "marketcap_usd", desc: bool = True, limit: int = 50, offset: int = 0,
                  query: str | None = None) -> DataFrame:
    t = table
    if query:
        q = query.strip().lower()
        t = t.filter(normalize_name(F.col("name")).startswith(q) | normalize_name(F.col("symbol")).startswith(q))
    c = F.col(sort)
    return page(t, [c.desc_nulls_last() if desc else c.asc_nulls_first(), F.asc("token")], limit, offset)


def global_search(tokens: DataFrame, pools: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Tokens by holders and pools by name for one query text.
    tokens: token, name, symbol, holders; pools: pool_id, pool_name."""
    q = query.strip().lower()
    hit = normalize_name(F.col("name")).startswith(q) | normalize_name(F.col("symbol")).startswith(q)
    t = tokens.filter(hit).orderBy(F.desc("holders"), F.asc("token")).limit(limit).select(
        F.lit("token").alias("kind"), F.col("token").alias("id"), "name", "holders")
    p = pools.filter(normalize_name(F.col("pool_name")).startswith(q)).orderBy("pool_name", "pool_id").limit(limit).select(
        F.lit("pool").alias("kind"), F.col("pool_id").cast("bigint").alias("id"), F.col("pool_name").alias("name"), F.lit(None).cast("bigint").alias("holders"))
    return t.unionByName(p)


def pool_details(values: DataFrame, metrics: DataFrame, creation: DataFrame, lp: DataFrame, fallback: DataFrame) -> DataFrame:
    """Reserves, TVL, LP unit value, creation and volumes; a metric of 0 falls back to the
    daily candle sums.  lp: pool_id, lp_supply; fallback: pool_id, volume_7d, volume_all."""
    v = values.select("pool_id", "base_id", "quote_id", "base_reserve", "quote_reserve")
    m = metrics.select("pool_id", "tvl_usd", "volume_7d_usd", "volume_all_usd")
    j = v.join(m, "pool_id", "left").join(creation, "pool_id", "left").join(lp, "pool_id", "left").join(fallback, "pool_id", "left")
    or_else = lambda a, b: F.coalesce(F.nullif(F.col(a), big(0)), F.col(b), big(0)).alias(a)
    return j.select("pool_id", "base_id", "quote_id", "base_reserve", "quote_reserve", "tvl_usd", "lp_supply", "created_height",
                    mul_div_floor(F.col("tvl_usd"), big(10**8), F.col("lp_supply")).alias("lp_value"),
                    or_else("volume_7d_usd", "volume_7d"), or_else("volume_all_usd", "volume_all"))


def pools_overview(table: DataFrame, sort: str = "tvl_usd", desc: bool = True, limit: int = 50, offset: int = 0,
                   holders_of: DataFrame | None = None, name_prefix: str | None = None, token=None, factory=None, pool_or_token=None) -> DataFrame:
    """Filtered, sorted page of pools with totals, the largest and the trending pool.

    table: pool_id, pool_name, base_id, quote_id, tvl_usd, volume_1d_usd, apr_bp,
    tvl_change_1d_bp, factory_id; ``holders_of``: pool_id to keep.  ``pool_or_token`` is an id that a search may mean either way.
    """
    t = table
    if factory is not None:
        t = t.filter(F.col("factory_id") == factory)
    if pool_or_token is not None:
        t = t.filter((F.col("pool_id") == pool_or_token) | (F.col("base_id") == pool_or_token) | (F.col("quote_id") == pool_or_token))
    if holders_of is not None:
        t = t.join(holders_of.select("pool_id").distinct(), "pool_id", "left_semi")
    if name_prefix:
        t = t.filter(normalize_name(F.col("pool_name")).startswith(name_prefix.strip().lower()))
    if token is not None:
        t = t.filter((F.col("base_id") == token) | (F.col("quote_id") == token))
    sums = t.agg(F.sum("tvl_usd").cast(DEC).alias("total_tvl"), F.sum("volume_1d_usd").cast(DEC).alias("total_volume_1d"),
                 F.max_by("pool_id", F.struct("tvl_usd", -F.col("pool_id"))).alias("largest"),
                 F.max_by("pool_id", F.struct("tvl_change_1d_bp", -F.col("pool_id"))).alias("trending"))
    c = F.col(sort)
    p = page(t, [c.desc() if desc else c.asc(), F.asc("pool_id")], limit, offset)
    return p.withColumns({n: sums.select(n).scalar() for n in ("total_tvl", "total_volume_1d", "largest", "trending")})


def lp_positions(balances: DataFrame, pools: DataFrame) -> DataFrame:
    """Value of each holder's share of each pool.  balances: address, token, amount;
    pools: pool_id, lp_token, lp_supply, base_tvl_usd, quote_tvl_usd."""
    j = balances.join(pools, balances.token == pools.lp_token)
    side = lambda s: mul_div_floor(F.col("amount"), F.col(f"{s}_tvl_usd"), F.col("lp_supply"))
    j = j.withColumns({"base_value": side("base"), "quote_value": side("quote")})
    return j.select("address", "pool_id", "amount", "base_value", "quote_value",
                    (F.col("base_value") + F.col("quote_value")).cast(DEC).alias("total_value"))


def factory_positions(balances: DataFrame, pools: DataFrame, factory) -> DataFrame:
    """Each address's shares of a factory's pools in USD and sats, the most valuable first (``position`` within the address, ties by pool).

    balances: address, token, amount; pools: pool_id, factory_id, lp_token, lp_supply and base_tvl_…, quote_tvl_… in usd and sats.  A pool
    without shares is worth nothing.
    """
    p = pools.filter(F.col("factory_id") == factory)
    j = balances.filter(F.col("amount") > 0).join(p, balances.token == p.lp_token)
    value = lambda s, u: F.when(F.col("lp_supply") > 0, mul_div_floor(F.col(f"{s}_tvl_{u}"), F.col("amount"), F.col("lp_supply"))).otherwise(big(0))
    j = j.withColumns({f"{s}_{u}": value(s, u) for u in ("usd", "sats") for s in ("base", "quote")})
    j = j.withColumns({f"total_{u}": sat_add(F.col(f"base_{u}"), F.col(f"quote_{u}")) for u in ("usd", "sats")})
    j = j.select("address", "pool_id", "amount", *[f"{s}_{u}" for u in ("usd", "sats") for s in ("base", "quote", "total")])
    return top_per_key(j, ["address"], [F.desc("total_usd"), F.asc("pool_id")], None)


def token_pairs(pools: DataFrame, tokens: DataFrame, query: str | None = None, token=None) -> DataFrame:
    """Pair rows with both tokens' names; the query matches anywhere in names, symbols
    or ids.  pools: pool_id, base_id, quote_id, tvl_usd; tokens: token, name, symbol."""
    b = tokens.select(F.col("token").alias("base_id"), F.col("name").alias("base_name"), F.col("symbol").alias("base_symbol"))
    q = tokens.select(F.col("token").alias("quote_id"), F.col("name").alias("quote_name"), F.col("symbol").alias("quote_symbol"))
    j = pools.join(b, "base_id", "left").join(q, "quote_id", "left")
    if token is not None:
        j = j.filter((F.col("base_id") == token) | (F.col("quote_id") == token))
    if query:
        text = F.lower(F.concat_ws("\n", "base_name", "quote_name", "base_symbol", "quote_symbol",
                                   F.col("base_id").cast("string"), F.col("quote_id").cast("string")))
        j = j.filter(text.contains(query.strip().lower()))
    return j


def pair_page(pools: DataFrame, tokens: DataFrame, factory, token=None, query: str | None = None, sort: str | None = "tvl",
              limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of a factory's pairs, of one token if given, with reserves, TVL and daily volume; by TVL, or by pool for any other ``sort``.

    A query that is an id matches the pool or either token exactly, any other text may stand anywhere in names and symbols.
    pools: pool_id, factory_id, base_id, quote_id, base_reserve, quote_reserve, tvl_usd, volume_1d_usd.
    """
    p = pools.filter(F.col("factory_id") == factory)
    text = (query or "").strip()
    if text.isdigit():
        p = p.filter(F.lit(int(text)).isin(F.col("pool_id"), F.col("base_id"), F.col("quote_id")))
    j = token_pairs(p, tokens, token=token)
    if text and not text.isdigit():
        names = F.concat_ws(" ", *[normalize_name(F.col(c)) for c in ("base_name", "quote_name", "base_symbol", "quote_symbol")])
        j = j.filter(names.contains(text.lower()))
    order = [F.desc("tvl_usd"), F.asc("pool_id")] if (sort or "tvl").lower() == "tvl" else [F.asc("pool_id")]
    return page(j, order, limit, offset)


def combined_history(amm: DataFrame, wraps: DataFrame, limit: int, offset: int = 0, address=None) -> DataFrame:
    """AMM and bridge events in one newest-first list with the summed total.
    Both: kind, ts, seq, address, amount."""
    cols = ["kind", "ts", "seq", "address", "amount"]
    u = amm.select(*cols).unionByName(wraps.select(*cols))
    if address is not None:
        u = u.filter(F.col("address") == address)
    return page(u, [F.desc("ts"), F.desc("seq"), F.asc("kind")], limit, offset)


def utxo_portfolio(utxos: DataFrame, tokens: DataFrame, runes: DataFrame, inscriptions: DataFrame, pending: DataFrame) -> DataFrame:
    """Unspent outputs by class and their sums per address.  utxos: outpoint, address,
    sats; the others list outpoints (pending: spending ones)."""
    u = utxos
    for n, s in (("has_token", tokens), ("has_rune", runes), ("has_inscription", inscriptions), ("is_pending", pending)):
        u = u.join(s.select("outpoint").distinct().withColumn(n, F.lit(True)), "outpoint", "left") \
            .withColumn(n, F.coalesce(n, F.lit(False)))
    clean = ~(F.col("has_token") | F.col("has_rune") | F.col("has_inscription") | F.col("is_pending"))
    part = lambda c: F.sum(F.when(c, F.col("sats")).otherwise(0))
    return u.groupBy("address").agg(
        F.count(F.lit(1)).alias("utxos"), F.sum("sats").alias("total_sats"), part(clean).alias("spendable_sats"),
        part(F.col("has_token")).alias("token_sats"), part(F.col("has_rune")).alias("rune_sats"),
        part(F.col("has_inscription")).alias("inscription_sats"), part(F.col("is_pending")).alias("pending_sats"),
        F.count_if(F.col("has_token") & ~F.col("has_rune") & ~F.col("has_inscription") & ~F.col("is_pending")).alias("amm_usable"))


def tokens_by_address(balances: DataFrame, table: DataFrame) -> DataFrame:
    """Balances with token names.  balances: address, token, amount."""
    return balances.join(table.select("token", "name", "symbol"), "token", "left")


def search_guess(query: str, tip: int, tokens: DataFrame, txs: DataFrame, limit: int = 10, addresses: DataFrame | None = None) -> DataFrame:
    """Typed guesses for a search text: block height, transaction, address, token id, token name.
    tokens: token, name, symbol, holders; txs: txid (hex); addresses: address, matched as a whole."""
    q = query.strip().lower()
    out = []
    if q.isdigit() and int(q) <= tip:
        out.append(tokens.sparkSession.range(1).select(F.lit("block").alias("kind"), F.lit(q).alias("id"), F.lit(None).cast("bigint").alias("rank")))
    if len(q) >= 8 and all(ch in "0123456789abcdef" for ch in q):
        out.append(txs.filter(F.col("txid").startswith(q)).orderBy("txid").limit(limit).select(
            F.lit("tx").alias("kind"), F.col("txid").alias("id"), F.lit(None).cast("bigint").alias("rank")))
    if addresses is not None:
        hit = addresses.filter(F.lower("address") == q).select(F.lit("address").alias("kind"), F.col("address").alias("id"), F.lit(None).cast("bigint").alias("rank"))
        out.append(hit.distinct())
    by_id = F.col("token").cast("string") == q
    by_name = normalize_name(F.col("name")).startswith(q) | normalize_name(F.col("symbol")).startswith(q)
    out.append(tokens.filter(by_id | by_name).orderBy(F.desc("holders"), F.asc("token")).limit(limit).select(
        F.lit("token").alias("kind"), F.col("token").cast("string").alias("id"), F.col("holders").alias("rank")))
    u = out[0]
    for x in out[1:]:
        u = u.unionByName(x)
    return u


def top_tokens_by_holders(table: DataFrame, n: int) -> DataFrame:
    return page(table, [F.desc("holders"), F.asc("token")], n, total=False)
