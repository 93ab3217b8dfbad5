"""Contract catalogue: metadata, names, prefixes, factories, series, key-value state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exact import DEC
from ..functions.paging import page, top_per_key
from ..functions.text import normalize_name, slug, u128_le, utf8_or_null
from ..session import cut_lineage, spread

# Method opcodes every factory offers.
FACTORY_OPCODES = (0, 1, 2, 3, 4, 7, 10, 11, 12, 13, 14, 21, 29, 50)


def storage_last_write(writes: DataFrame) -> DataFrame:
    """Last value and writer per (contract, key) in chain order."""
    at = F.struct("height", "tx_idx", "ev_idx")
    return writes.groupBy("contract", "key").agg(
        F.max_by(F.struct("value", "txid"), at).alias("v")).select("contract", "key", "v.value", "v.txid")


def contract_metadata(creations: DataFrame, writes: DataFrame) -> DataFrame:
    """Names and symbols in first-seen order without repeats; cap and mint amount only
    from writes of the creating transaction.  ``writes``: contract, key, value (text),
    height, tx_idx, ev_idx, txid; ``creations``: contract, txid."""
    pos = F.struct("height", "tx_idx", "ev_idx")
    texts = writes.filter(F.col("key").isin("/name", "/symbol") & F.col("value").isNotNull())
    first = texts.groupBy("contract", "key", "value").agg(F.min(pos).alias("at"))
    lists = first.groupBy("contract").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == k, F.struct("at", "value")))), lambda x: x["value"]).alias(n)
        for k, n in (("/name", "names"), ("/symbol", "symbols"))])
    born = writes.join(creations.select("contract", "txid"), ["contract", "txid"])
    nums = born.groupBy("contract").agg(
        F.max_by("value", F.when(F.col("key") == "/cap", pos)).alias("cap"),
        F.max_by("value", F.when(F.col("key").isin("/value-per-mint", "/value_per_mint"), pos)).alias("mint_amount"))
    nums = nums.select("contract", F.col("cap").try_cast(DEC).alias("cap"), F.col("mint_amount").try_cast(DEC).alias("mint_amount"))
    return creations.join(lists, "contract", "left").join(nums, "contract", "left")


def collection_names(instances: DataFrame) -> DataFrame:
    """Label of each instance of a collection template: ``base #n``, where the base is
    the text before ``#`` of the template's first known name.  ``instances``: template,
    token, creation_height, name.  The base is one aggregate per template; the number
    is the instance's ``index`` + 1."""
    base = F.trim(F.split(F.col("name"), "#")[0])
    known = F.col("name").isNotNull() & (base != "")
    first = instances.groupBy("template").agg(F.min_by(base, F.when(known, F.struct("creation_height", "token"))).alias("base"))
    j = instances.join(first, "template")
    return j.withColumn("label", F.concat(F.col("base"), F.lit(" #"), (F.col("index") + 1).cast("string")))


def contract_kv(writes: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Key-sorted page of the latest state of each contract, value shown as hex, text
    or little-endian number where it can be."""
    last = storage_last_write(writes)
    totals = last.groupBy("contract").agg(F.count(F.lit(1)).alias("total"))
    p = top_per_key(last, ["contract"], [F.asc("key")], limit, offset).join(totals, "contract")
    b = F.col("value")
    return p.select("contract", "key", F.concat(F.lit("0x"), F.lower(F.hex(b))).alias("value_hex"), utf8_or_null(b).alias("value_text"),
                    u128_le(b).alias("value_number"), "txid", "position", "total",
                    (F.lit(False) if limit is None else F.col("total") > offset + limit).alias("has_more"))


def creation_list(creations: DataFrame, holder_counts: DataFrame, by: str = "age", desc: bool = True,
                  limit: int = 50, offset: int = 0) -> DataFrame:
    """Page of creations by age or holder count with first name and symbol."""
    c = creations.join(holder_counts, "token", "left").withColumn("holders", F.coalesce("holders", F.lit(0)).cast("bigint")) \
        .withColumn("name", F.try_element_at("names", F.lit(1))).withColumn("symbol", F.try_element_at("symbols", F.lit(1)))
    cols = [F.col("creation_height"), F.col("token")] if by == "age" else [F.col("holders"), F.col("token")]
    return page(c, [x.desc() if desc else x.asc() for x in cols], limit, offset)


def contract_info(creations: DataFrame, holder_counts: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    c = creations if requested is None else creations.join(requested, "token", "left_semi")
    return c.join(holder_counts, "token", "left").withColumn("holders", F.coalesce("holders", F.lit(0)).cast("bigint"))


def name_prefix_search(creations: DataFrame, prefix: str, field: str = "names", limit: int = 50, offset: int = 0) -> DataFrame:
    """Tokens with a name (or symbol) starting with the prefix, in name order, once each."""
    n = creations.select("token", F.explode(field).alias("raw")).withColumn("norm", normalize_name(F.col("raw")))
    hit = n.filter(F.col("norm").startswith(prefix.strip().lower())).groupBy("token").agg(F.min("norm").alias("norm"))
    return page(hit, [F.asc("norm"), F.asc("token")], limit, offset)


def search_prefixes(creations: DataFrame, shortest: int = 2, longest: int = 6) -> DataFrame:
    """All distinct name and symbol prefixes of each token in a length range."""
    n = spread(creations.select("token", "names", "symbols"), "token").select("token", F.explode(F.array_distinct(F.transform(
        F.concat("names", "symbols"), lambda x: normalize_name(x)))).alias("norm"))
    n = n.filter(F.length("norm") >= shortest)
    size = F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length("norm")))).alias("size")
    return n.select("token", "norm", size).select("token", F.expr("substring(norm, 1, size)").alias("prefix")).distinct()


def factory_contracts(methods: DataFrame, names: DataFrame, proxies: DataFrame, created: DataFrame) -> DataFrame:
    """Contracts that are pool factories.

    methods: contract, opcodes; names: contract, name; proxies: contract, target;
    created: factory, template.  A contract counts when it offers every factory
    opcode or is named so, when its proxy target counts, or as template of a
    contract that a factory created.
    """
    need = F.array(*[F.lit(o) for o in FACTORY_OPCODES])
    by_code = methods.filter(F.size(F.array_except(need, F.col("opcodes"))) == 0).select("contract")
    by_name = names.filter(normalize_name(F.col("name")) == "ammfactory").select("contract")
    direct = by_code.union(by_name).distinct()
    via = proxies.join(direct.withColumnRenamed("contract", "target"), "target", "left_semi").select("contract")
    known = direct.union(via).distinct()
    templates = created.join(known.withColumnRenamed("contract", "factory"), "factory", "left_semi").select(F.col("template").alias("contract"))
    return known.union(templates).distinct()


def proxy_target(edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """Final target of each proxy: follow pointers up to ``max_depth`` steps, stop at a
    non-proxy or when a contract repeats.  ``edges``: contract, target."""
    cur = edges.select("contract", F.col("target").alias("at"), F.array("contract", "target").alias("seen"), F.lit(1).alias("depth"))
    step = edges.select(F.col("contract").alias("at"), F.col("target").alias("__next"))
    for i in range(max_depth - 1):
        nxt = cur.join(step, "at", "left")
        go = F.col("__next").isNotNull() & ~F.array_contains("seen", F.col("__next")) & (F.col("depth") == i + 1)
        cur = nxt.select("contract", F.when(go, F.col("__next")).otherwise(F.col("at")).alias("at"),
                         F.when(go, F.concat("seen", F.array("__next"))).otherwise(F.col("seen")).alias("seen"),
                         F.when(go, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"))
        if i % 4 == 3 and i + 2 < max_depth:
            cur = cut_lineage(cur)
    return cur.select("contract", F.col("at").alias("target"), "depth")


def series_ids(creations: DataFrame, priority: DataFrame | None = None) -> DataFrame:
    """Slug per token; the first token of a normalized name gets the plain slug, the n-th ``slug-n``.

    ``creations``: token, name, creation_height; ``priority``: token, priority (listed
    tokens come first).  A popular name is numbered in creation-height chunks.
    """
    from ..functions.scan import ordinal
    c = creations.withColumns({"slug": slug(F.col("name")), "__name": normalize_name(F.col("name"))}).filter(F.col("slug") != "")
    if priority is not None:
        c = c.join(priority, "token", "left")
    else:
        c = c.withColumn("priority", F.lit(None).cast("int"))
    c = c.withColumn("__p", F.coalesce("priority", F.lit(1_000_000)))
    chunk = F.when(F.col("__p") < 1_000_000, F.lit(-1).cast("bigint")).otherwise(F.floor(F.col("creation_height") / 1000).cast("bigint"))
    n = ordinal(c, ["__name"], [F.col("__p"), F.col("creation_height"), F.col("token")], chunk, "n")
    sid = F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat(F.col("slug"), F.lit("-"), F.col("n").cast("string")))
    return n.select("token", sid.alias("series_id"), "creation_height")


def series_lookup(series: DataFrame, requested: DataFrame, by: str, tip: int) -> DataFrame:
    """Series rows of the requested ids or tokens; unknown ones keep nulls."""
    return requested.join(series, by, "left").withColumn("confirmations", F.lit(tip) - F.col("creation_height") + 1)


def contract_methods(contracts: DataFrame) -> DataFrame:
    """Read and write method counts.  ``contracts``: contract, methods (array of name, opcode)."""
    m = contracts.select("contract", F.explode("methods").alias("m")).select("contract", "m.name")
    kind = F.when(F.col("name").startswith("get_"), "read").otherwise("write")
    return m.groupBy("contract", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
