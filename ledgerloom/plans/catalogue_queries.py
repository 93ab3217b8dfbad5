"""Plans over the contract catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as cat
from .facts import Facts
from .registry import query


@query("kv_last_write", """
select contract, key, arg_max(value, tx_idx) as value, arg_max(txid, tx_idx) as txid from writes group by 1, 2
""")
def kv_last_write(t: Facts):
    return cat.storage_last_write(t.writes)


META_SQL = """
select contract, txid, names, symbols, cast(cap as varchar) as cap, cast(mint_amount as varchar) as mint_amount from contracts
left join (select contract, string_agg(value, ',' order by pos) filter (where key = '/name') as names, string_agg(value, ',' order by pos) filter (where key = '/symbol') as symbols
           from (select contract, key, value, min(tx_idx) as pos from writes where key in ('/name', '/symbol') group by 1, 2, 3) group by 1) using (contract)
left join (select w.contract, arg_max(value, tx_idx) filter (where key = '/cap') as cap, arg_max(value, tx_idx) filter (where key = '/value-per-mint') as mint_amount
           from writes w join contracts c on w.contract = c.contract and w.txid = c.txid group by 1) using (contract)
"""


@query("contract_metadata", META_SQL)
def contract_metadata(t: Facts):
    m = cat.contract_metadata(t.contracts, t.writes)
    flat = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return m.select("contract", "txid", flat("names").alias("names"), flat("symbols").alias("symbols"), "cap", "mint_amount")


@query("collection_names", """
select template, token, base || ' #' || cast(token + 1 as varchar) as label
from (select template, token, name from creations) join (
  select template, arg_min(name, token) as base from creations where trim(name) <> '' group by 1) using (template)
""")
def collection_names(t: Facts):
    i = t.creations.select("template", "token", "creation_height", F.concat(F.col("names")[0], F.lit(" #x")).alias("name"),
                           F.col("token").alias("index"))
    return cat.collection_names(i).select("template", "token", "label")


@query("contract_kv", """
select contract, key, '0x' || lower(hex(encode(value))) as value_hex, value as value_text, txid, position, total, total > 4 as has_more from (
  select *, row_number() over (partition by contract order by key) as position, count(*) over (partition by contract) as total
  from (select contract, key, arg_max(value, tx_idx) as value, arg_max(txid, tx_idx) as txid from writes group by 1, 2)) where position <= 4
""")
def contract_kv(t: Facts):
    w = t.writes.withColumn("value", F.col("value").cast("binary"))
    return cat.contract_kv(w, 4).drop("value_number")


@query("contract_kv_numbers", """
select contract, key, case when length(v) > 0 then list_sum(list_transform(range(1, length(v) + 1), lambda i: cast(ord(v[i]) as hugeint) * cast(pow(256, i - 1) as hugeint))) end as value_number
from (select contract, key, arg_max(value, tx_idx) as v from writes group by 1, 2)
""", text="value_number")
def contract_kv_numbers(t: Facts):
    w = t.writes.withColumn("value", F.col("value").cast("binary"))
    return cat.contract_kv(w, None).select("contract", "key", "value_number")


@query("creation_list", """
select token, name, symbol, holders, position, total from (
  select c.token, name, symbol, coalesce(holders, 0) as holders, count(*) over () as total,
         row_number() over (order by coalesce(holders, 0) desc, c.token desc) as position
  from creations c left join holder_counts h on c.token = h.token) where position <= 60
""")
def creation_list(t: Facts):
    return cat.creation_list(t.creations, t.holder_counts, "holders", True, 60).select(
        "token", "name", "symbol", "holders", "position", "total")


@query("contract_info", """
select c.token, name, coalesce(holders, 0) as holders, cap, mint_amount from creations c left join holder_counts h on c.token = h.token
""", text="cap mint_amount")
def contract_info(t: Facts):
    return cat.contract_info(t.creations, t.holder_counts).select("token", F.col("names")[0].alias("name"), "holders", "cap", "mint_amount")


@query("name_prefix", """
select token, norm, position, total from (select token, norm, row_number() over (order by norm, token) as position, count(*) over () as total
  from (select token, lower(trim(name)) as norm from creations) where norm like 'small%') where position > 5 and position <= 80
""")
def name_prefix(t: Facts):
    return cat.name_prefix_search(t.creations, " Small", "names", 75, 5).select("token", "norm", "position", "total")


PREFIX_SQL = """
select distinct token, substr(norm, 1, n) as prefix from (select token, lower(name) as norm from creations union select token, lower(symbol) from creations),
range(2, 7) r(n) where n <= length(norm)
"""


@query("search_prefixes", PREFIX_SQL)
def search_prefixes(t: Facts):
    return cat.search_prefixes(t.creations)




@query("factories", """
select contract from (
  select token as contract from creations where cap % 3 = 0 or symbol = 'Brand#7'
  union select token from creations where token % 4 = 0 and token + 1 in (select token from creations where cap % 3 = 0 or symbol = 'Brand#7')) k
union
select token + 1 from creations where token % 10 = 0 and token in (
  select token from creations where cap % 3 = 0 or symbol = 'Brand#7'
  union select token from creations where token % 4 = 0 and token + 1 in (select token from creations where cap % 3 = 0 or symbol = 'Brand#7'))
""")
def factories(t: Facts):
    c = t.creations
    full = F.array(*[F.lit(o) for o in cat.FACTORY_OPCODES], F.lit(99))
    part = F.slice(full, 2, 20)
    methods = c.select(F.col("token").alias("contract"), F.when(F.col("cap") % 3 == 0, full).otherwise(part).alias("opcodes"))
    names = c.select(F.col("token").alias("contract"),
                     F.when(F.col("symbols")[0] == "Brand#7", "AMMFactory").otherwise(F.col("names")[0]).alias("name"))
    proxies = c.filter(F.col("token") % 4 == 0).select(F.col("token").alias("contract"), (F.col("token") + 1).alias("target"))
    created = c.filter(F.col("token") % 10 == 0).select(F.col("token").alias("factory"), (F.col("token") + 1).alias("template"))
    return cat.factory_contracts(methods, names, proxies, created)


@query("proxy_target", """
select contract, cur as target, depth from (
  with recursive e as (select token as contract, (token * 7 + cast(cap as bigint)) % (select count(*) from creations) as target from creations where token % 3 <> 0),
  walk as (select contract, target as cur, [contract, target] as seen, 1 as depth from e
           union all select w.contract, e.target, list_append(w.seen, e.target), w.depth + 1 from walk w join e on w.cur = e.contract
           where w.depth < 8 and not list_contains(w.seen, e.target))
  select contract, arg_max(cur, depth) as cur, max(depth) as depth from walk group by contract)
""")
def proxy_target(t: Facts):
    n = t.creations.agg(F.count(F.lit(1))).scalar()
    edges = t.creations.filter(F.col("token") % 3 != 0).select(
        F.col("token").alias("contract"), ((F.col("token") * 7 + F.col("cap").cast("bigint")) % n).alias("target"))
    return cat.proxy_target(edges)


SERIES_SQL = """
select token, slug || case when n = 1 then '' else '-' || cast(n as varchar) end as series_id, creation_height from (
  select token, creation_height, regexp_replace(lower(symbol), '\\s+', '-') as slug,
         row_number() over (partition by lower(symbol) order by case when token % 97 = 5 then 0 else 1 end, creation_height, token) as n from creations)
"""


def series_of(t: Facts):
    p = t.creations.filter(F.col("token") % 97 == 5).select("token", F.lit(0).alias("priority"))
    return cat.series_ids(t.creations.select("token", F.col("symbols")[0].alias("name"), "creation_height"), p)


@query("series_ids", SERIES_SQL)
def series_ids(t: Facts):
    return series_of(t)


@query("series_lookup", f"""
select r.series_id, s.token, s.creation_height, 5000 - s.creation_height + 1 as confirmations
from (select distinct lower(symbol) || '-2' as series_id from creations union select 'missing') r left join ({SERIES_SQL}) s using (series_id)
""")
def series_lookup(t: Facts):
    want = t.creations.select(F.concat(F.lower(F.col("symbols")[0]), F.lit("-2")).alias("series_id")).distinct() \
        .union(t.creations.select(F.lit("missing")).distinct())
    return cat.series_lookup(series_of(t), want, "series_id", 5000)


@query("contract_methods", """
select token as contract, kind, count(*) as n from (
  select token, 'read' as kind from creations union all select token, 'write' from creations
  union all select token, case when cap % 2 = 0 then 'read' else 'write' end from creations) group by 1, 2
""")
def contract_methods(t: Facts):
    third = F.when(F.col("cap") % 2 == 0, "get_cap").otherwise("set_cap")
    m = F.array(F.struct(F.lit("get_name").alias("name"), F.lit(1).alias("opcode")),
                F.struct(F.lit("mint").alias("name"), F.lit(77).alias("opcode")),
                F.struct(third.alias("name"), F.lit(3).alias("opcode")))
    return cat.contract_methods(t.creations.select(F.col("token").alias("contract"), m.alias("methods")))
