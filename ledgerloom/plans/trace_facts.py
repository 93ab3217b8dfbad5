"""Trace events derived from the events table: each event becomes one call tree whose
shape follows its type.  The same step table feeds both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exact import DEC
from ..operators.traces import BASE_KEY, FACTORY_KEY, QUOTE_KEY
from ..session import spread
from .facts_sql import CTES

ROUTER, ORACLE, FACTORY, BRIDGE = 9001, 9002, 9004, 1

# shape: list of (event, call_type, owner, opcode, in_token, in_amount, out_token, out_amount, extra_out, status, mark)
STEPS = {
    "buy": [("invoke", "call", "router", 3, "quote", "b", "", "", "", "", ""),
            ("invoke", "call", "pool", 3, "quote", "b", "", "", "", "", ""),
            ("invoke", "delegatecall", "pool", 3, "quote", "b", "", "", "", "", ""),
            ("return", "", "", -1, "", "", "base", "a", "", "success", ""),
            ("return", "", "", -1, "", "", "base", "a", "", "success", ""),
            ("return", "", "", -1, "", "", "base", "a", "", "success", "")],
    "anchored": [("invoke", "call", "router", 3, "quote", "b", "", "", "", "", ""),
                 ("invoke", "staticcall", "pool", 97, "", "", "", "", "", "", ""),
                 ("invoke", "delegatecall", "pool", 97, "", "", "", "", "", "", "anchor"),
                 ("return", "", "", -1, "", "", "", "", "", "success", "reserves"),
                 ("return", "", "", -1, "", "", "", "", "", "success", "reserves"),
                 ("invoke", "call", "pool", 3, "quote", "b", "", "", "", "", ""),
                 ("return", "", "", -1, "", "", "base", "a", "", "success", ""),
                 ("return", "", "", -1, "", "", "base", "a", "", "success", "")],
    "sell": [("invoke", "call", "router", 3, "base", "a", "", "", "", "", ""),
             ("invoke", "staticcall", "oracle", 5, "base", "a", "", "", "", "", ""),
             ("invoke", "call", "pool", 5, "base", "a", "", "", "", "", ""),
             ("return", "", "", -1, "", "", "quote", "b", "", "success", ""),
             ("return", "", "", -1, "", "", "", "", "", "success", ""),
             ("invoke", "call", "pool", 3, "base", "a", "", "", "", "", ""),
             ("return", "", "", -1, "", "", "quote", "b", "", "success", ""),
             ("return", "", "", -1, "", "", "quote", "b", "", "success", "")],
    "mint": [("invoke", "call", "mint", 77, "", "", "", "", "", "", ""),
             ("return", "", "", -1, "", "", "mint", "a", "", "success", "")],
    "mint_in": [("invoke", "call", "mint", 77, "mint", "h", "", "", "", "", ""),
                ("return", "", "", -1, "", "", "mint", "h", "a", "success", "")],
    "fail_root": [("invoke", "call", "router", 3, "base", "a", "", "", "", "", ""),
                  ("invoke", "call", "pool", 3, "base", "a", "", "", "", "", ""),
                  ("return", "", "", -1, "", "", "quote", "b", "", "success", ""),
                  ("return", "", "", -1, "", "", "", "", "", "failure", "")],
    "open": [("invoke", "call", "router", 3, "base", "a", "", "", "", "", ""),
             ("invoke", "call", "pool", 3, "base", "a", "", "", "", "", ""),
             ("return", "", "", -1, "", "", "quote", "b", "", "success", "")],
    "fail_child": [("invoke", "call", "router", 3, "base", "a", "", "", "", "", ""),
                   ("invoke", "call", "pool", 3, "base", "a", "", "", "", "", ""),
                   ("return", "", "", -1, "", "", "quote", "b", "", "failure", ""),
                   ("return", "", "", -1, "", "", "base", "a", "", "success", "")],
    "wrap": [("invoke", "call", "bridge", 77, "", "", "", "", "", "", ""),
             ("return", "", "", -1, "", "", "bridge", "a", "", "success", "")],
    "unwrap": [("invoke", "call", "bridge", 78, "bridge", "a", "", "", "", "", ""),
               ("return", "", "", -1, "", "", "", "", "", "odd", "")],
    "surplus": [("invoke", "call", "mint", 77, "", "", "", "", "", "", ""),
                ("return", "", "", -1, "", "", "", "", "", "success", "host"),
                ("return", "", "", -1, "", "", "mint", "a", "", "success", "")],
    "create": [("invoke", "call", "factory", 1, "", "", "", "", "", "", ""),
               ("create", "", "", -1, "", "", "", "", "", "", "created"),
               ("invoke", "call", "new", 0, "", "", "", "", "", "", ""),
               ("return", "", "", -1, "", "", "", "", "", "success", "keys"),
               ("return", "", "", -1, "", "", "", "", "", "success", "")],
}

SHAPE_SQL = """case event_type when 'view' then case when event_id % 2 = 0 then 'anchored' else 'buy' end when 'click' then 'sell'
  when 'purchase' then case event_id % 3 when 0 then 'mint_in' when 1 then 'mint' else 'surplus' end
  when 'error' then case event_id % 3 when 0 then 'fail_root' when 1 then 'open' else 'fail_child' end
  else case event_id % 3 when 0 then 'wrap' when 1 then 'unwrap' else 'create' end end"""


def _values() -> str:
    rows = [(shape, i, *s) for shape, steps in STEPS.items() for i, s in enumerate(steps)]
    return ",\n".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _name_sql(c: str) -> str:
    return (f"case {c} when 'router' then {ROUTER} when 'oracle' then {ORACLE} when 'factory' then {FACTORY} when 'bridge' then {BRIDGE} "
            f"when 'pool' then 5000 + pool_id when 'mint' then 7000 + user_id % 10 when 'new' then 100000 + event_id "
            f"when 'base' then base_id when 'quote' then quote_id end")


def _amount_sql(c: str) -> str:
    return f"case {c} when 'a' then a when 'b' then b when 'h' then a // 2 end"


CTES["tev"] = f"""
select event_id as trace_id, height, event_id as tx_idx, idx, event, ctype, {_name_sql('owner')} as owner, opcode,
       {_name_sql('in_tok')} as in_tok, {_amount_sql('in_amt')} as in_amt, {_name_sql('out_tok')} as out_tok, {_amount_sql('out_amt')} as out_amt,
       {_amount_sql('extra')} as extra_amt, case when status = 'odd' then case when event_id % 2 = 0 then 'failure' else 'success' end else status end as status,
       mark, shape, pool_id, base_id, quote_id, base_initial, quote_initial
from (select *, {SHAPE_SQL} as shape, cast(cents as hugeint) * 1000000 as a, cast(cents as hugeint) * 10000 * (45 + 7 * pool_id + event_id % 11) as b
      from ev join pools using (pool_id))
join (values {_values()}) s(shape, idx, event, ctype, owner, opcode, in_tok, in_amt, out_tok, out_amt, extra, status, mark) using (shape)
"""


def trace_events(t) -> DataFrame:
    """Trace events of every row of the events table (see STEPS), dealt by trace before a row becomes its events."""
    e = spread(t.ev.join(t.pools, "pool_id").withColumn("trace_id", F.col("event_id")), "trace_id")
    c = F.col("cents").cast(DEC)
    e = e.withColumns({"a": (c * 1000000).cast(DEC),
                       "b": (c * 10000 * (F.col("pool_id") * 7 + 45 + F.col("event_id") % 11)).cast(DEC),
                       "shape": F.expr(SHAPE_SQL)})
    e = e.withColumn("h", F.floor(F.col("a") / 2).cast(DEC))
    names = {"router": F.lit(ROUTER), "oracle": F.lit(ORACLE), "factory": F.lit(FACTORY), "bridge": F.lit(BRIDGE),
             "pool": F.col("pool_id") + 5000, "mint": F.col("user_id") % 10 + 7000, "new": F.col("event_id") + 100000,
             "base": F.col("base_id"), "quote": F.col("quote_id")}
    who = lambda n: (names[n] if n else F.lit(None)).cast("bigint")
    transfer = "array<struct<id:bigint,value:decimal(38,0)>>"

    def sheet(token: str, *amounts: str) -> Column:
        items = [F.struct(who(token).alias("id"), F.col(x).alias("value")) for x in amounts if x]
        return F.array(*items).cast(transfer)

    le = lambda x: F.array_join(F.transform(F.sequence(F.lit(15), F.lit(0), F.lit(-1)), lambda i: F.substring(
        F.lpad(F.lower(F.hex(x.cast("bigint"))), 32, "0"), (i * 2 + 1).cast("int"), F.lit(2))), "")
    reserves = F.concat(le(F.col("base_initial")), le(F.col("quote_initial")))
    kv = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))

    def step(i: int, s: tuple) -> Column:
        event, ctype, owner, op, in_tok, in_amt, out_tok, out_amt, extra, status, mark = s
        odd = F.when(F.col("event_id") % 2 == 0, "failure").otherwise("success")
        storage = F.array(kv(BASE_KEY, F.col("base_id")), kv(QUOTE_KEY, F.col("quote_id")), kv(FACTORY_KEY, F.lit(FACTORY))) \
            if mark == "keys" else F.array()
        return F.struct(
            F.lit(i).cast("bigint").alias("idx"), F.lit(event).alias("event"), F.lit(ctype or None).cast("string").alias("call_type"),
            who(owner).alias("myself"), (F.lit(FACTORY) if mark == "anchor" else F.lit(None)).cast("bigint").alias("caller"),
            (F.array(F.lit(op)) if op >= 0 else F.array()).cast("array<decimal(38,0)>").alias("inputs"),
            sheet(in_tok, in_amt).alias("incoming"), sheet(out_tok, out_amt, extra).alias("outgoing"),
            (odd if status == "odd" else F.lit(status or None)).cast("string").alias("status"),
            (reserves if mark == "reserves" else F.lit("aa" * 16) if mark == "host" else F.lit("")).alias("data"),
            storage.cast("array<struct<key:string,value:string>>").alias("storage"),
            (who("new") if mark == "created" else F.lit(None).cast("bigint")).alias("created"))

    steps = None
    for shape, rows in STEPS.items():
        arr = F.array(*[step(i, s) for i, s in enumerate(rows)])
        steps = F.when(F.col("shape") == shape, arr) if steps is None else steps.when(F.col("shape") == shape, arr)
    return e.select("trace_id", "height", F.col("event_id").alias("tx_idx"), F.explode(steps).alias("s")) \
        .select("trace_id", "height", "tx_idx", "s.*")
