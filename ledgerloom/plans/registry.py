"""Query registration: a Spark plan and, where one exists, its SQL counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .facts import Facts
from .facts_sql import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Wide decimals as text, so that values compare exactly across engines."""
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema])


def with_ctes(body: str) -> str:
    """Prefix the named subqueries that ``body`` refers to, directly or not."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, sub in CTES.items():
            if name not in seen and re.search(rf"(?:\bfrom|\bjoin|,)\s+{name}\b", text):
                seen.add(name)
                visit(sub)
                needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} as (\n{CTES[n].strip()}\n)" for n in needed)
    return f"with {ctes}\n{body.strip()}"


def query(name: str, sql: str | None = None, text: str = "", ints: str = ""):
    """Register a plan.  ``text`` / ``ints`` list SQL columns to cast for comparison."""

    def deco(fn: Callable[[Facts], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Facts(spark, sf_dir)))
        if sql is not None:
            body = sql.strip()
            casts = [f"cast({c} as varchar) as {c}" for c in text.split()] + \
                    [f"cast({c} as bigint) as {c}" for c in ints.split()]
            if casts:
                if body.lower().startswith("with "):
                    raise ValueError(f"{name}: start the body with select")
                body = f"select * replace ({', '.join(casts)}) from (\n{body}\n) q"
            ORACLES[name] = with_ctes(body)
        return fn

    return deco
