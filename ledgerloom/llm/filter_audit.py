"""Audit of how filters interact: what each filter removes in every order in which they can be applied.

Every document gets a mask of the filters that it fails. Masks are counted per part before anything is enumerated, so the enumeration sees at most 2^filters
cells a part, whatever the number of documents. A recursive query extends filter prefixes by each unused letter, carries the bits applied so far,
joins the cells of the part, and emits the metrics of that step; five levels give all orders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Letters of the filters in the order of their bits; the last, exact duplicates, needs the whole table.
LETTERS = "ABCDE"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: A (1) under 100 words, B (2) too few distinct words, C (4) too many capitals, D (8) marks of markup or code."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    bits = (n < 100, F.lit(100).cast("long") * distinct < F.lit(80).cast("long") * n, F.lit(100).cast("long") * capitals > F.lit(10).cast("long") * F.char_length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, and how many of them are labelled good or toxic.

    Rows meet by digest, never by text, and equal (digest, part, doc_id) rows are counted first, so that a text that holds a third of all rows is a few
    rows by the time its copies meet. A copy fails E if a smaller doc_id has its text; rows without doc_id have no smaller and are none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("d"), F.sha2(text, 256).alias("digest"), text_mask(text).alias("mask"))
    counted = rows.groupBy("d", "digest", "part", "mask").agg(F.count("*").alias("c"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("d")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("g"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("t"))
    known = counted.join(marks, "d", "left").select("digest", "part", "mask", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("t", F.lit(0)).alias("t"), "d", "c")
    # Per text, part and label at most a few rows: all documents, those without doc_id, the smallest doc_id and how often it occurs.
    kinds = stage(known.groupBy("digest", "part", "mask", "g", "t").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("d").isNull(), F.col("c")).otherwise(0)).alias("unnamed"),
                                                                     F.min("d").alias("least"), F.min_by("c", "d").alias("at_least")))
    first = kinds.groupBy("digest").agg(F.min("least").alias("first")).where("first is not null")
    # The rows of a kind that have the first doc_id of the text; one doc_id in several kinds is first in each.
    both = kinds.join(first, "digest", "left")
    kept = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = both.select("part", "mask", "g", "t", F.explode(F.array(F.struct(F.lit(0).alias("copy"), kept.alias("n")), F.struct(F.lit(1).alias("copy"), (F.col("n") - kept).alias("n")))).alias("x")).where("x.n > 0")
    mask = F.col("mask") + F.col("x.copy") * (1 << (len(LETTERS) - 1))
    return split.select("part", mask.cast("int").alias("mask"), F.col("x.n").alias("n"), "g", "t").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("good"), F.sum(F.col("n") * F.col("t")).alias("toxic"))


#: A part's cells are one array, joined at each level; the letters are those of the masks' bits. A step's metrics are sums over the cells of the part.
STEPS = """
with recursive walk(part, prefix, applied, step, metrics) as (
  select part, '', 0, 0, cast(array() as array<struct<filter:string, kept:bigint, removed:bigint, redundant:bigint, unique_fails:bigint, good_lost:bigint, toxic_lost:bigint>>)
  from {cells}
  union all
  select w.part, concat(prefix, l.letter), applied | l.bit, step + 1, concat(metrics, array(named_struct(
    'filter', l.letter,
    'kept', aggregate(cells, 0L, (s, x) -> s + if(x.mask & (applied | l.bit) = 0, x.n, 0L)),
    'removed', aggregate(cells, 0L, (s, x) -> s + if(x.mask & l.bit <> 0 and x.mask & applied = 0, x.n, 0L)),
    'redundant', aggregate(cells, 0L, (s, x) -> s + if(x.mask & l.bit <> 0 and x.mask & applied <> 0, x.n, 0L)),
    'unique_fails', aggregate(cells, 0L, (s, x) -> s + if(x.mask = l.bit, x.n, 0L)),
    'good_lost', aggregate(cells, 0L, (s, x) -> s + if(x.mask & l.bit <> 0 and x.mask & applied = 0, x.good, 0L)),
    'toxic_lost', aggregate(cells, 0L, (s, x) -> s + if(x.mask & l.bit <> 0 and x.mask & applied = 0, x.toxic, 0L)))))
  from (select *, explode(filter(array({letters}), y -> applied & y.bit = 0)) as l from walk) w join {cells} c on c.part = w.part
)
select part, prefix as filter_order, posexplode(metrics) as (at, m) from walk where step = {steps}
"""


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of all ``letters`` and step, from (part, mask, n, good, toxic) cells with bit k of the mask for letter k.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (what the step's filter removes, summed over all orders), zeros included.
    """
    spark = cells.sparkSession
    arrays = cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))  # at most 2^letters a part
    name = f"mask_cells_{uuid.uuid4().hex}"
    stage(arrays).createOrReplaceTempView(name)
    pairs = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << k})" for k, c in enumerate(letters))
    orders = spark.sql(STEPS.format(letters=pairs, cells=name, steps=len(letters)))
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # some 326 rows a part, however many parts there are
    try:
        rows = stage(orders.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "m.*"))
    finally:
        spark.conf.set(ROW_LIMIT, limit)
        spark.catalog.dropTempView(name)
    total = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(total, ["part", "filter"]).select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, text, lang) with labels (doc_id, quality, toxic).

    Null texts are empty, null langs an empty part; each row is a document, repeated rows too; a doc_id labelled several times is good (toxic) if any label says so.
    An empty table has no parts and no rows. A very long text is measured by itself, in one row.
    """
    return audit(stage(mask_cells(docs, labels)))
