"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a set of words weighted by how often they occur. For each of SAMPLES samples every (word, weight w) draws r and c from Gamma(2, 1) and beta from
(0, 1), all from hashes of the word and the sample, never of the text: t = floor(ln w / r + beta), and ln a = ln c - r (t - beta + 1). The sample of a
text is the (word, t) of the least a, kept as 16 bits of a hash. Two texts have equal samples with the chance of their generalised Jaccard similarity
(sum of least over sum of greatest weights), so likeness is the share of equal samples. Weights need not be whole numbers, and a word is one row however often it occurs.

r and ln c come from tables of quantiles: r is one of CELLS equally likely ones, ln c lies on a line between two, or, below the TAIL first cells, where
the least a is found, on the series of the inverse distribution (to within 1e-4 of c).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import once, stage

SAMPLES = 128
#: Samples of a row while they are drawn; more make the generated code too long to be compiled.
STEP = 4
CELLS, TAIL = 1024, 16
#: Characters of a partition: each of its words is a row of an aggregate that should fit in memory. Smaller ones hold less and repeat more.
PART_CHARS = 8_000_000
#: A null doc_id comes after all others in descending order.
LAST = -(1 << 63)


def gamma_quantiles(u: np.ndarray) -> np.ndarray:
    """Inverse of the distribution 1 - exp(-x) (1 + x) of Gamma(2, 1), by bisection."""
    low, high = np.zeros(len(u)), np.full(len(u), 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        less = 1 - np.exp(-mid) * (1 + mid) < u
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


def _table(values: np.ndarray) -> Column:
    return F.expr(f"array({', '.join(f'{x:.12g}D' for x in values)})")


def least_samples(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``g`` and k0 to k{STEP-1}: the least keys of samples g to g + STEP - 1 of (``keys``, term, w) rows.

    A key holds ln a in its upper 48 bits and the hash of (term, t) in its lower 16. One hash of (term, sample) gives c (34 bits), beta (20) and r (10).
    """
    edges = gamma_quantiles(np.concatenate(([1e-9], np.arange(1, CELLS) / CELLS, [1 - 0.25 / CELLS])))
    r = gamma_quantiles((np.arange(CELLS) + 0.5) / CELLS)
    tables = {"tc": np.log(edges)[:-1], "td": np.diff(np.log(edges)), "tr": r, "tq": 1 / r}
    each = range(STEP)
    rows = weighted.select(*keys, "term", F.log("w").alias("lw"), F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1), F.lit(STEP))).alias("g"))
    rows = rows.select("*", *[_table(v).alias(k) for k, v in tables.items()], *[F.xxhash64("term", F.col("g") + i).alias(f"h{i}") for i in each])
    cell, within, which = "shiftrightunsigned(h{i}, 54)", f"(shiftrightunsigned(h{{i}}, 30) & 16777215L) * {2**-24!r}D", f"(h{{i}} & {CELLS - 1}L)"
    s = f"sqrt(({cell} + {within}) * {2 / CELLS!r}D)"
    lnc = f"if({cell} < {TAIL}L, coalesce(ln({s} * (1D + {s} * ({1 / 3!r}D + {s} * {11 / 72!r}D))), -99D), tc[{cell}] + {within} * td[{cell}])"
    beta = f"((shiftrightunsigned(h{{i}}, 10) & 1048575L) + 0.5D) * {2**-20!r}D"
    rows = rows.select("*", *[F.expr(f"floor(lw * tq[{which}] + {beta})".format(i=i)).alias(f"t{i}") for i in each])
    key = f"shiftleft(floor(({lnc} - tr[{which}] * (t{{i}} - {beta} + 1D)) * {2**39}D), 16) | ((shiftrightunsigned(h{{i}}, 10) ^ (t{{i}} * 40503L)) & 65535L)"
    return rows.groupBy(*keys, "g").agg(*[F.min(F.expr(key.format(i=i))).alias(f"k{i}") for i in each])


def signatures(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``own`` and ``changed``: SAMPLES 16-bit samples of the words of ``text`` and of ``edited`` (-1: it has none).

    Texts without words in both are left out. Words that occur as often in both are drawn once. No shuffle is needed if rows are dealt by some of ``keys``.
    """
    both = texts.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    words = both.select(*keys, "x.kind", F.explode(F.split(F.coalesce("x.text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    counts = words.select(*keys, F.xxhash64("w").alias("term"), F.expr("cast(1 - kind as bigint)").alias("a"), F.expr("cast(kind as bigint)").alias("b")).groupBy(*keys, "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cases = F.expr("case when a = b then array(struct(2 as kind, a as w)) when b = 0 then array(struct(0 as kind, a as w)) when a = 0 then array(struct(1 as kind, b as w)) "
                   "else array(struct(0 as kind, a as w), struct(1 as kind, b as w)) end")
    least = least_samples(counts.select(*keys, "term", F.explode(cases).alias("x")).select(*keys, "x.kind", "term", "x.w"), [*keys, "kind"])
    halves = least.groupBy(*keys, "g").agg(*[F.min(F.when(F.col("kind") != other, F.col(f"k{i}"))).alias(f"{name}{i}") for name, other in (("own", 1), ("changed", 0)) for i in range(STEP)])
    part = [F.array(*[F.coalesce(F.col(f"{name}{i}").bitwiseAND(F.lit(0xFFFF)).cast("int"), F.lit(-1)) for i in range(STEP)]).alias(name) for name in ("own", "changed")]
    steps = halves.select(*keys, "g", *part).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("g", "own", "changed"))).alias("steps"))
    return steps.select(*keys, *[F.flatten(F.col(f"steps.{name}")).alias(name) for name in ("own", "changed")])


def no_words() -> Column:
    return F.array_repeat(F.lit(-1), SAMPLES)


def text_form(sig: Column) -> Column:
    """Four hexadecimal digits a sample, or dashes for a text without words."""
    return F.array_join(F.transform(sig, lambda x: F.when(x < 0, F.lit("----")).otherwise(F.lower(F.lpad(F.hex(x), 4, "0")))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 if one has none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda p: p))
    return same / F.lit(SAMPLES)


def neighbours(ids: DataFrame) -> DataFrame:
    """The rows of ``ids`` with (no, nh): the document after each by falling doc_id (after the last: the first).

    Documents are dealt by ranges of doc_id; a window orders each range, and only the first documents of ranges, one a partition, are ordered together.
    """
    placed = stage(ids.repartitionByRange("o", "h").withColumn("part", F.spark_partition_id()))
    inside = placed.withColumn("next", F.lead(F.struct("o", "h")).over(Window.partitionBy("part").orderBy(F.desc("o"), F.desc("h"))))
    heads = placed.groupBy("part").agg(F.max(F.struct("o", "h")).alias("head"))
    down, every = Window.orderBy(F.desc("part")), Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    linked = heads.select("part", F.coalesce(F.lead("head").over(down), F.first("head").over(every)).alias("after"))
    joined = inside.join(linked, "part").withColumn("next", F.coalesce("next", "after"))
    return joined.select(*ids.columns, F.col("next.o").alias("no"), F.col("next.h").alias("nh"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Rows that agree in doc_id and text are one document in the order and have equal results; a single document is its own next. Null texts are empty; texts
    without words have a fingerprint of dashes. Very long texts are rows of words like others; only the array of one text's words is held at once.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("o"), F.xxhash64("text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    texts = once(docs).select(F.coalesce("d", F.lit(LAST)).alias("o"), "h", F.coalesce("text", F.lit("")).alias("text"))
    lengths = stage(ids.groupBy("o", "h").agg(F.first("n").alias("n"), F.first("doc_id").alias("doc_id"), F.count("*").alias("rows")))
    follow = stage(neighbours(lengths))
    chars = lengths.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // PART_CHARS + 1)
    dealt = texts.repartition(parts, "o", "h")
    wanted = follow.select(F.col("no").alias("o"), F.col("nh").alias("h"), F.col("o").alias("po"), F.col("h").alias("ph"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    begun = dealt.join(wanted.repartition(parts, "o", "h"), ["o", "h"]).select(F.col("po").alias("o"), F.col("ph").alias("h"), F.expr("substring(text, 1, take)").alias("begin"), "take")
    whole = dealt.join(begun.repartition(parts, "o", "h"), ["o", "h"])
    pairs = whole.select("o", "h", "text", F.concat(F.expr("substring(text, 1, char_length(text) - take)"), F.col("begin")).alias("edited"))
    facts = pairs.select("o", "h", F.sha2("edited", 256).alias("edited_sha256"), F.char_length("text").cast("long").alias("n_chars"))
    held = stage(facts.join(signatures(pairs, ["o", "h"]), ["o", "h"], "left").select(
        "o", "h", "edited_sha256", "n_chars", F.coalesce("own", no_words()).alias("own"), F.coalesce("changed", no_words()).alias("changed")))
    after = follow.select("o", "h", "no", "nh", "doc_id", "rows").join(held.select(F.col("o").alias("no"), F.col("h").alias("nh"), F.col("own").alias("other")), ["no", "nh"])
    done = held.join(after.drop("no", "nh"), ["o", "h"]).select(
        "o", "h", "doc_id", "rows", "n_chars", "edited_sha256", text_form(F.col("own")).alias("fingerprint"), text_form(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"))
    again = ids.select("o", "h").join(done.where("rows > 1"), ["o", "h"])  # only repeated rows are joined back
    return done.where("rows = 1").unionByName(again.select(*done.columns)).drop("o", "h", "rows")
