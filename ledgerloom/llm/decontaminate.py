"""Benchmark decontamination: prefix-filtered set join of documents with item-sized windows, in DataFrame operations only.

The words of the benchmark are ordered by how often the documents use them. A document can only hold a window if it holds each of its words, so the
rarest word is the prefix that a full containment needs: document words are joined on it alone. A candidate fixes where the window would
have to begin (positional bound) and must lie inside the document (length bound); its words are then compared one by one, all candidates
of a document within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import join_key, keyed, stage

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that belong to no word: all but digits and letters.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: A table of words is broadcast up to this many rows (some 20 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; null has none. All gaps become spaces, so that the split needs no pattern."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS)), " "), "")


def _small(df: DataFrame) -> DataFrame:
    """The staged table, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(w, k, items): each distinct window, its number of words and the items that have it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    cut = items.select("item", "ws", F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - (size - 1), F.lit(1)))).alias("at"))
    return cut.groupBy(F.slice("ws", F.col("at"), F.lit(size)).alias("w")).agg(F.collect_set("item").alias("items")).withColumn("k", F.size("w"))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Where windows occur: d, h, at (first word, from 1), k (words) and the items of the window."""
    wins = stage(windows(benchmark, size).withColumn("id", F.monotonically_increasing_id()))
    vocabulary = stage(wins.select(F.explode("w").alias("word")).distinct())
    words = keyed(docs).select("d", "h", words_of(F.col("text")).alias("ws"))
    common = words.select(F.explode("ws").alias("word")).join(_small(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = wins.select("id", F.posexplode("w").alias("p", "word")).join(common, "word")
    complete = ranked.groupBy("id").agg(F.min(F.struct("n", "word", "p")).alias("f"), F.count("*").alias("c"))
    prefix = stage(complete.join(wins, "id").where("c = k").select(F.col("f.word").alias("word"), F.col("f.p").alias("p"), "w", "k", "items"))
    # a window with a word that no document has cannot occur, so c < k leaves it out
    spots = words.select("d", "h", F.posexplode("ws").alias("at", "word")).join(_small(prefix), "word").withColumn("first", F.col("at") - F.col("p") + 1).where("first >= 1")
    cands = spots.groupBy("d", "h").agg(F.collect_set(F.struct("first", "k", "w", "items")).alias("cands"))
    held = join_key(keyed(docs), cands, "inner").select("d", "h", words_of(F.col("text")).alias("ws"), "cands")
    same = F.filter("cands", lambda c: (c["first"] + c["k"] - 1 <= F.size("ws")) & (F.slice("ws", c["first"], c["k"]) == c["w"]))
    return held.select("d", "h", F.explode(same).alias("c")).select("d", "h", F.col("c.first").alias("at"), "c.k", "c.items")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` in ``row`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    Rows that agree in doc_id and text have equal results. Null and empty texts have no words; an item without words has no window; windows
    of items without id hit words but name no item.
    """
    found = stage(occurrences(docs, benchmark, size).distinct())
    order = Window.partitionBy("d", "h").orderBy("at", F.desc("end"))
    spans = found.select("d", "h", "at", (F.col("at") + F.col("k")).alias("end")).distinct()
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hit = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("at", F.coalesce(before, F.lit(0))))).groupBy("d", "h").agg(F.sum("new").alias("n_hit"))
    items = found.select("d", "h", F.explode("items").alias("item")).groupBy("d", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = join_key(hit, items, "left")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = keyed(docs, row).select("d", "h", "row", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return join_key(sized, both, "left").select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
