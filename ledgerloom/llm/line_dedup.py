"""Line dedup: prefix doubling over the line sequences of all documents, and deletion of later copies of repeated runs.

The lines that hold words form one sequence per document. Level 0 names every line that occurs more than once; level k+1 names the run
of 2^(k+1) lines at a position by the pair of level-k names at the position and 2^k lines on. Names of a level are the ranks of its sorted
groups, so suffixes with one name are an interval of the suffix array (to depth 2^k) whose longest common prefix is 2^k lines or
more; suffixes without a partner leave at once. A run of any length is the pair of names of two overlapping power-of-two runs.

A run counts as repeated when it holds ``min_words`` words. Every maximal repeated run is the union of its shortest parts of that size (those that begin
at a line and those that end at one), so doubling ends at their longest, and deeper prefixes cannot change what is deleted. Each line inside
such a part that has begun earlier (by doc_id, then line) is deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import join_key, keyed, once, small_batches, stage

#: Words that a run of lines must have to count as a repeated passage.
MIN_WORDS = 20

LINES = ("d long, h long, i int, a long, b long, n int, fore int, back int")


def shortest_runs(words: list[int], least: int) -> tuple[list[int], list[int]]:
    """For each line, how many lines from it on (and up to it) have ``least`` words; 0 where the document has too few."""
    n = len(words)
    sums = np.concatenate(([0], np.cumsum(words)))
    end = np.searchsorted(sums, sums[:-1] + least)
    fore = np.where(end <= n, end - np.arange(n), 0)
    start = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    back = np.where(start >= 0, np.arange(n) + 1 - start, 0)
    return fore.tolist(), back.tolist()


def _kept_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line with words of each document (repeated rows once): document, number, 128-bit content, words, and the lines of the shortest runs from and up to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for d, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(hashlib.blake2b(x.encode(), digest_size=16).digest(), n) for x in _kept_lines(text) if (n := len(x.split()))]
                if not rows:
                    continue
                words = [n for _, n in rows]
                ids = np.frombuffer(b"".join(x for x, _ in rows), dtype=np.int64)
                fore, back = shortest_runs(words, min_words)
                for column, values in zip(out, ([d] * len(rows), [h] * len(rows), range(len(rows)), ids[::2].tolist(), ids[1::2].tolist(), words, fore, back)):
                    column.extend(values)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["d", "h", "i", "a", "b", "n", "fore", "back"])

    return once(docs).mapInArrow(run, LINES)


def _ranked(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Groups of (a, b) with several positions, ranked in order: (a, b, r)."""
    groups = rows.groupBy(a, b).agg(F.count("*").alias("c")).where("c > 1").select(a, b)
    return stage(groups.orderBy(a, b).withColumn("r", F.monotonically_increasing_id()))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Shortest repeated runs that have begun earlier: d, h, i (first line), m (lines)."""
    lines = stage(line_table(docs, min_words))
    ranks = _ranked(lines, "a", "b")
    names = stage(lines.join(ranks, ["a", "b"]).select("d", "h", "i", "fore", "back", "r"))
    wanted = stage(names.select("d", "h", F.explode(F.array(
        F.struct(F.col("i"), F.col("fore").alias("m")), F.struct((F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("m")))).alias("w"))
        .select("d", "h", "w.i", "w.m").where("m > 0").distinct())
    row = wanted.agg(F.max("m")).first()
    longest = row[0] or 0
    level, span, hits = names.select("d", "h", "i", "r"), 1, []
    while span <= longest:
        here = wanted.where(F.col("m").between(span, 2 * span - 1))
        begun = join_key(here, level, "inner", ("d", "h", "i"))
        if span > 1:
            tail = level.select("d", "h", F.col("i").alias("j"), F.col("r").alias("s"))
            begun = join_key(begun.withColumn("j", F.col("i") + F.col("m") - span), tail, "inner", ("d", "h", "j"))
        else:
            begun = begun.withColumn("s", F.col("r"))
        firsts = begun.groupBy("m", "r", "s").agg(F.min(F.struct(F.col("d").isNull().alias("z"), "d", "h", "i")).alias("f"), F.count("*").alias("c")).where("c > 1")
        later = begun.join(firsts, ["m", "r", "s"]).where(F.struct(F.col("d").isNull().alias("z"), "d", "h", "i") > F.col("f"))
        hits.append(stage(later.select("d", "h", "i", "m")))
        span *= 2
        if span > longest:
            break
        half = span // 2
        pairs = join_key(level.withColumn("j", F.col("i") + half), level.select("d", "h", F.col("i").alias("j"), F.col("r").alias("s")), "inner", ("d", "h", "j")).select("d", "h", "i", "r", "s")
        level = stage(_renamed(stage(pairs)))
    out = hits[0] if hits else names.select("d", "h", "i", F.lit(1).alias("m")).limit(0)
    for x in hits[1:]:
        out = out.unionByName(x)
    return out


def _renamed(pairs: DataFrame) -> DataFrame:
    """Pairs of names replaced by the rank of the pair; pairs that occur once are left out."""
    p = pairs.select("d", "h", "i", F.col("r").alias("p"), F.col("s").alias("q"))
    return p.join(_ranked(p, "p", "q"), ["p", "q"]).select("d", "h", "i", "r")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` in ``row`` with the text that is left in ``kept``, and n_lines, n_removed, words_removed.

    Lines without words stay as they are. Rows that agree in doc_id and text are one document, so neither is a copy of the other. A null
    text has no lines and stays null; a null doc_id comes after all others.
    """
    small_batches(docs.sparkSession)
    runs = repeated_runs(docs, min_words).groupBy("d", "h").agg(F.collect_set(F.struct("i", "m")).alias("runs"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = join_key(keyed(docs, row), runs, "left").select("row", "text", "runs")
    schema = T.StructType([found.schema["row"], *T._parse_datatype_string("kept string, n_lines long, n_removed long, words_removed long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone, gone_words = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                dropped = {x for s in spans or () for x in range(s["i"], s["i"] + s["m"])}
                out, at, words = [], 0, 0
                for x in _kept_lines(text):
                    n = len(x.split())
                    if n and at in dropped:
                        words += n
                    else:
                        out.append(x)
                    at += n > 0
                kept.append(None if text is None else "\n".join(out) if dropped else text)
                total.append(at)
                gone.append(len(dropped))
                gone_words.append(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), *(pa.array(v, pa.int64()) for v in (total, gone, gone_words))],
                                             ["row", "kept", "n_lines", "n_removed", "words_removed"])

    return found.mapInArrow(run, schema)
