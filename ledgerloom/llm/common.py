"""Helpers shared by the training-data operators.

A document is identified by ``doc_id`` and the hash of its text: rows that agree in both are one document repeated and get
equal results; one ``doc_id`` with several texts names several documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.session import stage  # noqa: F401  (re-exported for the operators)

#: ASCII white space; everything else belongs to words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd multiplier and its inverse modulo 2**64, for hashes of byte ranges from prefix sums.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Rows of an Arrow batch; long texts make larger batches too big for a worker.
BATCH_ROWS = 500
#: Bytes of text that numpy looks at in one go; its arrays take some sixty times as much.
CHUNK_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in small Arrow batches, so that very long texts fit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """``d`` (doc_id), ``h`` (hash of the text), ``text`` and further columns of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text", *extra)


def join_key(left: DataFrame, right: DataFrame, how: str, keys: tuple[str, ...] = ("d", "h")) -> DataFrame:
    """Join on columns that may be null; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def once(docs: DataFrame) -> DataFrame:
    """``d``, ``h`` and ``text`` of each document, without repeated rows; no text moves but those of repeated documents."""
    rows = keyed(docs)
    again = stage(rows.groupBy("d", "h").agg(F.count("*").alias("c")).where("c > 1").select("d", "h"))
    if not again.limit(1).count():
        return rows
    return join_key(rows, again, "left_anti").union(join_key(rows, again, "left_semi").dropDuplicates(["d", "h"]))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: the 64-bit hash and the text number of every word, and each text's first word (and the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power = np.full(len(buf) + 1, BASE, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(len(buf) + 1, INVERSE, dtype=np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, offsets)
    return hashes, np.repeat(np.arange(len(texts)), np.diff(first)), first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (also across texts; the caller leaves those out)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + words[k:len(words) - n + 1 + k]
    return mix(out)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about CHUNK_BYTES together, with the number of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def as_bytes(column: pa.Array, lower: bool = False) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    raw = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
    return [t.lower() for t in raw] if lower else raw


def lists(values: np.ndarray, counts: Iterable[int], kind: pa.DataType) -> pa.Array:
    """Arrow lists of the given lengths over consecutive values."""
    offsets = np.concatenate(([0], np.cumsum(np.asarray(list(counts), dtype=np.int64)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def larger(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, for narrow rows that numpy handles many at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of sorted Arrow batches, one key at a time; only one key's rows are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def sorted_groups(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """Give each key's rows (an Arrow table) to ``fn``, which yields record batches; groups stream through a task one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            yield from fn(table)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
