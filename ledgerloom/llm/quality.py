"""Quality classifier: Bradley-Terry ranking learned from pairs of a good and a bad document.

Every text has a strength ``w . x`` over features of its style (shares of kinds of characters, word lengths, repetition). The chance
that a good document beats a bad one is the logistic of the difference of their strengths; ``w`` minimises the logistic loss on feature
differences of pairs. All labelled documents take part: they are dealt to groups, and each meets ``MEETINGS`` documents of the other kind
in its group, so that pairs grow with documents and not with their square. Newton's sums are added up in tasks; the driver solves
twenty equations. Strengths are cut at the exact quantile that the share of bad documents among the labelled ones gives, and
the score is the logistic of the strength shifted so that this cut has the score ``CUT``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import small_batches, sorted_groups, stage

#: Labelled documents to fit on (the first ones by hash of their id); None: all.
SAMPLE = None
#: Labelled documents of a group, the least number of each kind in it (documents of a rare kind are in several groups), and pairs of a document.
GROUP, LEAST, MEETINGS = 512, 64, 8
#: Weight of the ridge, and Newton's steps, at most.
RIDGE, STEPS = 1e-2, 12
#: Bins of one pass that looks for a quantile.
BINS = 4096
#: The score at which a document counts as good.
CUT = 0.3
#: Features of a text.
WIDTH = 20
#: Frequent function words of four languages (fixed values).
STOP = frozenset("the of and to in is that it for on was with as be at by this are le la de et les des en un une du que est pour "
                 "qui dans der die und das ist nicht ein eine zu den mit el los las y que por con para se del su al".split())
SYMBOLS = re.compile(r"[^\w\s.,;:'\"!?()\-]")
MARKS = re.compile(r"[.,;:!?]")


def features(text: str | None) -> list[float]:
    """Style of a whole text; null and empty texts have zeros and the marker of emptiness."""
    text = text or ""
    words = text.split()
    n, m = len(words), len(text)
    if not n:
        return [0.0] * (WIDTH - 1) + [1.0]
    lower = text.lower()
    distinct = len(set(lower.split()))
    lines = text.split("\n")
    letters = sum(map(len, words))
    caps = sum(1 for w in words if w.isupper() and len(w) > 1)
    symbols = len(SYMBOLS.findall(text))
    upper = m - len(re.sub(r"[A-ZÀ-ÖØ-Þ]", "", text))
    digits = len(re.findall(r"\d", text))
    return [
        np.log1p(n), letters / n / 8, distinct / n, distinct / np.sqrt(n) / 10, caps / n, symbols / m, np.sqrt(symbols / m),
        upper / m, np.sqrt(upper / m), digits / m, np.sqrt(digits / m), len(MARKS.findall(text)) / n, text.count("!") / n, text.count("|") / n,
        sum(1 for w in words if w.strip(".,;:!?").lower() in STOP) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        max(map(len, words)) / 40, len(re.findall(r"[.!?]\s", text)) / n, 0.0,
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in column.to_pylist()], dtype=float).reshape(-1, WIDTH)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, h, f, y) of the labelled documents whose crc32(doc_id) mod 5 is not 0, all of them without SAMPLE; repeated rows are one document.

    Labels that disagree about one document count as their majority (a tie as good); rows without label or id are left out.
    """
    learnt = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = (labels.where("quality is not null and doc_id is not null").where(learnt)
             .groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(list(_matrix(b.column(2))), pa.list_(pa.float64()))], ["_id", "h", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.where("doc_id is not null").where(learnt).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("h"), "text")
    rows = made.mapInArrow(run, f"_id {kind}, h long, f array<double>").join(known, "_id")  # features, not texts, are dealt
    once = rows.groupBy(F.xxhash64("_id").alias("k"), "h").agg(F.first("f").alias("f"), F.first("y").alias("y"))
    return once if SAMPLE is None else once.orderBy(F.xxhash64("k", "h"), "k", "h").limit(SAMPLE)


def _sums(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of the arrays that ``fn`` makes of the batches; each task adds up its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            part = fn(b)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    rows = df.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value")).collect()
    return np.array([v for _, v in sorted(rows)])


def _floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, WIDTH)


def groups(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """(id, good, bad): features of the documents that meet each other. Every document is in a group, with some LEAST or more of the other kind
    in the mean; documents of a kind too rare for that are in several groups."""
    n = max(1, (good + bad) // GROUP)
    copies = F.when(F.col("y") == 1, max(1, -(-LEAST * n // good))).otherwise(max(1, -(-LEAST * n // bad)))
    copies = F.least(copies, F.lit(n))
    # consecutive groups from a hashed one: copies of a document are in different groups
    dealt = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    dealt = dealt.select(((F.pmod(F.xxhash64("k", "h"), F.lit(n)) + F.floor(F.col("copy") * n / copies)) % n).cast("long").alias("id"), "k", "h", "f", "y")

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((group.column("h").to_numpy(), group.column("k").to_numpy()))
        f, y = _floats(group.column("f").combine_chunks())[order], group.column("y").to_numpy()[order]
        sides = [pa.array([f[y == side].tobytes()], pa.binary()) for side in (1, 0)]
        yield pa.RecordBatch.from_arrays([group.column("id").combine_chunks()[:1], *sides], ["id", "good", "bad"])

    return sorted_groups(dealt, ["id"], run, "id long, good binary, bad binary")


def _differences(b: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """Of each group, features of good minus bad documents: each document of the larger kind is in MEETINGS pairs, each of the smaller in as many or more."""
    for key, *sides in zip(*(c.to_pylist() for c in b.columns)):
        good, bad = (np.clip((np.frombuffer(s).reshape(-1, WIDTH) - mean) / scale, -6, 6) for s in sides)
        if len(good) and len(bad):
            rng = np.random.default_rng((seed, key))
            n = max(len(good), len(bad))
            for _ in range(MEETINGS):
                yield good[rng.permutation(n) % len(good)] - bad[rng.permutation(n) % len(bad)]


def nth_gap(values: DataFrame, n: int) -> float:
    """Middle between the ``n``-th and the next of the sorted numbers ``s`` (the last: itself), found by exact counts in ever smaller ranges."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    above = high
    while low < high:
        place = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = values.where(F.col("s").between(low, high)).groupBy(place.alias("p")).agg(F.count("*").alias("c"), F.min("s").alias("a"), F.max("s").alias("z"))
        bins = sorted(bins.collect())  # BINS rows at most
        at = 0
        while n > bins[at].c:
            n -= bins[at].c
            at += 1
        low, high, above = bins[at].a, bins[at].z, bins[at + 1].a if at + 1 < len(bins) else above
        last = n == bins[at].c
        if low == high:
            return (low + above) / 2 if last else low
    return low


def fit(rows: DataFrame, seed: int = 7) -> dict:
    """Weights, scaling and cut from features and labels (k, h, f, y); without both kinds of label every document has the same strength."""
    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _floats(b.column(0))
        return np.concatenate(([len(x), b.column(1).to_numpy().sum()], x.sum(0)))

    sums = _sums(rows.select("f", "y"), moments)
    n, good = (int(sums[0]), int(sums[1])) if len(sums) else (0, 0)
    bad = n - good
    if not (good and bad):
        return {"mean": np.zeros(WIDTH), "scale": np.ones(WIDTH), "w": np.zeros(WIDTH), "cut": 10.0 if bad else 0.0}
    mean = sums[2:] / n
    scale = np.sqrt(_sums(rows.select("f"), lambda b: ((_floats(b.column(0)) - mean) ** 2).sum(0)) / n) + 1e-6
    met = stage(groups(rows, good, bad))
    w = np.zeros(WIDTH)
    for _ in range(STEPS):  # Newton's method on the logistic loss of the differences
        def step(b: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            out = np.zeros(1 + WIDTH + WIDTH * WIDTH)
            for diff in _differences(b, mean, scale, seed):
                p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance of the wrong winner
                out += np.concatenate(([len(p)], diff.T @ p, ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()))
            return out

        sums = _sums(met, step)
        pairs = max(sums[0], 1)
        slope = sums[1:1 + WIDTH] / pairs - RIDGE * w
        change = np.linalg.solve(sums[1 + WIDTH:].reshape(WIDTH, WIDTH) / pairs + RIDGE * np.eye(WIDTH), slope)
        w = w + change
        if np.abs(change).max() < 1e-9:
            break

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((_floats(b.column(0)) - mean) / scale, -6, 6) @ w)], ["s"])

    return {"mean": mean, "scale": scale, "w": w, "cut": nth_gap(stage(rows.select("f").mapInArrow(strengths, "s double")), bad)}


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and all columns of ``docs`` nested in ``row``.

    Repeated rows score alike; a null or empty text gets the score of its (zero) features.
    """
    small_batches(docs.sparkSession)
    model = fit(stage(training_rows(docs, labels)))
    shift = np.log(CUT / (1 - CUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.clip((_matrix(b.column(1)) - model["mean"]) / model["scale"], -6, 6)
            s = 1 / (1 + np.exp(-np.clip(z @ model["w"] - model["cut"] + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["row", "score", "predicted"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    schema = T.StructType([*docs.select(row).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    scored = docs.select(row, "text").mapInArrow(run, schema)
    return scored.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted", "row")
