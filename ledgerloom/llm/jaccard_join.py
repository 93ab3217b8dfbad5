"""N-gram Jaccard join by chosen paths: every pair of different shingle sets with a Jaccard similarity of ``threshold`` or more.

A set of five-word shingles follows, in each run, the paths of the shingles it chooses: those whose hash for this run is below ``rate / |set|``.
Two sets meet in a bucket if they choose a shared shingle. Buckets of more than ``small`` sets split on further chosen shingles of their members, with a rate of
DEEP_RATE, as long as a split separates them. The worst pair has one set inside the other and all its buckets split DEPTH times; RUNS and DEEP_RATE are such
that of such pairs with similarity 0.8 one in 5000 is missed (``least_recall``); what stays together is compared in blocks, so that no bucket has a cap and none meets in one task.
Of buckets with the same members one is kept, and each pair is compared in the smallest bucket that it
shares. Equal sets are one class and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, chunks, gram_hashes, join_key, keyed, lists, mix, small_batches, sorted_groups, stage, word_hashes

WORDS, THRESHOLD, RUNS, SMALL, BLOCK, DEPTH = 5, 0.8, 10, 200, 1000, 4
RATE, DEEP_RATE = 1.2, 3.2
LARGEST = float(2**64)
#: Stands for a null doc_id.
LAST = (1 << 63) - 1


def recall_of_runs(similarity: float, runs: int, rate: float = RATE) -> float:
    """Chance that two sets of one size meet in a first-level bucket of one of the runs."""
    return 1 - float(np.exp(-rate * runs * 2 * similarity / (1 + similarity)))


def least_recall(similarity: float, runs: int = RUNS, rate: float = RATE, deep: float = DEEP_RATE, depth: int = DEPTH) -> float:
    """The same for the worst pair: one set inside the other, and every bucket that both are in splits ``depth`` times.

    The larger set then chooses ``rate * similarity`` shared shingles a run; after a split a pair is lost if none of its children, which split further, keeps it.
    """
    kept = 1.0
    for _ in range(depth):
        kept = 1 - float(np.exp(-deep * similarity * kept))
    return 1 - float(np.exp(-rate * runs * similarity * kept))


def shingle_sets(texts: list[bytes], n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    for _, part in chunks(texts):
        words, _, first = word_hashes(part)
        grams = gram_hashes(words, n)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            else:
                yield gram_hashes(words[a:b], b - a) if b > a else np.empty(0, np.uint64)


def chosen(tokens: np.ndarray, key: int, rate: float) -> np.ndarray:
    """Keys of the children of bucket ``key`` that a set follows."""
    seen = mix(tokens ^ np.uint64(key & (2**64 - 1)))
    return mix(seen[seen.astype(float) < rate / max(len(tokens), 1) * LARGEST] + np.uint64(0x632BE59BD9B4E019))


def set_table(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """d, h, s1, s2 (the set's 128-bit content; null without words), n (its size) and first-level bucket keys of each document."""
    seeds = [int(x) for x in mix(np.arange(1, runs + 1, dtype=np.uint64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, counts, one, two, size = [], [], [], [], []
            for s in shingle_sets(as_bytes(b.column(2), lower=True)):
                mine = np.unique(np.concatenate([chosen(s, x, RATE) for x in seeds])) if len(s) else s
                keys.append(mine)
                counts.append(len(mine))
                size.append(len(s))
                one.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else None)
                two.append(int(np.add.reduce(mix(s + np.uint64(1))).view(np.int64)) if len(s) else None)
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(size, pa.int32()), lists(flat, counts, pa.int64())],
                                             ["d", "h", "s1", "s2", "n", "keys"])

    return keyed(docs).select("d", "h", "text").mapInArrow(run, "d long, h long, s1 long, s2 long, n int, keys array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """v, copies, n and the shingle set of rows with a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(as_bytes(b.column(2), lower=True)))
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(flat, map(len, sets), pa.int64())], ["v", "copies", "s"])
    return rows.select("v", "copies", "text").mapInArrow(run, "v long, copies long, s array<long>")


def _children(rows: DataFrame) -> DataFrame:
    """(v, parent, key) of the split of buckets ``parents`` of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs, ups, keys = [], [], []
            for v, s, parents in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                tokens = s.values.to_numpy().view(np.uint64)
                for p in parents:
                    mine = chosen(tokens, p, DEEP_RATE).view(np.int64)
                    vs.extend([v] * len(mine))
                    ups.extend([p] * len(mine))
                    keys.extend(mine.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (vs, ups, keys)], ["v", "parent", "key"])
    return rows.select("v", "s", "parents").mapInArrow(run, "v long, parent long, key long")


def _similar(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of one block pair of a bucket: per set, how many documents it is linked to, and a linked set with a smaller number."""
    bucket, first, second = (group.column(k)[0].as_py() for k in ("key", "bi", "bj"))
    v = group.column("v").to_numpy()
    chunk = group.column("chunk").to_numpy()
    copies = group.column("copies").to_numpy()
    sets = [x.values.to_numpy() for x in group.column("s")]
    keys = [x.values.to_numpy() for x in group.column("keys")]
    n = len(v)
    if n < 2 or min(np.min(k) for k in keys) < bucket and bucket > min(set.intersection(*map(lambda k: set(k.tolist()), keys))):
        return  # all meet in a smaller bucket too
    size = np.array([len(s) for s in sets], dtype=np.float32)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(n), size.astype(int))
    shared = _gram(rows, column, n)
    link = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-4
    before = [k[k < bucket] for k in keys]
    if any(len(k) for k in before):
        _, column = np.unique(np.concatenate(before), return_inverse=True)
        link &= _gram(np.repeat(np.arange(n), [len(k) for k in before]), column, n) == 0
    np.fill_diagonal(link, False)
    if first != second:
        link &= chunk[:, None] != chunk[None, :]
    if not link.any():
        return
    degree = link @ copies.astype(np.float64)
    ends = np.flatnonzero(degree)
    low = np.array([v[link[i]].min() for i in ends])
    yield pa.RecordBatch.from_arrays([pa.array(v[ends]), pa.array(degree[ends].astype(np.int64)), pa.array(np.minimum(low, v[ends]))], ["v", "links", "low"])


def _gram(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Shared columns of all rows of a 0/1 matrix, a slice of columns at a time."""
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    count = np.bincount(columns)
    keep = count[columns] > 1  # a column of one row is shared by none
    rows, columns = rows[keep], columns[keep]
    if not len(columns):
        return out
    _, columns = np.unique(columns, return_inverse=True)
    step = max(1, (1 << 22) // n)
    for a in range(0, int(columns[-1]) + 1, step):
        lo, hi = np.searchsorted(columns, (a, a + step))
        m = np.zeros((n, min(step, int(columns[-1]) + 1 - a)), dtype=np.float32)
        m[rows[lo:hi], columns[lo:hi] - a] = 1
        out += m @ m.T
    return out


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex of each connected component of (v, low); hash-min with pointer jumping, staged each round."""
    both = stage(edges.where("v <> low").select("v", "low").union(edges.where("v <> low").select(F.col("low").alias("v"), F.col("v").alias("low"))).distinct())
    label = stage(both.groupBy("v").agg(F.least(F.min("low"), F.col("v")).alias("root")))
    while True:
        near = both.join(label.select(F.col("v").alias("low"), F.col("root").alias("r")), "low").groupBy("v").agg(F.min("r").alias("r"))
        step = label.join(near, "v").select("v", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jump = step.join(label.select(F.col("v").alias("root"), F.col("root").alias("up")), "root", "left")
        nxt = stage(jump.select("v", F.least("root", F.coalesce("up", "root")).alias("root"), "was"))
        if not nxt.where("root <> was").limit(1).count():
            return nxt.select("v", "root")
        label = nxt.select("v", "root")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, small: int = SMALL) -> DataFrame:
    """Per document: doc_id, h (hash of its text), class_id (smallest doc_id of its connected component), copy_of (smallest doc_id with
    its shingle set), n_copies (documents with this set), n_links (other documents that are equal or similar).

    Repeated rows are documents of their own, each with the other as a copy. Texts without words (null, empty, white space) are alone. A
    null doc_id comes after all others, so a class has it only if it has no other.
    """
    small_batches(docs.sparkSession)
    sigs = stage(set_table(docs, runs))
    order = F.struct(F.col("d").isNull().alias("z"), "d", "h")
    classes = stage(sigs.where("s1 is not null").groupBy("s1", "s2").agg(F.min(F.struct(F.col("d").isNull().alias("z"), "d", "h", "keys")).alias("f"), F.count("*").alias("copies"))
                    .select("s1", "s2", "f.d", "f.h", "f.keys", "copies").withColumn("v", F.monotonically_increasing_id()))
    level = classes.select("v", F.explode("keys").alias("key"))
    buckets = level.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    level = stage(level.join(buckets, "key"))
    met = level.select("v").distinct()
    reps = classes.join(met, "v", "left_semi").select("v", "copies", F.coalesce("d", F.lit(LAST)).alias("o"), "h")
    texts = keyed(docs).select(F.coalesce("d", F.lit(LAST)).alias("o"), "h", "text")
    sets = stage(_sets(texts.join(reps, ["o", "h"]).dropDuplicates(["o", "h"])))
    leaves = []
    for _ in range(DEPTH):
        big = level.where(F.col("c") > small)
        parents = big.groupBy("v").agg(F.collect_set("key").alias("parents"))
        if not big.limit(1).count():
            break
        kids = stage(_children(sets.join(parents, "v")))
        sizes = kids.groupBy("parent", "key").agg(F.count("*").alias("k"))
        tight = sizes.groupBy("parent").agg(F.max("k").alias("k"))
        judged = big.select("key", "c").distinct().join(tight.withColumnRenamed("parent", "key"), "key", "left")
        whole = judged.where("k is null or k * 2 > c").select("key")  # a split would leave most of it together
        leaves.append(stage(level.where(F.col("c") <= small).select("v", "key", "c").union(level.join(whole, "key", "left_semi").select("v", "key", "c"))))
        rest = kids.join(whole.withColumnRenamed("key", "parent"), "parent", "left_anti").select("v", "key").distinct()
        level = stage(rest.join(rest.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key").select("v", "key", "c"))
    leaves.append(level.select("v", "key", "c"))
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.union(x)
    # of buckets with the same members one is enough
    members = leaf.distinct()
    same = members.groupBy("key", "c").agg(F.sum(F.xxhash64("v").cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y"))
    leaf = members.join(same.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    mine = leaf.groupBy("v").agg(F.collect_list(F.struct("key", "c")).alias("leaf"))
    spread = (sets.join(mine, "v").select("v", "copies", "s", F.col("leaf.key").alias("keys"), F.explode("leaf").alias("l"))
              .select("v", "copies", "s", "keys", "l.key", F.ceil(F.col("l.c") / BLOCK).cast("int").alias("p"))
              .withColumn("chunk", F.pmod(F.xxhash64("v"), "p").cast("int"))
              .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
              .select("key", F.least("chunk", "o").alias("bi"), F.greatest("chunk", "o").alias("bj"), "chunk", "v", "copies", "keys", "s"))
    found = stage(sorted_groups(spread, ["key", "bi", "bj"], lambda g: _similar(g, threshold), "v long, links long, low long"))
    roots = components(found.select("v", "low"))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    named = stage(classes.select("s1", "s2", "d", "h", "copies", "v").join(links, "v", "left").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")))
    first = named.groupBy("root").agg(F.min(order).alias("c"))
    named = named.join(first, "root").select("s1", "s2", F.col("c.d").alias("class_id"), F.col("c.h").alias("class_h"), F.col("d").alias("copy_of"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    joined = sigs.drop("keys").join(named, ["s1", "s2"], "left")
    alone = F.col("s1").isNull()
    return joined.select(F.col("d").alias("doc_id"), "h", F.when(alone, F.col("d")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("h")).otherwise(F.col("class_h")).alias("class_h"),
                         F.when(alone, F.col("d")).otherwise(F.col("copy_of")).alias("copy_of"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
                         (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
