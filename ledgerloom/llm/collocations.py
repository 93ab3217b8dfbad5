"""Phrase collocations by stripes: each prefix keys an associative counter of the words that follow it.

Level k counts the words after prefixes of k words (k = 0: after nothing, so all words). A task turns a block of text into stripes (prefix, following words, their
counts); stripes of one prefix are merged elementwise, and the merged stripe gives all that is needed: the counts of its extensions, the total of the prefix (what no
frequent word follows is counted under word 0) and the largest extension, by which a phrase may be subsumed. Extensions of k + 1 words that occur often enough are the prefixes of the next level.

No phrase is frequent unless its first and its last k words are, so a level looks only at those, by a bitmap of bounded size that every task gets: it may let a
rare phrase pass, which its exact count then drops, but never stops a frequent one. Stripes of prefixes that hold a thousandth of all words, at most a thousand, are split by following word
and merged in shards, so no prefix is one task's work. Words are 64-bit hashes until the best phrases are known; two words of one hash raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BASE, CHUNK_BYTES, INVERSE, lists, mix, small_batches, stage

BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
#: Longest phrase; occurrences that make one; share of a phrase that a longer one must have to subsume it.
LONGEST, LEAST, SHARE = 4, 30, 80
TOP = 2000
#: Bytes of text that are counted together; a text is cut only where a piece ends.
BLOCK_BYTES = 4 << 20
#: A bitmap has about 16 bits a phrase, at most this many.
MAX_BITS = 1 << 26
#: Prefixes with a share of 1 / HEAVY of all words are split into SHARDS, the empty prefix into ROOT_SHARDS.
HEAVY, SHARDS, ROOT_SHARDS = 1000, 64, 256


def seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def marks(seeds: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of (language, words) for bitmaps."""
    out = seeds
    for w in words:
        out = mix(out * BASE + w)
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, from prefix sums over about CHUNK_BYTES at a time; never 0."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_BYTES)))
        low = starts[i]
        part = buf[low:ends[j - 1]]
        power = np.full(len(part) + 1, BASE, dtype=np.uint64)
        back = np.full(len(part) + 1, INVERSE, dtype=np.uint64)
        power[0] = back[0] = 1
        power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
        i = j
    return np.maximum(out, np.uint64(1))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts (lang, text) in blocks of about BLOCK_BYTES: the languages, where each one's stretch of bytes begins, and the lower-case bytes; stretches end with a line feed."""
    held: list[tuple[str, bytes]] = []
    size = 0

    def block() -> tuple[list[str], np.ndarray, np.ndarray]:
        ends = np.cumsum([0] + [len(t) + 1 for _, t in held])
        return [x for x, _ in held], ends[:-1], np.frombuffer(b"\n".join([t for _, t in held]) + b"\n", dtype=np.uint8)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            rest = (text or b"").lower()
            while rest:
                cut = len(rest)
                if cut > BLOCK_BYTES:
                    stops = np.flatnonzero(BREAK[np.frombuffer(rest, dtype=np.uint8, count=BLOCK_BYTES)])
                    later = stops if len(stops) else BLOCK_BYTES + np.flatnonzero(BREAK[np.frombuffer(rest, dtype=np.uint8, offset=BLOCK_BYTES)])[:1]
                    cut = int(later[-1]) + 1 if len(later) else cut
                held.append((lang, rest[:cut]))
                size += cut
                rest = rest[cut:]
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
    if held:
        yield block()


def words_of(langs: list[str], begins: np.ndarray, buf: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its distinct languages, and of every word its language, piece, hash and byte range."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~GAP[buf])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    names = sorted(set(langs))
    of = np.array([names.index(x) for x in langs], dtype=np.int16)
    lang = of[np.searchsorted(begins, starts, side="right") - 1]
    return names, lang, np.cumsum(BREAK[buf])[starts], word_hashes(buf, starts, ends), starts, ends


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a bitmap has each mark."""
    place = at & np.uint64(len(bits) * 8 - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _block_stripes(block: tuple, k: int, bits: np.ndarray | None, heavy: np.ndarray) -> pa.RecordBatch | None:
    """The stripes of a block: prefixes of ``k`` words, and the words that follow with their counts (word 0: no frequent one)."""
    names, lang, piece, h, _, _ = words_of(*block)
    seeds = np.array([seed(x) for x in names], dtype=np.uint64)[lang] if names else np.empty(0, np.uint64)
    n = len(h) - k + 1 if k else len(h)
    if n <= 0:
        return None
    prefix = [h[i:i + n] for i in range(k)]
    if k:
        own = marks(seeds[:n], prefix)
        often = (piece[:n] == piece[k - 1:k - 1 + n]) & has(bits, own)
        grows = np.zeros(n, dtype=bool)
        grows[:-1] = often[:-1] & often[1:] & (piece[:n - 1] == piece[k:k + n - 1])
        following = np.zeros(n, np.uint64)
        following[:-1] = np.where(grows[:-1], h[k:k + n - 1], np.uint64(0))
        shard = np.where(np.isin(own, heavy), following % np.uint64(SHARDS), np.uint64(0))[often]
        cols = [lang[:n][often], *[w[often] for w in prefix], shard, following[often]]
    else:
        cols = [lang, h % np.uint64(ROOT_SHARDS), h]
    if not len(cols[0]):
        return None
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    first = np.concatenate(([True], np.zeros(len(order) - 1, dtype=bool)))
    for c in cols[:-1]:
        first[1:] |= c[1:] != c[:-1]
    entry = first.copy()
    entry[1:] |= cols[-1][1:] != cols[-1][:-1]
    at = np.flatnonzero(entry)
    counts = np.diff(np.append(at, len(order)))
    stripe = np.flatnonzero(first)
    width = np.diff(np.append(np.searchsorted(at, stripe), len(at)))
    heads = np.stack([c[stripe] for c in cols[1:1 + k]], axis=1).reshape(-1) if k else np.empty(0, np.uint64)
    return pa.record_batch([pa.array([names[x] for x in cols[0][stripe]], type=pa.string()), lists(heads.view(np.int64), [k] * len(stripe), pa.int64()), pa.array(cols[-2][stripe].astype(np.int32)),
                            lists(cols[-1][at].view(np.int64), width, pa.int64()), lists(counts.astype(np.int32), width, pa.int32())], names=["lang", "prefix", "shard", "next", "n"])


def stripes(docs: DataFrame, k: int, bits: np.ndarray | None = None, heavy: np.ndarray | None = None) -> DataFrame:
    """(lang, prefix, shard, next, n): the stripes of each block of (lang, text) rows."""
    heavy = np.empty(0, np.uint64) if heavy is None else heavy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out = _block_stripes(block, k, bits, heavy)
            if out is not None:
                yield out
    return docs.mapInArrow(run, "lang string, prefix array<bigint>, shard int, next array<bigint>, n array<int>")


def merge(parts: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, shard, total, top, entries): stripes merged elementwise, with the words of ``least`` occurrences or more, the most of one, and all occurrences of the prefix.

    Stripes meet by prefix and shard and are added up where they meet; a merged stripe keeps only frequent extensions.
    """
    dealt = parts.repartition("lang", "prefix", "shard").select("lang", "prefix", "shard", F.explode(F.arrays_zip("next", "n")).alias("e"))
    added = dealt.groupBy("lang", "prefix", "shard", F.col("e.next").alias("next")).agg(F.sum("e.n").alias("n"))
    kept = (F.col("next") != 0) & (F.col("n") >= least)
    return added.groupBy("lang", "prefix", "shard").agg(F.sum("n").alias("total"), F.max(F.when(kept, F.col("n"))).alias("top"), F.collect_list(F.when(kept, F.struct("next", "n"))).alias("entries"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mark of (lang, ws) rows, all of one length."""
    for b in batches:
        if b.num_rows:
            words = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(b.num_rows, -1)
            known = {x: seed(x) for x in set(b.column(0).to_pylist())}
            seeds = np.array([known[x] for x in b.column(0).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([pa.array(marks(seeds, list(words.T)).view(np.int64))], names=["mark"])


def bitmap(found: DataFrame) -> np.ndarray:
    """Bytes of a bitmap of the marks of (lang, ws) rows: about 16 bits each, at most MAX_BITS; built in tasks, 32768 bits a row."""
    size = min(MAX_BITS, 1 << max(15, (16 * found.count()).bit_length()))
    at = F.col("mark").bitwiseAND(F.lit(size - 1))
    rows = (found.select("lang", "ws").mapInArrow(_marked, "mark bigint").select(F.expr(f"(mark & {size - 1}L) div 32768").alias("part"), (at % 32768).alias("bit"))
            .groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect())
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in rows:
        out[r.part * 4096:(r.part + 1) * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def heavy_marks(found: DataFrame, words: int) -> np.ndarray:
    """Marks of the phrases that begin at one of HEAVY words or more; at most HEAVY of them."""
    rows = found.where(F.col("a") * HEAVY >= words).select("lang", "ws").mapInArrow(_marked, "mark bigint").collect()
    return np.array([r.mark for r in rows], dtype=np.int64).view(np.uint64)


def names(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, w, word): the spelling of the words (lang, ws of one) that are wanted."""
    bits = bitmap(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            langs, lang, _, h, starts, ends = words_of(*block)
            if not len(h):
                continue
            seeds = np.array([seed(x) for x in langs], dtype=np.uint64)[lang]
            at = marks(seeds, [h])
            mine = np.flatnonzero(has(bits, at))
            _, one = np.unique(at[mine], return_index=True)
            mine, data = mine[one], block[2].tobytes()
            yield pa.record_batch([pa.array([langs[x] for x in lang[mine]], type=pa.string()), pa.array(h[mine].view(np.int64)),
                                   pa.array([data[a:b].decode() for a, b in zip(starts[mine], ends[mine])], type=pa.string())], names=["lang", "w", "word"])
    found = docs.mapInArrow(run, "lang string, w bigint, word string").groupBy("lang", "w").agg(F.min("word").alias("word"), F.max("word").alias("other"))
    word = F.when(F.col("word") == F.col("other"), F.col("word")).otherwise(F.raise_error(F.lit("two words have one hash")).cast("string"))
    return found.select("lang", "w", word.alias("word"))


def _pick() -> Column:
    """(score, cut, l, r) of the lowest-scoring cut, the first of equal ones; 128-bit products."""
    return F.expr("array_min(transform(arrays_zip(heads, tails), (x, j) -> named_struct('score', (cast(a as decimal(20,0)) * 2000000) div (cast(x.heads as decimal(20,0)) + x.tails), 'cut', j, 'l', x.heads, 'r', x.tails)))")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language of (text, lang) rows.

    Null texts are empty, null langs are ``und``; repeated rows count as often as they occur. A language without frequent phrases has no rows, like an empty table. Very long texts are counted in
    blocks that end with a piece; only a single piece is ever held whole. Ties in score and count go to the smaller phrase by bytes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    none = F.array().cast("array<bigint>")
    found = stage(merge(stripes(rows, 0), least))
    sizes = stage(found.groupBy("lang").agg(F.sum("total").alias("n")))
    words = sizes.agg(F.sum("n")).first()[0] or 0
    level = stage(found.select("lang", F.explode("entries").alias("e")).select("lang", F.array("e.next").alias("ws"), F.col("e.n").alias("a"), none.alias("heads"), none.alias("tails")))
    done = []
    for k in range(1, LONGEST):
        found = stage(merge(stripes(rows, k, bitmap(level), heavy_marks(level, words)), least))
        facts = found.groupBy("lang", F.col("prefix").alias("ws")).agg(F.sum("total").alias("total"), F.max("top").alias("right"))
        longer = found.select("lang", "prefix", F.explode("entries").alias("e")).select("lang", "prefix", F.concat("prefix", F.array("e.next")).alias("ws"), F.col("e.n").alias("a"))
        longer = longer.withColumn("rest", F.slice("ws", 2, k))
        before = level.join(facts, ["lang", "ws"], "left")
        if k > 1:
            left = longer.groupBy("lang", F.col("rest").alias("ws")).agg(F.max("a").alias("left"))
            most = F.greatest("left", "right").cast("decimal(20,0)")
            done.append(before.join(left, ["lang", "ws"], "left").where(F.coalesce(most * 100 < F.col("a").cast("decimal(20,0)") * SHARE, F.lit(True))).select("lang", "ws", "a", "heads", "tails"))
        first = before.select("lang", F.col("ws").alias("prefix"), F.concat("heads", F.array("total")).alias("heads"))
        last = level.select("lang", F.col("ws").alias("rest"), F.concat(F.array("a"), "tails").alias("tails"))
        level = stage(longer.join(first, ["lang", "prefix"]).join(last, ["lang", "rest"]).select("lang", "ws", "a", "heads", "tails"))
    done.append(level)
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    scored = every.select("lang", "ws", "a", _pick().alias("p")).select("lang", "ws", "a", "p.l", "p.r", "p.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    ahead = stage(scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"))  # with all ties of the last place
    spelt = names(rows, stage(ahead.select("lang", F.explode("ws").alias("w")).distinct().select("lang", F.array("w").alias("ws"))))
    each = ahead.select("*", F.posexplode("ws").alias("i", "w")).join(spelt, ["lang", "w"])
    named = each.groupBy("lang", "ws", "a", "l", "r", "score").agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "word")))["word"], " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
