"""Substring dedup by repeated-phrase automata.

1. Confirm recurring passages. Each window of ``WINDOW`` words is represented by its minimizer, the least hash of its ``GRAM``-word runs; equal windows
   have equal minimizers, and a document has about one minimizer for four windows. Stretches of windows whose minimizer is in several
   documents become segments, and their windows are counted by a 128-bit hash, which gives the first document of each recurring window.
2. Compile sharded automata. Segments of first documents are dealt to shards by that document; a shard compiles an Aho-Corasick automaton over
   their windows, with words as symbols.
3. Stream the documents. Each segment goes to the shards of the first documents of its windows, and the automaton locates every occurrence,
   word by word, so that no hash decides. A shard that many segments need is split by salt into parts with the same automaton.

All counts combine before they are shuffled, segments carry only recurring text, and no group grows with a hot passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import as_bytes, chunks, gram_hashes, small_batches, sorted_groups, stage, word_hashes

WINDOW, GRAM = 13, 6
#: Bytes of segments whose windows one automaton holds, and bytes that stream through it in one task.
SHARD_BYTES, STREAM_BYTES = 1 << 19, 1 << 23
#: A null doc_id comes after all others.
LAST = (1 << 63) - 1
#: Characters that can stand for words in an automaton over text.
CHARACTERS = 1_100_000


def documents(docs: DataFrame, *extra) -> DataFrame:
    """o (doc_id, null as the largest), h (hash of the text), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("o"), F.xxhash64("text").alias("h"), "text", *extra)


def window_minimizers(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: minimizer of the window at each word, whether it lies within one text, the words' texts, each text's first word."""
    words, text, first = word_hashes(part)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool), text, first
    least = gram_hashes(words, GRAM)
    for step in (1, 2, 4):  # eight runs of six words make thirteen words
        least = np.minimum(least[:-step], least[step:])
    return least, text[:n] == text[WINDOW - 1:], text, first


def minimizers(docs: DataFrame) -> DataFrame:
    """(m, o, h): minimizers of each document, about one for each stretch of windows that share it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, part in chunks(as_bytes(b.column(2))):
                least, inside, text, _ = window_minimizers(part)
                new = inside.copy()
                new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
                where = np.flatnonzero(new)
                rows = text[where] + at
                yield pa.RecordBatch.from_arrays([pa.array(least[where].view(np.int64)), pa.array(o[rows]), pa.array(h[rows])], ["m", "o", "h"])
    return documents(docs).mapInArrow(run, "m long, o long, h long")


def segments(docs: DataFrame) -> DataFrame:
    """(o, h, at, text): stretches of words whose windows may recur in another document."""
    # dealt once: both sides of the join read it, with the same columns and filters
    seen = minimizers(docs).where("m is not null and o is not null and h is not null").repartition("m")
    several = seen.groupBy("m").agg(F.min("o").alias("a"), F.max("o").alias("z"), F.max("h").alias("any")).where("a < z and any is not null").select("m")
    mine = seen.join(several.hint("shuffle_hash"), "m").groupBy("o", "h").agg(F.collect_set("m").alias("ms"))
    held = documents(docs).join(mine, ["o", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for o, h, raw, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3)):
                least, inside, _, _ = window_minimizers([raw])
                good = inside & np.isin(least.view(np.int64), ms.values.to_numpy())
                edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).view(np.int8)))
                words = raw.split() if len(edge) else []
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    for column, value in zip(out, (o, h, x, b" ".join(words[x:y + WINDOW - 1]).decode())):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["o", "h", "at", "text"])

    return held.select("o", "h", "text", "ms").mapInArrow(run, "o long, h long, at long, text string").dropDuplicates(["o", "h", "at"])


def segment_windows(segs: DataFrame) -> DataFrame:
    """(a, b, o, h, at): 128-bit hashes of the windows of each segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            cols = [x.column(k).to_numpy() for k in range(3)]
            for at, part in chunks(as_bytes(x.column(3))):
                words, text, _ = word_hashes(part)
                if len(words) < WINDOW:
                    continue
                inside = np.flatnonzero(text[:len(words) - WINDOW + 1] == text[WINDOW - 1:])
                one = gram_hashes(words, WINDOW)[inside]
                two = gram_hashes(words ^ np.uint64(0x5851F42D4C957F2D), WINDOW)[inside]
                rows = text[inside] + at
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(pa.array(c[rows]) for c in cols)], ["a", "b", "o", "h", "at"])
    return segs.select("o", "h", "at", "text").mapInArrow(run, "a long, b long, o long, h long, at long")


def _locate(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Compile the automaton of a shard and stream its segments: covered word ranges (o, h, x, y)."""
    kind, o, h, at = (group.column(k).to_numpy() for k in ("kind", "o", "h", "at"))
    texts = group.column("text").to_pylist()
    number: dict[str, int] = {}
    for i in np.flatnonzero(kind == 0).tolist():
        for w in texts[i].split(" "):
            number.setdefault(w, len(number) + 2)
    # one character a word while there are characters, else one integer
    wide = len(number) > CHARACTERS
    symbol = number if wide else {w: chr(n if n < 0xD800 else n + 0x800) for w, n in number.items()}
    unknown = 1 if wide else "\x01"

    def line_of(text: str) -> str | tuple:
        found = [symbol.get(w, unknown) for w in text.split(" ")]
        return tuple(found) if wide else "".join(found)

    first: dict[str | tuple, int] = {}
    for i in np.flatnonzero(kind == 0).tolist():
        line = line_of(texts[i])
        owner = int(o[i])
        for k in range(len(line) - WINDOW + 1):
            w = line[k:k + WINDOW]
            if first.get(w, LAST) >= owner:
                first[w] = owner
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if wide else ahocorasick.Automaton()
    for w, owner in first.items():
        automaton.add_word(w, owner)
    automaton.make_automaton()
    out: list[list] = [[], [], [], []]
    # segments of copies are equal: the automaton reads each text once, and every segment takes its own part of the matches
    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for i in np.flatnonzero(kind == 1).tolist() if first else ():
        if texts[i] not in seen:
            matches = list(automaton.iter(line_of(texts[i])))
            seen[texts[i]] = np.array([m for m, _ in matches], dtype=np.int64), np.array([w for _, w in matches], dtype=np.int64)
        lasts, owners = seen[texts[i]]
        lasts = lasts[owners < o[i]]
        if len(lasts):
            cut = np.flatnonzero(lasts[1:] - WINDOW > lasts[:-1])
            begins, ends = lasts[np.concatenate(([0], cut + 1))] - WINDOW + 1, lasts[np.append(cut, len(lasts) - 1)] + 1
            for column, values in zip(out, ([int(o[i])] * len(begins), [int(h[i])] * len(begins), (begins + at[i]).tolist(), (ends + at[i]).tolist())):
                column.extend(values)
    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["o", "h", "x", "y"])


def covered(docs: DataFrame) -> DataFrame:
    """(o, h, x, y): word ranges inside windows that start in a document with a smaller id."""
    segs = stage(segments(docs))
    wins = segment_windows(segs)
    firsts = wins.groupBy("a", "b").agg(F.min("o").alias("f"), F.max("o").alias("z")).where("f < z").select("a", "b", "f")
    wanted = stage(wins.join(firsts, ["a", "b"]).where("f < o").select("o", "h", "at", "f").distinct())
    size = F.octet_length("text") + 32
    owners = segs.join(wanted.select(F.col("f").alias("o")).distinct(), "o", "left_semi")
    total = owners.agg(F.sum(size)).first()[0] or 0
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, total // SHARD_BYTES)))
    needed = wanted.select("o", "h", "at", shard("f").alias("shard")).distinct()
    stream = stage(needed.join(segs, ["o", "h", "at"]).select("shard", F.lit(1).alias("kind"), "o", "h", "at", "text"))
    parts = stream.groupBy("shard").agg(F.ceil(F.sum(size) / STREAM_BYTES).cast("int").alias("parts"))
    salted = stream.join(parts, "shard").withColumn("salt", F.pmod(F.xxhash64("o", "h", "at"), "parts").cast("int"))
    held = owners.select(shard("o").alias("shard"), F.lit(0).alias("kind"), "o", "h", "at", "text").join(parts, "shard")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return sorted_groups(held.unionByName(salted).drop("parts"), ["shard", "salt"], _locate, "o long, h long, x long, y long")


def drop_repeated_words(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in ``row`` with n_words, n_removed and ``kept``, the words that are left, joined by one blank.

    Windows are judged on the input. Documents of one doc_id never remove each other's words; a null doc_id comes after all others; null and
    empty texts have no words, and ``kept`` is empty.
    """
    small_batches(docs.sparkSession)
    spans = covered(docs).groupBy("o", "h").agg(F.collect_list(F.struct("x", "y")).alias("spans"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = documents(docs, row).drop("text").join(spans, ["o", "h"], "left").select("row", "spans")
    place = docs.columns.index("text")
    schema = T.StructType([found.schema["row"], *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept = [], [], []
            for raw, ranges in zip(as_bytes(pc.struct_field(b.column(0), [place])), b.column(1).to_pylist()):
                words = raw.split()
                total.append(len(words))
                if ranges:
                    keep = np.ones(len(words), dtype=bool)
                    for s in ranges:
                        keep[s["x"]:s["y"]] = False
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])

    return found.mapInArrow(run, schema)
