"""LM scoring by a subword lattice.

A token is a whole word seen in training, the end, or a word spelled by pieces of an existing subword vocabulary: first a piece with the word-begin
sign, then others, with a chance to stop after each (single characters are pieces too, so every text has a path). The lattice of a word
has the whole word as one arc and all pieces as others; its probability is the sum over all segmentations, by a forward
recursion in log space; the text's is the product over its words and the end, and the probabilities of all texts add up to one.

Word and piece weights depend on a hidden class of the text, one for each value of ``lang`` among the training documents (the most frequent CLASSES; the
others are one more). A class has its own discounted counts and piece weights and falls back on those of all classes; a text's probability is the sum over
the classes, so ``lang`` is read only while learning.

Whole words have their training counts less an absolute discount (by the numbers of words seen once to four times); the mass that this frees
belongs to spelled words. Piece weights start from the vocabulary's own order of scores and are fitted to the distinct training words by expectation maximisation. Words and counts are aggregated by shuffles. The scores of the FREQUENT most frequent words go to all tasks; all other words meet theirs in a join, and a document's
sums come back. Only these words and the piece weights (bounded by the vocabulary) reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import as_bytes, join_key, keyed, larger, small_batches, stage

#: Rounds of expectation maximisation.
ROUNDS = 2
#: Words that a task counts before it hands them on, and the most frequent words, whose scores every task holds.
HELD_WORDS, FREQUENT = 400_000, 100_000
#: Words that the lattice works on at once.
WORD_ROWS = 40_000
BEGIN = "▁"
#: Classes with counts of their own, and the discount of their counts.
CLASSES, CLASS_DISCOUNT = 8, 0.75
SLOTS = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Pieces' smoothing, and the log probability of a character outside the vocabulary.
SMOOTH, FOREIGN = 0.05, math.log(1e-7)


def vocabulary(model: str = "piece_bpe_32k.model") -> list[str]:
    """Lower-case pieces of a public vocabulary by falling score; the fixed place of a piece is its number."""
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    found = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and not any("A" <= c <= "Z" for c in p):
            found.append((-sp.get_score(i), p))
    return [p for _, p in sorted(found)]


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials, place by place; the first term is finite."""
    if len(terms) == 1:
        return terms[0]
    stacked = np.stack(terms)
    top = stacked.max(axis=0)
    stacked -= top
    np.exp(stacked, out=stacked)
    return top + np.log(stacked.sum(axis=0))


class Lattice:
    """Forward and backward sums over all segmentations of many words at once; words of one length share a matrix."""

    def __init__(self, pieces: list[str], weights: list[np.ndarray]):
        codes = [self._codes(np.array([[ord(c) for c in p]], dtype=np.uint64), len(p))[0, 0] for p in pieces]
        self.hash = np.array(codes + [0], dtype=np.uint64)
        self.logs = [np.append(w, -np.inf) for w in weights]
        self.none = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.one = np.full(SLOTS, self.none, dtype=np.int32)
        self.two = np.full(SLOTS, self.none, dtype=np.int32)
        for i, c in enumerate(codes):
            a, b = int(c) >> 44, int(c) & (SLOTS - 1)
            if self.one[a] == self.none:
                self.one[a] = i
            elif self.two[b] == self.none:
                self.two[b] = i
            else:
                raise ValueError("two pieces share both slots")

    @staticmethod
    def _codes(chars: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((chars.shape[0], chars.shape[1] - n + 1), dtype=np.uint64)
        for k in range(n):
            out = (out + chars[:, k:chars.shape[1] - n + 1 + k] + np.uint64(1)) * PRIME
            out ^= out >> np.uint64(29)
        return out

    def _find(self, codes: np.ndarray) -> np.ndarray:
        at = self.one[(codes >> np.uint64(44)).astype(np.int64)]
        miss = self.hash[at] != codes
        at[miss] = self.two[(codes[miss] & np.uint64(SLOTS - 1)).astype(np.int64)]
        at[self.hash[at] != codes] = self.none
        return at

    def arcs(self, chars: np.ndarray) -> list[np.ndarray]:
        """By length of piece: the piece at each place of each word."""
        return [self._find(self._codes(chars, n)) for n in range(1, min(self.longest, chars.shape[1]) + 1)]

    def _weights(self, arcs: list[np.ndarray], k: int) -> list[np.ndarray]:
        lp = [self.logs[k][a] for a in arcs]
        lp[0] = np.where(arcs[0] == self.none, FOREIGN, lp[0])
        return lp

    def forward(self, lp: list[np.ndarray], n: int, m: int) -> np.ndarray:
        alpha = np.full((m + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, m + 1):
            alpha[j] = log_sum([alpha[j - k] + lp[k - 1][:, j - k] for k in range(1, min(self.longest, j) + 1)])
        return alpha

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, characters) of words of one length, a bounded part at a time."""
        length = np.array([len(w) for w in words])
        for m in np.unique(length).tolist():
            mine = np.flatnonzero(length == m)
            step = max(1, (1 << 16) // (m + 1))
            for a in range(0, len(mine), step):
                part = mine[a:a + step]
                flat = np.frombuffer("".join([words[i] for i in part.tolist()]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
                yield part, flat.astype(np.uint64).reshape(len(part), m)

    def scores(self, words: list[str]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word, under each weighting."""
        out = np.zeros((len(self.logs), len(words)))
        for part, chars in self.groups([BEGIN + w for w in words]):
            arcs = self.arcs(chars)
            for k in range(len(self.logs)):
                out[k, part] = self.forward(self._weights(arcs, k), *chars.shape)[-1]
        return out

    def expected(self, words: list[str], k: int) -> np.ndarray:
        """Expected number of uses of each piece under weighting ``k`` (last: characters outside the vocabulary)."""
        total = np.zeros(self.none + 1)
        for _, chars in self.groups([BEGIN + w for w in words]):
            n, m = chars.shape
            arcs = self.arcs(chars)
            lp = self._weights(arcs, k)
            alpha = self.forward(lp, n, m)
            beta = np.full((m + 1, n), -np.inf)
            beta[m] = -alpha[m]
            for j in range(m - 1, -1, -1):
                beta[j] = log_sum([beta[j + size] + lp[size - 1][:, j] for size in range(1, min(self.longest, m - j) + 1)])
            for size, a in enumerate(arcs, 1):
                post = np.exp(alpha[:m - size + 1].T + lp[size - 1] + beta[size:].T)
                total += np.bincount(a.ravel(), weights=post.ravel(), minlength=self.none + 1)
        return total


def piece_weights(pieces: list[str], uses: np.ndarray, foreign: float = 0.0, go_on: float = 0.7) -> np.ndarray:
    """Log weights: begin pieces share one, other pieces (and characters outside the vocabulary) share the chance to go on."""
    begins = np.array([p.startswith(BEGIN) for p in pieces])
    out = np.log(uses)
    out[begins] -= np.log(uses[begins].sum())
    out[~begins] += math.log(go_on) - np.log(uses[~begins].sum() + foreign)
    return out


def discounts(n: list[int]) -> list[float]:
    """What is taken from counts of one, two and more, from the numbers of words seen one to four times."""
    if not all(n[:2]):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), 0.95 * k) if n[k - 1] else 0.5 for k in (1, 2, 3)]


class Places(dict):
    """Places of the frequent words; all others share the last."""

    def __missing__(self, word: bytes) -> int:
        return len(self)


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def _expected_counts(words: DataFrame, pieces: list[str], weights: list[np.ndarray]) -> np.ndarray:
    """One E-step over the distinct words of each class (word, k); a task sends its piece sums, so the driver gets classes x vocabulary at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, weights)
        total = np.zeros((len(weights), len(pieces) + 1))
        for b in larger(batches, WORD_ROWS):
            k = b.column(1).to_numpy()
            words = b.column(0).to_pylist()
            for i in np.unique(k).tolist():
                total[i] += lattice.expected([words[j].decode() for j in np.flatnonzero(k == i).tolist()], i)
        k, used = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(used), pa.array(total[k, used])], ["k", "i", "x"])

    out = np.zeros((len(weights), len(pieces) + 1))
    for r in words.mapInArrow(run, "k long, i long, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).collect():
        out[r.k, r.i] = r.x
    return out


def score_texts(docs: DataFrame, model: str = "piece_bpe_32k.model", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and the other columns of ``docs`` in ``row``.

    Rows that agree in doc_id and text score alike, and each counts as training text. A null or empty text is its end token. Without training
    documents nothing is known and only pieces, weighted by the vocabulary's order, give scores. A null doc_id counts as training text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)).alias("held_out")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    common = docs.select(held, lang.alias("lang")).where("not held_out").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES).collect()
    kind = F.lit(len(common))
    for i, r in enumerate(common):
        kind = F.when(lang == F.lit(r.lang), i).otherwise(kind)
    base = keyed(docs, held, F.when(held, -1).otherwise(kind).alias("k"))
    texts_of = {r.k: r["count"] for r in base.where("k >= 0").groupBy("k").count().collect()}  # one row per class
    classes = max(texts_of, default=0) + 1
    ends = sum(texts_of.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, words in seen.items():
                names, n = list(words), np.fromiter(words.values(), dtype=np.int64, count=len(words))
                n = n if k >= 0 else np.zeros_like(n)
                for a in range(0, len(names), 50_000):
                    part = names[a:a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(np.full(len(part), k, np.int32)), pa.array(n[a:a + 50_000])], ["word", "k", "n"])
            seen.clear()

        for b in batches:
            for raw, k in zip(as_bytes(b.column(1)), b.column(0).to_pylist()):
                seen.setdefault(k, Counter()).update(_words(raw))
            if sum(map(len, seen.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    own = [F.coalesce(F.sum(F.when(F.col("k") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(classes)]
    counts = stage(base.select("k", "text").mapInArrow(count, "word binary, k int, n long").groupBy("word").agg(F.sum("n").alias("c"), *own))
    known = counts.where("c > 0")
    facts = known.agg(*[F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)], F.count("*"), F.coalesce(F.sum("c"), F.lit(0)),
                      *[F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(classes)], *[F.coalesce(F.sum((F.col(f"c{i}") > 0).cast("long")), F.lit(0)) for i in range(classes)]).first()
    seen, kinds, tokens = list(facts[:4]), facts[4], facts[5] + ends
    types = kinds + (ends > 0)
    taken = np.array([0.0, *discounts(seen)])
    ended = np.array([texts_of.get(i, 0) for i in range(classes)], dtype=float)
    size = np.array(facts[6:6 + classes], dtype=float) + ended
    back = np.where(size > 0, CLASS_DISCOUNT * np.array(facts[6 + classes:], dtype=float) / np.maximum(size, 1), 1.0)
    prior = np.log10((ended + 0.5) / (ended + 0.5).sum())

    pieces = vocabulary(model)
    go_on = [0.7] * classes
    weights = [piece_weights(pieces, 1 / (np.arange(len(pieces)) + 10.0))] * classes
    kinds_of = np.array(facts[6 + classes:], dtype=float)
    of_class = known.select("word", F.explode(F.array(*[F.when(F.col(f"c{i}") > 0, i) for i in range(classes)])).alias("k")).where("k is not null")
    for _ in range(rounds if kinds else 0):
        uses = _expected_counts(of_class, pieces, weights)
        share = (uses.sum(axis=0) + SMOOTH) / (uses.sum() + SMOOTH * uses.shape[1])  # of all classes, for what one has not seen
        for i in range(classes):
            mine = uses[i] + 50 * share
            go_on[i] = 1 - float((kinds_of[i] + 10) / (mine.sum() + 10))
            weights[i] = piece_weights(pieces, mine[:-1], mine[-1], go_on[i])
    freed = (taken[1] * seen[0] + taken[2] * seen[1] + taken[3] * (kinds - seen[0] - seen[1])) if kinds else 0.0
    novel = freed / tokens if freed else 1.0 / (tokens + 1)  # chance that a token is spelled
    spell = math.log(novel) + np.log(1 - np.array(go_on))[:, None]
    whole = (1 - novel) / max(tokens - freed, 1)
    low = 1 / (tokens + 0.1 * (types + 1))

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, weights)
        for b in larger(batches, WORD_ROWS):
            c = b.column(1).to_numpy()
            spelled = lattice.scores([w.decode() for w in b.column(0).to_pylist()]) + spell
            with np.errstate(divide="ignore"):
                s = np.logaddexp(spelled, np.log((c - taken[np.minimum(c, 3)]) * whole))
                logs = [np.logaddexp(np.log(np.maximum(b.column(2 + i).to_numpy() - CLASS_DISCOUNT, 0) / max(size[i], 1)), np.log(back[i]) + s[i]) / math.log(10) for i in range(classes)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in logs)], ["word", "c", *names])

    names = [f"s{i}" for i in range(classes)]
    shape = "word binary, c long, " + ", ".join(f"{x} double" for x in names)
    score = lambda rows: rows.select("word", "c", *[f"c{i}" for i in range(classes)]).mapInArrow(word_scores, shape)
    overall = ends * whole if ends else novel
    end_score = np.log10(ended / np.maximum(size, 1) + back * overall)
    end_base = math.log10((ends + 0.1) * low)
    frequent = score(counts.orderBy(F.desc("c"), "word").limit(FREQUENT)).toPandas()  # bounded by FREQUENT
    place = Places((w, i) for i, w in enumerate(map(bytes, frequent["word"])))
    c_top = np.append(frequent["c"].to_numpy(dtype=np.int64), 0)
    s_top = np.vstack([np.append(frequent[x].to_numpy(dtype=float), 0.0) for x in names])
    top = spark.sparkContext.broadcast((place, c_top, s_top))

    def frequent_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, c_top, s_top = top.value
        b_top = np.append(np.log10((c_top[:-1] + 0.1) * low), 0.0)
        for b in batches:
            total, seen, basic, logs = [], [], [], []
            for raw in as_bytes(b.column(2)):
                words = _words(raw)
                at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
                total.append(len(at) + 1)
                seen.append(int((c_top[at] > 0).sum()))
                basic.append(float(b_top[at].sum()))
                logs.append(s_top[:, at].sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *b.columns[3:], pa.array(total, pa.int64()), pa.array(seen, pa.int64()), pa.array(basic, pa.float64()), *(pa.array([x[i] for x in logs], pa.float64()) for i in range(len(names)))],
                                             ["d", "h", "row", "held_out", "n", "seen", "b", *names])

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = top.value[0]
        for b in batches:
            ds, hs, words, times = [], [], [], []
            for d, h, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                mine = Counter(filterfalse(place.__contains__, _words(raw)))
                words.extend(mine)
                times.extend(mine.values())
                ds.extend([d] * len(mine))
                hs.extend([h] * len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(hs, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int32())], ["d", "h", "word", "tf"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    texts = keyed(docs, row, held)
    schema = T.StructType([*texts.select("d", "h", "row", "held_out").schema.fields, *T._parse_datatype_string("n long, seen long, b double, " + ", ".join(f"{x} double" for x in names)).fields])
    first = texts.select("d", "h", "text", "row", "held_out").mapInArrow(frequent_sums, schema)
    pairs = keyed(docs).select("d", "h", "text").mapInArrow(rare_words, "d long, h long, word binary, tf int")
    met = pairs.join(score(counts), "word").groupBy("word", "d", "h").agg(F.first("tf").alias("tf"), F.first("c").alias("c"), *[F.first(x).alias(x) for x in names])  # repeated rows count once
    rest = met.groupBy("d", "h").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("r_seen"), F.sum(F.col("tf") * F.log10((F.col("c") + 0.1) * low)).alias("r_b"), *[F.sum(F.col("tf") * F.col(x)).alias(f"r_{x}") for x in names])
    both = join_key(first, rest, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    by_class = [F.lit(float(prior[i] + end_score[i])) + F.col(x) + zero(f"r_{x}") for i, x in enumerate(names)]
    scored = both.select("row", "held_out", F.col("n").alias("n_tokens"), (F.col("seen") + zero("r_seen") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
                         (F.col("b") + zero("r_b") + F.lit(end_base)).alias("base_score"), F.array(*by_class).alias("by"))
    total = F.array_max("by") + F.log10(F.aggregate("by", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - F.array_max("by"))))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", total.alias("score"), "row")
