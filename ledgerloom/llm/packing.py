"""Packing documents into token sequences by a grouping genetic algorithm on islands.

Only documents of more than ``CAPACITY`` tokens are cut: the first piece takes the remainder, all others are full. Full pieces are sequences of their own. The rest
is dealt to shards; on each shard several islands evolve packings of the same pieces. A child is made from two parents: well-filled bins of the
one are injected whole into the other, bins of the other that hold a piece twice are dissolved, and the displaced pieces go, largest first, where
they fit best. The fittest child is then bred on in fields, some open and some full bins at a time, until no bin more can be saved or its
share of fields is used up, which grows with the pieces. After an epoch each island takes over its neighbour's elite, and the best island of a
shard gives its sequences.
"""

from __future__ import annotations

import base64
import random
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keyed, small_batches, sorted_groups, stage

CAPACITY, END = 1024, 2
#: Pieces of a shard, islands of a shard, packings of an island, children of an epoch, epochs.
SHARD, ISLANDS, POPULATION, CHILDREN, EPOCHS = 16_384, 2, 3, 5, 2
#: Open and full bins of a field, pieces that earn a further field in an epoch, and fields of an epoch, at least.
FIELD, EARN, FIELDS = 50, 64, 100
#: Words of texts that have one blank or line end between words, where the vocabulary's pattern needs no look-ahead.
PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


class Encoder:
    """Ids of a text under a byte-level BPE vocabulary.

    Texts with other white space than one blank or line end between words take the vocabulary's own pattern, and texts with its special token,
    or with a run of white space too long for that pattern, the tokenizer itself.
    """

    def __init__(self, vocabulary: str, special: str = "<|endoftext|>"):
        import public_tokenizers
        self.vocabulary, self.special = vocabulary, special
        with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = self.encoding(PLAIN)
        self.whole = self.full = None

    def encoding(self, pattern: str):
        import tiktoken
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={self.special: max(self.ranks.values()) + 1})

    def fast(self, text: str) -> np.ndarray | None:
        """Ids of a text without the special token, if its white space is not too long."""
        flat = text.replace("\n", " ")
        if " ".join(flat.split()) == flat:
            return self.plain.encode_to_numpy(text, disallowed_special=())
        if self.whole is None:
            import public_tokenizers
            self.whole = self.encoding(public_tokenizers.PATTERN)
        try:
            return self.whole.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the look-ahead goes back over a run of white space
            return None

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        out = None if self.special in text else self.fast(text)
        if out is None:
            if self.full is None:
                import public_tokenizers
                from tokenizers import Tokenizer
                self.full = Tokenizer.from_file(public_tokenizers.path(self.vocabulary))
            out = np.array(self.full.encode(text, add_special_tokens=False).ids)
        return out.astype("<u4").tobytes()


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """d, piece, start, length and ids_crc32 of the pieces of all documents; null texts are empty and have the end id only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        end = struct.pack("<I", END)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (d, k, x, y - x, zlib.crc32(ids[4 * x:4 * y]))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["d", "piece", "start", "length", "ids_crc32"])

    return keyed(docs).select("d", "text").mapInArrow(run, "d long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Put items, largest first, where the least room is left; open new bins for the others. ``room`` belongs to ``bins``."""
    by_room: dict[int, list[int]] = {}
    for k, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(k)
    rooms = sorted(by_room)
    for x in sorted(items, key=lambda i: -sizes[i]):
        need = sizes[x]
        at = bisect_left(rooms, need)
        if at < len(rooms):
            r = rooms[at]
            same = by_room[r]
            k = same.pop()
            if not same:
                del by_room[r], rooms[at]
        else:
            k, r = len(bins), capacity
            bins.append([])
            room.append(r)
        bins[k].append(x)
        room[k] = r = r - need
        if r:
            if r in by_room:
                by_room[r].append(k)
            else:
                by_room[r] = [k]
                insort(rooms, r)


def fitness(room: list[int], capacity: int) -> float:
    """Mean square of the fill of the bins: fewer and fuller bins are fitter."""
    return sum((1 - r / capacity) ** 2 for r in room) / max(len(room), 1) - len(room)


def cross(giver: tuple, taker: tuple, sizes: list[int], capacity: int, rng: random.Random) -> tuple:
    """Child of two packings (bins, room)."""
    bins, room = giver
    full = [k for k, r in enumerate(room) if r <= capacity // 500]
    inject = [k for k in full if rng.random() < 0.7] or [min(range(len(room)), key=room.__getitem__)]
    taken = bytearray(len(sizes))
    new, left = [], []
    for k in inject:
        new.append(bins[k])
        left.append(room[k])
        for x in bins[k]:
            taken[x] = 1
    displaced = []
    for members, r in zip(*taker):
        if r > capacity // 100 or any(taken[x] for x in members):  # duplicates, or badly filled
            displaced.extend(x for x in members if not taken[x])
        else:
            new.append(members)
            left.append(r)
    rng.shuffle(displaced)
    new = [list(m) for m in new]
    best_fit(displaced, sizes, capacity, new, left)
    return new, left


def fresh(sizes: list[int], capacity: int, apart: float, rng: random.Random) -> tuple:
    """A new packing (bins, room): the ``apart`` share of the pieces comes first, so that packings differ."""
    order = list(range(len(sizes)))
    rng.shuffle(order)
    first = int(len(order) * apart)
    bins: list[list[int]] = []
    room: list[int] = []
    best_fit(order[:first], sizes, capacity, bins, room)
    best_fit(order[first:], sizes, capacity, bins, room)
    return bins, room


def generation(people: list[tuple], sizes: list[int], capacity: int, floor: int, rng: random.Random) -> tuple:
    """The fittest of some packings and their children."""
    for _ in range(CHILDREN):
        people.sort(key=lambda p: -fitness(p[1], capacity))
        if len(people[0][0]) <= floor:
            break
        a, b = rng.sample(range(min(3, len(people))), 2)
        people[-1] = cross(people[a], people[b], sizes, capacity, rng)
    return max(people, key=lambda p: fitness(p[1], capacity))


def breed_field(pick: list[int], bins: list[list[int]], room: list[int], sizes: list[int], capacity: int, rng: random.Random) -> bool:
    """Breed the pieces of a few bins among themselves and keep a fitter packing of them, the emptiest bin last; a bin saved is left empty. Tells whether one was found."""
    items = [x for k in pick for x in bins[k]]
    part = [sizes[x] for x in items]
    number = iter(range(len(items)))
    now = [[next(number) for _ in bins[k]] for k in pick], [room[k] for k in pick]
    people = [now, *(fresh(part, capacity, rng.random(), rng) for _ in range(POPULATION - 1))]
    best = generation(people, part, capacity, len(pick) - 1, rng)  # slack gathers in one bin before it can be saved
    if fitness(best[1], capacity) <= fitness(now[1], capacity) + 1e-9:
        return False
    order = sorted(range(len(best[0])), key=lambda i: best[1][i])
    for at, k in enumerate(pick):
        i = order[at] if at < len(order) else None
        bins[k], room[k] = ([], capacity) if i is None else ([items[x] for x in best[0][i]], best[1][i])
    return True


def evolve(sizes: list[int], elites: list[list[list[int]]], capacity: int, seed: int) -> list[list[int]]:
    """The fittest packing after some children of the given and of new packings, and after its fields are bred."""
    rng = random.Random(seed)
    people = [(e, [capacity - sum(sizes[x] for x in b) for b in e]) for e in elites]
    while len(people) < POPULATION:
        people.append(fresh(sizes, capacity, 0.05 * len(people), rng))
    floor = -(-sum(sizes) // capacity)
    bins, room = map(list, generation(people, sizes, capacity, floor, rng))
    left = max(FIELDS, len(sizes) // EARN)
    while left > 0 and len(bins) > floor:
        kinds: list[list[int]] = [[], []]
        for k, r in enumerate(room):
            kinds[not r].append(k)
        opened, full = kinds
        last = max(opened, key=room.__getitem__)
        opened.remove(last)
        rng.shuffle(opened)
        rng.shuffle(full)
        for at in range(0, max(len(opened), 1), FIELD):
            left -= 1
            breed_field([*opened[at:at + FIELD], *full[at:at + FIELD], last], bins, room, sizes, capacity, rng)
            if left <= 0 or not bins[last]:
                break
        held = [k for k, b in enumerate(bins) if b]
        bins, room = [bins[k] for k in held], [room[k] for k in held]
    return bins


def _island(group: pa.Table, capacity: int, epoch: int) -> Iterator[pa.RecordBatch]:
    shard, island = group.column("shard")[0].as_py(), group.column("island")[0].as_py()
    uid, length = group.column("uid").to_numpy(), group.column("length").to_numpy()
    source, slot = group.column("source").to_numpy(), group.column("slot").to_numpy()
    names, first, place = np.unique(uid, return_index=True, return_inverse=True)
    sizes = length[first].tolist()
    elites = []
    for s in np.unique(source) if epoch else ():
        mine = source == s
        bins: dict[int, list[int]] = {}
        for k, x in zip(slot[mine].tolist(), place[mine].tolist()):
            bins.setdefault(k, []).append(x)
        elites.append(list(bins.values()))
    best = evolve(sizes, elites, capacity, seed=(shard * 31 + island) * 31 + epoch)
    rows = [(k, x, at) for k, b in enumerate(best) for x, at in zip(b, np.cumsum([0] + [sizes[x] for x in b[:-1]]).tolist())]
    slots, items, offsets = (np.array(v, dtype=np.int64) for v in zip(*rows))
    n = len(items)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.full(n, island)), pa.array(names[items]), pa.array(np.array(sizes)[items]), pa.array(slots), pa.array(offsets)],
                                     ["shard", "island", "uid", "length", "slot", "offset"])


ISLAND = "shard long, island long, uid long, length long, slot long, offset long"


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    Each row is a document of its own, repeated or not; an empty or null text is one piece of one id. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    made = stage(pieces(docs, vocabulary, capacity).withColumn("uid", F.monotonically_increasing_id()))
    rest = made.where(F.col("length") < capacity).select("uid", "length")
    shards = max(1, round(rest.count() / SHARD))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    rows = dealt.select("shard", "uid", "length", F.lit(0).cast("long").alias("source"), F.lit(0).cast("long").alias("slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ISLANDS - 1).cast("long"))).alias("island"))
    for epoch in range(EPOCHS):
        elite = stage(sorted_groups(rows, ["shard", "island"], lambda g, e=epoch: _island(g, capacity, e), ISLAND))
        sent = elite.select("shard", "uid", "length", F.col("island").alias("source"), "slot", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)).alias("island"))
        rows = sent
    bins = elite.groupBy("shard", "island").agg(F.max("slot").alias("n"))
    best = bins.groupBy("shard").agg(F.min(F.struct("n", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    packed = elite.join(best, ["shard", "island"]).select("uid", (F.col("shard") * (1 << 32) + F.col("slot")).alias("sequence_id"), "offset")
    joined = made.join(packed, "uid", "left")
    return joined.select(F.col("d").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", -1 - F.col("uid")).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
