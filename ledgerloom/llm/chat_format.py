"""Chat formatting: a finite-state machine over roles checks the order of turns and emits text segments with loss flags from a declarative template.

Control strings inside texts get a backslash after their first character, and those that have backslashes there already get one more, so the formatted text can be
parsed back into exactly the same turns and no text can pass for a mark of the template.

A conversation is cut into chunks of CHUNK consecutive turn numbers, which different tasks format. Which state a chunk starts in is found before, from roles alone: a chunk
maps every state to the one that it ends in, and the maps of a conversation are composed in order, one short row a chunk. Rows stream through sorted partitions, and what is held is one
block of at most BLOCK_TURNS turns or about BLOCK_CHARS characters, however many turns a conversation has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, stage

#: Turn numbers of a chunk are those with the same upper bits.
CHUNK_BITS = 8
BLOCK_TURNS, BLOCK_CHARS = 256, 1 << 20
#: Chunk of rows without a turn number, which come first.
NO_TURN = -(1 << 62)


@dataclass(frozen=True)
class Turn:
    """What surrounds the text of a turn, and whether the text counts for the loss."""
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``turns`` by role; ``other`` for roles without one, its opening takes the role; ``moves`` (state, role, next state); ``final`` states in which a conversation may end.

    Every opening but one starts with a control string, every closing holds one, and openings end with white space, so marks and texts never run together.
    """
    controls: tuple[str, ...]
    turns: dict[str, Turn]
    other: Turn
    start: str
    moves: tuple[tuple[str, str, str], ...]
    final: tuple[str, ...]
    pattern: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or "\\" in c or re.search(r"\s", c):
                raise ValueError(f"not a control string: {c!r}")
        ordered = sorted(self.controls, key=len, reverse=True)
        object.__setattr__(self, "pattern", re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in ordered)))
        bare = [r for r, t in [*self.turns.items(), (None, self.other)] if not t.opening.startswith(self.controls)]
        if len(bare) > 1 or any(not any(c in t.closing for c in self.controls) or not t.opening[-1:].isspace() for t in [*self.turns.values(), self.other]):
            raise ValueError("marks of the template run together")

    # -- texts
    def escape(self, text: str) -> str:
        """A backslash after the first character of each control string, also of those that have some there."""
        return self.pattern.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self.pattern.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) segments of a turn."""
        turn = self.turns.get(role)
        if turn is None:
            name = self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
            return [(self.other.opening.replace("{role}", name), False), (self.escape(text), self.other.loss), (self.other.closing, False)]
        return [(turn.opening, False), (self.escape(text), turn.loss), (turn.closing, False)]

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        at = 0
        before, after = self.other.opening.split("{role}")
        marked = sorted(self.turns.items(), key=lambda x: len(x[1].opening), reverse=True)
        while at < len(formatted):
            if formatted.startswith(before, at):
                end = formatted.index(after, at + len(before))
                name = self.unescape(formatted[at + len(before):end])
                role, turn, begin = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name), self.other, end + len(after)
            else:
                role, turn = next((r, t) for r, t in marked if formatted.startswith(t.opening, at))
                begin = at + len(turn.opening)
            end = formatted.index(turn.closing, begin)
            yield role, self.unescape(formatted[begin:end])
            at = end + len(turn.closing)

    # -- order of turns
    def states(self) -> list[str]:
        return sorted({self.start, *(s for s, _, _ in self.moves), *(s for _, _, s in self.moves)})

    def steps(self) -> Callable[[int, str], tuple[int, bool]]:
        """(state, role) -> (next state, legal). After an illegal turn the machine goes on as if the role had been legal; an unknown role changes nothing."""
        number = {s: i for i, s in enumerate(self.states())}
        legal = {(number[s], r): number[t] for s, r, t in self.moves}
        resume = {r: number[t] for _, r, t in self.moves}

        def step(state: int, role: str) -> tuple[int, bool]:
            to = legal.get((state, role))
            return (to, True) if to is not None else (resume.get(role, state), False)
        return step


#: One public style of instruction template: users ask between [INST] marks, answers end with </s>.
INSTRUCTION = Template(
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"),
    turns={"system": Turn("<<SYS>>\n", "\n<</SYS>>\n"), "user": Turn("<s>[INST] ", " [/INST]"), "assistant": Turn(" ", "</s>", loss=True)},
    other=Turn("<<ROLE>>{role}\n", "<</ROLE>>"),
    start="start",
    moves=(("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"), ("user", "assistant", "assistant"), ("assistant", "user", "user")),
    final=("user", "assistant"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of at most ``limit`` rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == limit:
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def start_states(turns: DataFrame, template: Template) -> DataFrame:
    """(conv_id, chunk, state): the state in which each chunk of the conversations of several chunks starts."""
    step, count, first = template.steps(), len(template.states()), template.states().index(template.start)
    maps = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("ends", pa.list_(pa.int32()))])
    states = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("state", pa.int32())])

    def chunk_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, ends = None, []
            for conv, chunk, _, role in _rows(batches):
                if (conv, chunk) != key:
                    if key:
                        yield (*key, ends)
                    key, ends = (conv, chunk), list(range(count))
                ends = [step(s, role)[0] for s in ends]
            if key:
                yield (*key, ends)
        yield from _batches(rows(), maps)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, single, state = (), None, first
            for conv, chunk, ends in _rows(batches):
                if (conv,) != last:
                    last, single, state = (conv,), (conv, chunk, first), first
                else:
                    if single:
                        yield single
                        single = None
                    yield conv, chunk, state
                state = ends[state]
        yield from _batches(rows(), states)
    few = turns.select("conv_id", "chunk", "turn", "role").repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role")
    mapped = few.mapInArrow(chunk_maps, "conv_id bigint, chunk bigint, ends array<int>")
    return mapped.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(compose, "conv_id bigint, chunk bigint, state int")


BLOCK = "conv_id bigint, chunk bigint, block bigint, parted boolean, segments array<struct<text:string,loss:boolean>>, n_turns bigint, illegal bigint, state int"


def format_conversations(conversations: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """One row per block of turns, in order of (conv_id, chunk, block): ``segments`` (text, loss), whose texts joined are the formatted text; n_turns; ``illegal`` turns by
    the state machine; the ``state`` after the block; ``parted`` says that a conversation has several chunks.

    Turns go by (turn, role, text), nulls first; null texts and roles are empty, rows without conv_id are one conversation; repeated rows are turns of their own. Illegal turns are
    formatted like others, roles unknown to the template with its mark for others. An empty table has no blocks. A very long text is a block by itself.
    """
    small_batches(conversations.sparkSession)
    empty = F.lit("")
    turn = F.col("turn").cast("long")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.shiftright(turn, CHUNK_BITS), F.lit(NO_TURN)).alias("chunk"), turn.alias("turn"),
                                 F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    begins = start_states(turns, template).select("conv_id", "chunk", "state", F.lit(None).cast("long").alias("turn"), empty.alias("role"), empty.alias("text"))
    both = turns.withColumn("state", F.lit(None).cast("int")).unionByName(begins).withColumn("kind", F.when(F.col("state").isNull(), 1).otherwise(0))
    dealt = both.select("conv_id", "chunk", "kind", "turn", "role", "text", "state").repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "kind", "turn", "role", "text")
    step, first = template.steps(), template.states().index(template.start)
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("block", pa.int64()), ("parted", pa.bool_()),
                        ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("n_turns", pa.int64()), ("illegal", pa.int64()), ("state", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, block, parted, state = None, 0, False, first
            segments: list[dict] = []
            n = illegal = chars = 0
            for conv, chunk, kind, _, role, text, begin in _rows(batches):
                if (conv, chunk) != key:
                    if n:
                        yield (*key, block, parted, segments, n, illegal, state)
                    key, block, parted, state, segments, n, illegal, chars = (conv, chunk), 0, False, first, [], 0, 0, 0
                if not kind:
                    parted, state = True, begin
                    continue
                state, legal = step(state, role)
                for t, loss in template.segments(role, text):
                    if segments and not loss and not segments[-1]["loss"]:
                        segments[-1]["text"] += t
                    else:
                        segments.append({"text": t, "loss": loss})
                    chars += len(t)
                n, illegal = n + 1, illegal + (not legal)
                if n == BLOCK_TURNS or chars >= BLOCK_CHARS:
                    yield (*key, block, parted, segments, n, illegal, state)
                    block, segments, n, illegal, chars = block + 1, [], 0, 0, 0
            if n:
                yield (*key, block, parted, segments, n, illegal, state)
        yield from _batches(rows(), schema, 16)
    return dealt.mapInArrow(run, BLOCK)


FACTS = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("illegal", pa.int64()), ("valid", pa.bool_())]
FACTS_SQL = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, illegal bigint, valid boolean"


def read_back(blocks: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """One row per conversation, from what format_conversations() returns alone: its turns, parsed and unescaped, and the text under the loss mask, both as digests.

    Conversations of one chunk are read where they were formatted; the blocks of the others are dealt anew by conversation, since a digest goes over all of it in order. Blocks stream.
    """
    final = [i for i, s in enumerate(template.states()) if s in template.final]
    carried = pa.schema([("conv_id", pa.int64()), *FACTS, ("chunk", pa.int64()), ("block", pa.int64()),
                         ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("more", pa.int64()), ("state", pa.int32())])

    def reader(leave: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                last: tuple = ()
                none = (None,) * 5

                def done() -> tuple:
                    return (*last, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, illegal, illegal == 0 and state in final, *none)
                for conv, chunk, block, parted, segments, _, wrong, after in _rows(batches):
                    if leave and parted:
                        yield (conv, *(None,) * len(FACTS), chunk, block, segments, wrong, after)
                        continue
                    if (conv,) != last:
                        if last:
                            yield done()
                        last, turns, loss, n, chars, loss_chars, illegal = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                    formatted = "".join(s["text"] for s in segments)
                    for role, text in template.parse(formatted):
                        turns.update(f"{role}\n{text}\n".encode())
                        n += 1
                    for s in segments:
                        if s["loss"]:
                            text = template.unescape(s["text"])
                            loss.update(text.encode())
                            loss_chars += len(text)
                    chars, illegal, state = chars + len(formatted), illegal + wrong, after
                if last:
                    yield done()
            yield from _batches(rows(), carried, 64)
        return run
    sql = f"conv_id bigint, {FACTS_SQL}, chunk bigint, block bigint, segments array<struct<text:string,loss:boolean>>, more bigint, state int"
    read = stage(blocks.mapInArrow(reader(True), sql))
    parted = read.where("segments is not null").select("conv_id", "chunk", "block", F.lit(True).alias("parted"), "segments", F.lit(0).cast("long").alias("n_turns"), F.col("more").alias("illegal"), "state")
    rest = parted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "block").mapInArrow(reader(False), sql)
    facts = ["conv_id", *[c for c, _ in FACTS]]
    return read.where("segments is null").select(*facts).union(rest.select(*facts))
