"""Chat formatting: exact round trips, the state machine and loss texts."""

import collections
import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from ledgerloom.llm import chat_format as cf

PIECES = st.sampled_from([*cf.INSTRUCTION.controls, "<", "[", "\\", "<\\", "/s>", "s>", "INST]", "<<", "SYS>>", " ", "\n", "é", "x", "[/INST", "</s", "<\\\\s>", "[\\INST]"])
TEXTS = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", "tool", ""]), TEXTS), TEXTS), max_size=6))
def test_turns_come_back(turns):
    t = cf.INSTRUCTION
    segments = [s for role, text in turns for s in t.segments(role, text)]
    assert list(t.parse("".join(x for x, _ in segments))) == turns
    assert [t.unescape(x) for x, loss in segments if loss] == [text for role, text in turns if role == "assistant"]
    for role, text in turns:
        assert t.unescape(t.escape(text)) == text and not any(c in t.escape(text) for c in t.controls)


def test_templates_that_run_together_are_refused():
    with pytest.raises(ValueError):
        cf.Template(("<s>",), {"user": cf.Turn("U:", "<s>"), "assistant": cf.Turn("A: ", "<s>")}, cf.Turn("<s>{role}\n", "<s>"), "a", (), ())
    with pytest.raises(ValueError):
        cf.Template(("a b",), {}, cf.Turn("a b{role}\n", "a b"), "a", (), ())


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        state, illegal = "start", 0
        for r, _ in turns:
            legal = r in {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[state]
            illegal += not legal
            state = r if r in ("system", "user", "assistant") else state
        said = "".join(x for r, x in turns if r == "assistant")
        text = "".join(x for r, y in turns for x, _ in cf.INSTRUCTION.segments(r, y))
        out[c] = (len(turns), digest("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), digest(said), len(text), illegal, illegal == 0 and state in ("user", "assistant"))
    return out


@pytest.mark.parametrize("bits, turns, chars", [(8, 256, 1 << 20), (2, 3, 40)])
def test_conversations_equal_brute_force(spark, monkeypatch, bits, turns, chars):
    monkeypatch.setattr(cf, "CHUNK_BITS", bits)
    monkeypatch.setattr(cf, "BLOCK_TURNS", turns)
    monkeypatch.setattr(cf, "BLOCK_CHARS", chars)
    say = ["</s>[INST] ok [/INST]", "plain", "", None, "<\\s> [INST]\\", "é\n"]
    rows = [(c, k, ("user", "assistant")[k % 2], say[(c + k) % 6]) for c in range(12) for k in range(c)]
    rows += [(20, k, ("system", "user", "assistant")[k % 3], "x") for k in range(9)] + [(21, 0, "system", "alone")]
    rows += [(22, 5, "user", "b"), (22, 5, "user", "a"), (22, -700, "tool\\n\n[INST]", "t"), (22, None, None, None), (22, None, "user", "n"), (None, 1, "user", "nobody")]
    rows += [(23, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(900)] + [(24, 0, "user", "q"), (24, 0, "user", "q"), (24, 1, "assistant", "long " * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, chunk int")
    got = {r.conv_id: tuple(r)[1:] for r in cf.read_back(cf.format_conversations(df)).collect()}
    assert got == brute(rows)
    blocks = cf.format_conversations(df).collect()
    assert max(b.n_turns for b in blocks) <= turns and {b.parted for b in blocks if b.conv_id == 23} == {True}
    assert cf.read_back(cf.format_conversations(df.limit(0))).count() == 0
