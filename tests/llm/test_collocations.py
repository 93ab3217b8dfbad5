"""Phrase collocations against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import collocations


def brute(docs, least, top=2000, longest=4):
    out = {}
    for lang in {"und" if x is None else x for _, x in docs}:
        f, n = collections.Counter(), 0
        for text, x in docs:
            if ("und" if x is None else x) != lang:
                continue
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                w = re.findall(r"[^ \t]+", piece)
                n += len(w)
                for k in range(1, longest + 1):
                    f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        good = {p: a for p, a in f.items() if 1 < len(p) and a >= least}
        rows = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[p[:j]] + f[p[j:]]), j, f[p[:j]], f[p[j:]]) for j in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]):
            out[lang, i + 1] = (p.decode(), -a, l, r, n, -s)
    return out


def found(spark, docs, **kw):
    df = spark.createDataFrame([(t, x, "phrase", 1) for t, x in docs], "text string, lang string, phrase string, n int")
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, **kw).collect()}


def sample(count):
    rng = random.Random(3)
    common = [f"w{i}" for i in range(12)] + ["Été", "x\x00y", "AB"]
    docs = []
    for i in range(count):
        words = []
        for _ in range(rng.randrange(40)):
            words.append(rng.choice(["new york city council", "of the", "to be or not to be", "a a a a a"]) if rng.random() < 0.3 else rng.choice(common))
            words.append(rng.choice([" ", "  ", "\t", ". ", ", ", "\n", " ; "]))
        docs.append(("".join(words), ["en", "de", None, "und", ""][i % 5]))
    return docs + [(None, "en"), ("", None), (" . ", "fr"), ("lonely words", "fr")] + docs[:3] * 4


@pytest.mark.parametrize("heavy, block", [(1000, 4 << 20), (10, 300)])
def test_collocations_equal_brute_force(spark, monkeypatch, heavy, block):
    monkeypatch.setattr(collocations, "HEAVY", heavy)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    docs = sample(120)
    want = brute(docs, 4)
    assert len(want) > 80 and found(spark, docs, least=4) == want
    assert found(spark, docs, least=4, top=5) == brute(docs, 4, 5)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df).count() == 0


def test_prefix_totals_and_stripes(spark):
    """A merged stripe holds what follows a prefix, and the total of its entries is the number of times the prefix occurs."""
    df = spark.createDataFrame([("en", "a b a b a c. a")], "lang string, text string")
    root = collocations.merge(collocations.stripes(df, 0), 1).collect()
    words = {e.next: e.n for r in root for e in r.entries}
    assert sorted(words.values()) == [1, 2, 4] and sum(r.total for r in root) == 7
    ones = spark.createDataFrame([("en", [w]) for w in words], "lang string, ws array<bigint>")
    level = collocations.merge(collocations.stripes(df, 1, collocations.bitmap(ones)), 1).collect()
    assert {r.prefix[0]: r.total for r in level} == words
    assert sorted((words[r.prefix[0]], r.top) for r in level) == [(1, None), (2, 2), (4, 2)]


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 50)
    text = " ".join(f"w{i}" + ("." if i % 7 == 6 else "") for i in range(200)) + " " + "tail " * 40
    batch = pa.record_batch([pa.array(["en", "en"]), pa.array([text, "next"])], names=["lang", "text"])
    got, pieces = [], 0
    for block in collocations.blocks([batch]):
        _, _, piece, h, _, _ = collocations.words_of(*block)
        got += list(zip(piece + pieces, h))
        pieces += int(collocations.BREAK[block[2]].sum())
    whole = np.frombuffer((text + "\nnext\n").encode(), dtype=np.uint8)
    _, _, piece, h, _, _ = collocations.words_of(["en"], np.array([0]), whole)
    assert [x for _, x in got] == h.tolist()
    same = lambda p: [a == b for a, b in zip(p, p[1:])]
    assert same([p for p, _ in got]) == same(piece.tolist())
