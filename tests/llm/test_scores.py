"""Quality scores, LM scores, substring dedup, URL filter, extraction and fingerprints."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import extraction, fingerprints, lattice_lm, phrase_dedup, quality, queries, url_filter

import brute

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held) and sum(g.held_out for g in got.values()) > len(held)
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got.values())


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b.", 0.5), (1, "a b.", 0.5), (None, None, 0.5), (3, "", 0.5), (4, "x" * 100_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == 5 and all(r.predicted == 1 for r in out) and all(r["row"]["score"] == 0.5 for r in out)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_substring_dedup_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_phrase_dedup(spark, SF).collect()}
    assert got == brute.substring_dedup(rows)


@pytest.mark.parametrize("characters", [1_100_000, 5])
def test_substring_dedup_odd_rows(spark, monkeypatch, characters):
    monkeypatch.setattr(phrase_dedup, "STREAM_BYTES", 200)
    monkeypatch.setattr(phrase_dedup, "CHARACTERS", characters)
    p = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + p), (1, "x " + p), (2, p + " y"), (2, None), (None, p), (3, ""), (4, " ".join("ab") + " " + p)] + [(k, p + f" z{k}") for k in range(10, 40)], "doc_id long, text string")
    out = collections.Counter((r["row"]["doc_id"], r.n_words, r.n_removed, r.kept) for r in phrase_dedup.drop_repeated_words(docs).collect())
    want = [(1, 21, 0, "x " + p)] * 2 + [(2, 21, 20, "y"), (2, 0, 0, ""), (None, 20, 20, ""), (3, 0, 0, ""), (4, 21, 20, "a b")] + [(k, 21, 20, f"z{k}") for k in range(10, 40)]
    assert out == collections.Counter(want)
    assert phrase_dedup.drop_repeated_words(docs.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [100_000, 50])
def test_lm_base_scores_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice_lm, "FREQUENT", frequent)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    count = collections.Counter(w for d, t in rows if not out[d] for w in [*words(t), "\n"])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in queries.op5_lattice_lm(spark, SF).collect()}
    for d, t in rows:
        mine = [*words(t), "\n"]
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(mine), sum(count[w] > 0 for w in mine), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine), rel=1e-9)
        assert r.score < 0


def test_lattice_sums_all_segmentations():
    import itertools
    import numpy as np
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "▁ab", "aba"]
    logs = np.log(np.arange(1, 9) / 40)
    lattice = lattice_lm.Lattice(pieces, [logs])
    got = lattice.scores(["abab", "b", "aba"])[0]
    for word, value in zip(["abab", "b", "aba"], got):
        text = "▁" + word
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[start:i])
                    start = i
            parts.append(text[start:])
            if all(p in pieces for p in parts):
                total += math.prod(math.exp(logs[pieces.index(p)]) for p in parts)
        assert math.exp(value) == pytest.approx(total)
    assert lattice.expected(["aba"], 0)[:-1].sum() > 1


def test_lm_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a B c", 1), (1, "a B c", 1), (None, None, 1), (2, "zz " * 4000, 1), (3, "é" * 3000, 1)], "doc_id long, text string, score int")
    out = sorted((r.n_tokens, round(r.score, 6), r["row"]["score"]) for r in lattice_lm.score_texts(docs).collect())
    assert [x[0] for x in out] == [1, 2, 4, 4, 4001] and out[2] == out[3] and all(x[1] < 0 and x[2] == 1 for x in out)
    assert lattice_lm.score_texts(docs.limit(0)).count() == 0


PAGES = [(1, "http://Trusted.Org/x?y#z", '<a href="https://good.net/1">g</a>'), (2, "http://good.net/p", ""), (3, "https://spam.net/a", '<a href="//a.com/de/1">x</a>'), (4, "http://a.com/de/9", None),
         (5, None, None), (6, "no scheme", "x"), (7, "http://www.example.org/en/12?q", ""), (8, "http://example.org/en/2", ""), (9, "http://example.org", ""), (10, "http://sub.spam.net", "")]


def test_url_filter_small(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.verdicts(pages).collect()}
    assert out == {1: ("trusted.org", "/x", "org/", "allow"), 2: ("good.net", "/p", None, "allow"), 3: ("spam.net", "/a", None, "block"), 4: ("a.com", "/de/9", "com/de/", "block"), 5: ("", "", None, "allow"),
                   6: ("", "", None, "allow"), 7: ("www.example.org", "/en/12", "example.org/en/1", "block"), 8: ("example.org", "/en/2", "org/", "allow"), 9: ("example.org", "", None, "allow"), 10: ("sub.spam.net", "", None, "block")}
    assert url_filter.verdicts(pages.limit(0)).count() == 0


def test_ranks_equal_plain_iteration(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 1.0), ("c", "a", 1.0)]
    seeds = {"a": 0.75, "b": 0.25}
    rank = {"a": 0.15 * 0.75, "b": 0.15 * 0.25}
    for _ in range(5):
        nxt = {h: 0.15 * x for h, x in seeds.items()}
        for s, d, w in edges:
            nxt[d] = nxt.get(d, 0) + 0.85 * w * rank.get(s, 0)
        rank = nxt
    base = spark.createDataFrame([("t", h, 0.15 * seeds.get(h, 0), 0.0) for h in "abc"], "side string, host string, a double, own double")
    got = url_filter.iterate(spark.createDataFrame([("t", *e) for e in edges], "side string, src string, dst string, share double"), base, rounds=5)
    assert {r.host: round(r["rank"], 12) for r in got.collect()} == {h: round(x, 12) for h, x in rank.items()}


@pytest.mark.parametrize("links", [0, 12])
def test_verdicts_equal_dense_algebra(spark, links):
    """Hosts on several levels, some linked: ranks solve the linear system over all edges, and verdicts compare them."""
    import random

    import numpy as np
    rng = random.Random(5)
    tops = [f"d{k}.{t}" for k in range(6) for t in ("com", "org", "net")]
    hosts = tops + [f"s{k}.{rng.choice(tops)}" for k in range(30)]
    hosts += [f"u{k}.{rng.choice(hosts[18:])}" for k in range(20)]
    hosts = [h for h in hosts if h != tops[0]] + ["a.b.c.d.e.f.g.h.i.deep.net"]
    far = rng.sample(hosts, 12)
    pages = []
    for k in range(160):
        h = rng.choice(hosts)
        to = rng.choice(far) if links and rng.random() < 0.2 and h in far else None
        pages.append((k, f"http://{h}/{rng.choice(['de', 'fr', 'x', 'en'])}/{k}", f'<a href="http://{to}/y">y</a>' if to else ""))
    got = {r.page_id: r for r in url_filter.verdicts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    weight, seeds = collections.Counter(), {"allow": collections.Counter(), "block": collections.Counter()}
    known = {u.split("/")[2] for _, u, _ in pages} | {x.split("/")[2] for _, _, x in pages if x}
    for _, u, x in pages:
        if x and x.split("/")[2] != u.split("/")[2]:
            weight[u.split("/")[2], x.split("/")[2]] += 1
    for h in known:
        if h.count(".") >= 2:
            weight[h, h.split(".", 1)[1]] += 1
            weight[h.split(".", 1)[1], h] += 1
    for r in got.values():
        if r.rule:
            seeds[r.verdict][r.host] += 1
    every = sorted({x for e in weight for x in e} | known)
    at = {h: i for i, h in enumerate(every)}
    m = np.zeros((len(every), len(every)))
    for (a, b), n in weight.items():
        m[at[a], at[b]] = n
    share = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
    back = (share / np.maximum(share.sum(axis=0, keepdims=True), 1e-300)).T
    ranks = {}
    for side, matrix in (("allow", share), ("block", back)):
        v = np.array([seeds[side][h] for h in every]) / max(1, sum(seeds[side].values()))
        ranks[side] = np.linalg.solve(np.eye(len(every)) - 0.85 * matrix.T, 0.15 * v)
    assert len({r.verdict for r in got.values() if not r.rule}) == 2
    for r in got.values():
        trust, distrust = ranks["allow"][at[r.host]], ranks["block"][at[r.host]]
        assert r.trust == pytest.approx(trust, rel=1e-5, abs=1e-15) and r.distrust == pytest.approx(distrust, rel=1e-5, abs=1e-15)
        assert r.rule or r.verdict == ("block" if distrust > trust * (1 + 2e-5) else "allow")


def test_extraction_of_the_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op7_html_extraction(spark, SF).collect():
        want = [t for p, t, _ in extraction.blocks(pages[r.page_id]) if "article" in p]
        assert r.text == "\n".join(want) and r.n_chars == len(r.text)


def test_blocks():
    page = "<title>T</title><p>a &amp; <b>b</b>c<br>d&nbsp; e<p>f<!-- x --><script>var a='</p>'</script>g<ul><li>h<li><a href='>'>i</a></ul>&lt;j"
    assert [t for _, t, _ in extraction.blocks(page)] == ["T", "a & bc d e", "fg", "h", "i", "<j"]
    assert extraction.blocks(None) == extraction.blocks("") == extraction.blocks("<p> </p>") == []


def test_extraction_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, 2), (1, "", 2), (None, "<p>x", 2), (2, "<article>" + "<p>y.</p>" * 3000 + "</article>", 2)], "page_id long, html string, main int")
    out = extraction.extract(pages).collect()
    assert len(out) == 4 and all(r["row"]["main"] == 2 for r in out)
    assert [r.main for r in out if r["row"]["html"] in (None, "")] == ["", ""]
    assert extraction.extract(pages.limit(0)).count() == 0


def test_fingerprints_of_the_table(spark):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op10_document_fingerprints(spark, SF).collect()}
    errors, by_text = [], {}
    for k, (d, t) in enumerate(docs):
        after, r = docs[(k + 1) % len(docs)][1], got[d]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + after[:cut]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        a, b = (collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (t, edited))
        errors.append(r.near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(sum(errors) / len(errors)) < 0.03 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.1


def test_fingerprints_odd_rows(spark):
    docs = spark.createDataFrame([(5, "e e e"), (5, "e e e"), (4, None), (3, " \n"), (2, "b c d"), (None, "a")], "doc_id long, text string")
    out = sorted(((r.doc_id or 0), r.n_chars, r.near_edited, r.near_next) for r in fingerprints.fingerprints(docs).collect())
    assert [x[:2] for x in out] == [(0, 1), (2, 5), (3, 2), (4, 0), (5, 5), (5, 5)]
    assert out[2][2:] == (1.0, 0.0) and out[3][2:] == (1.0, 1.0) and out[4] == out[5]
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    assert fingerprints.fingerprints(docs.where("doc_id = 2")).first().near_next == 1.0


def test_fingerprints_of_dominant_words(spark):
    own = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    spam = "spam " * 10_000
    docs = spark.createDataFrame([(4, spam + own("a", 100)), (3, spam + own("b", 100)), (2, "hot " * 30 + own("c", 300)), (1, "cold " * 3000 + own("c", 300))], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in fingerprints.fingerprints(docs).collect()}
    assert got[4] > 0.93 and got[3] < 0.03  # 10000 / 10200, and nothing shared
    assert abs(got[2] - 300 / 3330) < 0.1


def test_samples_equal_direct_gamma_draws(spark):
    """Each sample is the (word, t) of the least a, with c and r from the inverse distribution of Gamma(2, 1) itself, not from tables."""
    import numpy as np
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(k, " ".join(f"w{i % (7 * k)}" for i in range(60 * k))) for k in range(1, 9)], "o long, text string")
    got = {r.o: r.own for r in fingerprints.signatures(docs.withColumn("edited", F.lit("")), ["o"]).collect()}
    terms = spark.range(56).select(F.concat(F.lit("w"), "id").alias("w")).select("w", F.xxhash64("w").alias("t"))
    hashes = terms.select("w", *[F.xxhash64("t", F.lit(j)).alias(str(j)) for j in range(fingerprints.SAMPLES)]).collect()
    h = {r.w: np.array(r[1:], dtype=np.int64).view(np.uint64) for r in hashes}
    same = total = 0
    for k, text in docs.collect():
        best = np.full(fingerprints.SAMPLES, np.inf)
        sig = np.zeros(fingerprints.SAMPLES, dtype=np.int64)
        for w, n in collections.Counter(text.split()).items():
            x = h[w]
            c = fingerprints.gamma_quantiles((x >> np.uint64(30)).astype(float) / 2**34)
            r = fingerprints.gamma_quantiles(((x & np.uint64(1023)).astype(float) + 0.5) / 1024)
            beta = ((x >> np.uint64(10)) & np.uint64(0xFFFFF)).astype(float) / 2**20
            t = np.floor(math.log(n) / r + beta)
            a = np.log(c) - r * (t - beta + 1)
            mark = ((x >> np.uint64(10)).astype(np.int64) ^ (t.astype(np.int64) * 40503)) & 0xFFFF
            sig = np.where(a < best, mark, sig)
            best = np.minimum(a, best)
        same += sum(int(p == q) for p, q in zip(got[k], sig))
        total += fingerprints.SAMPLES
    assert same >= 0.99 * total


def test_fingerprints_weigh_words_as_generalised_jaccard(spark):
    """Rising weights of one word against the same rest: likeness follows the sum of least over the sum of greatest weights."""
    rest = " ".join(f"r{i}" for i in range(100))
    docs = spark.createDataFrame([(10 - k, "heavy " * n + rest) for k, n in enumerate((1, 3, 10, 30, 100, 300, 1000))], "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in fingerprints.fingerprints(docs).collect()}
    for k, (n, m) in enumerate(zip((1, 3, 10, 30, 100, 300), (3, 10, 30, 100, 300, 1000))):
        assert abs(near[10 - k] - (100 + n) / (100 + m)) < 0.16


def test_fingerprints_of_a_repeated_row(spark):
    text = "a a b c d e f g h a b"
    docs = spark.createDataFrame([(3, text)] * 4 + [(2, text), (1, "a b c x y z")], "doc_id long, text string")
    out = fingerprints.fingerprints(docs).collect()
    assert len(out) == 6 and len({r.fingerprint for r in out if r.doc_id != 1}) == 1
    assert all(r.near_next == 1.0 for r in out if r.doc_id == 3)


def test_quality_measures_very_long_texts():
    assert quality.features("word " * (1 << 20))[17] == pytest.approx(0.1)


def test_quality_learns_from_repeated_rows_once(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 8)
    docs = spark.createDataFrame([(1, "a b.")] * 50 + [(2, f"text {i}") for i in range(50)] + [(3, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality.F, "crc32", lambda c: quality.F.lit(1))
    assert quality.training_rows(docs.where("doc_id <> 2"), labels).count() == 2
    assert quality.training_rows(docs, labels).count() == 8


def test_quality_learns_from_all_labelled_rows(spark, monkeypatch):
    """More rows than the old bound; each is in a group with the other kind, however rare that is, and the cut is the exact quantile."""
    import numpy as np
    ids = spark.range(30_000)
    docs = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string"), F.when(F.col("id") % 9999 == 2, " $$").otherwise("")).alias("text"))
    labels = ids.select(F.col("id").alias("doc_id"), (F.col("id") % 9999 != 2).cast("int").alias("quality"))
    rows = quality.stage(quality.training_rows(docs, labels))
    learnt = [k for k in range(30_000) if zlib.crc32(str(k).encode()) % 5]
    assert rows.count() == len(learnt) > 20_000
    bad = sum(k % 9999 == 2 for k in learnt)
    met = quality.groups(rows, len(learnt) - bad, bad).collect()
    assert sum(len(g.good) for g in met) == (len(learnt) - bad) * quality.WIDTH * 8 and len(met) > 1 and all(g.bad for g in met)
    model = quality.fit(rows)
    strength = np.sort([np.clip((np.array(r.f) - model["mean"]) / model["scale"], -6, 6) @ model["w"] for r in rows.select("f").collect()])
    assert bad and model["cut"] == pytest.approx((strength[bad - 1] + strength[bad]) / 2, abs=1e-9) and strength[bad - 1] < strength[bad]


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0], [0.5, -2.0, 7.0, 7.0, 7.5, 1e-9, 0.0], list(range(200))])
def test_quantile_gap_is_exact(spark, monkeypatch, values):
    monkeypatch.setattr(quality, "BINS", 4)
    df, held = spark.createDataFrame([(float(v),) for v in values], "s double").cache(), sorted(values)
    for n in {1, len(held) // 2 or 1, max(len(held) - 1, 1), len(held)}:
        assert quality.nth_gap(df, n) == (held[n - 1] + held[min(n, len(held) - 1)]) / 2


def test_labeller_reads_long_pages_as_one_sequence(monkeypatch):
    import numpy as np
    model, rng = extraction.Labeller(), np.random.default_rng(1)
    pages = [rng.normal(size=(n, extraction.DIM)).astype(np.float32) for n in (40, 95, 100)]
    whole = model.chances(pages)
    monkeypatch.setattr(extraction, "STRETCH", 7)
    assert np.allclose(model.chances(pages), whole, atol=1e-5)
    assert np.allclose(model.chances(pages[:1])[:, 0], whole[:40, 0], atol=1e-5)


def test_learning_sees_the_end_of_long_pages(monkeypatch):
    seen = []
    monkeypatch.setattr(extraction.Labeller, "train", lambda self, pages: seen.extend(pages))
    extraction.learn(["<nav>n</nav><article>" + "<p>x y.</p>" * 700 + "</article><footer>f</footer>"])
    assert len(seen[0][0]) == 702 and seen[0][1][-1] == 0 and seen[0][1][-2] == 1


def test_training_takes_long_pages():
    import numpy as np
    extraction.Labeller().train([(np.ones((n, extraction.DIM), np.float32), np.ones(n, np.float32)) for n in (3, 600, 9000)], passes=1)


def test_ranks_reach_far_hosts_however_small(spark):
    """Sixteen edges from a seed of 1e-12 a rank is still exact."""
    edges = spark.createDataFrame([("t", f"h{k}", f"h{k + 1}", 1.0, True) for k in range(16)], "side string, src string, dst string, share double, linked boolean")
    seeds = spark.createDataFrame([("t", "h0", 1e-12)], "side string, host string, rank double")
    got = {r.host: r["rank"] for r in url_filter.propagate(edges, seeds).collect()}
    assert got == {f"h{k}": pytest.approx(0.15e-12 * 0.85 ** k, rel=1e-9) for k in range(17)}


def test_lattice_has_the_long_pieces():
    import numpy as np
    pieces = lattice_lm.vocabulary()
    assert max(map(len, pieces)) > 8
    lattice = lattice_lm.Lattice(pieces, [lattice_lm.piece_weights(pieces, np.ones(len(pieces)))])
    long = max((p for p in pieces if p.startswith("▁")), key=len)
    assert lattice.expected([long[1:]], 0)[pieces.index(long)] > 0.5
