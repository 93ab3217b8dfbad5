"""The filter audit against brute force."""

import collections
import itertools
import re

from ledgerloom.llm import filter_audit


def brute(docs, labels):
    parts = collections.defaultdict(list)
    for d, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)),
                 any((u or "") == t and e is not None and d is not None and e < d for e, u, _ in docs)]
        good, toxic = (any(x == d and d is not None and v[k] == 1 for x, *v in labels) for k in (0, 1))
        parts[lang or ""].append((dict(zip("ABCDE", fails)), good, toxic))
    out = {}
    for part, rows in parts.items():
        removed = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for i, c in enumerate(order):
                before = order[:i]
                left = [r for r in rows if not any(r[0][b] for b in before)]
                gone = [r for r in left if r[0][c]]
                removed[c] += len(gone)
                out[part, "".join(order), i + 1] = [len(left) - len(gone), len(gone), sum(r[0][c] for r in rows) - len(gone),
                                                   sum(r[0][c] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(120))
    texts = [long, long + " #", "SHOUT " * 200, "a", None, "", long.upper(), "x $ y", long + " tail"]
    docs = [(k, texts[k * k % 9], ["en", "de", None][k % 3]) for k in range(40)] + [(3, texts[0], "en"), (3, texts[0], "de"), (None, texts[0], "en"), (None, None, None), (7, "only here", "fr")]
    labels = [(k, k % 2, (k + 1) % 3 % 2) for k in range(0, 40, 3)] + [(3, 1, None), (None, 1, 1), (4, None, None)]
    got = filter_audit.filter_audit(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int"),
                                    spark.createDataFrame([(*x, "e") for x in labels], "doc_id long, quality int, toxic int, lang string"))
    rows = got.collect()
    assert len(rows) == 4 * 120 * 5
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows} == brute(docs, labels)
    assert all(r["filter"] == r.filter_order[r.step - 1] for r in rows)


def test_audit_of_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    cells = filter_audit.mask_cells(docs, labels).collect()
    assert [(r.part, r["mask"], r.n, r.good, r.toxic) for r in cells] == [("en", 2, 1, 0, 0)]


def test_audit_of_other_letters(spark):
    """Three filters from given cells: 6 orders of 3 steps."""
    cells = spark.createDataFrame([("", 0, 5, 1, 0), ("", 3, 2, 0, 1), ("", 4, 7, 7, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in filter_audit.audit(cells, "XYZ").collect()}
    assert len(rows) == 18
    assert (rows["XYZ", 1].removed, rows["XYZ", 2].removed, rows["XYZ", 2].redundant, rows["XYZ", 3].removed, rows["XYZ", 3].kept) == (2, 0, 2, 7, 5)
    assert rows["XYZ", 1].shapley == 6 and rows["XYZ", 3].shapley == 42


def test_audit_of_many_parts(spark):
    """More rows than a recursive query may have by default, were they to count: the limit is lifted while it runs."""
    from pyspark.sql import functions as F
    limit = spark.conf.get(filter_audit.ROW_LIMIT)
    spark.conf.set(filter_audit.ROW_LIMIT, "1000")
    try:
        cells = spark.range(50).select(F.col("id").cast("string").alias("part"), F.lit(1).alias("mask"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
        assert filter_audit.audit(cells).count() == 50 * 600
        assert spark.conf.get(filter_audit.ROW_LIMIT) == "1000"
    finally:
        spark.conf.set(filter_audit.ROW_LIMIT, limit)
