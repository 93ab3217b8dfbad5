"""The corpus pipeline and each of its stages."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"passage{i}" for i in range(40))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, d long, h long, kept string"


def odd_rows():
    """Nulls in every column, empty and blank texts, a repeated row, one doc_id with two texts, copies, and a long text."""
    line = "a line of some twenty words that comes again and again in many of the documents of this small corpus today"
    texts = [(1, PASSAGE + " end"), (1, PASSAGE + " end"), (2, PASSAGE + " end"), (2, "another text of the same number\n" + line), (None, None), (None, PASSAGE), (3, ""), (4, " \n\t"), (5, line + "\nunlike"),
             (6, "long " * 20_000)]
    return [(d, t, "en", "web", len(t or ""), "x", 7, 8, "y") for d, t in texts] + [(9, "no lang", None, None, None, None, None, None, None)]


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, name, step):
    docs = spark.createDataFrame(odd_rows(), COLUMNS)
    out = step(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 9, None}
    else:
        assert out.columns == docs.columns
        kept = {r.doc_id for r in rows}
        assert kept <= {1, 2, 3, 4, 5, 6, 9, None} and 9 in kept
        assert all((r.row, r.d, r.h, r.kept) == ("x", 7, 8, "y") for r in rows if r.doc_id != 9)
    if name == "near_duplicates":
        assert sum((r.text or "").startswith(PASSAGE) and r.text.endswith("end") for r in rows) == 1
    if name == "lines":
        assert sum(PASSAGE + " end" in (r.text or "") for r in rows if r.doc_id == 2) == 0
    assert step(spark, docs.limit(0), SF).count() == 0


def test_run_applies_the_stages_in_order(spark):
    ran = corpus_pipeline.run(spark, SF)
    pieces = ran.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, SF))
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    assert left and {p.doc_id for p in pieces} == left
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for found in by_doc.values():
        found.sort(key=lambda p: p.piece)
        assert [p.start for p in found] == [sum(q.length for q in found[:i]) for i in range(len(found))]
    room = {}
    for p in pieces:
        room[p.sequence_id] = room.get(p.sequence_id, 0) + p.length
    assert max(room.values()) <= 1024
