"""Sinks, replays and chain shape."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.sources import blocks, upsert, versions
from ledgerloom.streaming import incremental


def test_upsert_replay_and_delete(spark, tmp_path):
    path = str(tmp_path / "t")
    mk = lambda rows: spark.createDataFrame(rows, "k bigint, op string, n bigint, v string")
    first = mk([(i, "put", 0, f"a{i}") for i in range(50)])
    second = mk([(1, "delete", 0, None), (2, "put", 1, "b"), (2, "put", 0, "old"), (3, "delete", 5, None), (3, "put", 1, "kept")])
    upsert.upsert_sink(first, path, ["k"], ["n"], 4)
    for _ in range(2):
        upsert.upsert_sink(second, path, ["k"], ["n"], 4)
        got = {r.k: r.v for r in versions.read_table(spark, path).collect()}
        assert got == {**{i: f"a{i}" for i in range(50) if i != 1}, 2: "b", 3: "kept"}


def test_price_history_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"100": "5", "101": "7"}))
    rows = blocks.read_price_history(spark, str(tmp_path / "p.json")).orderBy("height").collect()
    assert [(r.height, int(r.price)) for r in rows] == [(100, 5), (101, 7)]


def test_height_range_is_pushed_down(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("height")).write.parquet(str(tmp_path / "b"))
    df = blocks.load_blocks(spark, str(tmp_path / "b"), 10, 20)
    assert df.count() == 11
    assert "PushedFilters: [IsNotNull(height), GreaterThanOrEqual(height,10)" in df._jdf.queryExecution().toString()


def test_reprocessing_drops_vanished_heights(spark, tmp_path):
    path = str(tmp_path / "d")
    facts = spark.range(3000).select(F.col("id").alias("height"), F.lit(1).alias("v"))
    same = lambda df: df.groupBy("height").agg(F.sum("v").alias("v"))
    incremental.reprocess_from(facts, path, same, 0, 500)
    incremental.reprocess_from(facts.filter("height < 2100").withColumn("v", F.lit(5)), path, same, 1700, 500)
    got = {r.height: r.v for r in versions.read_table(spark, path).collect()}
    assert got == {h: (1 if h < 1700 else 5) for h in range(2100)}


def test_incremental_run_is_idempotent(spark, tmp_path):
    d = {n: str(tmp_path / n) for n in ("in", "ledger", "out", "c1", "c2")}
    schema = "height bigint, block_hash string, v bigint"
    fn = lambda df: df.groupBy("height", "block_hash").agg(F.sum("v").alias("v"))
    def feed(lo, hi):
        spark.range(lo, hi).select(F.col("id").alias("height"), F.concat(F.lit("h"), "id").alias("block_hash"), F.col("id").alias("v")) \
            .write.mode("append").parquet(d["in"])
    def run(ckpt):
        src = spark.readStream.schema(schema).parquet(d["in"])
        incremental.run_incremental(spark, src, d["ledger"], d["out"], [("m", 3, fn)], d[ckpt]).awaitTermination()
        return sorted((r.height, r.v) for r in versions.read_table(spark, d["out"] + "/m").collect())
    feed(0, 10)
    assert run("c1") == [(i, i) for i in range(3, 10)]
    feed(10, 15)
    assert run("c1") == [(i, i) for i in range(3, 15)]
    assert run("c2") == [(i, i) for i in range(3, 15)]


def test_block_in_parts_is_derived_whole_and_modules_fail_alone(spark, tmp_path):
    import pytest
    d = {n: str(tmp_path / n) for n in ("in", "ledger", "out", "c1", "c2", "c3")}
    schema = "height bigint, block_hash string, v bigint"
    for h, v in ((100, 1), (100, 1), (101, 5), (100, 7)):
        spark.createDataFrame([(h, f"b{h}", v)], schema).coalesce(1).write.mode("append").parquet(d["in"])
    total = lambda df: df.groupBy("height").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    def broken(df):
        raise RuntimeError("broken module")
    def run(ckpt, modules):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d["in"])
        incremental.run_incremental(spark, src, d["ledger"], d["out"], modules, d[ckpt]).awaitTermination()
    def rows(name):
        return sorted((r.height, r.n, r.v) for r in versions.read_table(spark, f"{d['out']}/{name}").collect())
    whole = [(100, 3, 9), (101, 1, 5)]
    run("c1", [("m", 0, total)])
    assert rows("m") == whole
    run("c2", [("m", 0, total), ("later", 101, total)])
    assert rows("m") == whole and rows("later") == [(101, 1, 5)]
    with pytest.raises(Exception, match="broken module"):
        run("c3", [("bad", 0, broken), ("next", 0, total)])
    assert rows("next") == whole


def test_late_trades_reach_their_candle(spark, tmp_path):
    schema = "pool_id bigint, height bigint, seq bigint, ts bigint, price_base decimal(38,0), price_quote decimal(38,0), base_delta decimal(38,0), quote_delta decimal(38,0)"
    for k, ts in enumerate((0, 100000, 200000, 300)):
        spark.createDataFrame([(1, ts // 600, k, ts, *map(Decimal, (5, 5, 100, 100)))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.candles_to_table(incremental.stream_candles(source), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {(r.bucket_ts, r.side): int(r.volume) for r in versions.read_table(spark, str(tmp_path / "out")).collect()}
    one = got[(99600, "base")]
    assert got[(0, "base")] == 2 * one and len(got) == 6


def test_late_trade_rewrites_its_day_alone(spark, tmp_path):
    schema = "pool_id bigint, bucket_ts bigint, side string, close bigint, op string, epoch bigint"
    path, day = str(tmp_path / "t"), F.floor(F.col("bucket_ts") / 86400)
    put = lambda epoch, *ts: upsert.upsert_sink(spark.createDataFrame([(1, t, "base", epoch, "put", epoch) for t in ts], schema), path, ["pool_id", "bucket_ts", "side"], ["epoch"], part=day)
    put(0, 0, 600, 86400, 172800)
    first = versions.version(spark, path)
    put(1, 1200)
    second = versions.version(spark, path)
    assert {d for d in first if first[d] != second[d]} == {0} and set(second) == {0, 1, 2}
    assert sorted((r.bucket_ts, r.close) for r in versions.read_table(spark, path).collect()) == [(0, 0), (600, 0), (1200, 1), (86400, 0), (172800, 0)]


def test_writer_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    import pytest
    path = str(tmp_path / "t")
    rows = lambda v: spark.range(100).select((F.col("id") % 4).alias("part"), "id", F.lit(v).alias("v"))
    assert versions.read_table(spark, path) is None
    versions.publish(rows(1), path, "part", lambda p: True)
    reader = versions.read_table(spark, path)

    def lost(*a, **k):
        raise RuntimeError("lost between data and manifest")
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lost)
        with pytest.raises(RuntimeError, match="between"):
            versions.publish(rows(2), path, "part", lambda p: p < 2)
    assert {r.v for r in versions.read_table(spark, path).collect()} == {1}
    versions.publish(rows(3).filter("part = 0"), path, "part", lambda p: p < 2)
    got = {(r.part, r.v) for r in versions.read_table(spark, path).collect()}
    assert got == {(0, 3), (2, 1), (3, 1)}
    assert reader.count() == 100 and {r.v for r in reader.collect()} == {1}
    versions.publish(rows(3).limit(0), path, "part", lambda p: True)
    assert versions.read_table(spark, path).count() == 0


def test_pool_size_counts_transactions(spark):
    from ledgerloom.streaming import mempool
    rows = [("t1", 1, "a"), ("t2", 2, "a"), ("t2", 2, "b"), ("t3", 3, "a"), ("t3", 3, "b")]
    pending = spark.createDataFrame([(t, s, a, 1.0) for t, s, a in rows], "txid string, first_seen bigint, address string, fee_rate double")
    assert sorted((r.txid, r.address) for r in mempool.mempool_prune(pending, 2).collect()) == [("t2", "a"), ("t2", "b"), ("t3", "a"), ("t3", "b")]
    page = mempool.pending_traces(pending, pending.select("txid"), 2).collect()
    assert [(r.txid, r.position, r.total) for r in page] == [("t3", 1, 3), ("t2", 2, 3)]


def test_series_number_within_the_normalized_name(spark):
    from ledgerloom.operators import catalogue
    rows = spark.createDataFrame([(1, "a b", 10), (2, "a-b", 20), (3, " A B", 30)], "token bigint, name string, creation_height bigint")
    assert {r.token: r.series_id for r in catalogue.series_ids(rows).collect()} == {1: "a-b", 2: "a-b", 3: "a-b-2"}
