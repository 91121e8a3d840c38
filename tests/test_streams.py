"""Streams and the decision table: late, out-of-order and repeated batches, compaction, sizes written."""

import os

import pytest
from pyspark.sql import functions as F

from assayer.functions.frames import fixed_table, heavy_keys, heavy_pieces, spread_join
from assayer.operators import verdicts as vd
from assayer.sources import decision_log
from assayer.streaming import live

ROW = "cid long, ordinal long, comment string"


def rows_of(df):
    return sorted((r["cid"] if r["cid"] is not None else -1, r["ordinal"], r["comment"]) for r in df.collect())


def written(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_decisions_in_batches_equal_one_merge(spark, tmp_path):
    """Out of order, repeated and empty batches, rows without a cid, a compaction after each of them."""
    batches = [
        [(1, 5, "a"), (2, 1, "b"), (1, 4, "old"), (None, 0, "loose")],
        [(1, 3, "late"), (3, 9, "c"), (2, 1, "again")],
        [],
        [(2, 8, "d"), (None, 7, "loose too"), (4, None, "no ordinal")],
        [(9, 1, "z"), (4, 2, "now one")],
    ]
    for compacted in ((), (1,), (0, 1, 2, 3, 4)):
        table = str(tmp_path / f"t{len(compacted)}")
        for k, rows in enumerate(batches):
            for _ in range(2):
                decision_log.append(spark.createDataFrame(rows, ROW), table, k, buckets=4)
            if k in compacted:
                decision_log.compact(spark, table, spark.createDataFrame([], ROW).schema)
        got = rows_of(decision_log.current(spark, table, spark.createDataFrame([], ROW).schema))
        assert got == [(-1, 0, "loose"), (-1, 7, "loose too"), (1, 5, "a"), (2, 8, "d"), (3, 9, "c"), (4, 2, "now one"), (9, 1, "z")], compacted


def test_what_is_written_follows_the_batch(spark, tmp_path):
    table, schema = str(tmp_path / "t"), spark.createDataFrame([], ROW).schema
    decision_log.append(spark.range(20_000).select(F.col("id").alias("cid"), F.lit(0).cast("long").alias("ordinal"), F.lit("c").alias("comment")), table, 0, buckets=16)
    decision_log.compact(spark, table, schema)
    before = written(table)
    decision_log.append(spark.createDataFrame([(7, 1, "x")], ROW), table, 1, buckets=16)
    new = {k: n for k, n in written(table).items() if k not in before}
    assert len(new) == 1 and sum(new.values()) < 3000
    decision_log.compact(spark, table, schema)
    new = {k for k in written(table) if k not in before and k.startswith("base")}
    assert {k.split("/")[2] for k in new} == {next(iter(new)).split("/")[2]}  # one bucket only
    assert decision_log.compact(spark, table, schema) == -1
    # a compaction that was broken off doesn't count
    decision_log.append(spark.createDataFrame([(8, 1, "y")], ROW), table, 2, buckets=16)
    decision_log.compact(spark, table, schema)
    os.remove(f"{table}/base/generation=2/_SUCCESS")
    want = {7: "x", 8: "y", 9: "c"}
    for step in (lambda: None, lambda: decision_log.compact(spark, table, schema), lambda: decision_log.vacuum(spark, table)):
        step()
        got = {r["cid"]: r["comment"] for r in decision_log.current(spark, table, schema).where("cid IN (7, 8, 9)").collect()}
        assert got == want and decision_log.current(spark, table, schema).count() == 20_000
    assert not [k for k in written(table) if k.startswith("log/batch=0") or k.startswith("log/batch=1")]
    assert decision_log.current(spark, str(tmp_path / "none"), schema).count() == 0


@pytest.fixture
def files(spark, tmp_path):
    """A stream of five files."""

    def build(batches, schema):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
        return live.stream_tables(spark, str(tmp_path), "t", spark.createDataFrame([], schema).schema)

    return build


def test_pages_come_late_twice_and_out_of_order(spark, files, tmp_path):
    batches = [[(1, 0, "a"), (2, 1, "b")], [(2, 2, "again"), (3, 3, "c"), (3, 2, "c first")], [(None, 9, "x")], [(1, 100_000_000, "years later"), (None, 9, "x")], [(4, -5, "d"), (2, 1, "b")]]
    table = str(tmp_path / "out")
    live.first_arrivals(files(batches, ROW), table, str(tmp_path / "state")).awaitTermination()
    got = live.arrived(spark, table, spark.createDataFrame([], ROW).schema)
    assert sorted(r["cid"] for r in got.where("cid IS NOT NULL").collect()) == [1, 2, 3, 4]
    assert got.where("cid IS NULL").count() == 2
    assert live.arrived(spark, str(tmp_path / "nothing"), got.schema).count() == 0


def test_a_stream_of_decisions_with_compaction(spark, files, tmp_path):
    batches = [[(k % 3, 10 * k + j, f"b{k}") for j in range(3)] for k in range(5)]
    table = str(tmp_path / "u")
    live.upsert_stream(files(batches, ROW), table, str(tmp_path / "us"), compact_every=2).awaitTermination()
    got = {r["cid"]: r["comment"] for r in decision_log.current(spark, table, spark.createDataFrame([], ROW).schema).collect()}
    assert got == {0: "b3", 1: "b4", 2: "b2"}
    assert decision_log.state(spark, table)[0] == 3


def test_heavy_keys_are_dealt_out(spark):
    big = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("k4", 2), (None, 3)], "k string, v int")
    assert heavy_keys(big, "k") == ["hot"] and heavy_keys(big.where("k IS NULL"), "k") == []
    for how, n in (("inner", 2001), ("left", 6000), ("left_semi", 2001)):
        out = spread_join(big, small, "k", ["id"], how)
        assert out.count() == n and "__salt" not in out.columns
    left = spread_join(big, small, "k", ["id"], "left")
    assert left.where("v IS NOT NULL").groupBy("v").count().collect() and left.where("k = 'hot' AND v IS NULL").count() == 0


def test_a_callee_of_many_sites_and_many_bounds(spark):
    """100,000 sites of one function, 1,000 bounds: sites never meet bounds."""
    sites = spark.range(100_000).select(
        F.lit("f").alias("callee"), F.col("id").cast("string").alias("path"), F.lit(2).cast("long").alias("line_no"), F.concat(F.lit("f(p, "), (F.col("id") % 500 + 100).cast("string"), F.lit(");")).alias("snippet"),
        F.lit("g").alias("caller"), F.lit(1).cast("long").alias("caller_start"), F.lit("void g() {\n f(p, 1);\n}").alias("body"),
    )
    asked = spark.range(1000).select(F.lit("f").alias("callee"), F.lit(2).alias("arg_pos"), F.lit(0).alias("buf_pos"), F.col("id").alias("bound"))
    got = {r["bound"]: r["caller_verdict"] for r in vd.caller_answers(asked, sites).collect()}
    # values run from 100 to 599: all outside up to 100, mixed up to 599, all inside from 600 on; no bound, no answer
    assert got == {b: "" if b == 0 or 100 < b < 600 else "oob" if b <= 100 else "bounded" for b in range(1000)}


def test_copies_for_heavy_keys_grow_with_their_shares_and_are_not_broadcast(spark):
    big = spark.range(2560).selectExpr("CASE WHEN id < 1280 THEN 'half' WHEN id < 1300 THEN 'two' ELSE concat('k', id) END AS k", "id")
    assert heavy_pieces(big, "k") == {128: ["half"], 2: ["two"]}
    small = fixed_table(spark, ["k", "v"], [("half", 1), ("two", 2), ("k1300", 3)])
    out = spread_join(big, small, "k", ["id"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.groupBy("v").count().collect()} == {(1, 1280), (2, 20), (3, 1)}
