"""Selection, push rows, validation, batches, outcomes, review and upsert."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions.frames import positions
from assayer.operators import normalize as n
from assayer.operators import reconcile as rc
from assayer.operators import summary as sm
from assayer.operators import categories as cat
from assayer.sources import sinks

SCHEMA = "cid string, classification string, comment string, checker string, file string, line long, accepted boolean, overridden boolean, base_classification string, ordinal long"


@pytest.fixture
def results(spark):
    def build(*rows):
        made = []
        for i, r in enumerate(rows):
            d = {"cid": "1", "classification": "Bug", "comment": None, "accepted": False, "overridden": False, "base": "", "file": None, **r}
            cid = d["cid"]
            made.append((cid, d["classification"], f"c{cid}" if d["comment"] is None else d["comment"], "OVERRUN", d["file"] or f"/src/f{cid}.c", 10, d["accepted"], d["overridden"], d["base"], i))
        return spark.createDataFrame(made, SCHEMA)

    return build


def ids(df):
    return sorted(int(r["cid"]) for r in df.collect())


def test_selection(results):
    r = results({"cid": "1"}, {"cid": "2", "accepted": True}, {"cid": "3", "overridden": True}, {"cid": None}, {"cid": "abc"}, {"cid": "4", "classification": "needs review"})
    assert ids(n.select_findings(r, "all")) == [1, 2, 3, 4]
    assert ids(n.select_findings(r, "accepted")) == [2, 3]
    assert ids(n.select_findings(r, "decided")) == [1, 2, 3]
    with pytest.raises(ValueError):
        n.select_findings(r, "sideways")


def test_push_rows(results):
    r = rc.push_rows(results({"cid": "1", "classification": "Accepted", "base": "False positive"}, {"cid": "2", "classification": ""}, {"cid": "2", "classification": "Intentional"}), "2024-01-02", "qa")
    got = {x["cid"]: x for x in r.collect()}
    assert got[1]["classification"] == "False positive" and got[2]["classification"] == "Intentional"
    assert got[1]["comment"] == "c1\n[Assayer — qa — 2024-01-02]" and got[2]["ordinal"] == 1
    again = rc.push_rows(r.withColumn("base_classification", F.lit("")), "2025-09-09", "other")
    assert {x["cid"]: x["comment"] for x in again.collect()} == {k: x["comment"] for k, x in got.items()}


def test_comment_cut(results):
    r = rc.push_rows(results({"comment": "x" * 50}), "d", stamp=False, max_comment=20).first()["comment"]
    assert len(r) == 20 and r.endswith("…")


SERVER = "cid long, checker string, file string"


@pytest.mark.parametrize(
    "server, want",
    [
        ([(7, "OVERRUN", "/x/f7.c")], (7, "cid")),
        ([(99, "OVERRUN", "/other/path/f7.c")], (99, "signature")),
        ([(98, "OVERRUN", "/a/f7.c"), (99, "OVERRUN", "/b/f7.c")], (None, "")),
        ([(99, "OVERRUN", "/a/f7.c"), (99, "OVERRUN", "/a/f7.c")], (None, "")),
        ([(1, "RESOURCE_LEAK", "/z.c")], (None, "")),
        ([(None, "OVERRUN", "/a/f7.c")], (None, "")),
    ],
)
def test_validation(spark, results, server, want):
    rows = rc.push_rows(results({"cid": "7"}), "d")
    r = rc.validate(rows, spark.createDataFrame(server, SERVER)).first()
    assert (r["server_cid"], r["match"]) == want


def queue(results, k, comment="same"):
    rows = rc.push_rows(results(*[{"cid": str(i), "comment": comment} for i in range(1, k + 1)]), "d", stamp=False)
    return rows.withColumn("server_cid", F.col("cid"))


def test_batches_of_hundred(results):
    b = rc.batches(rc.batch_rows(queue(results, 250))).orderBy("batch_no").collect()
    assert [len(x["cids"]) for x in b] == [100, 100, 50] and b[0]["cids"] == list(range(1, 101))


def test_classes_that_map_alike_stay_apart(results):
    rows = rc.push_rows(results({"cid": "1", "comment": "s"}, {"cid": "2", "comment": "s", "classification": "Intentional"}), "d", stamp=False)
    assert rc.batches(rc.batch_rows(rows)).count() == 2


OUT = "classification string, comment string, batch_no long, ok_count long, failed array<long>, error string"


@pytest.mark.parametrize("outcome, failed, error", [((2, [], ""), [], ""), ((1, [2], "nope"), [2], "nope"), ((0, [], ""), [1, 2], "Server rejected the update"), (None, [1, 2], "Server rejected the update")])
def test_outcomes(spark, results, outcome, failed, error):
    b = rc.batch_rows(queue(results, 2))
    o = spark.createDataFrame([("Bug", "same", 0, *outcome)] if outcome else [], OUT)
    r = rc.fold_outcomes(b, o, "store").collect()
    assert sorted(x["cid"] for x in r if x["status"] == "failed") == failed
    assert {x["error"] for x in r if x["status"] == "failed"} == ({error} if failed else set())


def test_no_store_and_dry_run(spark, results):
    b = rc.batch_rows(queue(results, 1))
    none = spark.createDataFrame([], OUT)
    assert rc.fold_outcomes(b, none, "").first()["status"] == "failed"
    assert rc.fold_outcomes(b, none, "s", dry_run=True).first()["status"] == "ok"


def test_full_flow(spark, results):
    r = results({"cid": "101", "accepted": True}, {"cid": "102", "classification": "False positive", "accepted": True}, {"cid": "103", "classification": "Needs review"}, {"cid": "104", "classification": "Intentional", "accepted": True})
    server = spark.createDataFrame([(101, "OVERRUN", "/build/f101.c"), (102, "OVERRUN", "/build/f102.c"), (900, "OVERRUN", "/build/f104.c")], SERVER)
    checked = rc.validate(rc.push_rows(n.select_findings(r), "d", "qa"), server)
    assert rc.validation_report(checked).first().asDict() == {"matched": 2, "remapped": 1, "unmatched": 0, "pushable": 3}
    b = rc.batch_rows(rc.partition_by_match(checked)[0])
    pushed = rc.fold_outcomes(b, spark.createDataFrame([], OUT), "s", dry_run=True)
    back = {x["cid"]: x for x in rc.apply_status(r.withColumn("cid", F.col("cid").cast("long")), pushed).collect()}
    assert back[104]["pushed_cid"] == 900 and back[103]["push_status"] == "" and back[101]["push_status"] == "ok"


def test_review_actions(spark, results):
    f = results({"cid": "1"}, {"cid": "2"}, {"cid": "3"}).withColumn("cid", F.col("cid").cast("long"))
    a = spark.createDataFrame(
        [(1, 0, "accept", "", "", "ann", "t0"), (1, 1, "accept", "", "", "bob", "t1"), (2, 2, "accept", "", "", "ann", "t2"), (2, 3, "override", "Intentional", " ", "bob", "t3")],
        "cid long, ordinal long, action string, classification string, comment string, reviewer string, ts string",
    )
    got = {r["cid"]: r for r in rc.review_state(f, a).collect()}
    assert (got[1]["accepted"], got[1]["accepted_by"], got[1]["classification"]) == (True, "ann", "Bug")
    assert (got[2]["accepted"], got[2]["overridden"], got[2]["classification"], got[2]["comment"]) == (False, True, "Intentional", "Manually overridden")
    assert (got[3]["accepted"], got[3]["overridden"]) == (False, False)


def test_upsert_repeats_without_change(spark):
    s = "cid long, ordinal long, comment string"
    old, new = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], s), spark.createDataFrame([(1, 5, "z"), (None, 6, "lost")], s)
    once = rc.upsert(old, new)
    assert sorted((r["cid"] or 0, r["comment"]) for r in once.collect()) == [(0, "lost"), (1, "z"), (2, "b")]
    keyed = new.where("cid is not null")
    assert sorted(rc.upsert(once, keyed).collect(), key=str) == sorted(once.collect(), key=str)


def test_positions_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.lit("cold")).otherwise("hot").alias("k"), (F.col("id") * 37).alias("o")).repartition(6)
    got = positions(df, ["k"], "o", large=100, pieces=8).orderBy("k", "o").collect()
    for key in ("hot", "cold"):
        assert [r["position"] for r in got if r["k"] == key] == list(range(sum(r["k"] == key for r in got)))


def test_categories_and_totals(spark):
    f = spark.createDataFrame([("buffer_size", 0), ("FORWARD_NULL", 1), ("UNKNOWN", 2), (None, 3)], "checker string, ordinal long")
    got = {r["category"]: r["n"] for r in sm.with_total(cat.with_category(f), "category").collect()}
    assert got == {"Buffer overflow": 1, "Null pointer dereferences": 1, "Uncategorized": 2, "Total": 4}
    order = [r["category"] for r in sm.in_category_order(cat.with_category(f)).collect()]
    assert order == ["Buffer overflow", "Null pointer dereferences", "Uncategorized", "Uncategorized"]


def test_sort_in_groups(spark):
    f = spark.createDataFrame([("UNINIT", "10", 0), ("UNINIT", "b", 1), ("UNINIT", "9", 2), ("UNINIT", "A", 3), ("OVERRUN", "z", 4)], "checker string, shown string, ordinal long")
    assert [r["shown"] for r in sm.sorted_in_groups(cat.with_category(f), "shown").collect()] == ["z", "9", "10", "A", "b"]


def test_run_partition_and_versions(spark, tmp_path):
    log = str(tmp_path / "log")
    row = lambda c: spark.createDataFrame([(1, 0, c)], "cid long, ordinal long, comment string")
    sinks.write_run(row("a"), log, "r1")
    sinks.write_run(row("b"), log, "r2")
    sinks.write_run(row("c"), log, "r2")
    assert sorted((r["run"], r["comment"]) for r in spark.read.parquet(log).collect()) == [("r1", "a"), ("r2", "c")]
    sinks.write_table(cat.with_category(row("q").withColumn("checker", F.lit("OVERRUN"))), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["category"] == "Buffer overflow"


@pytest.fixture
def numbered_twice(spark, monkeypatch):
    """Rows of one large group, numbered by quantiles that differ at each reading."""
    drawn = F.udf(lambda xs: sorted(random.SystemRandom().sample(xs, 7)), "array<bigint>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda c, shares, accuracy: drawn(F.collect_list(c)))
    monkeypatch.setattr(rc, "positions", functools.partial(positions, large=100, pieces=8))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    queue = spark.range(3000).select("id", F.col("id").alias("cid"), F.lit("Bug").alias("classification"), F.lit("c").alias("comment"), F.col("id").alias("ordinal")).drop("id")
    yield rc.batch_rows(queue)
    spark.conf.unset("spark.sql.exchange.reuse")


def _pushed(numbered):
    """Of each batch the lowest row fails by name, as the numbers themselves tell."""
    outcomes = numbered.groupBy("classification", "comment", "batch_no").agg(
        (F.count(F.lit(1)) - 1).alias("ok_count"), F.array(F.min("target_cid")).alias("failed"), F.lit("Fault").alias("error")
    )
    return rc.fold_outcomes(numbered, outcomes, "store")


def test_outcomes_of_a_large_group_fold_to_their_rows(numbered_twice):
    got = {(r["cid"], r["batch_no"], r["status"]) for r in _pushed(numbered_twice).collect()}
    assert got == {(k, k // 100, "failed" if k % 100 == 0 else "ok") for k in range(3000)}


def test_status_of_a_large_group_comes_back_to_every_finding(spark, numbered_twice):
    out = rc.apply_status(spark.range(3001).withColumnRenamed("id", "cid"), _pushed(numbered_twice))
    want = {(k, "failed" if k % 100 == 0 else "ok", k) for k in range(3000)} | {(3000, "", 0)}
    assert {(r["cid"], r["push_status"], r["pushed_cid"]) for r in out.collect()} == want


@pytest.mark.parametrize("name", ["outcome_folding", "status_on_findings"])
def test_repeated_findings_give_the_rows_of_the_sql(spark, tmp_path, name):
    import duckdb

    from assayer.plans import catalog

    con, orders = duckdb.connect(), "/root/testdata/sf0.001/orders.parquet"
    con.execute(f"COPY (SELECT * FROM '{orders}' UNION ALL SELECT * REPLACE (o_custkey + 150 AS o_custkey) FROM '{orders}' WHERE o_orderkey < 300) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    query = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(query.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in query.collect()) == sorted(want)


def test_last_push_counts_unless_every_is_asked_for(spark):
    found = spark.createDataFrame([(1,), (2,)], "cid long")
    pushed = spark.createDataFrame([(1, "ok", "", 1, 0), (1, "failed", "e", 9, 1), (2, "", "", 2, 2)], "cid long, status string, error string, target_cid long, ordinal long")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(rc.apply_status(found, pushed)) == [(1, "failed", "e", 9), (2, "", "", 0)]
    assert rows(rc.apply_status(found, pushed, every=True)) == [(1, "failed", "e", 9), (1, "ok", "", 1), (2, "", "", 0)]


def test_outcomes_meet_the_numbers_they_were_given_for(spark, monkeypatch):
    import duckdb

    from pyspark.sql import Window

    from assayer.plans import catalog

    drawn = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    by_lot = Window.partitionBy("classification", "comment").orderBy("__lot")
    # every order of the rows is a tie: each reading numbers them in another one
    monkeypatch.setattr(rc, "positions", lambda df, *a, **k: df.withColumn("__lot", drawn()).withColumn("position", F.row_number().over(by_lot) - 1).drop("__lot"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = catalog.QUERIES["outcome_folding"](spark, "/root/testdata/sf0.001").where("error = 'Fault: rejected'").count()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    con = duckdb.connect()
    con.execute("CREATE VIEW orders AS SELECT * FROM '/root/testdata/sf0.001/orders.parquet'")
    assert got >= con.execute(f"SELECT count(*) FROM ({catalog.ORACLES['outcome_folding']}) WHERE error = 'Fault: rejected'").fetchone()[0] > 0
