"""Main-event election, marking, overrides and trace facts on small traces."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import trace as tr
from assayer.sources import events_text

DECL_SINK = [("var_decl", 706), ("overrun-local", 710)]
NULL = [("var_decl", 174), ("string_null", 268), ("string_null_source", 174)]
BUF = [("var_decl", 174), ("buffer_size", 268), ("buffer_size_warning", 174)]
CHILD = [("var_decl", 174), ("overrun-local", 268), ("overrun-buffer-arg", 500)]


def elected(make_trace, make_findings, events, checker):
    r = tr.elect(make_trace(*events), make_findings((1, checker))).collect()
    return (r[0]["line"], r[0]["reason"]) if r else (0, "")


@pytest.mark.parametrize(
    "events, checker, want",
    [
        ([("var_decl", 706), ("overrun-local", 710, True)], "OVERRUN", (710, "main_event")),
        (DECL_SINK, "OVERRUN", (710, "sink_event")),
        ([("cond_true", 706), ("identity_transfer", 710)], "", (710, "last_event")),
        (NULL, "STRING_NULL", (268, "sink_event")),
        (BUF, "BUFFER_SIZE", (268, "sink_event")),
        (CHILD, "OVERRUN", (268, "sink_event")),
        ([("note", 5), ("note", 9), ("var_decl", 12)], "X", (9, "last_event")),
        ([("a", 3, True), ("b", 4, True)], "X", (4, "main_event")),
        ([("overrun", 0, True)], "OVERRUN", (0, "")),
        ([("note", 5, False, "", 7), ("other", 6, False, "", 7)], "X", (5, "last_event")),
    ],
)
def test_election(make_trace, make_findings, events, checker, want):
    assert elected(make_trace, make_findings, events, checker) == want


def test_sink_predicates(spark):
    rows = [("string_null_source", "STRING_NULL", False), ("string_null", "STRING_NULL", True), ("buffer_size_warning", "BUFFER_SIZE", False),
            ("buffer_size", "BUFFER_SIZE", True), ("buffer_size_warning", "BUFFER_SIZE_WARNING", True), ("Overrun-Local", "overrun", True), ("", "X", False)]
    df = spark.createDataFrame(rows, "tag string, checker string, want boolean")
    assert df.where(tr.is_sink_event(F.col("tag"), F.col("checker")) != F.col("want")).count() == 0


def mains(df):
    return {r["tag"]: r["main"] for r in df.collect()}


def test_heuristic_main_is_decided_again(make_trace, make_findings):
    first = tr.mark_main(make_trace(*BUF))
    again = tr.mark_main(first, make_findings((1, "BUFFER_SIZE")))
    assert mains(again) == {"var_decl": False, "buffer_size": True, "buffer_size_warning": False}
    assert sorted(tr.mark_main(again, make_findings((1, "BUFFER_SIZE"))).collect()) == sorted(again.collect())


def test_genuine_main_is_kept(make_trace, make_findings):
    t = make_trace(("var_decl", 174), ("buffer_size_warning", 174, True), ("buffer_size", 268))
    f = make_findings((1, "BUFFER_SIZE"))
    assert mains(tr.mark_main(t, f)) == {"var_decl": False, "buffer_size_warning": True, "buffer_size": False}
    assert tr.elect(t, f).first()["line"] == 174


@pytest.mark.parametrize("events, want", [(DECL_SINK, (710, "main_event", 706)), ([("var_decl", 0)], (33, "instance", 0))])
def test_apply_trace(make_trace, make_findings, events, want):
    f = make_findings((1, "OVERRUN", "src/foo.c", 706)).withColumn("merged_line", F.lit(44)).withColumn("instance_line", F.lit(33))
    r = tr.apply_trace(f, make_trace(*events)).first()
    assert (r["line"], r["line_src"], r["line_prev"]) == want


@pytest.mark.parametrize("line, src, overlay, want", [(710, "main_event", (706, 0), (710, "main_event")), (706, "instance", (710, 710), (710, "rest_main")), (706, "instance", (0, 0), (706, "instance"))])
def test_overlay(spark, make_findings, line, src, overlay, want):
    f = make_findings((42, "OVERRUN", "", line)).withColumn("line_src", F.lit(src))
    o = spark.createDataFrame([(42, 0, *overlay, "given.c")], "cid long, ordinal long, line long, main_event_line long, file string")
    r = tr.overlay_lines(f, o).first()
    assert (r["line"], r["line_src"]) == want
    assert r["file"] == ("given.c" if any(overlay) else "")


def test_trace_facts(make_trace):
    t = make_trace(("var_decl", 1), ("overrun-local", 2, False, 'Overrunning array "buf" of 64 bytes at byte offset 64 using index "i" (which evaluates to 64).'))
    r = tr.trace_facts(t).first()
    assert (r["defect_confirmed"], r["array_size"], r["index_value"]) == (True, 64, 64)


def test_trace_values_last_wins(make_trace):
    t = make_trace(("assignment", 1, False, 'The value of "n" is now 4.'), ("assignment", 2, False, "n = g(). n is 7."), ("return_value", 3, False, '"f()" may return 87'))
    r = tr.trace_maps(t).first()
    assert (r["variables"], r["return_values"]) == ({"n": 7}, {"f": 87})


def test_json_roundtrip_and_bad_cells(spark, make_trace):
    cells = events_text.events_to_json(make_trace(*[(a, b, b == 710) for a, b in DECL_SINK]))
    assert '"main":true' in cells.first()["events_json"]
    back = events_text.events_from_json(cells)
    assert [(r["tag"], r["line"], r["main"]) for r in back.orderBy("ordinal").collect()] == [("var_decl", 706, False), ("overrun-local", 710, True)]
    bad = spark.createDataFrame([(1, "not json"), (2, "[]"), (3, "None"), (4, '[1,"x",{"lineNumber":7}]')], "cid long, events_json string")
    assert [(r["cid"], r["line"]) for r in events_text.events_from_json(bad).collect()] == [(4, 7)]


def test_summary_counts_blank_parts(spark):
    text = 'var_decl@src/foo.c:706 — Variable "buf" declared here.; ; overrun-local@src/foo.c:710 — Overrunning array "buf"'
    rows = events_text.events_from_summary(spark.createDataFrame([(1, text)], "cid long, events_summary string")).orderBy("step").collect()
    assert [(r["step"], r["tag"], r["line"]) for r in rows] == [(1, "var_decl", 706), (3, "overrun-local", 710)]


def test_long_trace_comes_in_parts(make_trace):
    parts = tr.trace_text(make_trace(*[("t", i) for i in range(25)]), part_size=10).orderBy("part").collect()
    assert [len(p["tags"].split(",")) for p in parts] == [10, 10, 5]


@pytest.mark.parametrize("n", [1_500, 50_000])
def test_a_long_trace_is_one_cell(spark, n):
    """Whole traces in one row of each sheet, in order; parts only where asked for."""
    t = spark.range(n + 3).select(
        F.when(F.col("id") < n, 1).otherwise(2).cast("long").alias("cid"), (F.col("id") * 7919 % (n + 3)).alias("ordinal"), F.col("id").alias("step"), F.lit("tag").alias("tag"),
        (F.col("id") * 7919 % (n + 3)).alias("line"), F.lit(False).alias("main"), F.lit("d").alias("description"), F.lit("f.c").alias("file"),
    ).repartition(5)
    cells = {r["cid"]: r["events_json"] for r in events_text.events_to_json(t).collect()}
    lines = [e["line"] for e in json.loads(cells[1])]
    assert len(cells) == 2 and len(lines) == n and lines == sorted(lines) and len(json.loads(cells[2])) == 3
    assert [r["line"] for r in events_text.events_from_json(events_text.events_to_json(t.where("cid = 1"))).orderBy("ordinal").collect()] == lines
    summary = {r["cid"]: r["events_summary"] for r in events_text.events_to_summary(t).collect()}
    assert [int(x.split(":")[1].split(" ")[0]) for x in summary[1].split("; ")] == lines
    assert len({r["cid"]: r["tags"] for r in tr.trace_text(t).collect()}[1].split(",")) == n
    parts = events_text.events_to_json(t, 1000).where("cid = 1").orderBy("part").collect()
    assert [e["line"] for p in parts for e in json.loads(p["events_json"])] == lines and len(parts) == -(-n // 1000)


def test_result_does_not_depend_on_partitions(make_trace, make_findings):
    t, f = make_trace(*CHILD), make_findings((1, "OVERRUN"))
    assert tr.elect(t.repartition(7), f).collect() == tr.elect(t.coalesce(1), f).collect()


def test_gap_filling_with_repeated_ordinals_gives_the_rows_of_its_sql(spark, tmp_path):
    import duckdb

    from assayer.plans import catalog

    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    copied = f"SELECT * FROM '{d}/lineitem.parquet' UNION ALL SELECT * REPLACE (l_suppkey + 1024 AS l_suppkey) FROM '{d}/lineitem.parquet' WHERE l_orderkey < 500"
    con.execute(f"COPY ({copied}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{d}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    query = catalog.QUERIES["gap_filled_traces"](spark, str(tmp_path))
    want = con.execute(f"SELECT cid, ordinal, tag, line FROM ({catalog.ORACLES['gap_filled_traces']})").fetchall()
    assert sorted(tuple(r) for r in query.select("cid", "ordinal", "tag", "line").collect()) == sorted(want)
