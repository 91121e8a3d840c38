"""What lies beyond former limits gives the same answers as what lies below them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions.frames import fixed_table, positions
from assayer.operators import reconcile as rc
from assayer.operators import snippets as sn
from assayer.operators import source_tree as st
from assayer.operators import verdicts as vd
from assayer.session import scratch_dir
from assayer.sources import decision_log, issues_json, report_html, sinks, tree
from assayer.streaming import live


def test_large_files_are_read(spark, tmp_path):
    body = "\n".join(f"int x{i};" for i in range(80_000))
    (tmp_path / "big.c").write_text(f"void near_end(int n) {{\n  n = 1;\n}}\n{body}\nvoid last(int n) {{\n  near_end(n);\n}}\n")
    files = tree.scan_tree(spark, str(tmp_path))
    assert files.first()["length"] > 600_000
    facts = st.line_facts(files)
    assert {r["name"] for r in st.functions(facts).collect()} == {"near_end", "last"}
    assert st.call_sites(facts).where("callee = 'near_end' AND NOT is_start").first()["fn_name"] == "last"
    assert tree.scan_tree(spark, str(tmp_path), max_bytes=1000).count() == 0


def test_long_calls_keep_their_arguments(spark):
    line = f"  fn({'a' * 290}, 99);"
    files = spark.createDataFrame([("a.c", f"void g(int n) {{\n{line}\n}}\n")], "path string, content string")
    site = st.call_sites(st.line_facts(files)).where("callee = 'fn'")
    assert site.select(sn.call_arguments(F.col("snippet"), F.col("callee"))[1]).first()[0] == "99"


def test_the_asked_callee_is_parsed_not_the_first_call(spark):
    asked = spark.createDataFrame([("fn", 2, 0, 10)], "callee string, arg_pos int, buf_pos int, bound long")
    sites = spark.createDataFrame([("fn", "p", 2, "if (ok) g(1); fn(n, 99);", "main", 1, "void main() {\n if (ok) g(1); fn(n, 99);\n}")], "callee string, path string, line_no long, snippet string, caller string, caller_start long, body string")
    assert vd.caller_answers(asked, sites).first()["caller_verdict"] == "oob"


def test_deep_event_trees(spark):
    node = []
    for k in range(12, 0, -1):
        node = [{"eventNumber": k, "eventTag": f"t{k}", "lineNumber": k, "events": node}]
    rows = issues_json.flatten_events(spark.createDataFrame([(1, json.dumps(node)), (2, "[]"), (3, None)], "cid long, events string")).orderBy("ordinal").collect()
    assert [r["tag"] for r in rows] == [f"t{k}" for k in range(1, 13)]
    with pytest.raises(Exception, match="deeper"):
        issues_json.flatten_events(spark.createDataFrame([(1, json.dumps(node))], "cid long, events string"), depth=8).collect()


def test_long_comments_lines_and_names(spark):
    rows = spark.createDataFrame([(1, "Bug", "x" * 9000, "C", "f.c", 1_000_000, 0)], "cid long, classification string, comment string, checker string, file string, line long, ordinal long")
    assert len(rc.push_rows(rows, "d", stamp=False).first()["comment"]) == 9000
    page = f'<table><tr><th>CID</th><th>Checker</th><th>File</th><th>Function</th></tr><tr><td>1</td><td>UNINIT</td><td>src/b.c</td><td>{"q" * 80}</td><td>1000000</td></tr></table>'
    got = report_html.scan_index(spark.createDataFrame([("p", page)], "path string, html string")).first()
    assert (got["line"], got["function"]) == (1_000_000, "q" * 80)
    detail = "<pre>(1) Event e: text\n12345678   code();</pre>"
    assert report_html.detail_trace(spark.createDataFrame([("p", detail)], "path string, html string")).first()["line"] == 12_345_678


def test_every_callee_is_seen(spark):
    code = "void f() {\n" + "\n".join(f"  c{k}(1);" for k in range(9)) + "\n}"
    df = spark.createDataFrame([(1, code)], "cid long, code string")
    assert {r["callee"] for r in sn.callees(df).collect()} >= {f"c{k}" for k in range(9)}
    assert sn.callees(df, top=5).count() == 5


def test_fixed_values_are_lists():
    assert isinstance(dim.SINKS, list) and "strcpy" in dim.SINKS and not hasattr(dim, "MAX_SOURCE_BYTES")


def test_positions_in_a_hot_group_with_sparse_ordinals(spark):
    rnd = random.Random(1)
    rows = [(1, o) for o in sorted(rnd.sample(range(10**9), 3000))] + [(k, k * 70_000) for k in range(2, 3000)] + [(5, 5), (5, 5)]
    df = spark.createDataFrame(rows, "k long, o long")
    got = {}
    for r in positions(df, ["k"], "o", large=500, pieces=16).collect():
        got.setdefault(r["k"], []).append((r["position"], r["o"]))
    want = {}
    for k, o in rows:
        want.setdefault(k, []).append(o)
    for k, os in want.items():
        assert sorted(got[k]) == list(enumerate(sorted(os)))


def test_positions_stand_when_quantiles_differ_at_each_reading(spark, monkeypatch):
    # sketches merged in another order give other quantiles
    drawn = F.udf(lambda xs: sorted(random.SystemRandom().sample(xs, 7)), "array<bigint>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda c, shares, accuracy: drawn(F.collect_list(c)))
    df = spark.range(3000).select(F.lit("a").alias("k"), F.col("id").alias("o"))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # or one task may serve both readers by chance
    try:
        assert positions(df, ["k"], "o", large=100, pieces=8).where("position <> o").count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_line_windows_copy_and_broadcast_no_lines(spark):
    files = fixed_table(spark, ["path", "content"], [("a.c", "\n".join(f"l{k}" for k in range(1, 41))), ("b.c", "x")])
    points = fixed_table(spark, ["path", "line"], [("a.c", 1), ("a.c", 40), ("a.c", 90), ("b.c", 18), ("c.c", 1)])
    out = st.line_window(points, st.source_lines(files), reach=2)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["path"], r["line"]): r["snippet"] for r in out.collect()}
    first = "    1 >>> l1\n    2     l2\n    3     l3"
    assert got == {("a.c", 1): first, ("a.c", 40): "   39     l39\n   40 >>> l40"}


def test_texts_hits_and_traces_are_not_broadcast(spark):
    files = fixed_table(spark, ["path", "content"], [("a.c", "void f(int n) {\n  strcpy(d, s);\n}"), ("b.c", "")])
    found = fixed_table(spark, ["cid", "path", "function", "line", "code", "code_start_line", "checker"], [(1, "a.c", "f", 2, "void f(int n) {\n  strcpy(d, s);\n}", 1, "OVERRUN"), (2, "c.c", "g", 9, "x", 1, "UNINIT")])
    hits = fixed_table(spark, ["path", "line", "ordinal", "rule_id"], [("a.c", 4, 1, "unsafe-copy")])
    bodies = st.function_bodies(st.functions(st.line_facts(files)), files)
    rated = vd.callee_taint(sn.callees(found), vd.reading_functions(bodies))
    near = st.corroborate(found, hits)
    code = st.attach_code(found.select("cid", "path", "line"), st.functions(st.line_facts(files)), files)
    context = vd.with_context(found.withColumns({c: F.lit(False) for c in ("guard_on_path", "guard_takes_true", "defect_confirmed", "taint_confirmed")}), bodies=bodies)
    for df in (bodies, rated, near, code, context):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["cid"]: r["rule_id"] for r in near.collect()} == {1: "unsafe-copy", 2: ""}
    assert {r["cid"]: r["code_source"] for r in code.collect()} == {1: "function", 2: "none"}


def test_events_of_other_findings_leave_before_facts_are_read(spark, make_trace):
    found = spark.createDataFrame([(1, "OVERRUN"), (3, "UNINIT")], "cid long, checker string").withColumns({"code": F.lit("x"), "code_start_line": F.lit(1)})
    events = make_trace(("tainted_data", 4)).unionByName(make_trace(("step", 5), ("step", 6), cid=2))
    out = vd.gather(found, events)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Aggregate") < plan.find("LeftSemi")
    assert {r["cid"]: r["n_events"] for r in out.collect()} == {1: 1, 3: 0}


def test_lines_are_dealt_to_all_tasks(spark):
    # few packed bytes, many lines: merged by their bytes, a task would sort the lines of all files
    files = spark.range(200).select(F.concat(F.lit("f"), "id", F.lit(".c")).alias("path"), F.lit("int f(void) {\n  return 0;\n}").alias("content"))
    facts = st.line_facts(files)
    tasks = facts.groupBy(F.spark_partition_id().alias("task")).agg(F.max("fn_end")).collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert facts.count() == 600 and st.functions(facts).where("end_line = 3").count() == 200


def test_no_body_is_sorted_by_name(spark):
    from assayer.plans import catalog

    rows = [("f", "b.c", 1, "gets(x);"), ("f", "a.c", 9, "fgets(x);"), ("f", "a.c", 2, "return;"), ("g", "a.c", 5, "recv(s); getenv(n);"), ("h", "c.c", 1, "")]
    bodies = spark.createDataFrame(rows, "name string, path string, start_line long, body string")
    reading = vd.reading_functions(bodies)
    assert {r["callee"]: r["reads"] in ("recv", "getenv") for r in reading.collect()} == {"g": True}  # f's first definition reads nothing
    whole = catalog.QUERIES["callee_taint"](spark, "/root/testdata/sf0.001")
    for df in (reading, whole):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        aggregates = [line for line in plan.splitlines() if "Aggregate" in line and "name#" in line]
        assert aggregates and not any("body" in line for line in aggregates)


FINDING = "cid long, checker string, function string, line long, code string, code_start_line long"
TRACE = "cid long, ordinal long, step long, tag string, line long, main boolean, description string, file string"
SITE = "callee string, path string, line_no long, snippet string, caller string, caller_start long, body string"


def test_called_functions_are_not_called_uncalled(spark):
    code = "void fn_a(int n) {\n  return;\n}"
    findings = spark.createDataFrame([(1, "DEADCODE", "fn_a", 2, code, 1), (2, "DEADCODE", "fn_b(int)", 2, code.replace("fn_a", "fn_b"), 1), (3, "DEADCODE", "", 2, code, 1)], FINDING)
    trace = spark.createDataFrame([(c, 0, 1, "dead_error_line", 2, True, "x", "f.c") for c in (1, 2, 3)], TRACE)
    sites = spark.createDataFrame([("fn_a", "f.c", 9, "fn_a(1);", "main", 8, ""), ("fn_b", "f.c", 1, "void fn_b(int n) {", "fn_b", 1, "")], SITE)
    labels = lambda df: {r["cid"]: [e["label"] for e in r["evidence"]] for r in df.select("cid", "evidence").collect()}
    got = labels(vd.analyze(findings, trace, call_sites=sites))
    assert "function_has_no_callers" not in got[1] and "function_has_no_callers" in got[2] and "function_has_no_callers" not in got[3]
    assert all("function_has_no_callers" not in x for x in labels(vd.analyze(findings, trace)).values())


def test_audit_of_a_repeated_run_is_not_doubled(spark, tmp_path):
    rows = spark.createDataFrame([(1, "C", "f", 1, "Bug", 0.5, "x")], "cid long, checker string, file string, line long, classification string, confidence double, code string")
    for run in ("a", "a", "b"):
        sinks.write_audit(rows, str(tmp_path / "log"), run)
    assert spark.read.json(str(tmp_path / "log")).count() == 2


@pytest.mark.parametrize("as_folder", [True, False])
def test_streams_read_files_and_folders_in_several_batches(spark, tmp_path, as_folder):
    rows = spark.createDataFrame([(k % 4, k, f"c{k}", "2024-01-01") for k in range(12)], "cid long, ordinal long, classification string, ts string")
    path = str(tmp_path / "t.parquet")
    if as_folder:
        for k in range(3):
            rows.where(f"ordinal div 4 = {k}").coalesce(1).write.mode("append").parquet(path)
    else:
        rows.toPandas().to_parquet(path)
    stream = live.stream_tables(spark, str(tmp_path), "t", rows.schema)
    updates = live.drain(stream.groupBy("cid").agg(F.count(F.lit(1)).alias("n")), scratch_dir(spark, "n"), scratch_dir(spark, "s"), "update")
    assert {(r["cid"], r["n"]) for r in live.current(updates, ["cid"]).collect()} == {(k, 3) for k in range(4)}
    table = scratch_dir(spark, "u")
    q = live.upsert_stream(live.stream_tables(spark, str(tmp_path), "t", rows.schema), table, scratch_dir(spark, "us"))
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == (3 if as_folder else 1)
    got = decision_log.current(spark, table, rows.schema).collect()
    assert {(r["cid"], r["ordinal"]) for r in got} == {(k, 8 + k) for k in range(4)}


def test_work_on_small_tables_is_dealt_to_all_tasks(spark):
    from assayer.plans import q_code, q_sources

    d, tasks = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (q_code._snip(spark, d), q_sources._reports(spark, d), q_sources._object_pages(spark, d), q_sources._positional_pages(spark, d)):
        assert df.rdd.getNumPartitions() == tasks
