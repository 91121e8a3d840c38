"""Scans of reports, sheets, issues and trees; sinks that read back."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import source_tree as st
from assayer.operators import trace as tr
from assayer.operators import verdicts as vd
from assayer.plans import q_sources
from assayer.sources import events_text, issues_json, report_html, sinks, tabular, tree

INDEX = """<html><body><table border=1><tr><th>CID</th><th>Checker</th><th>File</th><th>Function</th><th>Type</th></tr>
<tr><td><a href="Code/1.html#x">1001</a></td><td>BUFFER_SIZE</td><td>src/a.c</td><td>copy(char *)</td><td>Not terminated</td></tr>
<tr><td>1002</td><td>UNINIT</td><td>src/b.c 77</td><td>unavailable</td><td>High</td></tr>
<tr><td>x</td><td>UNINIT</td></tr><tr><td>no id</td><td>UNINIT</td><td>a/b.c</td></tr>
<tr><td>1003</td><td>deadbeefdeadbeef</td><td>ABC</td><td>12</td><td>helper</td></tr></table></body></html>"""


def pages(spark, *texts):
    return spark.createDataFrame([(f"p{i}", x) for i, x in enumerate(texts)], "path string, html string")


def test_index(spark):
    got = {r["cid"]: r for r in report_html.scan_index(pages(spark, INDEX)).collect()}
    assert set(got) == {1001, 1002, 1003}
    assert (got[1001]["function"], got[1001]["type"], got[1001]["href"], got[1001]["line"]) == ("copy", "Not terminated", "Code/1.html", 0)
    assert (got[1002]["file"], got[1002]["line"], got[1002]["severity"], got[1002]["function"]) == ("src/b.c", 77, "High", "")
    assert (got[1003]["checker"], got[1003]["line"], got[1003]["function"]) == ("", 12, "ABC")


def test_links(spark):
    f = spark.createDataFrame([(1, "Code/1.html"), (2, "x/2.html"), (3, "3.html"), (4, ""), (5, "gone.html")], "cid long, href string")
    listing = spark.createDataFrame([("Code/1.html", 0), ("a/2.html", 1), ("b/2.html", 2), ("c/z3.html", 3)], "rel_path string, ordinal long")
    got = {r["cid"]: r["detail_file"] for r in report_html.resolve_links(f, listing).collect()}
    assert got == {1: "Code/1.html", 2: "b/2.html", 3: "c/z3.html", 4: "", 5: ""}


def test_detail_page(spark):
    page = '<html><body><pre>\n(1) Event var_decl:\nVariable "buf" declared here.\n  706      char buf[10];\n(2) Event overrun-local:\nOverrunning array.\n  710      memcpy(buf, src, n);\n</pre></body></html>'
    rows = report_html.detail_trace(pages(spark, page)).orderBy("ordinal").collect()
    assert [(r["step"], r["tag"], r["line"]) for r in rows] == [(1, "var_decl", 706), (2, "overrun-local", 710)]
    assert rows[1]["description"] == "Overrunning array."
    assert "   710  memcpy" in report_html.detail_source(pages(spark, page)).first()["source_code"]


def test_detail_stack_equals_brute_force(spark):
    rnd, texts, want = random.Random(7), [], {}
    for k in range(40):
        stack, lines, out = [], [], {}
        for pos in range(rnd.randint(1, 30)):
            if rnd.random() < 0.5:
                lines.append(f"({pos}) Event e: text")
                stack.append(pos)
                out[pos] = 0
            else:
                lines.append(f"{pos + 100} code")
                if stack:
                    out[stack.pop()] = pos + 100
        texts.append("\n".join(lines))
        want[f"p{k}"] = out
    got: dict = {}
    for r in report_html.detail_trace(pages(spark, *texts)).collect():
        got.setdefault(r["path"], {})[r["ordinal"]] = r["line"]
    assert got == {k: v for k, v in want.items() if v}


def test_fuzzy_headings(spark):
    raw = spark.createDataFrame([("7", "A/b.c", "Various", "f(x)"), ("z", "c.c", "1", "g"), ("8", "c.c", "n/a", "Unclassified")], ["Defect-ID", "Source_File_Name", "Line Number", "Func"])
    got = {r["cid"]: r for r in tabular.findings_from_table(raw).collect()}
    assert (got[7]["line"], got[7]["line_is_various"], got[7]["function"]) == (0, True, "f")
    assert set(got) == {7, 8} and got[8]["function"] == "" and not got[8]["line_is_various"]
    with pytest.raises(ValueError):
        tabular.map_headings(raw.select("Func"))
    assert tabular.match_heading(["Events Summary", "EventsJSON"], tabular.HEADINGS["events_json"]) == "EventsJSON"


def test_sheet_roundtrip(spark, make_trace, tmp_path):
    t = make_trace(("var_decl", 706), ("overrun-local", 710, True, 'say "x", y\nz'), cid=42)
    f = spark.createDataFrame([(42, "OVERRUN", "Out of bounds", "High", "src/foo.c", 0, "copy")], "cid long, checker string, type string, severity string, file string, line long, function string")
    sheet = sinks.pull_rows(f, events_text.events_to_summary(t), events_text.events_to_json(t))
    sinks.write_table(sheet, str(tmp_path / "sheet"), "csv", by=None)
    raw = tabular.read_table(spark, str(tmp_path / "sheet"))
    back = tabular.findings_from_table(raw)
    trace = events_text.events_from_json(back)
    line = tabular.settle_line(back, tr.trace_line(trace, back)).first()["line"]
    assert (line, trace.where("main").first()["description"]) == (710, 'say "x", y\nz')


def test_issues(spark):
    page = '{"columns":[{"name":"cid"},{"id":"checkerName"},"lineNumber"],"rows":[[5,"OVERRUN",706],{"mergedDefectId":{"cid":6},"mainEventLineNumber":710,"lineNumber":706,"events":[{"eventNumber":2,"eventTag":"overrun-local","lineNumber":710,"isMain":true},7]},{"checkerName":"X"}],"totalRows":3}'
    f = issues_json.findings_from_issues(issues_json.issue_rows(spark.createDataFrame([(page,)], "value string")))
    got = {r["cid"]: r for r in f.collect()}
    assert (got[5]["checker"], got[5]["line"], got[5]["line_src"]) == ("OVERRUN", 706, "rest")
    assert (got[6]["line"], got[6]["line_src"], len(got[6]["events"])) == (710, "rest_main", 1)
    e = issues_json.trace_from_events(f).collect()
    assert [(r["cid"], r["step"], r["line"], r["main"]) for r in e] == [(6, 2, 710, True)]


def test_event_tree(spark):
    deep = '[{"eventTag":"a","events":[{"eventTag":"b","events":[{"eventTag":"c"}]},{"eventTag":"d"}]},{"eventTag":"e"}]'
    df = spark.createDataFrame([(1, deep)], "cid long, events string")
    assert [r["tag"] for r in issues_json.flatten_events(df).orderBy("ordinal").collect()] == list("abcde")
    with pytest.raises(Exception, match="deeper"):
        issues_json.flatten_events(df, depth=2).collect()


SAMPLE = """#include <string.h>
/* int old(void) {
*/
void vulnerable_copy(char *input)
{
    char buf[64]; // }
    strncpy(buf, input, sizeof(buf));
    printf("{%s\\n", buf);
}

int main(int argc, char *argv[]) {
    vulnerable_copy(argv[1]);
    return 0;
}
"""


def test_tree_scan_to_verdict(spark, make_trace, tmp_path):
    root = tmp_path / "src"
    for name in ("a/copy.c", "build/skip.c", ".idea/skip.h", "notes.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(SAMPLE)
    (root / "big.c").write_text("x" * 500_001)
    assert sorted(r["path"] for r in tree.scan_tree(spark, str(root)).collect()) == ["a/copy.c", "big.c"]
    files = tree.scan_tree(spark, str(root), max_bytes=500_000)
    assert [r["path"] for r in files.collect()] == ["a/copy.c"]
    assert tree.list_tree(spark, str(root)).count() == 4  # hidden folders are not listed
    facts = st.line_facts(files)
    funcs = st.functions(facts)
    assert sorted((r["name"], r["start_line"], r["end_line"]) for r in funcs.collect()) == [("main", 11, 14), ("vulnerable_copy", 4, 9)]
    wanted = spark.createDataFrame([("vulnerable_copy",)], "callee string")
    sites = st.callers(wanted, st.call_sites(facts)).orderBy("line_no").collect()
    assert [(r["line_no"], r["caller"]) for r in sites] == [(4, "vulnerable_copy"), (12, "main")]
    assert st.callers(wanted, st.call_sites(facts), first_sites=1).count() == 1
    f = spark.createDataFrame([(1, "BUFFER_SIZE", "vulnerable_copy", "/ci/root/A/Copy.c", 7)], "cid long, checker string, function string, file string, line long")
    f = f.join(st.resolve_paths(f, files.select("path")), "file").withColumn("path", F.col("resolved"))
    assert f.first()["path"] == "a/copy.c"
    code = st.attach_code(f, funcs, files)
    assert code.first()["code"].startswith("void vulnerable_copy") and code.first()["code_start_line"] == 4
    out = vd.analyze(code, make_trace(("overrun", 7, True, "Calling 'strncpy' with a maximum size argument of 64 bytes on destination array 'buf' of size 64 bytes."))).first()
    assert (out["classification"], out["sink_func"], out["arg_dest"]) == ("Bug", "strncpy", "buf")
    assert "strncpy_no_null_terminator" in [e["label"] for e in out["evidence"]]


def test_sheet_line_comes_from_a_trace_without_a_flagged_event(spark, make_trace, make_findings, monkeypatch):
    plain = make_trace(("cond_true", 5), ("overrun-local", 30), ("note", 40), cid=17)
    unlined = make_trace(("note", 0), cid=34)
    flagged = make_trace(("overrun-local", 30), ("note", 8, True), cid=1)
    found = make_findings((17, "OVERRUN", "a.c", 3), (34, "OVERRUN", "a.c", 4), (1, "OVERRUN", "a.c", 6), (2, "OVERRUN", "a.c", 7))
    monkeypatch.setattr(q_sources.v, "findings", lambda spark, d: found)
    monkeypatch.setattr(q_sources.v, "trace", lambda spark, d: plain.union(unlined).union(flagged))
    got = {(r.cid, r.line, r.line_is_various) for r in q_sources.sheet_lines_from_whole_trace(spark, "").collect()}
    assert got == {(17, 30, 0), (34, 0, 1), (1, 8, 0), (2, 7, 0)}


def test_records_go_on_over_the_ends_of_blocks(spark, tmp_path):
    cells = [f"{k}" + "\n" * (k % 4) + ('"q"\n\n' if k % 5 == 0 else "") for k in range(60)]
    quoted = ['"' + c.replace('"', '""') + '"' for c in cells]
    (tmp_path / "a.csv").write_text("Comment\n" + "\n".join(quoted) + "\n")
    for bits in (0, 1, 3, 15):
        got = tabular.records(spark, str(tmp_path), block_bits=bits)
        assert got.groupBy("block").count().count() > (1 if bits < 15 else 0)
        assert [r["record"] for r in got.orderBy("block", "at").collect()] == ["Comment", *quoted]
