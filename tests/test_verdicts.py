"""Snippet facts, rules, decisions and the overrun anchoring cases."""

import hashlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer.operators import decision, rules, snippets as sn
from assayer.operators import verdicts as vd
from assayer.plans import q_code, q_findings

CODE = "cid long, checker string, function string, code string, code_start_line long, line long"


def snippet(spark, code, line=0, start=1):
    return sn.prepare(spark.createDataFrame([(1, "X", "f", code, start, line)], CODE))


def test_split_arguments(spark):
    df = snippet(spark, 'x = g(a, h(b, c[1,2]), "s", (int[]){1, 2}); g(z);')
    args = df.select(sn.call_arguments(F.col("code"), F.lit("g")).alias("a")).first()["a"]
    assert args == ["a", "h(b, c[1,2])", '"s"', "(int[]){1, 2}"]


def test_nearest_call_wins(spark):
    df = snippet(spark, "strcpy(a, b);\nx;\nstrcpy(c, d);\n", line=702, start=700)
    a = df.select(sn.call_arguments_near(F.col("lines"), F.lit("strcpy"), F.col("rel"), F.col("line")).alias("a")).first()["a"]
    assert a == ["c", "d"]


@pytest.mark.parametrize("line, want", [(2, "strcpy"), (4, "memcpy"), (3, "memcpy"), (0, "strcpy")])
def test_sink_by_distance(spark, line, want):
    df = snippet(spark, "f() {\nstrcpy(a, b);\nmemcpy(a, b, n);\nx;\n", line)
    got = df.select(sn.nearest_sink(F.col("code"), F.col("lines"), F.col("rel"), F.col("line")).alias("s")).first()["s"]
    assert got == want


@pytest.mark.parametrize(
    "code, want",
    [
        ("void f(int n) {\n x = n;\n}", ("args", 0)),
        ("void f(void) {\n m = 3;\n k = recv(s, b, 9);\n q = k;\n n = q;\n}", ("network", 3)),
        ("void f(void) {\n n = m;\n m = n;\n getenv(z);\n}", ("", 0)),
        ("void f(void) {\n a = getenv(z);\n b = a;\n c = b;\n d = c;\n n = d;\n}", ("", 0)),
    ],
)
def test_provenance(spark, code, want):
    r = sn.provenance(snippet(spark, code).withColumn("v", F.lit("n")), "v", hops=3).first()
    assert (r["origin_kind"], r["origin_line"]) == want


@pytest.mark.parametrize("expr, want", [("64", 64), ("sizeof(int) * 4", 16), ("sizeof(long)", 8), ("MAX", 12), ("3 * 5", 15), ("n + 1", 0)])
def test_constants(spark, expr, want):
    df = snippet(spark, "#define MAX 12\n")
    assert df.select(sn.resolve_constant(F.lit(expr), F.col("code")).alias("x")).first()["x"] == want


def analyze(spark, trace, *findings):
    rows = [(i, checker, "process_buffer", code, start, line) for i, (checker, code, line, start) in enumerate(findings)]
    return {r["cid"]: r for r in vd.analyze(spark.createDataFrame(rows, CODE), trace).collect()}


def test_overrun_is_anchored_on_the_flagged_line(spark, make_trace):
    far = "\n".join(["void process_buffer(char *src, int n) {", *[f"    char pad{i}[4];" for i in range(3)], "    char buf[10];", "    int i;",
                     "    for (i = 0; i < n; i++) buf[i] = src[i];", "    char dest[8];", "    if (n > 0) {", "        memcpy(dest, buf, n);", "    }", "}"])
    here = "\n".join(["void process_buffer(char *src, int n) {", "    char buf[10];", "    int i;", "    for (i = 0; i < n; i++) buf[i] = src[i];", "    char big[4];",
                      "    char small[4];", "    big[n] = small[n];", "}"])
    trace = make_trace(("var_decl", 705), ("overrun-local", 710, True), cid=0).unionByName(make_trace(("var_decl", 705), ("overrun-local", 707, True), cid=1))
    got = analyze(spark, trace, ("OVERRUN", far, 710, 701), ("OVERRUN", here, 707, 701))
    assert (got[0]["sink_func"], got[0]["arg_dest"], got[0]["array"]) == ("memcpy", "dest", "the buffer")
    r = got[1]
    assert (r["array"], r["index_var"], r["access_kind"], r["classification"]) == ("big", "n", "write", "Bug")


CASES = [
    ("UNINIT", "void f() {\n int a;\n b = a;\n c;\n}", ("Bug", 0.87)),
    ("UNINIT", "void f() {\n char b[4];\n memset(b, 0, 4);\n c;\n}", ("False positive", 0.89)),
    ("NO_BREAK", "void f() {\n a;\n /* fall through */\n c;\n}", ("Intentional", 1.0)),
    ("DIVIDE_BY_ZERO", "void f() {\n if (n != 0) {\n x = 1 / n;\n }\n}", ("False positive", 0.89)),
    ("CHECKED_RETURN", "void f() {\n a;\n send(s, b, n);\n c;\n}", ("Bug", 0.72)),
    ("CHECKED_RETURN", "void f() {\n a;\n if (send(s, b, n) < 0) x;\n c;\n}", ("False positive", 0.8)),
    ("CHECKED_RETURN", "void f() {\n a;\n (void)send(s, b, n);\n c;\n}", ("Intentional", 0.85)),
    ("SOMETHING", "", ("Needs review", 0.0)),
]


def test_checker_verdicts(spark, make_trace):
    got = analyze(spark, make_trace(("note", 3), cid=0), *[(checker, code, 3, 1) for checker, code, _ in CASES])
    assert {i: (r["classification"], r["confidence"]) for i, r in got.items()} == {i: want for i, (_, _, want) in enumerate(CASES)}


def plain_decision(evidence):
    """The decision written as a plain loop, to compare with the columns."""
    bug = sum(w for _, p, w in evidence if p == "bug") / 100
    fp = sum(w for _, p, w in evidence if p == "fp") / 100
    total, high, low = bug + fp, max(bug, fp), min(bug, fp)
    from assayer import dimensions as dim

    cb, cf = any(e[0] in dim.CRITICAL_BUG for e in evidence), any(e[0] in dim.CRITICAL_FP for e in evidence)
    dom = high / total if total else 0.0
    conf = 0.0 if not total else min(1.0, 0.55 + high * 0.22 + dom * 0.15) if low == 0 else min(1.0, 0.45 + (high - low) * 0.30 + high * 0.12 + dom * 0.15)
    if (cb and not cf and fp < 0.3) or (cf and not cb and bug < 0.3):
        conf = min(1.0, conf + 0.15)
    side = "Bug" if bug > fp else "False positive"
    if total == 0:
        return "Needs review", conf
    if (cb and not cf and bug > fp) or (cf and not cb and fp > bug) or (conf >= 0.45 and dom >= 0.62 and high - low >= 0.12) or (conf >= 0.50 and bug != fp):
        return side, conf
    if conf >= 0.35 and high > low + 0.15:
        return side, conf
    top = max(evidence, key=lambda e: e[2])
    if top[2] >= 75 and top[1] != "neutral" and abs(bug - fp) <= 0.02:
        return ("Bug" if top[1] == "bug" else "False positive"), max(conf, 0.5)
    return "Needs review", conf


def test_decisions_equal_a_plain_loop(spark):
    import random

    rnd = random.Random(3)
    labels = ["x", "unsafe_sink_function", "raii_smart_pointer", "y", "guard_a"]
    rows = [(i, [(j, rnd.choice(labels), rnd.choice(["bug", "fp", "neutral"]), rnd.choice([30, 35, 55, 60, 75, 80, 85, 90]), "d") for j in range(rnd.randint(0, 5))]) for i in range(300)]
    df = spark.createDataFrame(rows, "cid long, evidence array<struct<seq:int,label:string,polarity:string,weight_c:int,description:string>>")
    got = {r["cid"]: (r["classification"], r["confidence"]) for r in decision.decide(df).collect()}
    for cid, ev in rows:
        cls, conf = plain_decision([(e[1], e[2], e[3]) for e in ev])
        assert got[cid][0] == cls and abs(got[cid][1] - conf) <= 0.0051, (cid, ev, got[cid], cls, conf)


def test_registered_rule_and_checker(spark, make_trace):
    book = rules.RuleBook()
    book.register_checker("MY_CHECKER", lambda: F.when(F.col("line") == 3, "Intentional"))
    book.register_rule(rules.Rule("MY_CHECKER", "my_rule", "bug", 80, "found {function}", all=(r"danger\(",)))
    f = spark.createDataFrame([(1, "MY_CHECKER", "f", "danger(1);", 1, 1), (2, "MY_CHECKER", "f", "danger(1);", 1, 3)], CODE)
    got = {r["cid"]: r for r in vd.analyze(f, make_trace(("note", 1)), book=book).collect()}
    assert got[1]["classification"] == "Bug" and got[1]["reasons"][1] == "my_rule: found f"
    assert got[2]["classification"] == "Intentional"
    assert rules.rules_table(spark, book).where("label = 'my_rule'").count() == 1


def test_verdicts_read_neighbours_callees_and_other_scanners(spark, make_trace):
    body = "void take(char *b) {\n  recv(s, b, 9);\n}"
    near = "void caller(void) {\n  lost(p);\n  memcpy(a, b, n);\n}"
    rows = [
        (1, "BUFFER_SIZE", "lost(char *)", "", 1, 2, "a.c"), (2, "BUFFER_SIZE", "own", "void own(char *d) {\n  take(x);\n  show(d);\n}", 1, 3, "b.c"),
        (3, "BUFFER_SIZE", "nobody", "", 1, 2, "c.c"),
    ]
    findings = spark.createDataFrame(rows, CODE + ", path string")
    sites = spark.createDataFrame(
        [("lost", "z.c", 2, "lost(p);", "caller", 1, near), ("take", "a.c", 5, "take(q);", "lost", 4, ""), ("lost", "a.c", 4, "lost(char *p)", "lost", 4, "")],
        "callee string, path string, line_no long, snippet string, caller string, caller_start long, body string",
    )
    bodies = spark.createDataFrame([("take", "t.c", 1, 3, body)], "name string, path string, start_line long, end_line long, body string")
    hits = spark.createDataFrame([("b.c", 5, 1, "rule-7"), ("a.c", 9, 2, "rule-8")], "path string, line long, ordinal long, rule_id string")
    trace = make_trace(("note", 3), cid=9)
    got = {r["cid"]: r for r in vd.analyze(findings, trace, call_sites=sites, bodies=bodies, hits=hits).collect()}
    assert (got[1]["used_fallback"], got[1]["code"]) == (True, f"{body}\n\n{near}") and got[1]["confidence"] <= 0.6
    assert not got[2]["used_fallback"] and got[2]["origin"] == "take() (calls recv() internally)"
    assert [e["label"] for e in got[2]["evidence"]].count("semgrep_confirms") == 1 and got[2]["corroborated_by"] == "rule-7"
    assert (got[3]["code"], got[3]["used_fallback"], got[3]["corroborated_by"]) == ("", False, "")
    assert {c: r["prior"] for c, r in got.items()} == {1: 0.5, 2: 0.45, 3: 0.3}


def test_a_file_of_findings_holds_the_text_around_their_function_once(spark, tmp_path):
    """120 findings without code share a text of 3 MB: neither the writer nor its file holds a copy per finding."""
    near = "void caller(void) {\n" + "  x = 1;\n" * 330_000 + "}"
    own = [(1000 + k, "X", "own", f"void own(void) {{ f({k}); }}", 1, 1) for k in range(60)]
    findings = spark.createDataFrame([(k, "X", "lost", "", 1, 1) for k in range(120)] + own + [(2000, "X", "nobody", "", 1, 1)], CODE)
    sites = spark.createDataFrame([("lost", "z.c", 2, "lost(p);", "caller", 1, near)], "callee string, path string, line_no long, snippet string, caller string, caller_start long, body string")
    vd.with_neighbours(findings, sites).select("cid", "used_fallback", "code").write.parquet(out := str(tmp_path / "out"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "out").glob("*.parquet")]
    held = [m.row_group(g).column(2).total_uncompressed_size for m in files for g in range(m.num_row_groups)]
    assert sum(m.num_rows for m in files) == 181 and sum(held) < 8 * len(near)
    got = {r["cid"]: (r["used_fallback"], r["n"], r["x"]) for r in spark.read.parquet(out).select("cid", "used_fallback", F.length("code").alias("n"), F.md5("code").alias("x")).collect()}
    text = lambda x: (len(x), hashlib.md5(x.encode()).hexdigest())
    assert got == {k: (True, *text(near)) for k in range(120)} | {r[0]: (False, *text(r[3])) for r in own} | {2000: (False, *text(""))}


def test_queries_give_every_answer_of_their_operators(spark, make_findings, monkeypatch):
    late = "\n".join(["void f(int k) {", *["  pad();"] * 8, "  k = m;", "  if (k < 9) {", "    buf[k] = 0;", "  }", "}"])
    done = "void f(void) {\n" + "  x = 1;\n" * 5 + "  fetch(p);\n  done = TRUE;\n  if (done == TRUE) {\n    use(p);\n  }\n}"
    code = spark.createDataFrame([(1, "X", "f", late, 1, 12), (2, "X", "f", done, 1, 10)], CODE)
    monkeypatch.setattr(q_code.v, "code", lambda spark, d: code)
    flow = {r["cid"]: tuple(r)[1:] for r in q_code.index_flow_at_access(spark, "").collect()}
    assert flow == {1: (10, "m", 11, "k < 9", "<", "9"), 2: (0, "", 0, "", "", "")}
    assert {tuple(r) for r in q_code.guarded_success_calls(spark, "").collect()} == {(1, 0, "", ""), (2, 9, "done", "fetch")}
    found = make_findings((1, "OVERRUN", "a.c", 10), (2, "OVERRUN", "a.c", 9), (3, "OVERRUN", "a.c", 1), (4, "OVERRUN", "a.c", 9))
    monkeypatch.setattr(q_findings.v, "findings", lambda spark, d: found)
    assert {r["cid"]: r["place"] for r in q_findings.group_places(spark, "").collect()} == {2: 1, 4: 2, 1: 3, 3: 4}
