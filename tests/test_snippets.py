"""Facts of one snippet: walks of any length, sizes, guards."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import snippets as sn
from assayer.operators import symbols as sy
from assayer.operators import verdicts as vd


def origin(spark, code, var, hops=None):
    row = spark.createDataFrame([(1, code, 1, 1)], "cid long, code string, code_start_line long, line long").withColumn("v", F.lit(var))
    r = sn.provenance(sn.prepare(row), "v", hops=hops).first()
    return r.origin_kind, r.origin_line, r.origin_confidence, r.origin_var


def chain(n):
    steps = "".join(f"  a{k} = a{k + 1};\n" for k in range(n))
    return f"void f(int k) {{\n{steps}  a{n} = recv(s, buf, k);\n}}"


@pytest.mark.parametrize("n", [0, 1, 3, 12, 60])
def test_provenance_follows_any_number_of_assignments(spark, n):
    assert origin(spark, chain(n), "a0") == ("network", n + 2, "high", f"a{n}")


def test_provenance_can_be_limited(spark):
    assert origin(spark, chain(3), "a0", hops=4)[0] == "network"
    assert origin(spark, chain(3), "a0", hops=3) == ("", 0, "", "")


def test_provenance_stands_still_on_circles_parameters_and_nothing(spark):
    assert origin(spark, "void f(int k) {\n  a = b;\n  b = c;\n  c = a;\n  z = recv(1);\n}", "a") == ("", 0, "", "")
    assert origin(spark, chain(2), "k") == ("args", 0, "medium", "k")
    for var in ("", "unknown"):
        assert origin(spark, chain(2), var) == ("", 0, "", "")
    assert origin(spark, "", "a") == ("", 0, "", "")
    assert origin(spark, "void f(int k) {\n  a = b;\n}", "a") == ("", 0, "", "")


FILES = {
    "a/x.h": "#define A 4\n#define B (A * 3) // three\n#define C B\n#  define D (C << 2) /* shifted */\n#define HEX 0x20UL\n#define LOOP1 LOOP2\n#define LOOP2 LOOP1\n#define GONE (MISSING + 1)\n#define FN(x) (x)\n#define TEXT \"4\"\n",
    "b/y.h": "#define A 99\nstruct s {\n  char  field[D];\n  unsigned int words[sizeof(int) * A];\n  char one[8];\n};\n#define BIG (A * HUGE)\n#define HUGE 9223372036854775807\n#define ZERO (A / NIL)\n#define NIL 0\n",
}


def tree(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string")


def test_sizes_with_names_are_folded_over_the_tree(spark):
    got = {r["name"]: (r["kind"], r["value"]) for r in sy.symbol_values(sy.symbols(tree(spark))).collect()}
    defines = {"A": 4, "B": 12, "C": 12, "D": 48, "HEX": 32, "HUGE": 2**63 - 1, "NIL": 0}
    members = {"field": 48, "words": 16, "one": 8}
    assert got == {k: ("define", x) for k, x in defines.items()} | {k: ("member", x) for k, x in members.items()}
    assert sy.symbol_values(sy.symbols(tree(spark).limit(0))).count() == 0


def test_a_chain_of_names_of_any_length(spark):
    lines = "\n".join(f"#define N{k} (N{k + 1} + 1)" for k in range(9)) + "\n#define N9 1"
    got = {r["name"]: r["value"] for r in sy.symbol_values(sy.symbols(spark.createDataFrame([("x.h", lines)], "path string, content string"))).collect()}
    assert got == {f"N{k}": 10 - k for k in range(10)}


def test_a_constant_of_another_file_bounds_an_access(spark, make_trace):
    """The verdict follows the size that only the header tells."""
    code = "void f(int n) {\n  char buf[D];\n  if (n <= 48) {\n    buf[n] = 0;\n  }\n}"
    row = spark.createDataFrame([(1, "OVERRUN", "a.c", "f", 4, code, 1)], "cid long, checker string, path string, function string, line long, code string, code_start_line long")
    trace = make_trace(("overrun-local", 4))
    values = sy.symbol_values(sy.symbols(tree(spark)))
    alone, told = vd.analyze(row, trace).first(), vd.analyze(row, trace, symbols=values).first()
    assert (alone["bound"], told["bound"]) == (0, 48)
    assert told["is_off_by_one"] and told["classification"] == "Bug" and not alone["is_off_by_one"]
