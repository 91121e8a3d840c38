"""Operators on one code snippet.

A snippet is one function body next to its finding. Everything here is a Column
expression over the snippet, mostly array functions over its lines: the facts of a
finding are one projection and move no data.

``rel`` is the zero-based index of the flagged line inside ``lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions import text as t
from assayer.operators.source_tree import lines_of



def empty_strings() -> Column:
    return F.array().cast("array<string>")


def prepare(df: DataFrame) -> DataFrame:
    """Add lines and rel to (code, code_start_line, line)."""
    return df.withColumn("lines", lines_of(F.col("code"))).withColumn(
        "rel", (F.coalesce("line", F.lit(0)) - F.coalesce("code_start_line", F.lit(1))).cast("int")
    )


def at(lines: Column, index) -> Column:
    """Line at a zero-based index; NULL outside."""
    return F.get(lines, index)


def first_hit(lines: Column, test, upto: Column | None = None, last: bool = False) -> Column:
    """Index of the first (or last) line passing ``test(line, index)``."""
    idx = F.filter(F.transform(lines, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())
    if upto is not None:
        idx = F.filter(idx, lambda i: i <= upto)
    return F.array_max(idx) if last else F.array_min(idx)


# --- G11 sink near the flagged line -------------------------------------------
def best_sink(text: Column) -> Column:
    """Most dangerous copy function called in a text."""
    found = F.regexp_extract_all(text, F.lit(r"\b(" + "|".join(dim.SINKS) + r")\s*\("), 1)
    rank = F.array_min(F.transform(found, lambda x: F.array_position(t.members(dim.SINKS), x)))
    return F.get(t.members(dim.SINKS), (rank - 1).cast("int"))


def nearest_sink(code: Column, lines: Column, rel: Column, line: Column) -> Column:
    """Sink on the flagged line, else 1 then 2 lines away (before first), else anywhere."""
    inside = (line > 0) & (rel >= 0) & (rel < F.size(lines))
    near = F.coalesce(*[best_sink(at(lines, rel + o)) for o in (0, -1, 1, -2, 2)])
    return F.coalesce(F.when(inside, near), best_sink(code), F.lit(""))


# --- G12 call arguments ---------------------------------------------------------
def split_top_level(text: Column, stop_at_close: bool = False) -> Column:
    """Split at commas outside brackets; with ``stop_at_close`` the text ends at the
    parenthesis that closes the call."""
    flat = t.matches(text, r"^[^()\[\]{}]*\)" if stop_at_close else r"^[^()\[\]{}]*$")
    simple = F.split(F.substring_index(text, ")", 1) if stop_at_close else text, ",")
    tokens = F.regexp_extract_all(text, F.lit(r"[()\[\]{},]|[^()\[\]{},]+"), 0)
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("paren"), F.lit(False).alias("done"),
        F.lit("").alias("cur"), empty_strings().alias("parts"),
    )

    def step(s: Column, tok: Column) -> Column:
        opens, closes = tok.isin("(", "[", "{"), tok.isin(")", "]", "}")
        ends = s["done"] | (F.lit(stop_at_close) & (tok == ")") & (s["paren"] == 0))
        comma = (tok == ",") & (s["depth"] == 0)
        return F.struct(
            F.when(ends, s["depth"]).otherwise(s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(ends, s["paren"]).otherwise(s["paren"] + F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)).alias("paren"),
            ends.alias("done"),
            F.when(ends, s["cur"]).when(comma, "").otherwise(F.concat(s["cur"], tok)).alias("cur"),
            F.when(ends | ~comma, s["parts"]).otherwise(F.concat(s["parts"], F.array(s["cur"]))).alias("parts"),
        )

    nested = F.aggregate(tokens, start, step, lambda s: F.concat(s["parts"], F.array(s["cur"])))
    parts = F.transform(F.when(flat, simple).otherwise(nested), t.strip)
    return F.filter(parts, lambda x: x != "")


def call_arguments(text: Column, fn: Column) -> Column:
    """Arguments of the first call of ``fn`` in a text."""
    call = F.concat(F.lit(r"(?s)^.*?\b"), t.quoted(fn), F.lit(r"\s*\((.*)$"))
    return F.when((fn != "") & t.matches(text, call), split_top_level(t.extract(text, call), True)).otherwise(empty_strings())


def call_arguments_near(lines: Column, fn: Column, rel: Column, line: Column) -> Column:
    """Arguments of the call of ``fn`` nearest to the flagged line (first on a tie)."""
    call = F.concat(F.lit(r"\b"), t.quoted(fn), F.lit(r"\s*\("))
    hits = F.filter(
        F.transform(lines, lambda x, i: F.when(t.matches(x, call), F.struct(F.when(line > 0, F.abs(i - rel)).otherwise(0).alias("d"), i.alias("i")))),
        lambda h: h.isNotNull(),
    )
    best = F.array_min(hits)["i"]
    rest = F.array_join(F.slice(lines, best + 1, F.greatest(F.size(lines), F.lit(1))), "\n")
    return F.when((fn != "") & best.isNotNull(), call_arguments(rest, fn)).otherwise(empty_strings())


# --- G13 parameters -------------------------------------------------------------
# Signature line and qualifiers
SIGNATURE = r"^([A-Za-z_][\w\s\*]*?)\s+(\w+)\s*\(([^)]*)\)"
QUALIFIERS = r"\b(const|volatile|unsigned|signed|static|register|struct|union|enum|restrict|inline|extern)\b"


def parameter_names(lines: Column) -> Column:
    """Parameter names of the first signature line, in order."""
    sig = F.filter(
        F.transform(lines, t.strip), lambda s: ~t.matches(s, r"^(#|//|/\*|\*)") & t.matches(s, SIGNATURE)
    )
    body = t.strip(F.regexp_extract(t.txt(F.get(sig, F.lit(0))), SIGNATURE, 3))
    names = F.transform(
        split_top_level(body),
        lambda p: F.element_at(
            F.concat(F.array(F.lit("")), t.identifiers(F.replace(F.regexp_replace(p, QUALIFIERS, " "), F.lit("*"), F.lit(" ")))), -1
        ),
    )
    return F.when((body == "") | (F.lower(body) == "void"), empty_strings()).otherwise(F.filter(names, lambda x: x != ""))


def is_parameter(code: Column, var: Column) -> Column:
    """Whether a name stands in a signature-like list."""
    return t.matches(code, F.concat(F.lit(r"\b\w+\s+\w*\s*\([^)]*\b"), t.quoted(var), F.lit(r"\b[^)]*\)")))


# --- G14 assignments ------------------------------------------------------------
# Statement patterns
ASSIGNMENT = r"(?m)(?:^|;)\s*(?:\w+\s+)?(\w+)\s*=\s*([^;]+);"
SCAN_CALL = r"\b(sscanf|fscanf|sprintf|snprintf)\s*\(([^)]+)\)"


def assignments(code: Column) -> Column:
    """(target, source) pairs in order; the scanf family adds its last argument."""
    plain = F.arrays_zip(
        F.regexp_extract_all(code, F.lit(ASSIGNMENT), 1).alias("target"),
        F.transform(F.regexp_extract_all(code, F.lit(ASSIGNMENT), 2), t.strip).alias("source"),
    )
    scans = F.arrays_zip(
        F.regexp_extract_all(code, F.lit(SCAN_CALL), 1).alias("fn"),
        F.transform(F.regexp_extract_all(code, F.lit(SCAN_CALL), 2), lambda a: F.split(a, ",")).alias("args"),
    )
    scans = F.filter(scans, lambda s: s["fn"].isin("sscanf", "fscanf") & (F.size(s["args"]) >= 3))
    return F.concat(
        F.transform(plain, lambda p: F.struct(p["target"].alias("target"), p["source"].alias("source"))),
        F.transform(
            scans,
            lambda s: F.struct(t.strip(F.element_at(s["args"], -1)).alias("target"), F.concat(s["fn"], F.lit("_input")).alias("source")),
        ),
    )


# --- G15 provenance ---------------------------------------------------------------
_TAINT_FNS = [fn for _, fn in dim.TAINT_ORDER]
_TAINT_KINDS = [kind for kind, _ in dim.TAINT_ORDER]
_TAINT_ANY = "|".join(_TAINT_FNS)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, inside a lambda too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def provenance(df: DataFrame, var: str, hops: int | None = None, prefix: str = "origin") -> DataFrame:
    """Where a variable comes from: adds {prefix}_kind, _line, _confidence, _var.

    A parameter is 'args' at once. Else, per hop: a line naming the variable and a
    data source called in the snippet decides (sources in their fixed order, then
    the first line); otherwise the last assignment to the variable names the next
    one. The walk is a fold that stands still where a source is found or where no new name
    follows; no walk is longer than the snippet has assignments. ``hops`` gives a limited form.
    Rows that ask for no variable, and snippets without a source, pay for nothing more.
    """
    code, start = F.col("code"), F.col(var)
    known = (t.txt(start) != "") & t.matches(code, t.word(start))
    df = df.withColumn("__known", known)
    df = df.withColumn("__param", F.when(F.col("__known"), is_parameter(code, start)).otherwise(False))
    called = F.array_distinct(F.regexp_extract_all(code, F.lit(rf"\b({_TAINT_ANY})\s*\("), 1))
    df = df.withColumn("__present", F.when(F.col("__known") & ~F.col("__param"), called))
    place = lambda x: F.array_min(
        F.transform(
            F.array_intersect(F.regexp_extract_all(x, F.lit(rf"\b({_TAINT_ANY})\b"), 1), F.col("__present")),
            lambda f: F.array_position(t.members(_TAINT_FNS), f).cast("int"),
        )
    )
    line = lambda x, i: F.when(
        x.rlike(rf"\b(?:{_TAINT_ANY})\b"),
        F.struct(place(x).alias("p"), i.alias("i"), F.regexp_extract_all(x, F.lit(r"\b(\w+)\b"), 1).alias("words"), x.alias("x")),
    )
    df = df.withColumn("__tainted", F.when(F.size("__present") > 0, F.filter(F.transform("lines", line), lambda s: s["p"].isNotNull())))
    df = df.withColumn("__assign", F.when(F.size("__tainted") > 0, assignments(code)))

    def source_of(cur: Column) -> Column:
        # a plain name is one of the words of a line; only other texts need a pattern of their own
        names = F.when(cur.rlike(r"^\w+$"), F.filter("__tainted", lambda s: F.array_contains(s["words"], cur))).otherwise(
            F.filter("__tainted", lambda s: t.matches(s["x"], t.word(cur)))
        )
        return F.array_min(F.transform(names, lambda s: F.struct(s["p"].alias("p"), s["i"].alias("i"))))

    def name_after(cur: Column, seen: Column) -> Column:
        last = F.get(F.reverse(F.filter("__assign", lambda a: a["target"] == cur)), F.lit(0))["source"]
        return _let(F.get(F.filter(t.identifiers(last), lambda x: ~x.isin(*dim.NOT_A_SOURCE)), F.lit(0)), lambda x: F.when(~F.array_contains(seen, x), x))

    def state(cur: Column, seen: Column, p: Column, i: Column) -> Column:
        return F.struct(cur.cast("string").alias("cur"), seen.cast("array<string>").alias("seen"), p.cast("int").alias("p"), i.cast("int").alias("i"))

    def step(s: Column, _: Column) -> Column:
        on = lambda nxt: F.when(nxt.isNull(), state(nxt, s["seen"], s["p"], s["i"])).otherwise(state(nxt, F.concat(s["seen"], F.array(nxt)), s["p"], s["i"]))
        moved = lambda hit: F.when(hit.isNotNull(), state(s["cur"], s["seen"], hit["p"], hit["i"])).otherwise(_let(name_after(s["cur"], s["seen"]), on))
        return F.when(s["cur"].isNull() | s["p"].isNotNull(), s).otherwise(_let(source_of(s["cur"]), moved))

    none = F.lit(None)
    most = F.size("__assign") + 1
    rounds = F.sequence(F.lit(1), most if hops is None else F.least(F.lit(hops), most))
    df = df.withColumn("__walk", F.when(F.col("__assign").isNotNull(), F.aggregate(rounds, state(F.when(F.col("__known"), start), F.array(start), none, none), step)))
    found, param = F.col("__walk.p"), F.col("__param")
    out = (
        df.withColumn(f"{prefix}_kind", F.when(param, "args").otherwise(t.txt(F.get(t.members(_TAINT_KINDS), found - 1))))
        .withColumn(f"{prefix}_line", F.coalesce(F.col("__walk.i") + 1, F.lit(0)).cast("bigint"))
        .withColumn(f"{prefix}_confidence", F.when(param, "medium").when(found.isNotNull(), "high").otherwise(""))
        .withColumn(f"{prefix}_var", F.when(param, start).otherwise(t.txt(F.when(found.isNotNull(), F.col("__walk.cur")))))
    )
    return out.drop("__known", "__param", "__present", "__tainted", "__assign", "__walk")


def origin_text(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in dim.ORIGIN_TEXT.items() for x in p])
    return F.coalesce(F.try_element_at(table, kind), F.lit(dim.UNKNOWN_ORIGIN))


# --- G16, G17 earlier lines ---------------------------------------------------------
def reaching_definitions(lines: Column, var: Column, use: Column, k: int = 5) -> Column:
    """Last k assignments before a line, nearest first: (i, rhs). k = 1 is an as-of lookup.

    ``use`` is zero-based. Compound assignments count while it lies in the snippet.
    """
    inside = (use >= 0) & (use < F.size(lines))
    op = F.when(inside, F.lit(r"\s*(?:[+\-*/&|^]?=)\s*([^;]+);")).otherwise(r"\s*=\s*([^;]+);")
    pattern = F.concat(F.lit(r"\b"), t.quoted(var), op)
    hits = F.filter(
        F.transform(
            lines,
            lambda x, i: F.when(
                (i < use) & t.matches(x, pattern), F.struct(i.alias("i"), t.strip(t.extract(x, pattern)).alias("rhs"))
            ),
        ),
        lambda h: h.isNotNull(),
    )
    return F.slice(F.reverse(hits), 1, k)


def preceding_calls(lines: Column, fn: str, use: Column) -> Column:
    """Calls of ``fn`` on earlier lines: (i, args)."""
    pattern = rf"\b{fn}\s*\(([^)]*)\)"
    return F.filter(
        F.transform(
            lines,
            lambda x, i: F.when((i < use) & t.matches(x, pattern), F.struct(i.alias("i"), t.strip(F.regexp_extract(x, pattern, 1)).alias("args"))),
        ),
        lambda h: h.isNotNull(),
    )


def is_sanitized(lines: Column, var: Column, sanitizer: str, use: Column) -> Column:
    """Whether an earlier line matches the sanitizer and names the variable."""
    return F.exists(F.transform(lines, lambda x, i: (i < use) & t.matches(x, sanitizer) & t.matches(x, t.word(var))), lambda b: b)


def zeroing(lines: Column, var: Column) -> Column:
    """Index of the first memset(var, 0, ...) line."""
    pattern = F.concat(F.lit(r"\bmemset\s*\(\s*"), t.quoted(var), F.lit(r"\s*,\s*0\s*,\s*([^;]+?)\s*\)\s*;"))
    return F.when(var != "", first_hit(lines, lambda x, i: t.matches(x, pattern)))


# --- G18 guards ------------------------------------------------------------------
# Guard patterns
GUARD = r"\b(if|while)\s*\(([^)]+)\)"
LOOP_GUARD = r"\b(if|while|for)\s*\(([^)]+)\)"


def guards(lines: Column) -> Column:
    """Conditions of a snippet: (i, cond, var, is_null, is_bounds)."""

    def one(x: Column, i: Column) -> Column:
        cond = t.strip(F.regexp_extract(x, GUARD, 2))
        return F.when(
            t.matches(x, GUARD),
            F.struct(
                i.alias("i"),
                cond.alias("cond"),
                F.regexp_extract(cond, r"\b([A-Za-z_][A-Za-z0-9_]*)\s*(?:!=|==|<|>)", 1).alias("var"),
                t.matches(cond, r"!=\s*NULL|==\s*NULL|!\s*\w+|\w+\s*!=\s*0").alias("is_null"),
                t.matches(cond, r"<\s*\w+|>\s*\w+|<=\s*\w+|>=\s*\w+|\blen\b|\bsize\b|\blength\b").alias("is_bounds"),
            ),
        )

    return F.filter(F.transform(lines, one), lambda g: g.isNotNull())


# --- G19 guard scope ----------------------------------------------------------------
def guard_scope(df: DataFrame, var: str, prefix: str) -> DataFrame:
    """First guard naming a variable and whether it covers the flagged line.

    Adds {prefix}_guard_at (one-based in the snippet, 0 for none), _guard_kind and
    _guard_covers, _guard_inside. It covers when its block leaves early, when it is
    among the first three lines, or when the flagged line is still in its block.
    """
    lines, v = F.col("lines"), F.col(var)
    relevant = F.filter(guards(lines), lambda g: (g["var"] == v) | (F.instr(g["cond"], v) > 0))
    df = df.withColumn("__g", F.when(t.txt(v) != "", F.get(relevant, F.lit(0))))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(False).alias("done"), F.lit(False).alias("leaves"), F.lit(0).alias("n")
    )

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + t.count_of(x, "{") - t.count_of(x, "}")
        opened = s["opened"] | (F.instr(x, "{") > 0)
        leaves = s["leaves"] | t.matches(x, "return|exit|goto")
        return F.struct(
            F.when(s["done"], s["depth"]).otherwise(depth).alias("depth"),
            F.when(s["done"], s["opened"]).otherwise(opened).alias("opened"),
            (s["done"] | (opened & (depth <= 0))).alias("done"),
            F.when(s["done"], s["leaves"]).otherwise(leaves).alias("leaves"),
            F.when(s["done"], s["n"]).otherwise(s["n"] + 1).alias("n"),
        )

    block = F.aggregate(F.slice(lines, F.col("__g.i") + 1, F.greatest(F.size(lines), F.lit(1))), start, step)
    df = df.withColumn("__b", F.when(F.col("__g").isNotNull(), block))
    g, last = F.col("__g.i"), F.col("__g.i") + F.col("__b.n") - 1
    inside = (F.col("rel") == g) | (F.col("__b.done") & (F.col("rel") > g) & (F.col("rel") < last))
    kind = F.when(F.col("__g.is_null"), "null_check").when(F.col("__g.is_bounds"), "bounds_check").otherwise("other")
    return (
        df.withColumn(f"{prefix}_guard_at", F.coalesce(g + 1, F.lit(0)).cast("bigint"))
        .withColumn(f"{prefix}_guard_kind", F.when(F.col("__g").isNull(), "").otherwise(kind))
        .withColumn(f"{prefix}_guard_inside", F.coalesce(inside, F.lit(False)))
        .withColumn(f"{prefix}_guard_covers", F.coalesce(F.col("__b.leaves") | (g < 3) | inside, F.lit(False)))
        .drop("__g", "__b")
    )


# --- G20 fault, then proceed --------------------------------------------------------
def fault_then_proceed(lines: Column, rel: Column) -> Column:
    """First size check in the 12 lines before whose block does not leave: (i, cond)."""
    leave = r"\b(return|break|goto|exit|abort|longjmp)\b"
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(False).alias("done"), F.lit(False).alias("leaves"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + t.count_of(x, "{") - t.count_of(x, "}")
        opened = s["opened"] | (F.instr(x, "{") > 0)
        ends = opened & (depth <= 0)
        stop = s["done"]
        return F.struct(
            F.when(stop, s["depth"]).otherwise(depth).alias("depth"),
            F.when(stop, s["opened"]).otherwise(opened).alias("opened"),
            (stop | ends | t.matches(x, leave)).alias("done"),
            (s["leaves"] | (~stop & ~ends & t.matches(x, leave))).alias("leaves"),
        )

    def one(x: Column, i: Column) -> Column:
        block = F.aggregate(F.slice(lines, i + 1, F.greatest(rel + 1 - i, F.lit(1))), start, step)
        near = (i >= rel + 1 - 12) & (i < rel + 1)
        return F.when(
            near & t.matches(x, r"\b(if|while)\s*\(\s*\w+\s*>\s*\w+") & t.matches(x, GUARD) & ~block["leaves"],
            F.struct(i.alias("i"), t.strip(F.regexp_extract(x, GUARD, 2)).alias("cond")),
        )

    hits = F.filter(F.transform(lines, one), lambda h: h.isNotNull())
    return F.when((rel >= 0) & (rel < F.size(lines)), F.get(hits, F.lit(0)))


# --- G21 call guarded by a success flag -----------------------------------------------
def guarded_success_call(df: DataFrame, prefix: str = "flag") -> DataFrame:
    """The flagged line stands in ``if (flag == TRUE)`` and a call precedes ``flag = TRUE``.

    Adds {prefix}_guard_at, {prefix}_var, {prefix}_call ('' for none).
    """
    lines, rel = F.col("lines"), F.col("rel")
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("i"), F.lit("").alias("cond"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + t.count_of(x, "}") - t.count_of(x, "{")
        guard, out = t.matches(x, GUARD), depth < 0
        found = s["i"] >= 0
        return F.struct(
            F.when(found, s["depth"]).when(out, 0).otherwise(depth).alias("depth"),
            F.when(found, s["i"]).when(out & guard, rel - s["n"]).otherwise(-1).alias("i"),
            F.when(found, s["cond"]).when(out & guard, t.strip(F.regexp_extract(x, GUARD, 2))).otherwise("").alias("cond"),
            (s["n"] + 1).alias("n"),
        )

    back = F.reverse(F.slice(lines, 1, F.greatest(rel + 1, F.lit(1))))
    df = df.withColumn("__g", F.when((rel >= 0) & (rel < F.size(lines)), F.aggregate(back, start, step)))
    cond = F.col("__g.cond")
    named = F.coalesce(
        F.nullif(F.regexp_extract(cond, r"\b([A-Za-z_][A-Za-z0-9_]*)\s*==\s*(?:TRUE|true|1)\b", 1), F.lit("")),
        F.nullif(F.regexp_extract(cond, r"\b([A-Za-z_][A-Za-z0-9_]*)\b", 1), F.lit("")),
    )
    df = df.withColumn("__v", F.when(F.col("__g.i") >= 0, named))
    sets = F.concat(F.lit(r"\b"), t.quoted(F.col("__v")), F.lit(r"\s*=\s*(?:TRUE|true|1)\b"))
    call = r"(\b\w+(?:->\w+)*)\s*\("
    at_lines = F.filter(F.transform(lines, lambda x, i: F.when((i < F.col("__g.i")) & t.matches(x, sets), i)), lambda i: i.isNotNull())
    before = F.transform(
        F.reverse(at_lines),
        lambda j: F.get(
            F.filter(
                F.transform(
                    F.slice(lines, F.greatest(j - 6, F.lit(0)) + 1, F.least(j, F.lit(6))), lambda x: F.regexp_extract(x, call, 1)
                ),
                lambda c: c != "",
            ),
            F.lit(0),
        ),
    )
    found = F.get(F.filter(before, lambda c: c.isNotNull()), F.lit(0))
    df = df.withColumn("__call", F.when(F.col("__v").isNotNull(), found))
    hit = F.col("__call").isNotNull()
    return (
        df.withColumn(f"{prefix}_guard_at", F.when(hit, F.col("__g.i") + 1).otherwise(0).cast("bigint"))
        .withColumn(f"{prefix}_var", F.when(hit, F.col("__v")).otherwise(""))
        .withColumn(f"{prefix}_call", F.coalesce("__call", F.lit("")))
        .drop("__g", "__v", "__call")
    )


# --- G22 buffer size ------------------------------------------------------------------
def resolve_constant(expr: Column, code: Column) -> Column:
    """Bytes of a size expression; 0 when it cannot be resolved."""
    e = t.strip(expr)
    sizes = F.create_map(*[F.lit(x) for p in dim.TYPE_BYTES.items() for x in p])
    unit = F.try_element_at(sizes, t.strip(F.regexp_extract(e, r"sizeof\s*\(([^)]+)\)", 1)))
    times = F.nullif(F.regexp_extract(e, r"\*\s*(\d+)", 1), F.lit("")).try_cast("bigint")
    defined = F.nullif(t.extract(code, F.concat(F.lit(r"#define\s+"), t.quoted(e), F.lit(r"\s+(\d+)"))), F.lit("")).try_cast("bigint")
    product = r"^(\d+)\s*\*\s*(\d+)"
    return (
        F.when(e == "", F.lit(0).cast("bigint"))
        .when(t.matches(e, r"^\d+$"), F.coalesce(e.try_cast("bigint"), F.lit(0)))
        .when(unit.isNotNull(), unit * F.coalesce(times, F.lit(1)))
        .when(defined.isNotNull(), defined)
        .when(t.matches(e, product), t.to_int(F.regexp_extract(e, product, 1)) * t.to_int(F.regexp_extract(e, product, 2)))
        .otherwise(0)
        .cast("bigint")
    )


def buffer_info(code: Column, var: Column) -> Column:
    """(alloc, size_expr, size_bytes) from declaration, allocation or literal; NULL for none."""
    v = t.quoted(var)
    decl = F.concat(F.lit(r"\b(?:char|int|uint8_t|uint16_t|uint32_t|uint64_t|BYTE|WORD)\s+"), v, F.lit(r"\s*\[\s*([^\]]+)\s*\]"))
    heap = F.concat(F.lit(r"\b"), v, F.lit(r"\s*=\s*(?:\([^)]*\))?\s*(malloc|calloc|realloc)\s*\(([^)]+)\)"))
    lit = F.concat(F.lit(r"\b(?:char|const\s+char)\s*\*?\s*"), v, F.lit(r"\s*=\s*\"([^\"]*)\""))

    def info(kind: Column, expr: Column, size: Column) -> Column:
        return F.struct(kind.alias("alloc"), expr.alias("size_expr"), size.cast("bigint").alias("size_bytes"))

    by_decl, by_heap = t.strip(t.extract(code, decl)), t.strip(t.extract(code, heap, 2))
    length = F.length(t.extract(code, lit))
    return F.when(
        var != "",
        F.when(t.matches(code, decl), info(F.lit("stack"), by_decl, resolve_constant(by_decl, code)))
        .when(
            t.matches(code, heap),
            info(F.when(t.extract(code, heap, 1) == "calloc", "calloc").otherwise("malloc"), by_heap, resolve_constant(by_heap, code)),
        )
        .when(t.matches(code, lit), info(F.lit("literal"), F.concat(F.lit('"string"('), length.cast("string"), F.lit(")")), length)),
    )


def member_size(code: Column, member: Column) -> Column:
    """Size expression of a struct field ('' for none)."""
    field = F.substring_index(F.substring_index(member, ".", -1), "->", -1)
    return t.strip(t.extract(code, F.concat(F.lit(r"(?:\b\w+\b\s+){0,6}\b"), t.quoted(field), F.lit(r"\s*\[\s*([^\]]+)\s*\]"))))


# --- G23 array access -------------------------------------------------------------------
# Access forms in order, declaration type words
SUBSCRIPT = r"\b(\w+)\s*\[([^\]]+)\]"
POINTER = r"\*\s*\(\s*(\w+)\s*\+\s*([^\)]+)\)"
POINTER_SIMPLE = r"\*\s*(\w+)\s*\+\s*([^\;]+)"
TYPE_WORDS = (
    r"char|int|short|long|float|double|void|uint8_t|uint16_t|uint32_t|uint64_t|int8_t|int16_t|int32_t|int64_t|size_t|"
    r"BYTE|WORD|DWORD|BOOL|static|const|volatile|unsigned|signed|extern|struct\s+\w+|union\s+\w+|enum\s+\w+"
)


def _access(x: Column, i: Column) -> Column:
    def form(pattern: str, from_star: bool) -> Column:
        arr, idx = F.regexp_extract(x, pattern, 1), t.strip(F.regexp_extract(x, pattern, 2))
        plain = t.strip(F.regexp_replace(idx, r"\([^)]+\)", ""))
        var = F.regexp_extract(plain, r"^([A-Za-z_][A-Za-z0-9_]*)\b", 1)
        begin = F.instr(x, "*") if from_star else F.instr(x, arr)
        rest = F.substring(x, begin, F.length(x))
        return F.struct(
            arr.alias("array"), idx.alias("index_expr"), F.when(var != "", var).otherwise(idx).alias("index_var"),
            i.cast("int").alias("i"), F.when(F.instr(rest, "=") > 0, "write").otherwise("read").alias("kind"),
        )

    return (
        F.when(t.matches(x, SUBSCRIPT), form(SUBSCRIPT, False))
        .when(t.matches(x, POINTER), form(POINTER, True))
        .when(t.matches(x, POINTER_SIMPLE), form(POINTER_SIMPLE, True))
    )


def array_access(lines: Column, rel: Column) -> Column:
    """Access on the flagged line, else on the line before, else after; NULL for none."""
    return F.coalesce(*[_access(at(lines, rel + o), rel + o) for o in (0, -1, 1)])


def array_declaration(lines: Column, arr: Column) -> Column:
    """(size_expr, size) of the first declaration; size is 0 unless written as a number."""
    decl = F.concat(F.lit(rf"\b(?:{TYPE_WORDS})\b[\w\s\*]*?\b"), t.quoted(arr), F.lit(r"\s*\[\s*([^\]]+)\s*\]"))
    hit = F.get(F.filter(lines, lambda x: t.matches(x, decl)), F.lit(0))
    expr = t.strip(t.extract(hit, decl))
    return F.when(
        (arr != "") & hit.isNotNull(),
        F.struct(expr.alias("size_expr"), F.when(t.matches(expr, r"^\d+$"), F.coalesce(expr.try_cast("bigint"), F.lit(0))).otherwise(0).cast("bigint").alias("size")),
    )


def _flip(op: Column) -> Column:
    return F.when(op == "<", ">").when(op == ">", "<").when(op == "<=", ">=").when(op == ">=", "<=").otherwise(op)


def _comparison(cond: Column, left: Column) -> Column:
    """(op, limit) of ``left op limit``; turned around when the limit stands first."""
    ahead = F.concat(left, F.lit(r"\s*([<>!=]=?|==)\s*([^;)\s&|]+)"))
    behind = F.concat(F.lit(r"([^;)\s&|]+)\s*([<>!=]=?|==)\s*"), left)
    return F.when(t.matches(cond, ahead), F.struct(t.extract(cond, ahead).alias("op"), t.strip(t.extract(cond, ahead, 2)).alias("limit"))).when(
        t.matches(cond, behind), F.struct(_flip(t.extract(cond, behind, 2)).alias("op"), t.strip(t.extract(cond, behind)).alias("limit"))
    )


def index_flow(df: DataFrame, lines: str, var: str, access: str, prefix: str) -> DataFrame:
    """Assignment and guard of an index up to its access (as-of lookups).

    Adds {prefix}_assign_at, _assign_expr, _guard_at, _guard_cond, _guard_op,
    _guard_limit; places are one-based in the snippet, 0 for none. A guard counts
    when its condition contains the name as text; without one, a guard on the array
    inside the assigned expression is taken.
    """
    ls, v, a = F.col(lines), F.col(var), F.col(access)
    ok = t.matches(v, r"^[A-Za-z_][A-Za-z0-9_]*$") & (a >= 0) & (a < F.size(ls))
    assign = F.concat(F.lit(r"\b"), t.quoted(v), F.lit(r"\s*=\s*([^;]+);"))
    df = df.withColumn("__a", F.when(ok, first_hit(ls, lambda x, i: (i <= a) & t.matches(x, assign), last=True)))
    df = df.withColumn("__expr", t.strip(t.extract(t.txt(at(ls, F.col("__a"))), assign)))
    cond_of = lambda x: F.regexp_extract(x, LOOP_GUARD, 2)
    df = df.withColumn("__g", F.when(ok, first_hit(ls, lambda x, i: (i <= a) & (F.instr(cond_of(x), v) > 0), last=True)))
    base = F.regexp_extract(t.strip(F.regexp_replace("__expr", r"\(\s*\w+\s*\)", "")), r"^([A-Za-z_][A-Za-z0-9_]*)\s*\[", 1)
    df = df.withColumn("__base", F.when(F.col("__g").isNull(), F.nullif(base, F.lit(""))))
    df = df.withColumn("__g2", F.when(F.col("__base").isNotNull(), first_hit(ls, lambda x, i: (i <= a) & (F.instr(cond_of(x), F.col("__base")) > 0), last=True)))
    df = df.withColumn("__place", F.coalesce("__g", "__g2"))
    df = df.withColumn("__cond", t.strip(cond_of(t.txt(at(ls, F.col("__place"))))))
    own = F.concat(F.lit(r"\b"), t.quoted(v))
    based = F.concat(F.lit(r"\b"), t.quoted(F.col("__base")), F.lit(r"\s*\[[^\]]+\]"))
    df = df.withColumn("__cmp", F.when(F.col("__g").isNotNull(), _comparison(F.col("__cond"), own)).when(F.col("__g2").isNotNull(), _comparison(F.col("__cond"), based)))
    return (
        df.withColumn(f"{prefix}_assign_at", F.coalesce(F.col("__a") + 1, F.lit(0)).cast("bigint"))
        .withColumn(f"{prefix}_assign_expr", t.txt(F.col("__expr")))
        .withColumn(f"{prefix}_guard_at", F.coalesce(F.col("__place") + 1, F.lit(0)).cast("bigint"))
        .withColumn(f"{prefix}_guard_cond", t.txt(F.col("__cond")))
        .withColumn(f"{prefix}_guard_op", t.txt(F.col("__cmp.op")))
        .withColumn(f"{prefix}_guard_limit", t.txt(F.col("__cmp.limit")))
        .drop("__a", "__expr", "__g", "__base", "__g2", "__place", "__cond", "__cmp")
    )


# --- G24 guard against bound --------------------------------------------------------------
def off_by_one(op: Column, limit: Column, size: Column) -> Column:
    """Whether the guard lets the index reach the array size; an unresolved '<=' counts."""
    n = F.when(t.matches(limit, r"^\d+$"), limit.try_cast("bigint"))
    return (
        F.when(n.isNotNull() & (op == "<="), n >= size)
        .when(n.isNotNull() & (op == "<"), n > size)
        .when(n.isNull() & (op == "<="), True)
        .otherwise(False)
    )


def guard_is_safe(cond: Column, var: Column, size: Column) -> Column:
    """Whether the guard keeps the index below the size, read from numbers only."""
    p = F.concat(F.lit(r"\b"), t.quoted(var), F.lit(r"\s*([<>!=]=?)\s*(\d+)"))
    op, n = t.extract(cond, p), F.nullif(t.extract(cond, p, 2), F.lit("")).try_cast("bigint")
    return F.coalesce(F.when(op == "<", n <= size).when(op == "<=", n < size), F.lit(False))


def guard_status(cond: Column, var: Column, index: Column, size: Column, size_expr: Column, array: Column, covers: Column) -> Column:
    """none, irrelevant, safe, unsafe or unknown. '<' and '<=' count alike here;
    :func:`off_by_one` keeps them apart."""
    forward = F.concat(F.lit(r"\b"), t.quoted(var), F.lit(r"\b\s*<=?\s*(\w+)"))
    backward = F.concat(F.lit(r"(\w+)\s*>=?\s*\b"), t.quoted(var), F.lit(r"\b"))
    bound = t.first_text(t.extract(cond, forward), t.extract(cond, backward))
    n = F.when(t.matches(bound, r"^\d+$"), bound.try_cast("bigint"))
    tied = (size_expr != "") & ((F.instr(size_expr, bound) > 0) | (F.instr(cond, "sizeof") > 0) | (bound == array))
    return (
        F.when((cond == "") | var.isin("", "the offset", "the index", "index"), "none")
        .when(~t.matches(cond, t.word(var)), "irrelevant")
        .when(index.isNotNull() & (size > 0), F.when((index >= 0) & (index < size), "safe").otherwise("unsafe"))
        .when(
            bound != "",
            F.when(n.isNotNull() & (size > 0), F.when(n <= size, "safe").otherwise("unsafe")).when(tied, "safe").otherwise("unknown"),
        )
        .when(covers, "safe")
        .otherwise("unknown")
    )


# --- G26 data-flow rows ---------------------------------------------------------------------
def data_flow(lines: Column, var: Column, rel: Column) -> Column:
    """Lines that declare, assign or (when flagged) use a variable: (i, event, text)."""
    v = t.quoted(var)
    declares = F.concat(F.lit(r"(?:int|char|void|uint\w*|size_t|BYTE|struct\s+\w+)\s*\*?\s*"), v, F.lit(r"\b"))
    assigns = F.concat(F.lit(r"\b"), v, F.lit(r"\s*="))
    taints = r"\b(?:recv|fgets|read|getenv|scanf|fread)\s*\("

    def one(x: Column, i: Column) -> Column:
        s = t.strip(x)
        event = (
            F.when((s == "") | t.matches(s, r"^(//|/\*|\*)"), None)
            .when(t.matches(s, declares), "declared")
            .when(t.matches(s, assigns), F.when(t.matches(s, taints), "taint-src").otherwise("assigned"))
            .when((i == rel) & t.matches(s, t.word(var)), "used")
        )
        return F.when(event.isNotNull(), F.struct(i.alias("i"), event.alias("event"), s.alias("text")))

    return F.when(var == "", F.array().cast("array<struct<i:int,event:string,text:string>>")).otherwise(
        F.filter(F.transform(lines, one), lambda e: e.isNotNull())
    )


def data_flow_text(flow: Column, var: Column, rel: Column, start: Column) -> Column:
    """Rendered trace, one line per event."""
    shown = F.transform(
        flow,
        lambda e: F.concat(
            F.lit("    Line "), F.lpad((e["i"] + start).cast("string"), 4, " "), F.lit(": "), F.rpad(e["event"], 10, " "), F.lit("  "),
            e["text"], F.when(e["i"] == rel, "  ← DEFECT").otherwise(""),
        ),
    )
    return F.when(F.size(flow) > 0, F.concat(F.lit("  Data flow for `"), var, F.lit("`:\n"), F.array_join(shown, "\n"))).otherwise("")


# --- G28 fate of an unchecked call ------------------------------------------------------------
def checked_return(df: DataFrame) -> DataFrame:
    """Which call a return-value finding means and what becomes of its result.

    Needs lines, rel, line, function, code_start_line, trace_sink. Adds fate_call,
    fate_line, fate ('used', 'ignored', 'discard', ''), fate_class, fate_confidence.
    """
    lines, rel = F.col("lines"), F.col("rel")
    own = F.lower(t.txt(F.col("function")))

    def on_line(x: Column, i: Column) -> Column:
        names = F.regexp_extract_all(x, F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1)
        keep = F.filter(names, lambda f: ~F.lower(f).isin(*dim.RETURN_SKIP) & (F.lower(f) != own))
        dist = F.when(F.col("line") > 0, F.abs(i - rel)).otherwise(i + F.col("code_start_line").cast("int"))
        return F.transform(keep, lambda f: F.struct(dist.cast("int").alias("d"), f.alias("fn"), i.alias("i"), x.alias("text")))

    df = df.withColumn("__calls", F.flatten(F.transform(lines, on_line)))
    sink = F.lower(t.txt(F.col("trace_sink")))
    focus = F.filter("__calls", lambda c: F.lower(c["fn"]) == sink)
    serious = F.filter("__calls", lambda c: ~t.matches(c["fn"], dim.RETURN_BENIGN))
    pool = (
        F.when((sink != "") & (F.size(focus) > 0), focus)
        .when((sink == "") & (F.size(serious) > 0), serious)
        .otherwise(F.col("__calls"))
    )
    df = df.withColumn("__c", F.array_min(pool))
    fn, text = F.col("__c.fn"), F.col("__c.text")
    before = t.extract(text, F.concat(F.lit(r"^(.*?)\b"), t.quoted(fn), F.lit(r"\s*\(")))
    used = (
        t.matches(before, r"[+\-*/%&|^<>]?=\s*[^=]")
        | t.matches(before, r"\b(if|while|for|return|assert)\s*\(?\s*$")
        | t.matches(before, r"(&&|\|\||\?|:)\s*$")
    )
    fate = F.when(fn.isNull(), "").when(t.matches(text, dim.RETURN_IGNORED), "ignored").when(used, "used").otherwise("discard")
    critical, benign = t.matches(fn, dim.RETURN_CRITICAL), t.matches(fn, dim.RETURN_BENIGN)
    df = df.withColumn("fate", fate)
    cls = (
        F.when(F.col("fate") == "used", "False positive")
        .when(F.col("fate") == "ignored", "Intentional")
        .when(F.col("fate") == "", "Needs review")
        .when(~critical & benign, "False positive")
        .otherwise("Bug")
    )
    # Confidence per fate
    conf = (
        F.when(F.col("fate") == "used", 0.80)
        .when(F.col("fate") == "ignored", 0.85)
        .when(F.col("fate") == "", 0.0)
        .when(critical, 0.72)
        .when(benign, 0.65)
        .otherwise(0.52)
    )
    return (
        df.withColumn("fate_call", t.txt(fn))
        .withColumn("fate_line", F.coalesce(F.col("__c.i") + F.col("code_start_line"), F.lit(0)).cast("bigint"))
        .withColumn("fate_class", cls)
        .withColumn("fate_confidence", conf.cast("double"))
        .drop("__calls", "__c")
    )


# --- G29 operation and operands -----------------------------------------------------------------
def overflow_operation(code: Column, lines: Column, rel: Column) -> Column:
    """(operation, var, operand) of the flagged line, else of the snippet."""
    line = t.strip(at(lines, rel))
    text = F.when(line != "", line).otherwise(code)
    calls = F.regexp_extract_all(text, F.lit(r"\b(\w+)\s*\("), 1)
    names = F.filter(t.identifiers(text), lambda x: ~x.isin(*dim.C_KEYWORDS) & ~F.array_contains(calls, x))
    second = lambda fallback: F.coalesce(F.get(names, F.lit(1)), F.lit(fallback))

    def result(op: str, fallback: str) -> Column:
        return F.struct(F.lit(op).alias("operation"), F.coalesce(F.get(names, F.lit(0)), F.lit("the operand")).alias("var"), second(fallback).alias("operand"))

    return (
        F.when(F.instr(text, "*") > 0, result("multiplication", "multiplier"))
        .when(F.instr(text, "-") > 0, result("subtraction", "subtrahend"))
        .when(F.instr(text, "+") > 0, result("addition", "addend"))
        .otherwise(result("arithmetic", "value"))
    )


# --- G30 nearest things ---------------------------------------------------------------------------
def nearest_call(lines: Column, rel: Column) -> Column:
    """(i, fn, args) of the call nearest to a line; the earlier one on a tie."""
    p = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)"
    hits = F.filter(
        F.transform(
            lines,
            lambda x, i: F.when(t.matches(x, p), F.struct(F.abs(i - rel).alias("d"), i.alias("i"), F.regexp_extract(x, p, 1).alias("fn"), F.regexp_extract(x, p, 2).alias("args"))),
        ),
        lambda h: h.isNotNull(),
    )
    return F.array_min(hits)


def nearest_guard(lines: Column, rel: Column) -> Column:
    """(i, kind, cond) of the last guard at or above a line."""
    hit = first_hit(lines, lambda x, i: (i <= F.least(rel, F.size(lines) - 1)) & t.matches(x, LOOP_GUARD), last=True)
    x = at(lines, hit)
    return F.when(
        hit.isNotNull(),
        F.struct(hit.alias("i"), F.regexp_extract(x, LOOP_GUARD, 1).alias("kind"), t.strip(F.regexp_extract(x, LOOP_GUARD, 2)).alias("cond")),
    )


def latest_assignment(lines: Column, var: Column, rel: Column) -> Column:
    """(i, rhs) of the last plain assignment at or above a line."""
    p = F.concat(F.lit(r"\b"), t.quoted(var), F.lit(r"\s*=\s*([^;]+);"))
    hit = first_hit(lines, lambda x, i: (i <= F.least(rel, F.size(lines) - 1)) & t.matches(x, p), last=True)
    return F.when(hit.isNotNull(), F.struct(hit.alias("i"), t.strip(t.extract(at(lines, hit), p)).alias("rhs")))


def first_declaration(code: Column, var: Column) -> Column:
    """(line, size_expr) of the first declaration of a variable, one-based."""
    p = F.concat(F.lit(r"(?m)^[ \t]*(?:\w+\s+){1,6}\b"), t.quoted(var), F.lit(r"\s*(?:\[\s*([^\]]*)\s*\])?\s*(?:=|;)"))
    whole = t.extract(code, p, 0)
    before = F.substring(code, 1, F.instr(code, whole) - 1)
    return F.when(
        whole != "", F.struct((t.count_of(before, "\n") + 1).cast("bigint").alias("line"), t.txt(t.extract(code, p, 1)).alias("size_expr"))
    )


# --- G7 callees ---------------------------------------------------------------------------------------
def callees(df: DataFrame, top: int | None = None) -> DataFrame:
    """Callees of each snippet in order (G7): cid, rank, callee; ``top`` keeps the first ones.

    Order is by the place of 'name('; a name only written with a blank before the
    parenthesis has no such place and comes first. Equal places sort by name.
    """
    names = F.array_distinct(F.filter(F.regexp_extract_all("code", F.lit(r"\b(\w+)\s*\("), 1), lambda x: ~x.isin(*dim.SKIPPED_CALLEES)))
    placed = F.array_sort(F.transform(names, lambda x: F.struct(F.instr(F.col("code"), F.concat(x, F.lit("("))).alias("p"), x.alias("callee"))))
    return df.select("cid", F.posexplode(placed if top is None else F.slice(placed, 1, top)).alias("rank", "c")).select(
        "cid", (F.col("rank") + 1).alias("rank"), F.col("c.callee").alias("callee")
    )


def callee_code(named: DataFrame, bodies: DataFrame) -> DataFrame:
    """Callees with the text and signature of their first definition."""
    from assayer.operators.source_tree import first_function

    return named.join(first_function(bodies).withColumnRenamed("name", "callee"), "callee")


def dereferenced(code: Column) -> Column:
    """First dereferenced name: p->x, then *p, then p[."""
    return t.first_text(
        F.regexp_extract(code, r"\b(\w+)\s*->\s*\w+", 1), F.regexp_extract(code, r"\*(\w+)", 1), F.regexp_extract(code, r"\b(\w+)\s*\[", 1)
    )


def first_identifier(code: Column) -> Column:
    return t.txt(F.get(F.filter(t.identifiers(code), lambda x: ~x.isin(*dim.C_KEYWORDS)), F.lit(0)))
