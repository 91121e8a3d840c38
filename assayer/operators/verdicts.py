"""From finding, trace and code to a verdict (R3-R8, G25): the whole analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions import text as t
from assayer.functions.frames import dealt, spread_join, unsized
from assayer.operators import decision, rules, snippets as sn, trace as tr
from assayer.operators.normalize import capped_confidence
from assayer.operators.source_tree import corroborate, first_function, lines_of
from assayer.operators.symbols import bounds_by_name
from assayer.session import for_long_rows, staged

INTENTIONAL_SETS = ("DEADCODE", "ARRAY_VS_SINGLETON", "UNUSED_VALUE", "CONSTANT_EXPRESSION_RESULT", "NO_BREAK")


def code_facts(df: DataFrame) -> DataFrame:
    """Facts read from the snippet of each finding, as one projection.

    Needs cid, checker, function, line, code, code_start_line and the trace facts
    (trace_sink, null_var, ...) and described variables (dest_var, src_var, size_bytes).
    """
    code, lines, rel, line = F.col("code"), F.col("lines"), F.col("rel"), F.col("line")
    df = sn.prepare(df)
    df = df.withColumn("sink_func", t.first_text(F.col("trace_sink"), sn.nearest_sink(code, lines, rel, line)))
    df = df.withColumn("args", sn.call_arguments_near(lines, F.col("sink_func"), rel, line))
    two = F.size("args") >= 2
    df = df.withColumn("arg_dest", F.when(two, F.get("args", F.lit(0))).otherwise("")).withColumn(
        "arg_src", F.when(two, F.get("args", F.lit(1))).otherwise("")
    )
    # only rule sets with the shared rules read origin and guard
    shared = F.col("rule_set").isin(*[s for s in rules.SHARED_SETS if s != rules.GENERIC])
    df = df.withColumn("traced_var", F.when(shared, F.col("arg_src")).otherwise(""))
    df = sn.provenance(df, "traced_var")
    df = df.withColumn("guard_var", F.when(shared, t.first_text(F.col("arg_src"), F.col("arg_dest"))).otherwise(""))
    df = sn.guard_scope(df, "guard_var", "arg")
    # A call with flat arguments
    called = F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)"), 1)
    release = F.create_map(*[F.lit(x) for p in dim.RELEASE_OF.items() for x in p])
    alloc = F.get(F.filter(called, lambda f: f.isin(*dim.RELEASE_OF)), F.lit(0))
    start = F.coalesce("code_start_line", F.lit(1))
    dest = t.first_text(F.col("arg_dest"), F.col("dest_var"))
    src = t.first_text(F.col("arg_src"), F.col("src_var"))
    df = df.withColumns(
        {
            "guard_line": F.when(F.col("arg_guard_at") > 0, F.col("arg_guard_at") + start - 1).otherwise(0),
            "guard_covers": F.col("arg_guard_covers"),
            "release_func": t.txt(F.try_element_at(release, alloc)),
            "dest": dest,
            "src": src,
        }
    )
    # data read by a callee stands in where the snippet itself shows no source
    # (callee_taint: 'name() (calls fn() internally)', '' when unknown)
    if "callee_taint" not in df.columns:
        df = df.withColumn("callee_taint", F.lit(""))
    df = df.withColumn(
        "origin",
        F.when(F.col("origin_kind") != "", sn.origin_text(F.col("origin_kind")))
        .when(F.col("callee_taint") != "", F.col("callee_taint"))
        .when(F.coalesce("taint_confirmed", F.lit(False)), "a tainted external source")
        .otherwise(dim.UNKNOWN_ORIGIN),
    )
    any_var = t.first_text(F.col("src"), F.col("dest"))
    guess = t.first_text(sn.dereferenced(code), sn.first_identifier(code))
    df = df.withColumn(
        "var",
        F.when(F.col("rule_set") == "REVERSE_INULL", t.first_text(F.col("null_var"), any_var, guess))
        .when(F.col("rule_set") == "FORWARD_NULL", t.first_text(any_var, guess))
        .otherwise(any_var),
    )
    df = df.withColumn("null_target", F.when(F.col("rule_set").isin("REVERSE_INULL", "FORWARD_NULL"), F.col("var")).otherwise(""))
    df = sn.guard_scope(df, "null_target", "nul")
    # the success-flag pattern is asked for one rule set only
    forward = F.col("rule_set") == "FORWARD_NULL"
    df = df.withColumn("rel_all", F.col("rel")).withColumn("rel", F.when(forward, F.col("rel")).otherwise(-1))
    df = sn.guarded_success_call(df, "flag").withColumn("rel", F.col("rel_all")).drop("rel_all", "traced_var")
    s = t.quoted(F.col("src"))
    bounded = F.concat(F.lit(r"\b"), s, F.lit(r"\b.*sizeof|sizeof.*\b"), s, F.lit(r"\b"))
    memset = sn.preceding_calls(lines, "memset", rel)
    first_args = sn.call_arguments(code, F.col("sink_func"))
    d3 = F.get(F.split(F.get(first_args, F.lit(0)), r"[.\->\[\s]"), F.lit(0))
    s3 = F.get(first_args, F.lit(2))
    full_size = (
        t.matches(s3, F.concat(F.lit(r"sizeof\s*\(\s*"), t.quoted(d3))) | (s3 == d3) | (t.matches(s3, r"\bsizeof\b") & ~t.matches(s3, r"-\s*1\s*$|-\s*sizeof\s*\("))
    )
    return df.withColumns(
        {
            "src_bounded": (F.col("src") != "") & t.matches(code, bounded),
            "memset_before": (F.col("dest") != "") & F.exists(memset, lambda m: F.instr(m["args"], F.col("dest")) > 0),
            "size_equal_in_code": F.col("sink_func").isin("strncpy", "strncat") & F.coalesce(full_size, F.lit(False)),
            "null_guard_line": F.when(F.col("nul_guard_at") > 0, F.col("nul_guard_at")).otherwise(0),
            "null_guard_covers": F.col("nul_guard_covers"),
            "null_guard_inside": F.col("nul_guard_inside"),
            # the guard's place is counted inside the snippet, the flagged line in the file
            "null_guard_before": F.col("nul_guard_at") < F.col("line"),
            "guarded_by_flag": (F.col("flag_guard_at") > 0) & (F.col("null_target") != ""),
            "copy_size": F.coalesce("index_value", F.lit(0)),
            "dest_size": F.coalesce("size_bytes", F.lit(0)),
            "caller_exempt": (t.txt(F.col("function")) == "") | t.txt(F.col("function")).rlike(r"(?i)\bmain\b|\b_init\b|\b_fini\b|callback|hook|handler"),
        }
    ).drop("args", "guard_var", "arg_guard_at", "arg_guard_kind", "arg_guard_covers", "arg_guard_inside", "nul_guard_at", "nul_guard_kind", "nul_guard_covers", "nul_guard_inside", "flag_guard_at", "flag_var", "flag_call")


def reading_functions(bodies: DataFrame) -> DataFrame:
    """Functions that read outside data (G7): callee, reads (the first such call in the fixed order).

    Bodies are read before the first definition of a name is taken, so none is sorted by name.
    """
    readers = t.members(dim.CALLEE_TAINT)
    called = F.regexp_extract_all("body", F.lit(r"\b(" + "|".join(dim.CALLEE_TAINT) + r")\s*\("), 1)
    place = F.array_min(F.transform(called, lambda fn: F.array_position(readers, fn)))
    read = bodies.select("name", "path", "start_line", F.get(readers, (place - 1).cast("int")).alias("reads"))
    return first_function(read).where(F.col("reads").isNotNull()).select(F.col("name").alias("callee"), "reads")


def callee_taint(callees: DataFrame, reading: DataFrame) -> DataFrame:
    """Callees that read outside data (G7): cid, callee_taint for the first such callee.

    ``callees(cid, rank, callee)`` are the ranked callees of each finding, ``reading`` is what
    :func:`reading_functions` gives: names meet names, no body travels, and a callee of very many findings is
    dealt to many tasks. The result joins the findings before :func:`judge` and stands in as origin where
    the snippet itself shows none.
    """
    text = F.concat("callee", F.lit("() (calls "), "reads", F.lit("() internally)"))
    found = spread_join(callees.select("cid", "rank", "callee"), reading, "callee", ["cid"]).select("cid", "rank", text.alias("text"))
    return found.groupBy("cid").agg(F.min_by("text", "rank").alias("callee_taint"))


def overrun_access(df: DataFrame) -> DataFrame:
    """Array access and its bound for overrun findings (G23): array, index_var, index_expr,
    access_i, access_kind, bound, bound_expr.

    Other findings see an empty snippet here, so they cost nothing.
    """
    on = F.col("rule_set") == "OVERRUN"
    df = df.withColumn("o_lines", F.when(on, F.col("lines")).otherwise(sn.empty_strings()))
    lines, rel, code = F.col("o_lines"), F.col("rel"), F.when(on, F.col("code")).otherwise("")
    df = df.withColumn("acc", sn.array_access(lines, rel))
    df = df.withColumn("decl", F.when(F.col("acc").isNotNull(), sn.array_declaration(lines, F.col("acc.array"))))
    loose_arr, loose_idx = F.regexp_extract(code, sn.POINTER, 1), t.strip(F.regexp_extract(code, sn.POINTER, 2))
    loose_var = F.regexp_extract(t.strip(F.regexp_replace(loose_idx, r"\([^)]+\)", "")), r"^([A-Za-z_][A-Za-z0-9_]*)\b", 1)
    df = df.withColumns(
        {
            "array": t.first_text(F.col("acc.array"), loose_arr, F.lit("the buffer")),
            "index_var": t.first_text(
                F.col("acc.index_var"), F.when(F.col("acc").isNull(), t.first_text(loose_var, loose_idx)), F.lit("the offset")
            ),
            "index_expr": t.first_text(F.col("acc.index_expr"), F.when(F.col("acc").isNull(), loose_idx)),
            "access_i": F.coalesce(F.col("acc.i"), F.lit(-1)),
            "access_kind": t.first_text(F.col("acc.kind"), F.when(loose_arr != "", "read"), F.lit("access")),
            "decl_size": F.coalesce(F.col("decl.size"), F.lit(0)).cast("bigint"),
            "declared": F.col("decl").isNotNull(),
        }
    )
    df = df.withColumn("bound", F.when(F.col("decl_size") > 0, F.col("decl_size")).otherwise(F.coalesce("array_size", F.lit(0))).cast("bigint"))
    df = df.withColumn("bound_expr", t.first_text(F.col("decl.size_expr"), F.when(F.col("bound") > 0, F.col("bound").cast("string"))))
    return df.drop("acc", "decl")


def overrun_facts(df: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Index flow and guard verdicts of overrun findings.

    ``symbols(name, kind, value)``: sizes of the source tree that have a name (G22), see :mod:`assayer.operators.symbols`.
    """
    df = overrun_access(df)
    if symbols is not None:
        df = bounds_by_name(staged(df, "accesses"), symbols)
    df = sn.index_flow(df, "o_lines", "index_var", "access_i", "idx")
    # a traced index of 0 counts as absent
    df = df.withColumn("traced_index", F.nullif(F.col("index_value"), F.lit(0)))
    provable = (F.col("idx_guard_op") != "") & (F.col("idx_guard_limit") != "") & (F.col("bound") > 0)
    return df.withColumns(
        {
            "is_off_by_one": provable & sn.off_by_one(F.col("idx_guard_op"), F.col("idx_guard_limit"), F.col("bound")),
            "guard_is_safe": provable & sn.guard_is_safe(F.col("idx_guard_cond"), F.col("index_var"), F.col("bound")),
            "index_guard": sn.guard_status(
                F.col("idx_guard_cond"), F.col("index_var"), F.col("traced_index"), F.col("bound"), F.col("bound_expr"),
                F.col("array"), F.coalesce("guard_covers", F.lit(False)),
            ),
            "named_access": ~F.col("array").isin("", "the buffer", "the array", "array")
            & ~F.col("index_var").isin("", "the offset", "the index", "index"),
        }
    ).drop("o_lines", "declared")


# Calls that bring in a value from outside
INPUT_CALLS = r"\b(recv|recvfrom|fread|fgets|getenv|scanf|sscanf|fscanf|read|accept|ntohs|ntohl|getchar|gets|atoi|strtol)\b"


QUESTION = ["callee", "arg_pos", "buf_pos", "bound"]


def caller_question(df: DataFrame) -> DataFrame:
    """What to ask the callers of a finding's function: callee, place of the flagged
    index and of the array among its parameters (0 for none). Needs lines, index_var, array."""
    names = sn.parameter_names(F.col("lines"))
    # Name in the first signature line
    heads = F.transform(
        F.filter("lines", lambda x: ~t.strip(x).rlike(r"^(#|//|/\*|\*)")),
        lambda x: F.regexp_extract(t.strip(x), r"^[\w\s\*]+\b(\w+)\s*\(", 1),
    )
    place = lambda c: F.coalesce(F.array_position(names, F.col(c)).cast("int"), F.lit(0))
    return df.withColumns(
        {"callee": t.txt(F.get(F.filter(heads, lambda x: x != ""), F.lit(0))), "arg_pos": place("index_var"), "buf_pos": place("array")}
    )


PLACES = ["callee", "arg_pos", "buf_pos"]


def caller_answers(asked: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Verdict of the callers per question (G25): 'oob', 'bounded_before', 'bounded' or ''.

    ``call_sites(callee, path, line_no, snippet, caller, caller_start, body)``.
    Sites never meet questions. A site is read once for each pair of places among the arguments that
    anybody asks about (a few per callee) and summed up at once: per place a histogram of the constants
    passed, and counts of the rest. How many constants lie below a bound is a
    running sum over the histogram and the bounds together, ordered by value. The sites of a callee that
    very many call are dealt to many tasks.
    """
    asked = asked.where((F.col("callee") != "") & (F.col("arg_pos") > 0)).select(*QUESTION).distinct()
    places = asked.select(*PLACES).distinct().groupBy("callee").agg(F.collect_list(F.struct("arg_pos", "buf_pos")).alias("places"))
    sites = call_sites.where(F.col("snippet") != "").select("callee", "path", "line_no", "snippet", "caller_start", "body")
    q = (
        spread_join(sites, places, "callee", ["path", "line_no"])
        .withColumn("args", sn.call_arguments(F.col("snippet"), F.col("callee")))
        .withColumn("lines", lines_of(F.col("body")))
        .select("callee", "path", "line_no", "caller_start", "args", "lines", F.inline("places"))
        .withColumn("arg", F.get("args", F.col("arg_pos") - 1))
    )
    passed = F.get("args", F.col("buf_pos") - 1)
    declared = F.when(F.col("buf_pos") > 0, sn.array_declaration(F.col("lines"), passed)["size"])
    at = F.greatest(F.lit(1), F.least(F.col("line_no") - F.col("caller_start") + 1, F.size("lines"))) - 1
    q = q.withColumn("declared", F.when(declared > 0, declared)).withColumn("at", at.cast("int"))
    q = sn.index_flow(q, "lines", "arg", "at", "cf")
    number = F.when(F.col("arg").rlike(r"^\d+$"), F.col("arg").try_cast("bigint"))
    input_call = F.col("arg").rlike(INPUT_CALLS)
    relative = ~input_call & F.col("arg").rlike(r"\b(sizeof\s*\(|\b[\w]+\s*-\s*1\b)")
    histogram = staged(
        q.groupBy(*PLACES, number.alias("value")).agg(
            F.count_if(F.col("arg").isNotNull()).alias("n"),
            F.count_if(number.isNull() & input_call).alias("from_input"),
            F.count_if(number.isNull() & relative).alias("relative"),
            F.count_if(number.isNull() & F.col("arg").isNotNull() & (F.col("cf_guard_at") > 0)).alias("guarded"),
            F.min(F.when(F.col("declared").isNotNull(), F.struct("path", "line_no", "declared"))).alias("d"),
        ),
        "passed-values",
    )
    whole = histogram.groupBy(*PLACES).agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("constants"),
        F.sum("from_input").alias("from_input"), F.sum("relative").alias("relative"), F.sum("guarded").alias("guarded"), F.min("d")["declared"].alias("declared"),
    )
    sized = asked.join(whole, PLACES).withColumn("size", F.when(F.col("bound") > 0, F.col("bound")).otherwise(F.coalesce("declared", F.lit(0))))
    hits = sized.join(below_sizes(histogram, sized), [*PLACES, "size"], "left")
    below, known = F.coalesce("below", F.lit(0)), F.col("size") > 0
    hits = hits.select(
        *QUESTION,
        (F.when(known, F.col("constants") - below).otherwise(0) + F.col("from_input")).alias("b"),
        F.when(known, below + F.col("relative")).otherwise(0).alias("f"),
        F.col("guarded").alias("g"),
    )
    verdict = (
        F.when((F.col("b") > 0) & (F.col("f") == 0) & (F.col("g") == 0), "oob")
        .when((F.col("g") > 0) & (F.col("b") == 0), "bounded_before")
        .when((F.col("f") > 0) & (F.col("b") == 0), "bounded")
        .when((F.col("b") > 0) & (F.col("f") == 0), "oob")
        .otherwise("")
    )
    return hits.select(*QUESTION, verdict.alias("caller_verdict"))


def below_sizes(histogram: DataFrame, sized: DataFrame) -> DataFrame:
    """Constants below each asked size (callee, places, size): ``below``, by one running sum per place."""
    values = histogram.where(F.col("value").isNotNull()).select(*PLACES, F.col("value").alias("x"), F.lit(1).alias("kind"), "n")
    bounds = sized.where(F.col("size") > 0).select(*PLACES, F.col("size").alias("x"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("n")).distinct()
    earlier = Window.partitionBy(*PLACES).orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return values.unionByName(bounds).withColumn("below", F.sum("n").over(earlier)).where("kind = 0").select(*PLACES, F.col("x").alias("size"), "below")


def caller_evidence(df: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of the callers onto findings: adds caller_verdict ('' for none)."""
    out = caller_question(df).join(answers, QUESTION, "left")
    return out.withColumn("caller_verdict", t.txt(F.col("caller_verdict"))).drop("callee", "arg_pos", "buf_pos")


def extra_overrun_evidence(df: DataFrame) -> DataFrame:
    """Second evidence array of inconclusive overruns: index constant, provenance, callers."""
    open_ = (F.col("rule_set") == "OVERRUN") & (F.col("classification") == "Needs review")
    df = df.withColumn("asked_var", F.when(open_, F.col("index_var")).otherwise(""))
    df = sn.provenance(df, "asked_var", prefix="index_origin").drop("asked_var")
    plain = lambda c: F.regexp_extract(F.regexp_replace(F.col(c), r"\s+", ""), r"^\(?(\d+)\)?$", 1)
    const = F.nullif(t.first_text(plain("index_expr"), plain("idx_assign_expr")), F.lit("")).try_cast("bigint")
    known, sized = ~F.col("index_var").isin("the offset", "the index", "index"), F.col("bound") > 0
    # Labels, polarities and weights
    entries = [
        (known & sized & (const < F.col("bound")), "constant_index_within_bounds", "fp", 85, "the index is a constant inside the array"),
        (known & sized & (const >= F.col("bound")), "constant_index_out_of_bounds", "bug", 90, "the index is a constant outside the array"),
        (known & F.col("index_origin_kind").isin("network", "file", "env", "args", "convert"), "overrun_index_untrusted_origin", "bug", 62, "the index comes from outside"),
        (known & F.col("index_origin_kind").isin("local", "literal", "bounded", "safe"), "overrun_index_safe_origin", "fp", 60, "the index comes from a safe source"),
        (known & (F.col("caller_verdict") == "oob"), "overrun_caller_passes_oob", "bug", 80, "callers pass values outside the array"),
        (known & (F.col("caller_verdict") == "bounded_before"), "overrun_caller_bound_index", "fp", 72, "callers limit the index before the call"),
        (known & (F.col("caller_verdict") == "bounded"), "overrun_caller_passes_bounded", "fp", 85, "every caller passes a value inside the array"),
    ]
    made = [
        F.when(
            cond,
            F.struct(
                F.lit(i).alias("seq"), F.lit(label).alias("label"), F.lit(pol).alias("polarity"), F.lit(w).alias("weight_c"), F.lit(text).alias("description")
            ),
        )
        for i, (cond, label, pol, w, text) in enumerate(entries)
    ]
    return df.withColumn("extra_evidence", F.filter(F.array(*made), lambda e: e.isNotNull()))


def overrun_overrides(df: DataFrame) -> DataFrame:
    """Ordered corrections of overrun decisions (R6). Needs the extra decision in
    extra_class and extra_confidence."""
    on = F.col("rule_set") == "OVERRUN"
    # Floors and confidences of the corrections
    cls, conf = F.col("classification"), F.col("confidence")
    to_bug = on & F.col("is_off_by_one") & (cls != "Bug")
    to_fp = on & ~F.col("is_off_by_one") & F.col("guard_is_safe") & (cls == "Bug")
    df = df.withColumns(
        {
            "classification": F.when(to_bug, "Bug").when(to_fp, "False positive").otherwise(cls),
            "confidence": F.when(to_bug, F.greatest(conf, F.lit(0.82))).when(to_fp, F.greatest(conf, F.lit(0.78))).otherwise(conf),
        }
    )
    cls, conf, g = F.col("classification"), F.col("confidence"), F.col("index_guard")
    traced_oob = F.coalesce((F.col("bound") > 0) & (F.col("traced_index") >= F.col("bound")), F.lit(False))
    weak = on & (cls == "False positive") & g.isin("irrelevant", "unsafe", "unknown")
    df = df.withColumns(
        {
            "classification": F.when(weak, F.when((g == "unsafe") | F.col("named_access"), "Bug").otherwise("Needs review")).otherwise(cls),
            "confidence": F.when(
                weak,
                F.when((g == "unsafe") & traced_oob, 0.78).when((g == "unsafe") | F.col("named_access"), 0.60).otherwise(0.55),
            ).otherwise(conf),
        }
    )
    cls, conf = F.col("classification"), F.col("confidence")
    open_ = on & (cls == "Needs review")
    by_trace, by_safe, by_unsafe = open_ & traced_oob, open_ & (g == "safe"), open_ & (g == "unsafe")
    by_access = open_ & g.isin("irrelevant", "none") & F.col("named_access")
    df = df.withColumns(
        {
            "classification": F.when(by_trace, "Bug").when(by_safe, "False positive").when(by_unsafe | by_access, "Bug").otherwise(cls),
            "confidence": F.when(by_trace, 0.78).when(by_safe, 0.55).when(by_unsafe, 0.60).when(by_access, 0.55).otherwise(conf),
        }
    )
    cls, conf = F.col("classification"), F.col("confidence")
    extra = on & (cls == "Needs review") & F.col("extra_class").isin("Bug", "False positive") & (F.col("extra_confidence") >= 0.55)
    return df.withColumns(
        {
            "classification": F.when(extra, F.col("extra_class")).otherwise(cls),
            "confidence": F.when(extra, F.greatest(conf, F.col("extra_confidence") - 0.05)).otherwise(conf),
        }
    )


def context_prior(df: DataFrame) -> DataFrame:
    """Prior confidence of the context (R8), clamped to 0..1."""
    add = lambda cond, w: F.when(F.coalesce(cond, F.lit(False)), w).otherwise(0.0)
    guarded = F.col("guard_on_path") & F.col("guard_takes_true")
    prior = (
        F.lit(0.5) + add(F.col("defect_confirmed"), 0.35) + add(F.col("taint_confirmed"), 0.15)
        + add(guarded, -0.3) + add(F.size(lines_of(F.col("code"))) < 5, -0.2)
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), prior))
    return df.withColumn("prior", F.round(F.least(F.lit(1.0), clamped + add(F.col("corroborated_by") != "", 0.15)), 2))


def gather(findings: DataFrame, trace: DataFrame, code: DataFrame | None = None) -> DataFrame:
    """Findings with their trace facts and code, joined on cid; the trace is reduced to
    one row per finding in a single pass. ``code(cid, code, code_start_line)`` may be
    left out when the findings carry these columns.

    The joins need the findings by cid anyway; naming the partition count keeps the
    adaptive planner from merging them into few tasks, for what follows is bound by
    computation, not by bytes. Events of other findings are left out before they are read for
    facts; that join orders the rest by cid, so the facts are summed up without another sort.
    """
    asked = trace.join(unsized(findings.select("cid")), "cid", "left_semi")
    df = dealt(findings, "cid").join(unsized(tr.trace_summary(asked)), "cid", "left")
    if code is not None:
        df = df.join(unsized(code), "cid", "left")
    fill = {"defect_confirmed": False, "taint_confirmed": False, "guard_on_path": False, "guard_takes_true": False,
            "size_equal_in_trace": False, "trace_validates": False, "null_var": "", "trace_sink": "", "n_events": 0,
            "dest_var": "", "src_var": "", "size_bytes": 0, "buffer_bytes": 0, "code": "", "code_start_line": 1}
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in fill.items()})


def function_name(df: DataFrame) -> Column:
    """Bare name of a finding's function, '' for none."""
    return F.regexp_extract(t.txt(F.col("function")), r"(\w+)\s*(?:\(.*)?$", 1)


def neighbour_code(names: DataFrame, call_sites: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Code around functions (R3): name, text, one row for each of ``names(name)`` that has any.

    First what the function calls, by line, where ``bodies`` has its definition, then
    the functions that call it, by path and line; each once. A name's text is as long as its neighbours are.
    """
    names = names.select("name").distinct()
    sites = call_sites.where(~F.col("callee").eqNullSafe(F.col("caller")))
    rank = lambda kind, path, line: F.struct(F.lit(kind).alias("kind"), path.alias("path"), line.cast("long").alias("line"))
    asked = names.select(F.col("name").alias("callee"), "name")
    calling = spread_join(sites.select("callee", "path", "line_no", "caller_start", "body"), asked, "callee", ["path", "line_no"])
    found = calling.groupBy("name", rank(1, F.col("path"), F.col("caller_start")).alias("rank")).agg(F.max("body").alias("text"))
    if bodies is not None:
        called = unsized(sites.select("caller", "callee", "path", "line_no")).join(names, F.col("caller") == F.col("name"))
        called = called.groupBy("name", "callee").agg(F.min(rank(0, F.col("path"), F.col("line_no"))).alias("rank"))
        defined = first_function(bodies).select(F.col("name").alias("callee"), F.col("body").alias("text"))
        found = found.unionByName(spread_join(called, defined, "callee", ["name"]).select("name", "rank", "text"))
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return found.where(t.strip(F.col("text")) != "").groupBy("name").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def with_neighbours(df: DataFrame, call_sites: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """The code around its function for a finding that has none (R3): adds used_fallback.

    Each function's text is put together once and handed to its findings; findings never meet single neighbours. Findings
    with code of their own stay apart, so that a written file has the rows of a function one behind the other and its text once.
    """
    for_long_rows(df.sparkSession, "code")
    named = df.withColumn("__name", F.when(F.col("code") == "", F.nullif(function_name(df), F.lit(""))))
    texts = staged(neighbour_code(named.where("__name IS NOT NULL").select(F.col("__name").alias("name")), call_sites, bodies), "neighbours")
    asking, others = named.where("__name IS NOT NULL"), named.where("__name IS NULL")
    out = spread_join(asking, texts.select(F.col("name").alias("__name"), F.col("text").alias("__fb")), "__name", ["cid"], "left", spread=True)
    out = out.withColumn("used_fallback", F.col("__fb").isNotNull()).withColumn("code", F.coalesce("__fb", "code"))
    return out.drop("__name", "__fb").unionByName(others.withColumn("used_fallback", F.lit(False)).drop("__name"))


def with_context(df: DataFrame, call_sites: DataFrame | None = None, bodies: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """What stands around a finding: adds used_fallback, callee_taint, corroborated_by and prior.

    ``bodies(name, path, start_line, body)`` are the functions of the source tree, ``hits(path, line, ordinal,
    rule_id)`` those of another scanner; findings need ``path`` for them. Each may be missing, its columns then say nothing.
    """
    if call_sites is not None:
        df = with_neighbours(df, call_sites, bodies)
    if bodies is not None:
        taint = callee_taint(sn.callees(df), reading_functions(bodies))
        df = df.drop("callee_taint").join(unsized(taint), "cid", "left").withColumn("callee_taint", t.txt(F.col("callee_taint")))
    if hits is not None:
        df = corroborate(df.drop("rule_id"), hits).withColumnRenamed("rule_id", "corroborated_by")
    for name, default in (("used_fallback", False), ("callee_taint", ""), ("corroborated_by", "")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    return context_prior(df)


def with_caller_count(df: DataFrame, call_sites: DataFrame | None) -> DataFrame:
    """Number of call sites of each finding's function: ``n_callers``; NULL without a call graph or a function name.

    Sites are counted per callee before they meet the findings. A definition line is no call.
    """
    if call_sites is None:
        return df.withColumn("n_callers", F.lit(None).cast("bigint"))
    used = call_sites.where(~F.col("callee").eqNullSafe(F.col("caller"))).groupBy(F.col("callee").alias("__callee")).agg(F.count(F.lit(1)).alias("n_callers"))
    out = df.withColumn("__name", function_name(df)).join(used, F.col("__name") == F.col("__callee"), "left")
    count = F.when(F.col("__name") != "", F.coalesce("n_callers", F.lit(0))).cast("bigint")
    return out.withColumn("n_callers", count).drop("__name", "__callee")


def judge(df: DataFrame, book: rules.RuleBook = rules.DEFAULT_BOOK, call_sites: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Gathered findings to verdicts: classification, confidence, reasons, evidence."""
    for name, default in (("used_fallback", False), ("line_is_various", False), ("corroborated_by", "")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    if "n_callers" not in df.columns:
        df = with_caller_count(df, call_sites)
    df = df.withColumn("rule_set", rules.rule_set(F.col("checker"), F.col("code") != "", book))
    answers = None
    if call_sites is not None:
        asking = overrun_access(sn.prepare(df.where(F.col("rule_set") == "OVERRUN")))
        if symbols is not None:
            asking = bounds_by_name(staged(asking, "asking"), symbols)
        answers = caller_answers(caller_question(asking), call_sites)
    df = staged(overrun_facts(staged(code_facts(df), "code-facts"), symbols), "overrun-facts")
    if answers is not None:
        df = caller_evidence(df, answers)
    else:
        df = df.withColumn("caller_verdict", F.lit(""))
    df = staged(rules.evidence(rules.with_facts(df), book), "evidence")
    df = decision.decide(df)
    df = _extra_decision(extra_overrun_evidence(df))
    df = overrun_overrides(df)
    df = df.withColumn("all_lines", F.col("lines")).withColumn(
        "lines", F.when(F.col("rule_set") == "CHECKED_RETURN", F.col("lines")).otherwise(sn.empty_strings())
    )
    df = sn.checked_return(df).withColumn("lines", F.col("all_lines")).drop("all_lines")
    return _finish(df, book)


def _extra_decision(df: DataFrame) -> DataFrame:
    """Decision over the extra evidence, beside the first one."""
    keep = ["evidence", "classification", "confidence", "reasons", "dominant"]
    work = ["bug_c", "fp_c", "critical_bug", "critical_fp", "n_insufficient", "top_weight", "top_polarity",
            "bug_score", "fp_score", "winner", "loser", "margin", "dominance"]
    main = df.withColumn("__main", F.struct(*keep, *work)).drop(*keep, *work).withColumnRenamed("extra_evidence", "evidence")
    second = decision.decide(main)
    return second.select(
        *[c for c in second.columns if c not in keep + work + ["__main"]],
        F.col("classification").alias("extra_class"),
        F.col("confidence").alias("extra_confidence"),
        *[F.col(f"__main.{c}").alias(c) for c in keep + work],
    )


def _finish(df: DataFrame, book: rules.RuleBook) -> DataFrame:
    """Checkers that answer by themselves, remaps, caps."""
    rset, cls, conf = F.col("rule_set"), F.col("classification"), F.col("confidence")
    returns = rset == "CHECKED_RETURN"
    empty = (F.col("code") == "") & (F.col("n_events") == 0)
    bugs = F.exists("evidence", lambda e: e["polarity"] == "bug")
    fps = F.exists("evidence", lambda e: e["polarity"] == "fp")
    lean = (rset == "UNUSED_VALUE") & (cls == "Needs review") & (bugs != fps)
    new_cls: Column = (
        F.when(empty, "Needs review")
        .when(returns, F.col("fate_class"))
        .when(lean, F.when(bugs, "Bug").otherwise("Intentional"))
        .when(rset.isin(*INTENTIONAL_SETS) & (cls == "False positive"), "Intentional")
        .otherwise(cls)
    )
    for name, fn in book.columns.items():
        new_cls = F.when((rset == name) & fn().isNotNull(), fn()).otherwise(new_cls)
    new_conf = F.when(empty, 0.0).when(returns, F.col("fate_confidence")).when(lean, 0.55).otherwise(conf)
    # both read the class as it was, so they are set together
    return df.withColumns(
        {"classification": new_cls, "confidence": capped_confidence(new_conf, F.col("used_fallback"), F.col("line_is_various"))}
    )


def analyze(
    findings: DataFrame, trace: DataFrame, code: DataFrame | None = None, book: rules.RuleBook = rules.DEFAULT_BOOK, call_sites: DataFrame | None = None,
    bodies: DataFrame | None = None, hits: DataFrame | None = None, symbols: DataFrame | None = None,
) -> DataFrame:
    """The analysis of a report: findings, trace and code to verdicts.

    Call sites, function bodies and another scanner's hits are joined in by :func:`with_context`; ``symbols`` give
    array sizes that stand in other files.
    The gathered findings are staged: the verdict itself is then one scan and one
    projection, planned once.
    """
    gathered = gather(findings, trace, code)
    if call_sites is not None or bodies is not None:
        gathered = staged(gathered, "gathered-alone")
    return judge(staged(with_context(gathered, call_sites, bodies, hits), "gathered"), book, call_sites, symbols)
