"""Queries over evidence, decisions and verdicts.

All of them read their facts from trace and code; the checks derive the same facts in SQL
(``fact_checks``), apply the rules as written out in ``rule_checks`` and decide.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions import text as t
from assayer.functions.frames import dealt, unsized
from assayer.operators import categories as cat
from assayer.operators import decision, rules, snippets as sn, source_tree as st
from assayer.operators import symbols as sy
from assayer.operators import verdicts as vd
from assayer.plans import fact_checks as fc
from assayer.plans import verdict_checks as vc
from assayer.plans import views as v
from assayer.plans.registry import flag, query, quoted_list
from assayer.session import staged

FLAGS = [
    "defect_confirmed", "taint_confirmed", "guard_on_path", "guard_takes_true", "size_equal_in_trace", "size_equal_in_code", "trace_validates", "src_bounded",
    "memset_before", "null_guard_covers", "null_guard_before", "null_guard_inside", "guarded_by_flag", "caller_exempt", "guard_covers",
]
TEXTS = ["rule_set", "origin", "sink_func", "release_func", "null_var", "var"]
NUMBERS = ["guard_line", "null_guard_line", "dest_size", "copy_size"]


def _known(spark, d):
    """Facts of trace and code of every finding."""
    df = vd.gather(v.code(spark, d), v.trace(spark, d))
    return vd.code_facts(df.withColumn("rule_set", rules.rule_set(F.col("checker"), F.col("code") != "")))


@query("SELECT cid, " + ", ".join(f"{c}::INT::BIGINT AS {c}" for c in FLAGS) + ", " + ", ".join(TEXTS + NUMBERS) + " FROM v_known", fc.CODE_FACTS)
def code_facts(spark, d):
    """G11-G21 and E10-E12 as the rules read them."""
    return _known(spark, d).select("cid", *[flag(F.col(c)).alias(c) for c in FLAGS], *TEXTS, *[F.col(c).cast("bigint").alias(c) for c in NUMBERS])


def _ruled(spark, d):
    df = staged(_known(spark, d), "known")
    return rules.evidence(rules.with_facts(df)).select("cid", "checker", "rule_set", "evidence")


@query("SELECT cid, seq::BIGINT AS seq, label, polarity, w::BIGINT AS weight_c, text AS description FROM v_ev", fc.RULED)
def rule_evidence(spark, d):
    """R0, R1, R2."""
    e = rules.evidence_rows(_ruled(spark, d))
    return e.select("cid", F.col("seq").cast("bigint").alias("seq"), "label", "polarity", F.col("weight_c").cast("bigint").alias("weight_c"), "description")


@query("SELECT cid, b::BIGINT AS bug_c, f::BIGINT AS fp_c FROM v_score WHERE cid IN (SELECT cid FROM v_ev)", fc.RULED)
def evidence_score(spark, d):
    """D1, as an aggregate of the long table."""
    return decision.score_rows(rules.evidence_rows(_ruled(spark, d)))


@query("SELECT cid, b::BIGINT AS bug_c, f::BIGINT AS fp_c, cb::INT::BIGINT AS critical_bug, cf::INT::BIGINT AS critical_fp FROM v_score", fc.RULED)
def critical_flags(spark, d):
    """D1 in the row, D2."""
    s = decision.critical_flags(decision.scores(_ruled(spark, d)))
    return s.select("cid", F.col("bug_c").cast("bigint").alias("bug_c"), F.col("fp_c").cast("bigint").alias("fp_c"), flag(F.col("critical_bug")).alias("critical_bug"), flag(F.col("critical_fp")).alias("critical_fp"))


@query("SELECT cid, classification, confidence FROM v_decided", fc.RULED)
def decision_by_evidence(spark, d):
    """D3, D4, D5."""
    return decision.decide(_ruled(spark, d)).select("cid", "classification", "confidence")


@query("SELECT cid, classification, reasons FROM v_reasons", fc.RULED)
def top_reasons(spark, d):
    """D6."""
    return decision.decide(_ruled(spark, d)).select("cid", "classification", F.array_join("reasons", " | ").alias("reasons"))


@query(
    """
SELECT cid, 'copies_outside_text' AS label, 'bug' AS polarity, 70::BIGINT AS weight_c, 'strcpy() of ' || origin AS description FROM v_known WHERE checker = 'CUSTOM_RULE' AND regexp_matches(code, '\\bstrcpy\\s*\\(') AND sink_func = 'strcpy'""",
    fc.CODE_FACTS,
)
def registered_rule(spark, d):
    """K: a checker and a rule of the user's own, beside the given ones."""
    book = rules.RuleBook()
    book.register_checker("CUSTOM_RULE")
    book.register_rule(rules.Rule("CUSTOM_RULE", "copies_outside_text", rules.BUG, 70, "strcpy() of {origin}", all=(r"\bstrcpy\s*\(",), needs="sink_func = 'strcpy'"))
    df = _known(spark, d).withColumn("rule_set", rules.rule_set(F.col("checker"), F.col("code") != "", book)).where("checker = 'CUSTOM_RULE'")
    e = rules.evidence_rows(rules.evidence(rules.with_facts(df), book))
    return e.select("cid", "label", "polarity", F.col("weight_c").cast("bigint").alias("weight_c"), "description")


@query(
    "SELECT a.cid, a.label AS bug_label, b.label AS fp_label FROM v_ev a JOIN v_ev b ON a.cid = b.cid AND a.polarity = 'bug' AND b.polarity = 'fp' WHERE a.label = b.label OR "
    + " OR ".join(f"(contains(a.label, '{w}') AND contains(b.label, '{w}'))" for w in dim.DOMAIN_WORDS),
    fc.RULED,
)
def conflicts(spark, d):
    """D7."""
    return decision.conflicts(_ruled(spark, d))


@query(
    """
SELECT c.cid, (c.cid % 3 = 0 AND f.text IS NOT NULL)::INT::BIGINT AS used_fallback, CASE WHEN c.cid % 3 <> 0 THEN c.code ELSE coalesce(f.text, '') END AS code FROM v_code c LEFT JOIN k_neighbours f ON f.name = c.function""",
    vc.SITES | vc.NEIGHBOURS,
)
def fallback_code(spark, d):
    """A third of the findings come without their code and get the functions around theirs."""
    df = v.code(spark, d).withColumn("code", F.when(F.col("cid") % 3 == 0, "").otherwise(F.col("code")))
    files = v.files(spark, d)
    bodies = staged(st.function_bodies(st.functions(st.line_facts(files)), files), "bodies")
    return vd.with_neighbours(df, _passing_sites(spark, d), bodies).select("cid", flag(F.col("used_fallback")).alias("used_fallback"), "code")


@query("SELECT cid, prior FROM v_prior", fc.RULED)
def context_prior(spark, d):
    """R8."""
    df = _known(spark, d).withColumn("corroborated_by", F.lit(""))
    return vd.context_prior(df).select("cid", "prior")


def _overrun(spark, d):
    """Facts, evidence and both decisions of every finding, as :func:`verdicts.judge` orders them, without a call graph."""
    df = staged(vd.overrun_facts(staged(_known(spark, d), "known")), "overrun").withColumn("caller_verdict", F.lit(""))
    df = decision.decide(staged(rules.evidence(rules.with_facts(df)), "evidence"))
    return vd._extra_decision(vd.extra_overrun_evidence(df))


@query(
    "SELECT cid, buffer AS array, index_var, index_expr, bound, bound_expr, cond AS guard_cond, index_guard, is_off_by_one::INT::BIGINT AS is_off_by_one, guard_is_safe::INT::BIGINT AS guard_is_safe, named_access::INT::BIGINT AS named_access FROM k_bound WHERE rule_set = 'OVERRUN'",
    vc.ALONE,
)
def overrun_bounds(spark, d):
    """G23, G24 of overrun findings: access, bound, guard and what the guard is worth."""
    df = vd.overrun_facts(staged(_known(spark, d).where("rule_set = 'OVERRUN'"), "known"))
    return df.select(
        "cid", "array", "index_var", "index_expr", "bound", "bound_expr", F.col("idx_guard_cond").alias("guard_cond"), "index_guard",
        *[flag(F.col(c)).alias(c) for c in ("is_off_by_one", "guard_is_safe", "named_access")],
    )


def _headers(spark, d):
    """A header with sizes that have names, one behind the other; the numbers come from the parts."""
    top = v.table(spark, d, "part").agg(F.max("p_size").cast("string").alias("m"))
    text = F.concat(F.lit("// sizes\n#define BASE "), "m", F.lit("\n#define TWICE (BASE * 2)\n#define MAX (TWICE - 36) // bytes\n#define LOOP LOOP\nstruct box {\n  char name[TWICE];\n};"))
    return top.select(F.lit("inc/x.h").alias("path"), text.alias("content"))


@query("SELECT name, kind, value::BIGINT AS value FROM v_symbols", vc.SYMBOLS)
def symbol_values(spark, d):
    """Defines and members of the tree, folded."""
    return sy.symbol_values(sy.symbols(v.files(spark, d).unionByName(_headers(spark, d))))


@query("SELECT cid, buffer AS array, bound, bound_expr, index_guard, is_off_by_one::INT::BIGINT AS is_off_by_one, guard_is_safe::INT::BIGINT AS guard_is_safe FROM k_bound WHERE rule_set = 'OVERRUN'", vc.NAMED_BOUNDS)
def overrun_bounds_by_name(spark, d):
    """G22 in G23, G24: bounds whose size is a name of another file."""
    values = sy.symbol_values(sy.symbols(v.files(spark, d).unionByName(_headers(spark, d))))
    df = vd.overrun_facts(staged(_known(spark, d).where("rule_set = 'OVERRUN'"), "known"), values)
    return df.select("cid", "array", "bound", "bound_expr", "index_guard", flag(F.col("is_off_by_one")).alias("is_off_by_one"), flag(F.col("guard_is_safe")).alias("guard_is_safe"))


@query("SELECT cid, classification, confidence FROM k_corrected", vc.ALONE)
def overrun_overrides(spark, d):
    """R6."""
    return vd.overrun_overrides(_overrun(spark, d)).select("cid", "classification", "confidence")


@query("SELECT cid, classification, confidence FROM k_final", vc.ALONE)
def final_classes(spark, d):
    """The verdict from trace and snippet alone."""
    return vd.analyze(v.code(spark, d), v.trace(spark, d)).select("cid", "classification", "confidence")


@query(
    """
SELECT c.cid, CASE WHEN c.cid % 7 = 0 OR h.b IS NULL THEN '' WHEN h.b > 0 AND h.f = 0 AND h.g = 0 THEN 'oob' WHEN h.g > 0 AND h.b = 0 THEN 'bounded_before' WHEN h.f > 0 AND h.b = 0 THEN 'bounded' WHEN h.b > 0 AND h.f = 0 THEN 'oob' ELSE '' END AS caller_verdict
FROM v_code c LEFT JOIN (SELECT a.cid, count(*) FILTER (x.arg_n IS NOT NULL AND x.arg_n >= a.bound) + count(*) FILTER (x.arg LIKE 'atoi%') AS b, count(*) FILTER (x.arg_n IS NOT NULL AND x.arg_n < a.bound) AS f, count(*) FILTER (x.guarded) AS g
 FROM (SELECT cid, function, cid % 40 + 1 AS bound FROM v_code) a JOIN v_passed x ON x.callee = a.function GROUP BY 1) h USING (cid)""",
    {
        "v_passed": """
SELECT callee, arg, try_cast(arg AS BIGINT) AS arg_n, guarded FROM (
 SELECT 'fn_' || ((p_partkey + 1) % 211) AS callee, CASE p_partkey % 3 WHEN 0 THEN (p_size % 60)::VARCHAR WHEN 1 THEN 'n' ELSE 'atoi(src)' END AS arg,
  p_partkey % 3 = 1 AS guarded, p_partkey FROM part
 UNION ALL SELECT 'fn_' || ((p_partkey * 7) % 211), 'n', p_partkey % 5 IN (1, 3), p_partkey FROM part WHERE p_partkey % 8 = 3)"""
    },
)
def caller_evidence(spark, d):
    """What callers pass as the second argument. Every caller body compares
    something that contains the letter n, so a passed ``n`` counts as guarded."""
    df = _with_access(v.code(spark, d))
    answers = vd.caller_answers(vd.caller_question(df), _passing_sites(spark, d))
    return vd.caller_evidence(df, answers).select("cid", "caller_verdict")


def _with_access(code):
    s = sn.prepare(dealt(code, "cid"))
    return s.withColumn("index_var", F.lit("n")).withColumn("array", F.lit("buf")).withColumn("bound", (F.col("cid") % 40 + 1).cast("bigint"))


def _passing_sites(spark, d):
    """All calls on all lines of all snippets; the line that defines a function is no call of it."""
    lines = dealt(v.code(spark, d), "cid").select("cid", "function", "code_start_line", "code", F.posexplode(F.split("code", "\n")).alias("i", "text"))
    sites = lines.select(
        F.explode(F.array_distinct(st.callees_in(F.col("text")))).alias("callee"), F.col("cid").cast("string").alias("path"), (F.col("code_start_line") + F.col("i")).alias("line_no"),
        t.strip(F.col("text")).alias("snippet"), F.col("function").alias("caller"), F.col("code_start_line").alias("caller_start"), F.col("code").alias("body"),
    )
    return sites.where("callee <> caller OR line_no <> caller_start")


def _hits(files):
    """Another scanner's hits: lines of the tree that call what it watches."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    rule = F.expr("CASE WHEN contains(text, 'strcpy(') THEN 'unsafe-copy' WHEN contains(text, 'sprintf(') THEN 'unsafe-format' WHEN contains(text, 'atoi(') THEN 'unchecked-number' ELSE '' END")
    return lines.select("path", (F.col("i") + 1).cast("bigint").alias("line"), (F.col("i") + 1).cast("bigint").alias("ordinal"), rule.alias("rule_id"))


def _verdicts(spark, d):
    files = v.files(spark, d)
    bodies = st.function_bodies(st.functions(st.line_facts(files)), files)
    placed = v.code(spark, d).selectExpr("*", f"{v.FILE_NO} AS file_no").selectExpr("*", f"{v.FILE_PATH} AS path").drop("file_no")
    return vd.analyze(placed, v.trace(spark, d), call_sites=_passing_sites(spark, d), bodies=staged(bodies, "bodies"), hits=_hits(files))


@query(vc.VERDICTS, vc.WHOLE)
def verdicts(spark, d):
    """G11-G25, R0-R8, D1-D6 in one plan: finding, trace and code to a verdict."""
    return _verdicts(spark, d).select("cid", "checker", "sink_func", "origin", "guard_line", "index_guard", "classification", "confidence", F.array_join("reasons", " | ").alias("reasons"))


@query(vc.SUMMARY, vc.WHOLE | vc.CATEGORY)
def verdict_summary(spark, d):
    """Flagship: verdicts per category and class."""
    out = cat.with_category(_verdicts(spark, d).select("checker", "classification", "confidence"))
    return out.groupBy("category", "classification").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


@query("SELECT cid, checker, classification, confidence FROM k_final", vc.TREE)
def tree_verdicts(spark, d):
    """Files to verdicts: function spans, enclosing code, callers and rules over the source tree."""
    files = v.files(spark, d)
    facts = st.line_facts(files)
    funcs = st.functions(facts)
    placed = v.code(spark, d).selectExpr("cid", f"{v.FILE_NO} AS file_no", "checker", "function", "cid % 140 AS line").selectExpr("cid", f"{v.FILE_PATH} AS path", "checker", "function", "line")
    code = st.attach_code(placed, funcs, files)
    located = st.callers(placed.select(F.col("function").alias("callee")), st.call_sites(facts).where("NOT (is_start AND callee = fn_name)"))
    bodies = staged(st.function_bodies(funcs, files), "bodies")
    sites = located.join(unsized(bodies.select("path", F.col("start_line").alias("caller_start"), "body")), ["path", "caller_start"], "left").withColumn("body", t.txt(F.col("body")))
    found = code.select("cid", "path", "checker", "function", "line", "code", "code_start_line")
    out = vd.analyze(found, v.trace(spark, d), call_sites=staged(sites, "call-sites"), bodies=bodies, hits=_hits(files))
    return out.select("cid", "checker", "classification", "confidence")
