"""Evidence rules (R0-R4): rules are rows, compiled into one projection.

A rule fires on patterns of the code and on facts of the finding. All rules of a
finding are evaluated in one ``select`` as an array of structs, rule set first, so
no row is exploded before matching and no regex runs for another checker's rules.
Users add rows with :func:`register_rule` or whole rule sets with
:func:`register_checker`; nothing is a UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import text as t
from assayer.functions.frames import fixed_table

GENERIC = "GENERIC"
# rule sets that also take the shared rules
SHARED_SETS = (
    "BUFFER_SIZE", "OVERRUN", "INTEGER_OVERFLOW", "STRING_NULL", "REVERSE_INULL", "FORWARD_NULL", "RESOURCE_LEAK", "DEADCODE", GENERIC,
)
# checker -> rule set; the comparison is exact and any other checker is generic
DISPATCH = {
    "BUFFER_SIZE": "BUFFER_SIZE",
    "OVERRUN": "OVERRUN",
    "OVERRUN_STATIC": "OVERRUN",
    "OVERRUN_DYNAMIC": "OVERRUN",
    "INTEGER_OVERFLOW": "INTEGER_OVERFLOW",
    "STRING_NULL": "STRING_NULL",
    "REVERSE_INULL": "REVERSE_INULL",
    "FORWARD_NULL": "FORWARD_NULL",
    "ARRAY_VS_SINGLETON": "ARRAY_VS_SINGLETON",
    "NEGATIVE_RETURNS": "NEGATIVE_RETURNS",
    "RESOURCE_LEAK": "RESOURCE_LEAK",
    "DEADCODE": "DEADCODE",
    "UNUSED_VALUE": "UNUSED_VALUE",
    "UNINIT": "UNINIT",
    "DIVIDE_BY_ZERO": "DIVIDE_BY_ZERO",
    "USE_AFTER_FREE": "USE_AFTER_FREE",
    "SIZEOF_MISMATCH": "SIZEOF_MISMATCH",
    "CONSTANT_EXPRESSION_RESULT": "CONSTANT_EXPRESSION_RESULT",
    "NO_BREAK": "NO_BREAK",
    "SHIFT_OVERFLOW": "SHIFT_OVERFLOW",
    "CHECKED_RETURN": "CHECKED_RETURN",
    "CHECKED_QRS": "CHECKED_RETURN",
}

# Facts a rule may name in ``needs``; a missing column gets this default. A number of
# callers that is not known is not zero.
FACTS = {
    "defect_confirmed": "false", "taint_confirmed": "false", "guard_on_path": "false", "guard_takes_true": "false",
    "size_equal_in_trace": "false", "size_equal_in_code": "false", "trace_validates": "false", "src_bounded": "false",
    "memset_before": "false", "null_guard_covers": "false", "null_guard_before": "false", "null_guard_inside": "false",
    "guarded_by_flag": "false", "caller_exempt": "false", "guard_covers": "false",
    "origin": "''", "sink_func": "''", "release_func": "''", "corroborated_by": "''", "null_var": "''", "var": "''",
    "guard_line": "0", "null_guard_line": "0", "dest_size": "0", "copy_size": "0", "n_callers": "-1", "n_lines": "0",
}


@dataclass(frozen=True)
class Rule:
    """One row: every ``all`` pattern, some ``any`` pattern (or ``or_needs``), no ``none`` pattern, and ``needs``."""

    rule_set: str
    label: str
    polarity: str
    weight_c: int
    text: str
    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    needs: str = ""
    or_needs: str = ""
    absent: str = ""  # second pass: no earlier evidence of 'fp', or of 'any' polarity


SHARED = "SHARED"
BUG, FP, NEUTRAL = "bug", "fp", "neutral"

# Patterns shared by several rules
EARLY_RETURN = r"\bif\s*\(.*\)\s*\{?\s*return\b"
RAII = r"\bstd::unique_ptr|\bstd::shared_ptr|\bauto_ptr|\bQScopedPointer|\bg_auto"
TERMINATED = r"\[\s*(?:sizeof.*-\s*1|\w+\s*-\s*1)\s*\]\s*=\s*[\"']\\0[\"']"
FALLTHROUGH = r"(?i)//\s*fallthrough|/\*\s*fall.?through|FALLTHRU|FALLTHROUGH|\[\[fallthrough\]\]"
BOUNDED_COPY = r"(?i)\bstrncpy\b|\bstrncat\b|\bsnprintf\b|\bstrlcpy\b"
DISABLED = r"#if 0|#ifdef NEVER"


def _has_word(column: str, words) -> str:
    return "(" + " OR ".join(f"instr({column}, '{w}') > 0" for w in words) + ")"


from assayer import dimensions as dim  # noqa: E402

UNTRUSTED, TRUSTED = _has_word("origin", dim.UNTRUSTED_WORDS), _has_word("origin", dim.TRUSTED_WORDS)

# Labels, polarities, weights (hundredths) and triggers
RULES: list[Rule] = [
    Rule(SHARED, "trace_confirmed_defect", BUG, 30, "the trace reports a defect on this path", needs="defect_confirmed"),
    Rule(SHARED, "trace_confirmed_taint", BUG, 25, "the trace reports tainted data at the sink", needs="taint_confirmed"),
    Rule(SHARED, "guard_confirmed_on_path", FP, 35, "the trace passed a guard on its true branch", needs="guard_on_path AND guard_takes_true"),
    Rule(SHARED, "guard_present_uncertain", NEUTRAL, 0, "the trace passed a guard of unknown outcome", needs="guard_on_path AND NOT guard_takes_true"),
    Rule(SHARED, "taint_from_untrusted_source", BUG, 80, "the value comes from {origin}", needs=UNTRUSTED),
    Rule(SHARED, "taint_from_safe_source", FP, 60, "the value comes from {origin}", needs=f"{TRUSTED} AND NOT {UNTRUSTED}"),
    Rule(SHARED, "taint_from_allocation", BUG, 65, "the allocation may have returned NULL", needs=f"instr(origin, 'alloc') > 0 AND NOT {TRUSTED} AND NOT {UNTRUSTED}"),
    Rule(SHARED, "guard_dominates_all_paths", FP, 90, "the guard at line {guard_line} covers every path", needs="guard_line > 0 AND guard_covers"),
    Rule(SHARED, "guard_partial_coverage", NEUTRAL, 0, "the guard at line {guard_line} may be bypassed", needs="guard_line > 0 AND NOT guard_covers"),
    Rule(SHARED, "guard_present", FP, 55, "a guard stands at line {guard_line}", needs="guard_line > 0 AND guard_covers IS NULL"),
    Rule(SHARED, "unsafe_sink_function", BUG, 85, "{sink_func}() never checks its destination",
         needs="sink_func IN ('strcpy','strcat','wcscpy','wcscat','gets','sprintf','vsprintf')"),
    Rule(SHARED, "bounded_sink_function", FP, 85, "{sink_func}() takes a size",
         needs="sink_func IN ('strncpy','strncat','snprintf','strlcpy','strlcat','memcpy_s','strcpy_s')"),
    Rule(SHARED, "memcpy_sink", BUG, 60, "memcpy() relies on the caller's size", needs="sink_func = 'memcpy'"),
    Rule(SHARED, "release_function_found", FP, 85, "{release_func}() is the matching release", needs="release_func <> ''"),
    Rule(SHARED, "early_return_without_release", BUG, 80, "an early return shows no release", all=(EARLY_RETURN,), needs="release_func = ''"),
    Rule(SHARED, "raii_smart_pointer", FP, 90, "a smart pointer owns the resource", all=(RAII,)),
    Rule(SHARED, "explicit_null_termination", FP, 85, "the copy is terminated explicitly", all=(TERMINATED,)),
    Rule(SHARED, "upcast_to_wider_type", FP, 80, "the operand is widened before the operation", all=(r"\(\s*(long long|int64_t|uint64_t|size_t)\s*\)",)),
    Rule(SHARED, "explicit_range_guard", FP, 90, "the operand is compared with the type's limit",
         all=(r"\bif\s*\(.*>\s*(INT_MAX|UINT_MAX|0x7[Ff]+|32767|65535)\)",)),
    Rule(SHARED, "preprocessor_disabled_block", FP, 95, "the preprocessor leaves the code out", all=(DISABLED,)),
    Rule(SHARED, "documented_fallthrough", FP, 90, "the fall-through is marked as wanted", all=(FALLTHROUGH,)),
    Rule(SHARED, "insufficient_context", NEUTRAL, 0, "only {n_lines} lines of code are known", needs="n_lines < 5"),
    Rule(SHARED, "semgrep_confirms", BUG, 45, "rule {corroborated_by} reports the same place", needs="corroborated_by <> ''"),
    # BUFFER_SIZE
    Rule("BUFFER_SIZE", "strncpy_no_null_terminator", BUG, 85, "{sink_func}() may fill the whole destination",
         needs="sink_func IN ('strncpy','strncat') AND (size_equal_in_trace OR size_equal_in_code OR (dest_size > 0 AND copy_size <> 0 AND copy_size >= dest_size))"),
    Rule("BUFFER_SIZE", "safe_bounded_api_with_sizeof", FP, 70, "the bounded call keeps room for the terminator",
         all=(BOUNDED_COPY,), any=(r"(?i)sizeof\s*\([^)]*\)\s*-\s*1",), or_needs="guard_line > 0"),
    Rule("BUFFER_SIZE", "explicit_null_termination_after_copy", FP, 75, "the buffer is terminated after the copy",
         all=("(?i)" + TERMINATED, r"(?i)\bstrncpy\b|\bmemcpy\b")),
    Rule("BUFFER_SIZE", "unsafe_sink_but_bounded_source", FP, 55, "the source of {sink_func}() is limited by sizeof",
         needs="sink_func IN ('strcpy','strcat','wcscpy','wcscat','gets') AND src_bounded"),
    Rule("BUFFER_SIZE", "always_unsafe_sink", BUG, 75, "{sink_func}() has no visible limit",
         needs="sink_func IN ('strcpy','strcat','wcscpy','wcscat','gets') AND NOT src_bounded"),
    Rule("BUFFER_SIZE", "sprintf_unbounded", BUG, 60, "sprintf() has no limit", needs="sink_func = 'sprintf'"),
    Rule("BUFFER_SIZE", "memset_before_memcpy_cfg", FP, 65, "the destination is zeroed before memcpy()", needs="sink_func = 'memcpy' AND memset_before"),
    Rule("BUFFER_SIZE", "memcpy_without_size_guard", BUG, 55, "memcpy() has neither guard nor sizeof",
         none=(r"(?i)sizeof\s*\(",), needs="sink_func = 'memcpy' AND guard_line = 0"),
    Rule("BUFFER_SIZE", "memcpy_with_size_guard", FP, 50, "the size of memcpy() looks limited",
         any=(r"(?i)sizeof\s*\(",), or_needs="guard_line > 0", needs="sink_func = 'memcpy'"),
    # INTEGER_OVERFLOW, STRING_NULL
    Rule("INTEGER_OVERFLOW", "unsigned_wrap_defined_behavior", FP, 60, "unsigned arithmetic wraps by definition",
         all=(r"(?i)\buint(8|16|32|64)_t\b|\bunsigned\b",), none=(r"(?i)\b(signed|int32_t|int64_t)\b",)),
    Rule("STRING_NULL", "copy_without_null_termination", BUG, 65, "{sink_func}() is not followed by a terminator",
         none=(r"(?i)[\"']\\0[\"']",), needs="sink_func IN ('memcpy','strncpy')"),
    # null checks
    Rule("REVERSE_INULL", "null_guard_dominates_dereference", FP, 75, "the check at line {null_guard_line} covers the use",
         needs="null_guard_line > 0 AND null_guard_covers AND null_guard_before"),
    Rule("REVERSE_INULL", "trace_confirmed_null", BUG, 85, "the trace shows `{var}` is NULL", needs="null_var <> '' AND null_var = var"),
    Rule("FORWARD_NULL", "null_guard_covers_all_paths", FP, 75, "the check at line {null_guard_line} covers the use",
         needs="null_guard_line > 0 AND null_guard_covers"),
    Rule("FORWARD_NULL", "cfg_call_inside_guard_block", FP, 80, "the use stands inside the checked block", needs="null_guard_line > 0 AND null_guard_inside"),
    Rule("FORWARD_NULL", "guarded_call_success_flag", FP, 75, "the use is reached only after a success flag", needs="guarded_by_flag"),
    Rule("FORWARD_NULL", "trace_confirmed_null_deref", BUG, 90, "the trace shows `{var}` is NULL", needs="null_var <> '' AND null_var = var"),
    # RESOURCE_LEAK
    *[
        Rule("RESOURCE_LEAK", f"release_function_{fn}", FP, 75, f"{fn}() is called", all=(rf"\b{fn}\s*\(",))
        for fn in ("fclose", "close", "free", "delete", "CloseHandle", "pclose", "regfree")
    ],
    Rule("RESOURCE_LEAK", "raii_smart_pointer", FP, 80, "a smart pointer owns the resource", all=("(?i)" + RAII,)),
    Rule("RESOURCE_LEAK", "goto_cleanup_pattern", FP, 65, "all paths jump to one exit", all=(r"(?i)\bgoto\s+(cleanup|done|error|exit)",)),
    Rule("RESOURCE_LEAK", "early_return_without_release", BUG, 70, "an early return shows no release",
         all=(r"(?i)if\s*\(.*\)\s*\{?\s*return",), none=(r"\b(fclose|close|free|delete|CloseHandle|pclose|regfree)\s*\(",), needs="release_func = ''"),
    # DEADCODE
    Rule("DEADCODE", "preprocessor_disabled_block", FP, 85, "the preprocessor leaves the code out", all=(DISABLED,)),
    Rule("DEADCODE", "marked_todo_fixme", FP, 60, "the code is marked as unfinished", all=(r"\bTODO\b|\bFIXME\b|\bDEAD\b|\bXXX\b",)),
    Rule("DEADCODE", "assert_unreachable", FP, 75, "the path ends in an assertion", all=(r"\bassert\s*\(\s*0\s*\)|\bassert\s*\(\s*false\s*\)",)),
    Rule("DEADCODE", "function_has_no_callers", FP, 55, "nobody calls the function", needs="n_callers = 0 AND NOT caller_exempt"),
    Rule("DEADCODE", "trace_confirmed_unreachable", BUG, 70, "the trace shows the block cannot be reached", needs="defect_confirmed"),
    # rule sets without the shared rules
    Rule("ARRAY_VS_SINGLETON", "zero_length_guard", FP, 80, "a zero length is handled",
         all=(r"(?i)numocts\s*==\s*0|len\s*==\s*0|size\s*==\s*0|count\s*==\s*0",)),
    Rule("ARRAY_VS_SINGLETON", "sizeof_deref_pattern", FP, 75, "sizeof(*p) is the size of the target", all=(r"(?i)\bsizeof\s*\(\s*\*",)),
    Rule("ARRAY_VS_SINGLETON", "singleton_passed_as_array", BUG, 65, "one element is passed where many are expected", absent="fp"),
    Rule("NEGATIVE_RETURNS", "negative_return_checked", FP, 85, "the result is compared before use",
         any=(r"(?i)if\s*\(.*<\s*0\s*\)", r"(?i)if\s*\(.*==\s*EOF\s*\)")),
    Rule("NEGATIVE_RETURNS", "trace_shows_validation", FP, 80, "the trace shows a validation", needs="trace_validates"),
    Rule("NEGATIVE_RETURNS", "negative_used_as_size", BUG, 75, "the result is used as size or index", all=(r"(?i)\bmalloc\s*\(|\bmemcpy\s*\(|\[\s*\w+\s*\]",)),
    Rule("NEGATIVE_RETURNS", "no_visible_validation", BUG, 55, "no validation is visible", absent="any"),
    Rule("UNUSED_VALUE", "debug_logging_context", FP, 70, "the value serves logging", all=(r"\b(printf|log|debug|assert|cout|cerr|trace|LOG_|DBG_)\b",)),
    Rule("UNUSED_VALUE", "explicit_void_cast", FP, 75, "the value is discarded explicitly", all=(r"\b(void)\s*\w+|\(void\)",)),
    Rule("UNUSED_VALUE", "assigned_before_return", NEUTRAL, 0, "the value is set before a return", all=(r"(?i)\breturn\b", r"\b(\w+)\s*=\s*")),
    Rule("UNUSED_VALUE", "value_computed_not_used", BUG, 60, "the value is never read", absent="any"),
    Rule("UNINIT", "zero_initialization_present", FP, 85, "the variable is zeroed first",
         any=(r"(?i)\bmemset\s*\(|\bcalloc\s*\(|\b=\s*\{0\}", r"(?i)struct\s+\w+\s+\w+\s*=\s*\{0\}")),
    Rule("UNINIT", "aggregate_initializer", FP, 80, "an initializer list sets all fields", all=(r"(?i)\b=\s*\{[^}]*\}",)),
    Rule("UNINIT", "read_before_assignment", BUG, 75, "the variable is read before it is set", absent="fp"),
    Rule("DIVIDE_BY_ZERO", "nonzero_guard_present", FP, 85, "the divisor is checked",
         all=(r"(?i)if\s*\(.*!=\s*0\s*\)|if\s*\(.*>\s*0\s*\)|if\s*\(.*>=\s*1\s*\)",)),
    Rule("DIVIDE_BY_ZERO", "trace_shows_nonzero_check", FP, 80, "the trace shows a check of the divisor", needs="trace_validates"),
    Rule("DIVIDE_BY_ZERO", "division_without_guard", BUG, 75, "no check of the divisor is visible", absent="fp"),
    Rule("USE_AFTER_FREE", "null_after_free_with_check", FP, 80, "the pointer is cleared and checked again",
         all=(r"(?i)\bfree\s*\(.*\)\s*;", r"(?i)\b\w+\s*=\s*NULL\s*;", r"(?i)\bif\s*\(.*!=\s*NULL")),
    Rule("USE_AFTER_FREE", "possible_use_after_free", BUG, 70, "the pointer may be used after free()", absent="fp"),
    Rule("SIZEOF_MISMATCH", "sizeof_deref_safe", FP, 80, "sizeof(*p) is the size of the target", all=(r"(?i)sizeof\s*\(\s*\*",)),
    Rule("SIZEOF_MISMATCH", "sizeof_element_safe", FP, 75, "sizeof(a[0]) is the size of an element", all=(r"(?i)sizeof\s*\(\s*\w+\s*\[0\]\s*\)",)),
    Rule("SIZEOF_MISMATCH", "sizeof_wrong_type", BUG, 70, "sizeof may measure the wrong type", absent="fp"),
    Rule("CONSTANT_EXPRESSION_RESULT", "assert_or_static_assert", FP, 80, "the constant is asserted", all=(r"\bassert\s*\(|\bstatic_assert\s*\(",)),
    Rule("CONSTANT_EXPRESSION_RESULT", "preprocessor_conditional", FP, 65, "the constant selects a configuration", all=(r"#if",)),
    Rule("CONSTANT_EXPRESSION_RESULT", "suspicious_constant_expression", BUG, 55, "the result never changes", absent="fp"),
    Rule("SHIFT_OVERFLOW", "shift_amount_validated", FP, 80, "the shift amount is checked", all=(r"(?i)if\s*\(.*<\s*\d+|if\s*\(.*>=\s*\d+",)),
    Rule("SHIFT_OVERFLOW", "shift_without_guard", BUG, 70, "the shift amount is not checked", absent="fp"),
    Rule("NO_BREAK", "documented_fallthrough", FP, 90, "the fall-through is marked as wanted", all=(FALLTHROUGH,)),
    Rule("NO_BREAK", "missing_break_statement", BUG, 65, "a case runs into the next", absent="fp"),
]


class RuleBook:
    """Rules and checkers in force; a copy may be extended without touching the defaults."""

    def __init__(self, rules: list[Rule] | None = None, dispatch: dict[str, str] | None = None):
        self.rules = list(RULES if rules is None else rules)
        self.dispatch = dict(DISPATCH if dispatch is None else dispatch)
        self.columns: dict[str, Callable[..., Column]] = {}

    def register_rule(self, rule: Rule) -> None:
        """Add one row."""
        self.rules.append(rule)

    def register_checker(self, name: str, fn: Callable[[], Column] | None = None) -> None:
        """Give a checker its own rule set; ``fn`` may return a class Column that,
        where it is not NULL, replaces the scored class."""
        self.dispatch[name] = name
        if fn is not None:
            self.columns[name] = fn


DEFAULT_BOOK = RuleBook()


def register_rule(rule: Rule) -> None:
    DEFAULT_BOOK.register_rule(rule)


def register_checker(name: str, fn: Callable[[], Column] | None = None) -> None:
    DEFAULT_BOOK.register_checker(name, fn)


def rules_table(spark: SparkSession, book: RuleBook = DEFAULT_BOOK) -> DataFrame:
    """The rules as a DataFrame."""
    sep = "  &&  "
    rows = [
        (i, r.rule_set, r.label, r.polarity, r.weight_c, sep.join(r.all), sep.join(r.any), sep.join(r.none), r.needs, r.or_needs, r.absent, r.text)
        for i, r in enumerate(book.rules)
    ]
    names = ["rule_no", "rule_set", "label", "polarity", "weight_c", "regex_all", "regex_any", "regex_none", "needs", "or_needs", "absent", "description"]
    return fixed_table(spark, names, rows)


def rule_set(checker: Column, has_code: Column, book: RuleBook = DEFAULT_BOOK) -> Column:
    """Rule set of a finding; without code or for an unknown checker the generic one (R2)."""
    table = F.create_map(*[F.lit(x) for p in book.dispatch.items() for x in p])
    return F.when(has_code, F.coalesce(F.try_element_at(table, checker), F.lit(GENERIC))).otherwise(GENERIC)


def with_facts(df: DataFrame) -> DataFrame:
    """Add every fact a rule may ask for; facts that are not known get their default.

    The generic rule set judges from trace and code text only, so facts derived
    from the code structure are blank for it.
    """
    structural = ("origin", "sink_func", "release_func", "corroborated_by", "guard_line", "guard_covers")
    have = set(df.columns)
    cols = {}
    for name, default in FACTS.items():
        if name == "n_lines":
            continue
        value = F.coalesce(F.col(name), F.expr(default)) if name in have and name != "guard_covers" else (F.col(name) if name in have else F.expr(default))
        if name in structural and "rule_set" in have:
            value = F.when(F.col("rule_set") == GENERIC, F.expr(default)).otherwise(value)
        cols[name] = value
    from assayer.operators.source_tree import lines_of

    cols["n_lines"] = F.size(lines_of(F.col("code")))
    return df.withColumns(cols)


def _described(text: str) -> Column:
    parts = [F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", text) if p]
    return F.concat(*parts)


def condition(rule: Rule) -> Column:
    code = F.col("code")
    tests = [F.col("rule_set").isin(*SHARED_SETS) if rule.rule_set == SHARED else F.col("rule_set") == rule.rule_set]
    if rule.needs:
        tests.append(F.expr(rule.needs))
    tests += [code.rlike(p) for p in rule.all]
    either = [code.rlike(p) for p in rule.any] + ([F.expr(rule.or_needs)] if rule.or_needs else [])
    if either:
        any_of = either[0]
        for e in either[1:]:
            any_of = any_of | e
        tests.append(any_of)
    tests += [~code.rlike(p) for p in rule.none]
    out = tests[0]
    for x in tests[1:]:
        out = out & x
    return out


def _fired(rules: list[tuple[int, Rule]]) -> Column:
    made = [
        F.when(
            condition(r),
            F.struct(
                F.lit(i).alias("seq"), F.lit(r.label).alias("label"), F.lit(r.polarity).alias("polarity"),
                F.lit(r.weight_c).alias("weight_c"), _described(r.text).alias("description"),
            ),
        )
        for i, r in rules
    ]
    return F.filter(F.array(*made), lambda e: e.isNotNull())


def evidence(df: DataFrame, book: RuleBook = DEFAULT_BOOK) -> DataFrame:
    """Add ``evidence``: array of (seq, label, polarity, weight_c, description).

    Default rules ("nothing spoke for a false positive") run in a second pass over
    the array of the first. Needs code, rule_set and the facts of :func:`with_facts`.
    """
    numbered = list(enumerate(book.rules))
    first = [(i, r) for i, r in numbered if not r.absent]
    second = [(i, r) for i, r in numbered if r.absent]
    df = df.withColumn("__first", _fired(first))
    if not second:
        return df.withColumnRenamed("__first", "evidence")
    no_fp = ~F.exists("__first", lambda e: e["polarity"] == FP)
    nothing = ~F.exists("__first", lambda e: e["polarity"].isin(FP, BUG))
    made = [
        F.when(
            condition(r) & (no_fp if r.absent == "fp" else nothing),
            F.struct(
                F.lit(i).alias("seq"), F.lit(r.label).alias("label"), F.lit(r.polarity).alias("polarity"),
                F.lit(r.weight_c).alias("weight_c"), _described(r.text).alias("description"),
            ),
        )
        for i, r in second
    ]
    late = F.filter(F.array(*made), lambda e: e.isNotNull())
    return df.withColumn("evidence", F.concat("__first", late)).drop("__first")


def evidence_rows(df: DataFrame) -> DataFrame:
    """Evidence as a long table: cid, seq, label, polarity, weight_c, description.

    Exploding an expression instead of the column keeps the optimizer from adding a
    size filter below the projection, which would evaluate every rule twice.
    """
    return df.select("cid", F.explode(F.array_compact("evidence")).alias("e")).select("cid", "e.*")


def fallback_code(df: DataFrame, snippets: DataFrame) -> DataFrame:
    """Code of callees and callers where a finding has none (R3): adds used_fallback.

    ``snippets(cid, rank, text)``; only findings without code are looked up.
    """
    bare = df.where(F.col("code") == "").select("cid")
    joined = (
        snippets.where(t.strip(F.col("text")) != "")
        .join(bare, "cid", "left_semi")
        .groupBy("cid")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("__fb"))
    )
    used = (F.col("code") == "") & F.col("__fb").isNotNull()
    return (
        df.join(joined, "cid", "left")
        .withColumn("used_fallback", used)
        .withColumn("code", F.when(used, F.col("__fb")).otherwise(F.col("code")))
        .drop("__fb")
    )
