"""Category, weakness reference and comment templating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions import text as t
from assayer.functions.frames import fixed_table


def with_category(df: DataFrame, checker: str = "checker") -> DataFrame:
    """Add ``category``; the checker compares without case and blanks."""
    table = dim.category_table(df.sparkSession)
    key = F.upper(t.strip(F.col(checker)))
    return (
        df.withColumn("checker_key", key)
        .join(F.broadcast(table), "checker_key", "left")
        .withColumn("category", F.coalesce("category", F.lit(dim.UNCATEGORIZED)))
        .drop("checker_key")
    )


def with_weakness(df: DataFrame) -> DataFrame:
    """Add the CWE / CERT / OWASP / CVSS reference; the checker compares exactly."""
    return df.join(F.broadcast(dim.weakness_table(df.sparkSession)), "checker", "left")


def reference_line() -> Column:
    """One-line reference built from the columns of :func:`with_weakness`."""
    return F.when(
        F.col("cwe_id").isNotNull(),
        F.concat(
            F.lit("Reference: CWE-"), F.col("cwe_id").cast("string"), F.lit(" ("), F.col("cwe_name"),
            F.lit(") | CERT "), F.col("cert"), F.lit(" | OWASP "), F.col("owasp"), F.lit(" | "), F.col("cwe_url"),
        ),
    ).otherwise("")


def comment_with_reference(comment: Column) -> Column:
    """Append the reference once; nothing is added where the id already stands."""
    marker = F.concat(F.lit("CWE-"), F.col("cwe_id").cast("string"))
    return F.when(
        F.col("cwe_id").isNull() | (F.instr(t.txt(comment), marker) > 0), t.txt(comment)
    ).otherwise(F.concat(F.rtrim(t.txt(comment), F.lit(t.WHITESPACE)), F.lit("\n\n"), reference_line()))


# Fragments that make a line look like code
CODE_HINTS = ["if (", "sizeof", "strncpy", "snprintf", "free(", "return", "memcpy"]


def tagged_fix(fix: Column, short: bool = False) -> Column:
    """Fix text with the weakness id as a code comment, once; "no fix" and empty texts stay as they are.

    ``short`` gives the form for narrow cells: a text of over 400 characters is cut to its first code line (or the first
    220 characters of its first line), one of 300 and more has no id.
    """
    text = t.strip(fix)
    tag = F.when(
        F.col("cwe_id").isNotNull(), F.concat(F.lit(" // CWE-"), F.col("cwe_id").cast("string"))
    ).otherwise("")
    whole = F.when((tag != "") & (F.instr(text, tag) > 0), text)
    bare = F.lower(text).startswith("no fix") | (text == "")
    if short:
        lines = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: t.strip(x) != "")
        code = F.filter(lines, lambda x: F.exists(t.members(CODE_HINTS), lambda h: F.instr(x, h) > 0))
        cut = F.when(F.size(code) > 0, t.strip(F.get(code, F.lit(0)))).otherwise(F.substring(F.get(lines, F.lit(0)), 1, 220))
        whole = whole.when(F.length(text) > 400, t.strip(F.concat(cut, tag)))
        bare = bare | (F.length(text) >= 300)
    return whole.when(bare, text).otherwise(t.strip(F.concat(text, tag)))


def store_for_project(projects: DataFrame, streams: DataFrame) -> DataFrame:
    """Triage store per project: its own, else that of its first stream, else '<project>-TS'.

    ``projects(project, store)``, ``streams(project, stream_rank, store)``.
    """
    named = streams.where(t.strip(F.col("store")) != "")
    from_stream = named.groupBy("project").agg(F.min_by("store", "stream_rank").alias("stream_store"))
    return projects.join(from_stream, "project", "left").select(
        "project",
        t.first_text(F.col("store"), F.col("stream_store"), F.concat("project", F.lit("-TS"))).alias("store"),
    )


# Short comment templates: family, class, position, text. Users pass their own
# table to replace them; only the choice by hash is fixed.
DEFAULT_TEMPLATES = [
    ("buffer_overflow", "bug", 0, "{sink_func}() at line {line} of {function}() writes `{src_var}` into `{dest_var}` unchecked."),
    ("buffer_overflow", "bug", 1, "`{src_var}` ({origin}) reaches {sink_func}() at line {line}; nothing limits it to `{dest_var}`."),
    ("buffer_overflow", "false_positive", 0, "{checker} at line {line} of {function}() is bounded: {guard_reason}"),
    ("buffer_overflow", "false_positive", 1, "Line {line} of {function}() stays inside `{dest_var}`."),
    ("buffer_overflow", "needs_review", 0, "Check the sizes of `{dest_var}` and `{src_var}` at line {line}."),
    ("null_deref", "bug", 0, "`{var}` is used at line {line} of {function}() without a NULL check."),
    ("null_deref", "bug", 1, "`{var}` comes from {origin} and may be NULL at line {line}."),
    ("null_deref", "false_positive", 0, "`{var}` is checked at line {guard_line} before line {line}."),
    ("null_deref", "false_positive", 1, "The guard {guard_cond} protects `{var}` at line {line}."),
    ("resource_leak", "bug", 0, "`{resource}` is not released on {leak_paths} of {function}()."),
    ("resource_leak", "bug", 1, "The return at line {line} skips {release_func}() for line {alloc_line}."),
    ("resource_leak", "false_positive", 0, "{release_func}() releases `{resource}` at line {release_line}."),
    ("resource_leak", "false_positive", 1, "{function}() releases what it acquires."),
    ("integer_overflow", "bug", 0, "The {operation} of `{var}` and `{operand}` at line {line} has no range check."),
    ("integer_overflow", "bug", 1, "`{var}` ({origin}) may overflow in the {operation} at line {line}."),
    ("integer_overflow", "false_positive", 0, "`{var}` is limited by {guard_desc} before line {line}."),
    ("integer_overflow", "false_positive", 1, "{guard_desc} keeps line {line} in range."),
]


def template_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, ["family", "class_key", "template_no", "template"], DEFAULT_TEMPLATES)


def with_template_comment(df: DataFrame, placeholders: list[str], templates: DataFrame | None = None) -> DataFrame:
    """Choose a template by md5 of the cid modulo the template count and fill it.

    The 128-bit modulus is exact in two steps: the high half is reduced before
    the low half is added, so nothing exceeds BIGINT.
    """
    table = templates if templates is not None else template_table(df.sparkSession)
    counted = table.groupBy("family", "class_key").agg(
        F.array_sort(F.collect_list(F.struct("template_no", "template"))).alias("__templates")
    )
    n = F.size("__templates").cast("bigint")
    digest = F.md5(F.col("cid").cast("string").cast("binary"))
    words = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]
    shift = F.pmod(F.lit(4294967296).cast("bigint"), n)
    rest = F.pmod(words[0], n)
    for part in words[1:]:
        rest = F.pmod(rest * shift + part, n)
    filled = F.coalesce(F.get("__templates", rest.cast("int")).getField("template"), F.lit("Manual review required."))
    for name in placeholders:
        filled = F.replace(filled, F.lit("{" + name + "}"), t.txt(F.col(name)))
    filled = F.regexp_replace(filled, r"\{[A-Za-z_]+\}", "")
    return (
        df.join(counted, ["family", "class_key"], "left").withColumn("comment", filled).drop("__templates")
    )
