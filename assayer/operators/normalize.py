"""Row-level normalisation and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions import text as t

EVENT_STEP = ("step", "eventNumber", "stepNumber")
EVENT_TAG = ("type", "tag", "eventTag", "eventType")
EVENT_TEXT = ("description", "eventDescription", "covLStrEventDescription")
EVENT_FILE = ("file", "filePathname", "filePath")
EVENT_LINE = ("line", "lineNumber", "eventLineNumber", "strippedLineNumber")
EVENT_MAIN = ("main", "isMain")
EVENT_FIELDS = tuple(dict.fromkeys(EVENT_STEP + EVENT_TAG + EVENT_TEXT + EVENT_FILE + EVENT_LINE + EVENT_MAIN))


def normalized_event(get, default_file: Column | None = None) -> list[Column]:
    """Canonical event columns; ``get(name)`` returns the raw column or a NULL."""
    files = [get(n) for n in EVENT_FILE] + ([default_file] if default_file is not None else [])
    tag = t.first_text(*[get(n) for n in EVENT_TAG])
    return [
        t.first_nonzero(*[get(n) for n in EVENT_STEP]).alias("step"),
        tag.alias("type"),
        tag.alias("tag"),
        t.first_text(*[get(n) for n in EVENT_TEXT]).alias("description"),
        t.first_text(*files).alias("file"),
        t.first_nonzero(*[get(n) for n in EVENT_LINE]).alias("line"),
        t.is_true(F.coalesce(get("main"), get("isMain"))).alias("main"),
    ]


def normalize_events(raw: DataFrame, keep: list[str], default_file: str | None = None) -> DataFrame:
    """Rename event aliases to the canonical columns; first non-blank alias wins."""
    present = set(raw.columns)

    def get(name: str) -> Column:
        return F.col(name).cast("string") if name in present else F.lit(None).cast("string")

    fallback = F.col(default_file) if default_file else None
    return raw.select(*keep, *normalized_event(get, fallback))


def clean_function(col: Column) -> Column:
    """Drop a trailing argument list and status words."""
    bare = F.regexp_replace(t.strip(col), r"\(.*\)\s*$", "")
    return F.when(F.lower(bare).isin(*dim.NOT_A_FUNCTION), "").otherwise(bare)


def language_filter(findings: DataFrame, language: str) -> DataFrame:
    """C mode leaves out C++ files; any other mode keeps everything."""
    if language.lower() != "c":
        return findings
    return findings.where(~t.extension(F.col("file")).isin(*dim.CPP_EXTENSIONS))


def skipped_extensions(findings: DataFrame) -> DataFrame:
    ext = t.extension(F.col("file"))
    return (
        findings.where(ext.isin(*dim.CPP_EXTENSIONS))
        .groupBy(ext.alias("extension"))
        .agg(F.count(F.lit(1)).alias("skipped"))
    )


SELECTION_MODES = ("all", "accepted", "decided")


def select_findings(findings: DataFrame, mode: str = "accepted") -> DataFrame:
    """Findings to push: all, accepted or overridden, or anything decided."""
    mode = (mode or "accepted").strip().lower()
    if mode not in SELECTION_MODES:
        raise ValueError(f"unknown push mode: {mode!r}")
    usable = findings.where(t.coerce_cid(F.col("cid")).isNotNull())
    if mode == "accepted":
        return usable.where(F.coalesce("accepted", F.lit(False)) | F.coalesce("overridden", F.lit(False)))
    if mode == "decided":
        cls = F.lower(t.strip(F.col("classification")))
        return usable.where((cls != "") & (cls != "needs review"))
    return usable


def filter_results(results: DataFrame, classification: str = "All", category: str = "All") -> DataFrame:
    """Review filter; 'Accepted' tests the flag, other classes leave accepted rows out."""
    accepted = F.coalesce("accepted", F.lit(False))
    if classification == "Accepted":
        results = results.where(accepted)
    elif classification != "All":
        results = results.where(~accepted & (F.col("classification") == classification))
    if category != "All":
        results = results.where(F.col("category") == category)
    return results


def first_findings(findings: DataFrame, n: int) -> DataFrame:
    """The first n findings in report order."""
    return findings.orderBy("ordinal").limit(n)


def not_yet_done(findings: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: findings that have no decision yet."""
    return findings.join(done.select("cid"), "cid", "left_anti")


def store_class(col: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in dim.STORE_CLASS.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, col), col)


def pushed_class(classification: Column, base: Column) -> Column:
    """Blank means 'Needs review'; 'Accepted' stands for the class beneath it."""
    cls = t.strip(classification)
    cls = F.when(cls == "", "Needs review").otherwise(cls)
    return F.when(F.lower(cls) == "accepted", t.strip(t.first_text(base, F.lit("Bug")))).otherwise(cls)


def stamped(comment: Column, run_date: str, reviewer: str = "", tool: str = "Assayer") -> Column:
    """Provenance marker, added once. The date is a parameter, so a rerun gives the same text."""
    who = (reviewer or "").strip()
    marker = "[" + " — ".join([tool] + ([who] if who else []) + [run_date]) + "]"
    text = t.strip(comment)
    return (
        F.when(text == "", F.lit(marker))
        .when(F.instr(text, f"[{tool}") > 0, text)
        .otherwise(F.concat(text, F.lit("\n" + marker)))
    )


def truncated(comment: Column, max_length: int | None) -> Column:
    if not max_length:
        return comment
    cut = F.concat(F.rtrim(F.substring(comment, 1, max_length - 1), F.lit(t.WHITESPACE)), F.lit("…"))
    return F.when(F.length(comment) > max_length, cut).otherwise(comment)


def review_reason() -> Column:
    """Why a row needs review, first cause first. Columns: classification,
    line_missing, errored, line_is_various, has_code."""
    return F.when(
        F.col("classification") == "Needs review",
        F.when(F.col("line_missing"), "excel_line_missing")
        .when(F.col("errored"), "exception")
        .when(F.col("line_is_various"), "line_various")
        .when(~F.col("has_code"), "no_code")
        .otherwise("low_confidence_or_unhandled"),
    ).otherwise("")


def line_route(tabular: bool = True) -> Column:
    """'anchored', 'whole_function' or 'manual' for a finding of a tabular export.

    Columns: line, line_is_various, checker, function, has_code.
    """
    if not tabular:
        return F.lit("anchored")
    missing = (F.coalesce(F.col("line"), F.lit(0)) <= 0) | F.coalesce(F.col("line_is_various"), F.lit(False))
    agnostic = (
        F.upper(F.col("checker")).isin(*dim.LINE_AGNOSTIC) & F.col("has_code") & (t.txt(F.col("function")) != "")
    )
    return F.when(~missing, "anchored").when(agnostic, "whole_function").otherwise("manual")


def capped_confidence(confidence: Column, fallback_code: Column, various: Column) -> Column:
    capped = F.when(fallback_code, F.least(confidence, F.lit(0.60))).otherwise(confidence)
    return F.when(various, F.least(capped, F.lit(0.70))).otherwise(capped)


def confidence_band(confidence: Column) -> Column:
    """Three bands of the review table."""
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")


def confidence_sentence(confidence: Column) -> Column:
    """The sentence in front of the reasons."""
    return (
        F.when(confidence >= 0.80, "High confidence.")
        .when(confidence >= 0.55, "Moderate confidence — review recommended.")
        .otherwise("Low confidence — manual review required.")
    )


def percent_label(confidence: Column) -> Column:
    return F.concat(F.floor(confidence * 100).cast("string"), F.lit("%"))


def finding_text(mode: str = "summary") -> Column:
    """Finding rendered as text: summary, full, meta, comment or fix.

    Columns: cid, checker, classification, accepted, file, line, line_is_various,
    function, severity, confidence, comment, fix, source_code.
    """
    c = lambda n: t.txt(F.col(n))
    line = F.when(F.coalesce("line_is_various", F.lit(False)), "Various").otherwise(c("line"))
    cls = F.when(F.coalesce("accepted", F.lit(False)), "Accepted").otherwise(
        t.first_text(F.col("classification"), F.lit("Needs review"))
    )
    pct = percent_label(F.coalesce(F.col("confidence"), F.lit(0.0)))
    if mode in ("comment", "fix"):
        return t.strip(F.col(mode))
    if mode == "meta":
        pairs = [
            ("ID:             ", c("cid")), ("Checker:        ", c("checker")), ("File:           ", c("file")),
            ("Line:           ", line), ("Function:       ", c("function")), ("Severity:       ", c("severity")),
            ("Classification: ", cls), ("Confidence:     ", pct),
        ]
        return t.strip(F.concat_ws("\n", *[F.concat(F.lit(k), v) for k, v in pairs]))
    parts = [
        F.concat(F.lit("ID: "), c("cid"), F.lit("  |  Checker: "), c("checker"), F.lit("  |  Classification: "), cls),
        F.concat(F.lit("File: "), c("file"), F.lit("  :  line "), line),
        F.concat(F.lit("Function: "), c("function"), F.lit("  |  Severity: "), c("severity"), F.lit("  |  Confidence: "), pct),
        F.when(c("comment") != "", F.concat(F.lit("Comment: "), c("comment"))),
    ]
    if mode == "full":
        parts += [
            F.when(c("fix") != "", F.concat(F.lit("Proposed Fix:\n"), c("fix"))),
            F.when(c("source_code") != "", F.concat(F.lit("Source:\n"), F.rtrim(c("source_code"), F.lit("\n")))),
        ]
    return t.strip(F.concat_ws("\n", *parts))
