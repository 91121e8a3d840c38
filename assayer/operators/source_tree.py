"""Source-tree operators (G1-G6, G8-G10): lines, functions, calls, path matching.

Files are at most 500 kB (the scan leaves larger ones out), so a window per path
is bounded. One line-level pass per path gives depth, function starts and the
enclosing function of every line; call sites inherit it, so no range join is
needed to find a caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions import text as t
from assayer.functions.frames import dealt, positions, unsized

# Line endings, calls, definition lines
EOL = "\r\n|\r|\n"
CALL = r"\b([A-Za-z_]\w*)\s*\("
DEFINITION = r"^[\w\s\*]+\b(\w+)\s*\([^;]*\)\s*(\{.*)?$"
LITERAL_OR_COMMENT = r"(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])+'|/\*.*?\*/|//.*$)"
BUCKET = 64


def lines_of(content: Column) -> Column:
    """Text as an array of lines; a final line break adds no line."""
    text = t.txt(content)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, "(\r\n|\r|\n)$", ""), EOL)
    )


def source_lines(files: DataFrame) -> DataFrame:
    """path, line_no, text (G1)."""
    return files.select("path", F.posexplode(lines_of(F.col("content"))).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).alias("line_no"), "text"
    )


def line_facts(files: DataFrame) -> DataFrame:
    """Lines with brace depth and enclosing function.

    Columns: path, line_no, text, depth, is_start, fn_name, fn_start, fn_end. Braces
    in literals and comments do not count; fn_end is NULL for an unclosed body.
    Files are dealt to all tasks before they are split: the adaptive planner merges
    partitions by the bytes of packed texts, and a task sorts all lines of its files.
    """
    by_path = Window.partitionBy("path").orderBy("line_no")
    upto = by_path.rowsBetween(Window.unboundedPreceding, 0)
    earlier = by_path.rowsBetween(Window.unboundedPreceding, -1)
    lines = source_lines(dealt(files.select("path", "content"), "path")).withColumn("code", F.regexp_replace("text", LITERAL_OR_COMMENT, " "))
    opens_comment, closes_comment = F.instr("code", "/*") > 0, F.instr("code", "*/") > 0
    lines = lines.withColumn("__c", F.when(opens_comment, 1).when(closes_comment, 0)).withColumn(
        "__in", F.coalesce(F.last("__c", ignorenulls=True).over(earlier), F.lit(0)) == 1
    )
    effective = (
        F.when(F.col("__in") & closes_comment, F.substring_index("code", "*/", -1))
        .when(F.col("__in"), F.lit(""))
        .when(opens_comment, F.substring_index("code", "/*", 1))
        .otherwise(F.col("code"))
    )
    lines = lines.withColumn("code", t.strip(effective)).drop("__c", "__in")
    opens, closes = t.count_of(F.col("code"), "{"), t.count_of(F.col("code"), "}")
    lines = (
        lines.withColumn("__s", F.sum(opens - closes).over(upto))
        .withColumn("depth", F.col("__s") - F.least(F.lit(0), F.min("__s").over(upto)))
        .withColumn("before", F.coalesce(F.lag("depth").over(by_path), F.lit(0)))
        .withColumn("last_line", F.max("line_no").over(Window.partitionBy("path")))
    )
    name = F.regexp_extract("code", DEFINITION, 1)
    opened = (F.instr("code", "{") > 0) | F.coalesce(F.lead("code").over(by_path), F.lit("")).startswith("{")
    start = (
        (F.col("before") == 0)
        & (name != "")
        & ~name.isin(*dim.SKIPPED_CALLEES)
        & opened
        & ~F.col("code").startswith("#")
    )
    lines = (
        lines.withColumn("is_start", start)
        .withColumn("__n", F.when(start, name))
        .withColumn("fn_start", F.last(F.when(F.col("is_start"), F.col("line_no")), ignorenulls=True).over(upto))
        .withColumn("fn_name", F.last("__n", ignorenulls=True).over(upto))
    )
    closed = F.when((F.instr("code", "}") > 0) & (F.col("depth") == 0), F.col("line_no"))
    lines = lines.withColumn("fn_end", F.min(closed).over(Window.partitionBy("path", "fn_start")))
    inside = F.col("line_no") <= F.coalesce("fn_end", "last_line")
    return lines.select(
        "path",
        "line_no",
        "text",
        "depth",
        "is_start",
        F.when(inside, F.col("fn_name")).alias("fn_name"),
        F.when(inside, F.col("fn_start")).alias("fn_start"),
        F.when(inside, F.col("fn_end")).alias("fn_end"),
        "last_line",
    )


def functions(facts: DataFrame) -> DataFrame:
    """Defined functions: name, path, start_line, end_line, signature."""
    return facts.where("is_start").select(
        F.col("fn_name").alias("name"),
        "path",
        F.col("fn_start").alias("start_line"),
        F.coalesce("fn_end", "last_line").alias("end_line"),
        t.strip(F.col("text")).alias("signature"),
    )


def first_function(funcs: DataFrame) -> DataFrame:
    """One definition per name, the first by path and line."""
    rest = [c for c in funcs.columns if c != "name"]
    return (
        funcs.groupBy("name")
        .agg(F.min_by(F.struct(*rest), F.struct("path", "start_line")).alias("r"))
        .select("name", *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def function_bodies(funcs: DataFrame, files: DataFrame) -> DataFrame:
    """Functions with their text: sliced from the file row, lines are not exploded."""
    span = F.slice(lines_of(F.col("content")), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return funcs.join(unsized(files.select("path", "content")), "path").withColumn("body", F.array_join(span, "\n")).drop("content")


def anchor_by_name(findings: DataFrame, funcs: DataFrame) -> DataFrame:
    """Move the search line to the first definition of the named function in the file."""
    at = funcs.groupBy("path", F.col("name").alias("function")).agg(F.min("start_line").alias("__at"))
    return (
        findings.join(at, ["path", "function"], "left")
        .withColumn("search_line", F.coalesce("__at", "line"))
        .drop("__at")
    )


def enclosing_function(findings: DataFrame, funcs: DataFrame, line: str = "line") -> DataFrame:
    """Smallest function around a line (G3): adds fn_name, fn_start, fn_end.

    Distinct (path, line) pairs are looked up once. Spans are cut into buckets of
    lines, so the interval test runs inside an equi-join on path and bucket.
    """
    points = findings.select("path", F.col(line).alias("__line")).distinct()
    spans = funcs.select(
        "path", "name", "start_line", "end_line",
        F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))).alias("__b"),
    )
    hit = (
        points.withColumn("__b", F.floor(F.col("__line") / BUCKET))
        .join(unsized(spans), ["path", "__b"])
        .where(F.col("__line").between(F.col("start_line"), F.col("end_line")))
        .groupBy("path", "__line")
        .agg(
            F.min_by(
                F.struct("name", "start_line", "end_line"),
                F.struct((F.col("end_line") - F.col("start_line")), F.col("start_line")),
            ).alias("f")
        )
        .select("path", F.col("__line").alias(line), F.col("f.name").alias("fn_name"), F.col("f.start_line").alias("fn_start"), F.col("f.end_line").alias("fn_end"))
    )
    return findings.join(unsized(hit), ["path", line], "left")


def attach_code(findings: DataFrame, funcs: DataFrame, files: DataFrame, line: str = "line", reach: int = 25) -> DataFrame:
    """Code of each finding (G3): its function, else ``reach`` lines on either side of it.

    Adds code, code_start_line, code_source ('function', 'window' or 'none').
    """
    has_fn = F.col("fn_start").isNotNull()
    at = F.coalesce(F.col(line), F.lit(0))
    first = F.when(has_fn, F.col("fn_start")).otherwise(F.greatest(F.lit(0), at - reach) + 1).cast("bigint")
    last = F.when(has_fn, F.col("fn_end")).otherwise(at + reach).cast("bigint")
    placed = enclosing_function(findings, funcs, line).withColumns({"__from": first, "__to": last})
    bodies = line_ranges(placed.select("path", "__from", "__to"), files)
    return (
        placed.join(unsized(bodies), ["path", "__from", "__to"], "left")
        .withColumns({"code": t.txt(F.col("__text")), "code_start_line": F.col("__from")})
        .withColumn("code_source", F.when(F.col("code") == "", "none").when(has_fn, "function").otherwise("window"))
        .drop("fn_start", "fn_end", "__from", "__to", "__text")
    )


def line_ranges(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Text of ranges of lines (path, __from, __to): adds __text, one row per distinct range.

    A file is split into lines once, however many ranges of it are wanted, and each
    range is cut once, however many findings lie in it.
    """
    ranges = wanted.groupBy("path").agg(F.collect_set(F.struct("__from", "__to")).alias("__ranges"))
    split = files.select("path", "content").join(unsized(ranges), "path").select("path", "__ranges", F.inline(F.array(F.struct(lines_of(F.col("content")).alias("__every")))))
    size = F.greatest(F.lit(0), F.least(F.col("__r.__to"), F.size("__every")) - F.col("__r.__from") + 1)
    cut = F.array_join(F.slice("__every", F.col("__r.__from").cast("int"), size.cast("int")), "\n")
    return split.select("path", "__every", F.explode("__ranges").alias("__r")).select("path", "__r.__from", "__r.__to", cut.alias("__text"))


def line_window(findings: DataFrame, lines: DataFrame, reach: int = 15) -> DataFrame:
    """Numbered lines around each finding, the flagged one marked (G4): path, line, snippet.

    One row per distinct (path, line): findings join it on both columns. A file's lines and the
    lines wanted of it meet once; windows are cut there, so no line is copied for the findings around it.
    """
    wanted = findings.where(F.col("line").isNotNull()).groupBy("path").agg(F.collect_set("line").alias("__wanted"))
    by_path = lines.select("path", F.col("line_no").cast("bigint").alias("line_no"), "text").groupBy("path")
    every = by_path.agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("__every"))
    # sizes are not to be guessed from the tables behind: texts are never broadcast
    points = every.join(wanted.hint("merge"), "path").select("path", "__every", F.explode("__wanted").alias("line"))
    at = F.col("line")
    first, last = F.greatest(F.lit(1), at - reach + 1), F.greatest(F.lit(1), at + reach)
    # line numbers run from 1 without gaps
    near = F.slice("__every", first.cast("int"), (last - first + 1).cast("int"))
    mark = lambda x: F.when(x["line_no"] == at, ">>>").otherwise("   ")
    shown = F.transform(near, lambda x: F.concat(F.lpad(x["line_no"].cast("string"), 5, " "), F.lit(" "), mark(x), F.lit(" "), x["text"]))
    return points.select("path", "line", F.array_join(shown, "\n").alias("snippet"), F.size(near).alias("__n")).where("__n > 0").drop("__n")


def callees_in(text: Column) -> Column:
    """Indexed call names on a line, repeats kept."""
    return F.filter(F.regexp_extract_all(text, F.lit(CALL), 1), lambda x: ~x.isin(*dim.SKIPPED_CALLEES))


def call_sites(lines: DataFrame) -> DataFrame:
    """Call sites (G5): callee, path, line_no, snippet. Works per line, no shuffle.

    Given :func:`line_facts` it also carries the caller of each site.
    """
    extra = [c for c in ("fn_name", "fn_start", "fn_end", "is_start") if c in lines.columns]
    return lines.select(
        F.explode(callees_in(F.col("text"))).alias("callee"),
        "path",
        "line_no",
        t.strip(F.col("text")).alias("snippet"),
        *extra,
    )


def callers(wanted: DataFrame, located_sites: DataFrame, first_sites: int | None = None) -> DataFrame:
    """Sites that call the wanted functions (G6): callee, path, line_no, snippet, caller, caller_start, caller_end.

    ``wanted(callee)`` is made distinct, so a callee called from a third of all
    sites is only split, never multiplied. ``first_sites`` reproduces a fan-out
    limit by report order; by default every site is kept. A definition line is
    itself a site.
    """
    sites = located_sites.join(wanted.select("callee").distinct(), "callee", "left_semi").select(
        "callee", "path", "line_no", "snippet",
        t.txt(F.col("fn_name")).alias("caller"),
        F.coalesce("fn_start", F.lit(1)).alias("caller_start"),
        F.coalesce("fn_end", F.col("line_no") + 25).alias("caller_end"),
    )
    if first_sites is None:
        return sites
    files = sites.select("callee", "path").distinct()
    order = Window.partitionBy("callee").orderBy("path")
    numbered = files.withColumn("__p", F.row_number().over(order).cast("bigint"))
    placed = sites.join(numbered, ["callee", "path"]).withColumn("__o", F.col("__p") * 1_000_000 + F.col("line_no"))
    return positions(placed, ["callee"], "__o").where(F.col("position") < first_sites).drop("__p", "__o", "position")


def without_callers(names: DataFrame, sites: DataFrame, include_definitions: bool = True) -> DataFrame:
    """Functions nobody calls (G8). Entry points and callbacks are left out.

    A definition line counts as a call unless ``include_definitions`` is off.
    """
    used = sites if include_definitions else sites.where(~(F.col("is_start") & (F.col("callee") == F.col("fn_name"))))
    entry = F.col("name").rlike(r"(?i)\bmain\b|\b_init\b|\b_fini\b|callback|hook|handler")
    return (
        names.where((F.col("name") != "") & ~entry)
        .join(used.select(F.col("callee").alias("name")).distinct(), "name", "left_anti")
    )


def _suffixes(path: Column) -> Column:
    """Trailing parts of a path, lower case, shortest first."""
    parts = F.filter(F.split(F.lower(F.replace(t.txt(path), F.lit("\\"), F.lit("/"))), "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))


def resolve_paths(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Repository file for each reported path (G9): file, resolved, score.

    The exact relative path wins; else the file sharing most trailing parts. Both
    sides are indexed by their suffixes, one row per suffix on the listing side, so
    a file name shared by thousands of folders makes no pairs.
    """
    reported = paths.select("file").where(t.strip(F.col("file")) != "").distinct()
    by_suffix = (
        listing.select("path", F.posexplode(_suffixes(F.col("path"))).alias("k", "suffix"), F.size(_suffixes(F.col("path"))).alias("n"))
        .groupBy("suffix")
        .agg(F.min_by("path", F.struct((F.col("n") != F.col("k") + 1), F.col("path"))).alias("candidate"))
    )
    best = (
        reported.select("file", F.posexplode(_suffixes(F.col("file"))).alias("k", "suffix"))
        .join(by_suffix, "suffix")
        .groupBy("file")
        .agg(F.max_by("candidate", "k").alias("by_suffix"), (F.max("k") + 1).alias("score"))
    )
    exact = listing.select(F.col("path").alias("exact")).distinct()
    return (
        reported.join(best, "file", "left")
        .join(exact, F.regexp_replace("file", "^/+", "") == F.col("exact"), "left")
        .select("file", t.first_text(F.col("exact"), F.col("by_suffix")).alias("resolved"), F.coalesce("score", F.lit(0)).cast("bigint").alias("score"))
    )


def path_coverage(resolved: DataFrame) -> DataFrame:
    """Distinct paths checked and resolved, over all of them."""
    return resolved.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("resolved") != "").cast("bigint").alias("resolved")
    )


def corroborate(findings: DataFrame, hits: DataFrame, reach: int = 3) -> DataFrame:
    """First external hit within ``reach`` lines (G27): adds rule_id ('' for none).

    ``hits(path, line, ordinal, rule_id)``. Each hit is spread over the lines it
    covers and reduced to the first hit per (path, line); the join is then a plain
    lookup with one row per key.
    """
    covered = (
        hits.where((F.col("line") > 0) & (F.col("rule_id") != ""))
        .groupBy("path", "line")
        .agg(F.min(F.struct("ordinal", "rule_id")).alias("h"))
        .select("path", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("line"), "h")
        .groupBy("path", "line")
        .agg(F.min("h").alias("h"))
    )
    return findings.join(unsized(covered), ["path", "line"], "left").withColumn("rule_id", t.txt(F.col("h.rule_id"))).drop("h")
