"""Issue JSON (S7-S10): positional pages, issue objects, event trees, instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as t
from assayer.operators import normalize as n

PAGE = "STRUCT<columns: ARRAY<STRING>, rows: ARRAY<STRING>, totalRows: BIGINT>"
OBJECT = "MAP<STRING,STRING>"


def issue_rows(pages: DataFrame, json: str = "value") -> DataFrame:
    """Rows of search pages as maps (S7): positional rows are zipped with the column
    names (``name``, else ``id``); object rows pass through."""
    page = pages.withColumn("__page", F.from_json(F.col(json), PAGE))
    names = F.transform(
        F.coalesce("__page.columns", F.array().cast("array<string>")),
        lambda c: F.when(c.startswith("{"), t.first_text(F.get_json_object(c, "$.name"), F.get_json_object(c, "$.id"))).otherwise(c),
    )
    keep = [c for c in pages.columns if c != json]
    rows = page.select(*keep, names.alias("__names"), F.posexplode("__page.rows").alias("row_no", "__row"))
    values = F.from_json("__row", "ARRAY<STRING>")
    width = F.least(F.size("__names"), F.size(values))
    zipped = F.map_from_arrays(F.slice("__names", 1, width), F.slice(values, 1, width))
    return rows.select(
        *keep, "row_no", F.when(F.col("__row").startswith("["), zipped).otherwise(F.from_json("__row", OBJECT)).alias("issue")
    )


def _events(json: Column, default_file: Column) -> Column:
    """Issue events as structs; elements that are no objects are dropped."""
    objects = F.filter(F.from_json(json, "ARRAY<STRING>"), lambda e: e.startswith("{"))
    maps = F.transform(objects, lambda e: F.from_json(e, OBJECT))
    return F.transform(maps, lambda m: F.struct(*n.normalized_event(lambda k: F.try_element_at(m, F.lit(k)), default_file)))


def findings_from_issues(issues: DataFrame, v1: bool = False) -> DataFrame:
    """Issue maps to findings (S8). The main-event path and line are preferred; the
    older shape carries no events. Rows without a cid are dropped."""
    g = lambda k: F.try_element_at("issue", F.lit(k))
    cid = F.coalesce(t.coerce_cid(g("cid")), t.coerce_cid(F.get_json_object(g("mergedDefectId"), "$.cid")))
    keep = [c for c in issues.columns if c != "issue"]
    df = issues.select(
        *keep,
        cid.alias("cid"),
        t.txt(g("checkerName")).alias("checker"),
        t.first_text(g("displayType"), g("checkerSubcategoryLongDescription")).alias("type"),
        t.txt(g("displayImpact")).alias("severity"),
        t.first_text(g("mainEventFilePath"), g("mainEventFilePathname"), g("filePathname")).alias("file"),
        t.txt(g("functionDisplayName")).alias("function"),
        t.to_int(g("mainEventLineNumber")).alias("rest_main_line"),
        t.to_int(g("lineNumber")).alias("occurrence_line"),
        (F.lit(None).cast("string") if v1 else g("events")).alias("__events"),
    ).where(F.col("cid").isNotNull())
    return (
        df.withColumn("line", t.first_nonzero(F.col("rest_main_line"), F.col("occurrence_line")))
        .withColumn("line_src", F.when(F.col("rest_main_line") != 0, "rest_main").otherwise("rest"))
        .withColumn("events", _events(F.col("__events"), F.col("file")))
        .drop("__events", "occurrence_line")
    )


def trace_from_events(findings: DataFrame) -> DataFrame:
    """Long trace from a nested ``events`` column."""
    rows = findings.select("cid", F.posexplode("events").alias("ordinal", "e"))
    return rows.select("cid", F.col("ordinal").cast("bigint").alias("ordinal"), "e.*").drop("type")


def flatten_events(trees: DataFrame, json: str = "events", depth: int | None = None) -> DataFrame:
    """Nested event trees to a flat trace in pre-order.

    Each level is one nested ``transform`` inside the row, so nothing is shuffled. The
    number of levels is looked up in the data, doubled until no tree is deeper; with a
    given ``depth`` a deeper tree raises an error instead of losing events.
    """

    def children(text: Column) -> Column:
        return F.filter(F.from_json(text, "ARRAY<STRING>"), lambda e: e.startswith("{"))

    def deeper(text: Column, left: int) -> Column:
        if left == 0:
            return F.coalesce(F.size(children(text)) > 0, F.lit(False))
        return F.coalesce(F.exists(children(text), lambda e: deeper(F.get_json_object(e, "$.events"), left - 1)), F.lit(False))

    if depth is None:
        depth = 4
        while not trees.where(deeper(F.col(json), depth)).isEmpty():
            depth *= 2

    def level(text: Column, left: int) -> Column:
        nodes = children(text)
        if left == 0:
            return F.when(F.size(nodes) > 0, F.raise_error(F.lit(f"event tree deeper than {depth}")).cast("array<string>"))
        return F.flatten(
            F.transform(
                nodes,
                lambda e: F.concat(
                    F.array(e), F.coalesce(level(F.get_json_object(e, "$.events"), left - 1), F.array().cast("array<string>"))
                ),
            )
        )

    flat = trees.select("cid", F.posexplode(level(F.col(json), depth)).alias("ordinal", "__e"))
    maps = flat.withColumn("__m", F.from_json("__e", OBJECT))
    nested_file = F.get_json_object(F.try_element_at("__m", F.lit("fileId")), "$.filePathname")
    return maps.select(
        "cid",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        *n.normalized_event(lambda k: F.try_element_at("__m", F.lit(k)), nested_file),
    ).drop("type")


def current_instance(instances: DataFrame) -> DataFrame:
    """Newest instance per finding (S10): cid, instance_line, function, type, severity, n_instances.

    ``instances(cid, snapshot_ord, lineNumber, checkerLineNumber, primaryLineNumber,
    mainEventLineNumber, functionDisplayName, functionMangledName, type, impact)``.
    """
    fields = ["lineNumber", "checkerLineNumber", "primaryLineNumber", "mainEventLineNumber"]
    row = F.struct(
        t.first_nonzero(*[F.col(f) for f in fields]).alias("line"),
        t.first_text(F.col("functionDisplayName"), F.col("functionMangledName")).alias("function"),
        t.txt(F.col("type")).alias("type"),
        t.txt(F.col("impact")).alias("severity"),
    )
    return (
        instances.groupBy("cid")
        .agg(F.max_by(row, "snapshot_ord").alias("i"), F.count(F.lit(1)).alias("n_instances"))
        .select(
            "cid",
            F.col("i.line").alias("instance_line"),
            F.col("i.function").alias("function"),
            F.col("i.type").alias("type"),
            F.col("i.severity").alias("severity"),
            "n_instances",
        )
    )


def enrich_from_instance(findings: DataFrame, current: DataFrame) -> DataFrame:
    """Instance function wins where present; type and severity fill blanks."""
    i = current.select("cid", "instance_line", *[F.col(c).alias(f"__{c}") for c in ("function", "type", "severity")])
    return (
        findings.join(i, "cid", "left")
        .withColumn("function", t.first_text(F.col("__function"), F.col("function")))
        .withColumn("type", t.first_text(F.col("type"), F.col("__type")))
        .withColumn("severity", t.first_text(F.col("severity"), F.col("__severity")))
        .withColumn("merged_line", t.to_int(F.col("line")))
        .withColumn("instance_line", F.coalesce("instance_line", F.lit(0)).cast("bigint"))
        .drop("__function", "__type", "__severity")
    )
