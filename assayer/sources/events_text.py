"""Events held as text in one cell: JSON (S11) and the older summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as t
from assayer.functions.frames import positions
from assayer.operators import normalize as n


def events_from_json(df: DataFrame, json: str = "events_json") -> DataFrame:
    """JSON cells to a long trace; bad JSON gives no events, non-objects are dropped."""
    objects = F.filter(F.from_json(F.col(json), "ARRAY<STRING>"), lambda e: e.startswith("{"))
    rows = df.select("cid", F.posexplode(objects).alias("ordinal", "__e")).withColumn(
        "__m", F.from_json("__e", "MAP<STRING,STRING>")
    )
    return rows.select(
        "cid",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        *n.normalized_event(lambda k: F.try_element_at("__m", F.lit(k))),
    ).drop("type")


def _cells(trace: DataFrame, shown, name: str, separator: str, part_size: int | None) -> DataFrame:
    """Events written one by one, where they lie, and joined in order: one row per cid, or per (cid, part) where a size is given."""
    rows = trace.select("cid", "ordinal", shown.alias("__x"))
    if part_size is not None:
        rows = positions(rows, ["cid"], "ordinal").withColumn("part", F.floor(F.col("position") / part_size).cast("bigint"))
    keys = ["cid"] if part_size is None else ["cid", "part"]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "__x"))), lambda e: e["__x"]), separator)
    return rows.groupBy(*keys).agg(joined.alias(name))


def events_to_json(trace: DataFrame, part_size: int | None = None) -> DataFrame:
    """Traces as JSON arrays: cid, events_json; one cell holds a whole trace, however long.

    With ``part_size`` a longer trace goes on in further rows (cid, part).
    The heuristic mark is internal and not written."""
    event = F.struct(
        t.to_int(F.col("step")).alias("step"),
        t.txt(F.col("tag")).alias("type"),
        t.txt(F.col("tag")).alias("tag"),
        t.txt(F.col("description")).alias("description"),
        t.txt(F.col("file")).alias("file"),
        t.to_int(F.col("line")).alias("line"),
        F.coalesce("main", F.lit(False)).alias("main"),
    )
    cells = _cells(trace, F.to_json(event), "events_json", ",", part_size)
    return cells.withColumn("events_json", F.concat(F.lit("["), "events_json", F.lit("]")))


# One part of a summary
SUMMARY_PART = r"^([^@;]+?)@([^:]*):(\d+)\s*[—-]\s*(.*)$"


def events_from_summary(df: DataFrame, summary: str = "events_summary") -> DataFrame:
    """Summary cells to a long trace; the step is the place of the part, blank parts included."""
    rows = df.select("cid", F.posexplode(F.split(t.txt(F.col(summary)), "; ")).alias("pos", "part")).withColumn(
        "part", t.strip(F.col("part"))
    )
    m = lambda k: t.strip(F.regexp_extract("part", SUMMARY_PART, k))
    return rows.where(F.col("part").rlike(SUMMARY_PART)).select(
        "cid",
        F.col("pos").cast("bigint").alias("ordinal"),
        (F.col("pos") + 1).cast("bigint").alias("step"),
        m(1).alias("tag"),
        m(4).alias("description"),
        m(2).alias("file"),
        t.to_int(m(3)).alias("line"),
        F.lit(False).alias("main"),
    )


def events_to_summary(trace: DataFrame, part_size: int | None = None) -> DataFrame:
    """Traces as readable text: cid, events_summary; with ``part_size`` in rows (cid, part)."""
    shown = F.concat(
        t.first_text(F.col("tag"), F.lit("?")), F.lit("@"), t.txt(F.col("file")), F.lit(":"), t.txt(F.col("line")),
        F.lit(" — "), t.txt(F.col("description")),
    )
    return _cells(trace, shown, "events_summary", "; ", part_size)
