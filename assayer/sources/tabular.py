"""Tabular exports (S5, S6) and decision tables with alternate layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from assayer.functions import text as t
from assayer.functions.frames import dealt
from assayer.operators import normalize as n
from assayer.session import staged

# Accepted headings per column, best first
HEADINGS = {
    "cid": ["cid", "defect id", "issue id", "defect", "id"],
    "checker": ["checker", "type", "issue type", "checker type"],
    "type": ["type", "subtype", "checker type"],
    "severity": ["severity", "impact", "priority"],
    "file": ["file", "source file", "path", "filepath", "file path"],
    "line": ["line", "line number", "location", "lineno"],
    "function": ["function", "function name", "procedure", "func"],
    "events_json": ["eventsjson", "events json", "event json"],
    "events_summary": ["events summary", "event summary", "events"],
}


def match_heading(headings: list[str], candidates: list[str]) -> str | None:
    """Heading for a column: equal, then containing a candidate, then contained in one."""
    plain = [h.lower().replace("_", " ").replace("-", " ") for h in headings]
    tests = (
        lambda h, c: h == c,
        lambda h, c: c in h,
        lambda h, c: h in c and len(h) > 1,
    )
    for test in tests:
        for cand in candidates:
            for original, h in zip(headings, plain):
                if test(h, cand):
                    return original
    return None


def records(spark: SparkSession, path: str, block_bits: int = 15) -> DataFrame:
    """Records of quoted text tables, read in splits: file, block, at (order inside the file), is_first, record.

    A file is cut into blocks of lines as any text is, and a line break ends a record where the quotes before it
    are even. Quotes are summed up per block, a running sum over the blocks (one row each) tells whether a
    block begins inside a cell, and inside blocks the lines are judged apart; a record whose lines lie
    in several blocks is put together by its first line. A block has at most 2 ** ``block_bits`` lines, so that no task
    holds a whole split. Quotes must be doubled inside quoted cells and
    stand nowhere else (RFC 4180).
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    lines = lines.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value"), t.count_of(F.col("value"), '"').alias("q"))
    # blocks in the order of the file: by split, then by the lines in it
    lines = staged(lines.withColumn("block", F.struct("split", F.shiftright("at", block_bits).alias("part"))).drop("split"), "table-lines")
    inside = Window.partitionBy("file", "block").orderBy("at")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("q").alias("n"), F.min("at").alias("first"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"), F.count(F.lit(1)).over(earlier).alias("nth"), "first")
    before = F.coalesce(F.sum("q").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    judged = dealt(lines, "file", "block").withColumn("before", before).join(blocks, ["file", "block"])
    judged = judged.withColumn("start", F.when((F.col("before") + F.col("ahead")) % 2 == 0, F.col("at")))
    judged = staged(judged.withColumn("own", F.last("start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))), "table-lines")
    last = judged.groupBy("file", "block").agg(F.max("start").alias("last"))
    last = last.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    keyed = judged.join(last, ["file", "block"]).withColumn("record_at", F.coalesce("own", "carried"))
    joined = keyed.groupBy("file", "record_at").agg(
        F.min(F.struct("block", "at")).alias("place"), F.max(F.coalesce((F.col("nth") == 0) & (F.col("start") == F.col("first")), F.lit(False))).alias("is_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("record"),
    )
    return joined.select("file", "place.block", "place.at", "is_first", F.regexp_replace("record", "\r$", "").alias("record"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with quoted multi-line cells, in as many tasks as its size asks for; a byte-order mark is dropped.

    Every file begins with its headings; those of the first one hold. Empty lines are no rows.
    """
    quoted = {"quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.option("header", True).options(**quoted).csv(path).columns
    schema = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))])
    rows = records(spark, path).where(~F.col("is_first") & (t.strip(F.col("record")) != ""))
    cells = rows.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), quoted).alias("r"))
    return cells.select(*[F.col(f"r.c{k}").alias(n.lstrip("\ufeff")) for k, n in enumerate(names)])


def map_headings(raw: DataFrame) -> DataFrame:
    """Rename fuzzy headings to the canonical columns; absent ones become ''."""
    found = {name: match_heading(raw.columns, cands) for name, cands in HEADINGS.items()}
    for name in ("cid", "file"):
        if found[name] is None:
            raise ValueError(f"no {name} column among {raw.columns}")
    return raw.select(
        *[
            (t.txt(F.col(f"`{src}`")) if src is not None else F.lit("")).alias(name)
            for name, src in found.items()
        ],
        *[c for c in raw.columns if c == "ordinal"],
    )


def parse_line(df: DataFrame) -> DataFrame:
    """'Various' is flagged and, like any other text, gives line 0."""
    text = F.lower(t.strip(F.col("line")))
    return df.withColumn("line_is_various", text == "various").withColumn("line", t.to_int(F.col("line")))


def findings_from_table(raw: DataFrame) -> DataFrame:
    """Findings of a tabular export (S5); rows whose cid is no integer are dropped."""
    df = parse_line(map_headings(raw))
    return df.withColumn("cid", t.coerce_cid(F.col("cid"))).where(F.col("cid").isNotNull()).withColumn(
        "function", n.clean_function(F.col("function"))
    )


def settle_line(findings: DataFrame, trace_lines: DataFrame) -> DataFrame:
    """A trace line replaces the sheet's line and clears the 'Various' flag."""
    ev = F.coalesce("event_line", F.lit(0))
    return (
        findings.join(trace_lines.select("cid", "event_line"), "cid", "left")
        .withColumn("line", F.when(ev != 0, ev).otherwise(F.col("line")))
        .withColumn("line_is_various", F.col("line_is_various") & (ev == 0))
        .drop("event_line")
    )


# Spellings of decision columns
DECISION_COLUMNS = {
    "cid": ["CID", "cid"],
    "classification": ["Classification", "FinalClassification", "classification"],
    "comment": ["Comment", "FinalComment", "comment"],
    "checker": ["Checker", "checker"],
    "file": ["File", "file"],
}


def decisions_from_table(raw: DataFrame) -> DataFrame:
    """Decisions in any of the known layouts (S14), last row per cid by ``ordinal``.

    A cid that is no integer drops the row; :func:`rejected_decisions` counts them.
    """
    from assayer.operators.reconcile import last_per_cid

    return last_per_cid(_decision_columns(raw).where(F.col("cid").isNotNull())).drop("first_ordinal")


def rejected_decisions(raw: DataFrame) -> DataFrame:
    return _decision_columns(raw).where(F.col("cid").isNull()).agg(F.count(F.lit(1)).alias("rejected"))


def _decision_columns(raw: DataFrame) -> DataFrame:
    have = {c: f"`{c}`" for c in raw.columns}

    def pick(name: str):
        present = [F.col(have[c]) for c in DECISION_COLUMNS[name] if c in have]
        return t.first_text(*present) if present else F.lit("")

    df = raw.select(pick("cid").alias("cid_text"), *[pick(c).alias(c) for c in DECISION_COLUMNS if c != "cid"], "ordinal")
    return (
        df.where((F.col("cid_text") != "") & (F.col("classification") != ""))
        .withColumn("cid", t.coerce_cid(F.col("cid_text")))
        .drop("cid_text")
    )
