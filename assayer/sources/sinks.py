"""Written results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as t

# Column layouts
DISPOSITIONS = [
    "CID", "Checker", "Type", "Severity", "File", "Line", "Function", "Classification", "Comment", "Fix", "Timestamp", "Category",
]
FINAL_DECISIONS = [
    "CID", "Checker", "File", "Line", "FinalClassification", "FinalComment", "Fix", "Reviewer", "Timestamp", "Status", "Category",
]
PULL_SHEET = ["CID", "Checker", "Subtype", "Severity", "File", "Line", "Function", "Events Summary", "EventsJSON"]
RESULT_SHEET = ["CID", "Checker", "Category", "File", "Line", "Disposition", "Confidence", "Comment", "Events Summary"]


def stamp(run_ts: str):
    """Run time as shown in sinks; a parameter, so reruns give the same bytes."""
    return F.date_format(F.lit(run_ts).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def disposition_rows(results: DataFrame, run_ts: str) -> DataFrame:
    """The 12-column layout of analysed findings."""
    src = ["cid", "checker", "type", "severity", "file", "line", "function", "classification", "comment", "fix"]
    return results.select(
        *[F.col(a).alias(b) for a, b in zip(src, DISPOSITIONS)], stamp(run_ts).alias("Timestamp"), F.col("category").alias("Category")
    )


def decision_rows(decisions: DataFrame) -> DataFrame:
    """The 11-column layout of final decisions; status from the accepted flag."""
    status = F.when(F.coalesce("accepted", F.lit(False)), "Accepted").otherwise("Overridden")
    return decisions.select(
        F.col("cid").alias("CID"), F.col("checker").alias("Checker"), F.col("file").alias("File"), F.col("line").alias("Line"),
        F.col("classification").alias("FinalClassification"), F.col("comment").alias("FinalComment"), F.col("fix").alias("Fix"),
        F.col("reviewer").alias("Reviewer"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        status.alias("Status"), F.col("category").alias("Category"),
    )


def pull_rows(findings: DataFrame, summaries: DataFrame, jsons: DataFrame) -> DataFrame:
    """The 9-column sheet of pulled findings, one row per CID: both cells hold the whole trace."""
    cells = jsons.join(summaries, "cid")
    joined = findings.join(cells, "cid", "left")
    src = ["cid", "checker", "type", "severity", "file", "line", "function"]
    return joined.select(
        *[F.col(a).alias(b) for a, b in zip(src, PULL_SHEET)],
        t.txt(F.col("events_summary")).alias("Events Summary"),
        t.first_text(F.col("events_json"), F.lit("[]")).alias("EventsJSON"),
    )


def result_rows(results: DataFrame) -> DataFrame:
    """The 9-column sheet of analysed findings; the confidence as a whole percentage."""
    src = ["cid", "checker", "category", "file", "line", "classification"]
    return results.select(
        *[F.col(a).alias(b) for a, b in zip(src, RESULT_SHEET)],
        F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")).alias("Confidence"),
        t.txt(F.col("comment")).alias("Comment"),
        t.txt(F.col("events_summary")).alias("Events Summary"),
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = "category") -> None:
    """Write parquet, JSON or CSV, split by category."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    if by:
        writer = writer.partitionBy(by)
    writer.save(path)


def write_run(decisions: DataFrame, path: str, run: str) -> None:
    """A new run starts with an empty log: only its own partition is replaced."""
    (
        decisions.withColumn("run", F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .parquet(path)
    )


def audit_rows(results: DataFrame) -> DataFrame:
    """Decision log with a digest of the code that was judged."""
    return results.select(
        "cid", "checker", "file", "line", "classification", "confidence",
        F.sha2(t.txt(F.col("code")), 256).alias("context_hash"),
    )


def write_audit(results: DataFrame, path: str, run: str) -> None:
    """The log of a run, as JSON in its own partition: a repeated run replaces its rows and no others."""
    (
        audit_rows(results)
        .withColumn("run", F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .json(path)
    )


def write_files(files: DataFrame, root: str) -> int:
    """Write each row (path, content) as a file below ``root``; gives their number.

    A file is written under a passing name and renamed, so a repeated task leaves the same file.
    """
    where = root if "://" in root else f"file://{root}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(f"{where}/{path}")
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                passing = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(passing) as out:
                    out.write((content or "").encode())
                store.move(passing, name)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
