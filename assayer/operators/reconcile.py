"""Reconciliation with a triage store and batched write-back.

Keys are aggregated before they are joined, so the small side of each join has
one row per key; a hot key on the large side is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as t
from assayer.functions.frames import earliest, latest, positions
from assayer.operators import normalize as n
from assayer.session import staged

MAX_BATCH = 100


def last_per_cid(df: DataFrame) -> DataFrame:
    """Last row per cid wins (W1); first_ordinal keeps the place of the first."""
    first = df.groupBy("cid").agg(
        F.max_by(F.struct(*[c for c in df.columns if c != "cid"]), "ordinal").alias("__row"),
        F.min("ordinal").alias("first_ordinal"),
    )
    return first.select("cid", *[F.col(f"__row.{c}").alias(c) for c in df.columns if c != "cid"], "first_ordinal")


def first_per_cid(df: DataFrame, max_findings: int | None = None) -> DataFrame:
    """First row per cid (W2); the optional cut is the caller's page limit."""
    kept = earliest(df.where(F.col("cid").isNotNull()), "cid", "ordinal", df.columns)
    return kept if max_findings is None else kept.orderBy("ordinal").limit(max_findings)


def push_rows(
    findings: DataFrame, run_date: str, reviewer: str = "", stamp: bool = True, max_comment: int | None = None, tool: str = "Assayer"
) -> DataFrame:
    """Rows to write back: cid, classification, comment, checker, file, line, ordinal."""
    base = F.col("base_classification") if "base_classification" in findings.columns else F.lit("Bug")
    comment = t.strip(F.col("comment"))
    if stamp:
        comment = n.stamped(F.col("comment"), run_date, reviewer, tool)
    rows = findings.select(
        t.coerce_cid(F.col("cid")).alias("cid"),
        n.pushed_class(F.col("classification"), base).alias("classification"),
        n.truncated(comment, max_comment).alias("comment"),
        t.txt(F.col("checker")).alias("checker"),
        t.txt(F.col("file")).alias("file"),
        t.to_int(F.col("line")).alias("line"),
        "ordinal",
    ).where(F.col("cid").isNotNull())
    once = last_per_cid(rows)
    return once.withColumn("ordinal", F.col("first_ordinal")).drop("first_ordinal")


def validate(rows: DataFrame, server: DataFrame) -> DataFrame:
    """Match rows to the store: by cid, else by a unique (checker, file name).

    Adds server_cid and match ('cid', 'signature' or ''). An ambiguous signature
    stays unmatched, and every listing counts, duplicates included.
    """
    listed = server.select(
        t.coerce_cid(F.col("cid")).alias("server_cid"),
        t.txt(F.col("checker")).alias("checker"),
        t.basename(F.col("file")).alias("file_name"),
    ).where(F.col("server_cid").isNotNull())
    ids = listed.select(F.col("server_cid").alias("cid")).distinct().withColumn("__by_cid", F.lit(True))
    unique = (
        listed.groupBy("checker", "file_name")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("server_cid").alias("__sig_cid"))
        .where(F.col("__n") == 1)
        .drop("__n")
    )
    found = rows.join(ids, "cid", "left").withColumn("file_name", t.basename(F.col("file")))
    by_cid, by_signature = F.col("__by_cid").isNotNull(), F.col("__sig_cid").isNotNull()
    return found.join(unique, ["checker", "file_name"], "left").select(
        *rows.columns,
        F.when(by_cid, F.col("cid")).otherwise(F.col("__sig_cid")).alias("server_cid"),
        F.when(by_cid, "cid").when(by_signature, "signature").otherwise("").alias("match"),
    )


def validation_report(validated: DataFrame) -> DataFrame:
    """One row: matched, remapped, unmatched, pushable."""
    count = lambda cond: F.count_if(cond).cast("bigint")
    return validated.agg(
        count(F.col("match") == "cid").alias("matched"),
        count(F.col("match") == "signature").alias("remapped"),
        count(F.col("match") == "").alias("unmatched"),
        count(F.col("match") != "").alias("pushable"),
    )


def partition_by_match(validated: DataFrame, require_validated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Queue to send and rows that are skipped (W5). The validation runs once and is staged for both."""
    if not require_validated:
        return validated, validated.where(F.lit(False))
    validated = staged(validated, "validated")
    return validated.where(F.col("server_cid").isNotNull()), validated.where(F.col("server_cid").isNull())


def batch_rows(queue: DataFrame, size: int = MAX_BATCH) -> DataFrame:
    """Number the rows into batches of one class and comment.

    Adds batch_no (inside its class and comment) and target_cid. The key is the
    class of this tool, before it is mapped to a store value. A class and comment
    shared by a third of all rows is numbered by many tasks.
    """
    target = F.coalesce("server_cid", "cid") if "server_cid" in queue.columns else F.col("cid")
    placed = positions(queue.withColumn("target_cid", target), ["classification", "comment"], "ordinal", ties=("cid",))
    return placed.withColumn("batch_no", F.floor(F.col("position") / size).cast("bigint")).drop("position")


def batches(numbered: DataFrame) -> DataFrame:
    """One row per request: class, comment, batch_no, cids (at most one batch size)."""
    return numbered.groupBy("classification", "comment", "batch_no").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "target_cid"))), lambda x: x["target_cid"]
        ).alias("cids"),
        n.store_class(F.first("classification")).alias("store_classification"),
    )


def fold_outcomes(numbered: DataFrame, outcomes: DataFrame, store: str, dry_run: bool = False) -> DataFrame:
    """Spread batch outcomes to rows (W7): adds status ('ok', 'failed') and error.

    ``outcomes(classification, comment, batch_no, ok_count, failed, error)``. A
    shortfall that names no cid fails its whole batch; so does a missing outcome.
    Without a store nothing is claimed as written.
    """
    if not store:
        return numbered.withColumn("status", F.lit("failed")).withColumn("error", F.lit("No triage store selected"))
    if dry_run:
        return numbered.withColumn("status", F.lit("ok")).withColumn("error", F.lit(""))
    key = ["classification", "comment", "batch_no"]
    sizes = numbered.groupBy(*key).agg(F.count(F.lit(1)).alias("__size"))
    verdict = sizes.join(outcomes, key, "left").select(
        *key,
        F.coalesce("failed", F.array().cast("array<bigint>")).alias("__failed"),
        ((F.coalesce(F.size("failed"), F.lit(0)) <= 0) & (F.coalesce("ok_count", F.lit(0)) < F.col("__size"))).alias("__all"),
        t.txt(F.col("error")).alias("__error"),
    )
    bad = F.col("__all") | F.array_contains("__failed", F.col("target_cid"))
    return (
        numbered.join(verdict, key)
        .withColumn("status", F.when(bad, "failed").otherwise("ok"))
        .withColumn("error", F.when(bad, t.first_text(F.col("__error"), F.lit("Server rejected the update"))).otherwise(""))
        .drop("__failed", "__all", "__error")
    )


def apply_status(findings: DataFrame, pushed: DataFrame, every: bool = False) -> DataFrame:
    """Outcome back onto the findings by their own cid.

    Of a cid pushed more than once the last row counts, or with ``every`` each of them
    gives the finding a row.
    """
    told = pushed.where(t.txt(F.col("status")) != "")
    outcome = F.struct("status", "error", "target_cid")
    told = told.select("cid", outcome.alias("__p")) if every else told.groupBy("cid").agg(F.max_by(outcome, "ordinal").alias("__p"))
    return findings.join(told, "cid", "left").select(
        *findings.columns,
        t.txt(F.col("__p.status")).alias("push_status"),
        t.txt(F.col("__p.error")).alias("push_error"),
        F.coalesce(F.col("__p.target_cid"), F.lit(0)).cast("bigint").alias("pushed_cid"),
    )


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """One decision per cid, latest action wins (W9); rows without a cid are kept all."""
    everything = current.unionByName(changes, allowMissingColumns=True)
    keyed = everything.where(F.col("cid").isNotNull())
    loose = everything.where(F.col("cid").isNull())
    return latest(keyed, "cid", "ordinal", everything.columns).select(*everything.columns).unionByName(loose)


def review_state(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Accept and override actions applied to findings.

    ``actions(cid, ordinal, action, classification, comment, reviewer, ts)``, action
    'accept' or 'override'. A second accept of an accepted finding changes nothing,
    so a finding is described by its last override and the first accept after it.
    """
    is_override = F.col("action") == "override"
    last_override = actions.where(is_override).groupBy("cid").agg(
        F.max_by(F.struct("classification", "comment"), "ordinal").alias("__ov"), F.max("ordinal").alias("__ov_at")
    )
    accepts = (
        actions.where(F.col("action") == "accept")
        .join(last_override.select("cid", "__ov_at"), "cid", "left")
        .where(F.col("ordinal") > F.coalesce("__ov_at", F.lit(-1)))
        .groupBy("cid")
        .agg(F.min_by(F.struct("reviewer", "ts"), "ordinal").alias("__ac"))
    )
    joined = findings.join(last_override, "cid", "left").join(accepts, "cid", "left")
    over, acc = F.col("__ov").isNotNull(), F.col("__ac").isNotNull()
    rest = [c for c in findings.columns if c not in ("classification", "comment", "accepted", "overridden")]
    return joined.select(
        *rest,
        F.when(over, F.col("__ov.classification")).otherwise(F.col("classification")).alias("classification"),
        F.when(over, t.first_text(t.strip(F.col("__ov.comment")), F.lit("Manually overridden"))).otherwise(F.col("comment")).alias("comment"),
        acc.alias("accepted"),
        over.alias("overridden"),
        t.txt(F.col("__ac.reviewer")).alias("accepted_by"),
        F.col("__ac.ts").alias("accepted_at"),
    )
