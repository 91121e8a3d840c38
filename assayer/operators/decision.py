"""Scoring and decision.

Weights are integer hundredths, so sums do not depend on partition order; the
confidence formula is applied once, in a fixed order. The evidence of a finding is
an array bounded by the number of rules, so the whole decision is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.operators.normalize import confidence_sentence


def _sum(polarity: str) -> Column:
    chosen = F.transform(F.filter("evidence", lambda e: e["polarity"] == polarity), lambda e: e["weight_c"])
    return F.aggregate(chosen, F.lit(0), lambda acc, x: acc + x)


def scores(df: DataFrame) -> DataFrame:
    """Add bug_c and fp_c from the evidence array."""
    return df.withColumn("bug_c", _sum("bug")).withColumn("fp_c", _sum("fp"))


def score_rows(evidence_rows: DataFrame) -> DataFrame:
    """Scores of a long evidence table: cid, bug_c, fp_c (D1 as a partial aggregate)."""
    part = lambda p: F.coalesce(F.sum(F.when(F.col("polarity") == p, F.col("weight_c"))), F.lit(0)).cast("bigint")
    return evidence_rows.groupBy("cid").agg(part("bug").alias("bug_c"), part("fp").alias("fp_c"))


def critical_flags(df: DataFrame) -> DataFrame:
    """Add critical_bug and critical_fp."""
    has = lambda labels: F.exists("evidence", lambda e: e["label"].isin(*labels))
    return df.withColumn("critical_bug", has(dim.CRITICAL_BUG)).withColumn("critical_fp", has(dim.CRITICAL_FP))


def confidence_and_class(df: DataFrame) -> DataFrame:
    """Add confidence (unrounded), dominance and classification.

    Needs bug_c, fp_c, critical_bug, critical_fp, n_insufficient, top_weight, top_polarity.
    """
    # Constants of the formula and of the ladder
    df = (
        df.withColumn("bug_score", F.col("bug_c") / F.lit(100.0))
        .withColumn("fp_score", F.col("fp_c") / F.lit(100.0))
        .withColumn("winner", F.greatest("bug_score", "fp_score"))
        .withColumn("loser", F.least("bug_score", "fp_score"))
        .withColumn("margin", F.col("winner") - F.col("loser"))
        .withColumn(
            "dominance",
            F.when(F.col("bug_c") + F.col("fp_c") > 0, F.col("winner") / (F.col("bug_score") + F.col("fp_score"))).otherwise(0.0),
        )
    )
    base = (
        F.when(F.col("bug_c") + F.col("fp_c") == 0, 0.0)
        .when(F.col("loser") == 0, F.least(F.lit(1.0), F.lit(0.55) + F.col("winner") * 0.22 + F.col("dominance") * 0.15))
        .otherwise(
            F.least(F.lit(1.0), F.lit(0.45) + F.col("margin") * 0.30 + F.col("winner") * 0.12 + F.col("dominance") * 0.15)
        )
    )
    bug_only, fp_only = F.col("critical_bug") & ~F.col("critical_fp"), F.col("critical_fp") & ~F.col("critical_bug")
    lifted = (bug_only & (F.col("fp_score") < 0.3)) | (fp_only & (F.col("bug_score") < 0.3))
    df = df.withColumn("confidence", base)
    df = df.withColumn("confidence", F.when(lifted, F.least(F.lit(1.0), F.col("confidence") + 0.15)).otherwise(F.col("confidence")))
    df = df.withColumn(
        "confidence",
        F.when(F.col("n_insufficient") > 0, F.greatest(F.lit(0.0), F.col("confidence") - F.col("n_insufficient") * 0.20)).otherwise(F.col("confidence")),
    )
    c, bug, fp = F.col("confidence"), F.col("bug_score"), F.col("fp_score")
    more_bug, more_fp = bug > fp, fp > bug
    tie = (F.col("top_weight") >= 75) & F.col("top_polarity").isin("bug", "fp") & (F.abs(F.col("bug_c") - F.col("fp_c")) <= 2)
    side = lambda cond: F.when(cond, "Bug").otherwise("False positive")
    df = df.withColumn(
        "__step",
        F.when(F.col("bug_c") + F.col("fp_c") == 0, "Needs review")
        .when(bug_only & more_bug, "Bug")
        .when(fp_only & more_fp, "False positive")
        .when((c >= 0.45) & (F.col("dominance") >= 0.62) & (F.col("margin") >= 0.12), side(more_bug))
        .when((c >= 0.50) & more_bug, "Bug")
        .when((c >= 0.50) & more_fp, "False positive")
        .when((c >= 0.35) & (bug > fp + 0.15), "Bug")
        .when((c >= 0.35) & (fp > bug + 0.15), "False positive")
        .when(tie, "tie")
        .otherwise("Needs review"),
    )
    return (
        df.withColumn("confidence", F.when(F.col("__step") == "tie", F.greatest(F.col("confidence"), F.lit(0.50))).otherwise(F.col("confidence")))
        .withColumn("classification", F.when(F.col("__step") == "tie", side(F.col("top_polarity") == "bug")).otherwise(F.col("__step")))
        .drop("__step")
    )


def decide(df: DataFrame) -> DataFrame:
    """Evidence to decision: classification, confidence, reasons, dominant."""
    df = critical_flags(scores(df))
    top = F.array_max(F.transform("evidence", lambda e: F.struct(e["weight_c"].alias("w"), (-e["seq"]).alias("s"), e["polarity"].alias("p"))))
    df = (
        df.withColumn("n_insufficient", F.size(F.filter("evidence", lambda e: e["label"] == "insufficient_context")))
        .withColumn("__top", top)
        .withColumn("top_weight", F.coalesce(F.col("__top.w"), F.lit(0)))
        .withColumn("top_polarity", F.coalesce(F.col("__top.p"), F.lit("")))
        .drop("__top")
    )
    df = confidence_and_class(df)
    ranked = F.array_sort(
        F.transform(
            "evidence",
            lambda e: F.struct((-e["weight_c"]).alias("w"), e["seq"].alias("seq"), e["polarity"].alias("polarity"), e["label"].alias("label"), e["description"].alias("description")),
        )
    )
    df = df.withColumn("__ranked", ranked)

    def best(polarity: str, k: int) -> Column:
        return F.slice(F.filter("__ranked", lambda e: e["polarity"] == polarity), 1, k)

    dominant = (
        F.when(F.col("classification") == "Bug", best("bug", 3))
        .when(F.col("classification") == "False positive", best("fp", 3))
        .otherwise(F.concat(best("bug", 2), best("fp", 2)))
    )
    df = df.withColumn("dominant", dominant).drop("__ranked")
    shown = F.transform("dominant", lambda e: F.concat_ws(": ", e["label"], F.when(e["description"] != "", e["description"])))
    nothing = F.array(F.lit("Insufficient evidence for automatic classification."))
    reasons = F.concat(F.array(confidence_sentence(F.col("confidence"))), F.when(F.size("dominant") > 0, shown).otherwise(nothing))
    return df.withColumn("reasons", reasons).withColumn("confidence", F.round("confidence", 2))


def conflicts(df: DataFrame) -> DataFrame:
    """Bug and false-positive evidence about the same thing (D7): cid, bug_label, fp_label.

    Labels meet when equal or when both hold a domain word. The pairs are built
    inside the row from at most one entry per rule.
    """
    words = F.array(*[F.lit(w) for w in dim.DOMAIN_WORDS])
    both = lambda a, b: F.exists(words, lambda w: (F.instr(a["label"], w) > 0) & (F.instr(b["label"], w) > 0))
    pairs = F.flatten(
        F.transform(
            F.filter("evidence", lambda e: e["polarity"] == "bug"),
            lambda b: F.transform(
                F.filter("evidence", lambda f: (f["polarity"] == "fp") & ((f["label"] == b["label"]) | both(b, f))),
                lambda f: F.struct(b["label"].alias("bug_label"), f["label"].alias("fp_label")),
            ),
        )
    )
    return df.select("cid", F.explode(pairs).alias("p")).select("cid", "p.bug_label", "p.fp_label")
