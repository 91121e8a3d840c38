"""Counts, breakdowns, grouping and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions.frames import positions
from assayer.functions import text as t


def class_counts(results: DataFrame, review: bool = False) -> DataFrame:
    """Findings per class; in the review summary accepted rows count as 'Accepted' (A1)."""
    cls: Column = F.col("classification")
    if review:
        cls = F.when(F.coalesce("accepted", F.lit(False)), "Accepted").otherwise(cls)
    return results.groupBy(cls.alias("classification")).agg(F.count(F.lit(1)).alias("n"))


def with_total(df: DataFrame, key: str) -> DataFrame:
    """Counts per key plus a 'Total' row, from one pass over the input."""
    return (
        df.rollup(key)
        .agg(F.count(F.lit(1)).alias("n"), F.grouping(key).alias("__g"))
        .select(F.when(F.col("__g") == 1, "Total").otherwise(F.col(key)).alias(key), "n")
    )


def in_category_order(results: DataFrame) -> DataFrame:
    """Findings in display order of their category, then report order (A3): adds category_order and ``place`` (from 1).

    Places inside a category are exact positions, also where a category holds most findings; a running sum over
    the few categories moves them up. Unknown categories come last.
    """
    order = dim.category_order(results.sparkSession)
    known = results.join(F.broadcast(order), "category", "left").withColumn("category_order", F.coalesce("category_order", F.lit(1_000_000)))
    running = Window.orderBy("category_order").rowsBetween(Window.unboundedPreceding, -1)
    sizes = known.groupBy("category_order").agg(F.count(F.lit(1)).alias("__n"))  # one row per category
    starts = sizes.select("category_order", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__start"))
    placed = positions(known, ["category_order"], "ordinal").join(F.broadcast(starts), "category_order")
    return placed.withColumn("place", (F.col("position") + F.col("__start") + 1).cast("bigint")).drop("position", "__start").orderBy("place")


def needs_review_breakdown(results: DataFrame, top: int = 10) -> DataFrame:
    """Needs-review rows by reason, checker (top n) and category (A4)."""
    review = results.where(F.col("classification") == "Needs review")
    sets = review.groupingSets(
        [[F.col("reason")], [F.col("checker")], [F.col("category")]], F.col("reason"), F.col("checker"), F.col("category")
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__g"))
    # bits of grouping_id: reason 4, checker 2, category 1; a set bit is rolled up
    named = sets.select(
        F.when(F.col("__g") == 3, "reason").when(F.col("__g") == 5, "checker").otherwise("category").alias("facet"),
        F.coalesce("reason", "checker", "category").alias("value"),
        "n",
    )
    checkers = named.where(F.col("facet") == "checker").orderBy(F.desc("n"), "value").limit(top)
    return named.where(F.col("facet") != "checker").unionByName(checkers)


def completeness(findings: DataFrame, trace: DataFrame) -> DataFrame:
    """Rows, rows with a trace, rows with a detail page, rows with a line (A5)."""
    have = trace.select("cid").distinct().withColumn("__t", F.lit(True))
    detail = t.txt(F.col("detail_file")) != "" if "detail_file" in findings.columns else F.lit(False)
    return findings.join(have, "cid", "left").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("__t")).alias("with_trace"),
        F.count_if(F.col("__t").isNull()).alias("without_trace"),
        F.count_if(detail).alias("with_detail"),
        F.count_if(F.coalesce("line", F.lit(0)) != 0).alias("with_line"),
    )


def distinct_paths(findings: DataFrame) -> DataFrame:
    """Distinct non-blank paths."""
    path = t.strip(F.col("file"))
    return findings.where(path != "").select(path.alias("file")).distinct()


def first_names(df: DataFrame, key: str, name: str, k: int = 3) -> DataFrame:
    """The k first distinct names per key, sorted and joined (A6). Names are
    reduced to distinct ones and ranked before any of them is collected."""
    from pyspark.sql import Window

    distinct = df.select(key, name).distinct()
    ranked = distinct.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(name))).where(F.col("__r") <= k)
    return ranked.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names"))


def sorted_in_groups(results: DataFrame, column: str) -> DataFrame:
    """Categories in display order; inside, numbers before text, text without case."""
    order = dim.category_order(results.sparkSession)
    text = t.txt(F.col(column))
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))
    return results.join(F.broadcast(order), "category", "left").orderBy(
        "category_order", number.asc_nulls_last(), F.lower(text), "ordinal"
    )


def inventory(listing: DataFrame) -> DataFrame:
    """Files and bytes per extension over the whole listing."""
    return listing.groupBy(t.extension(F.col("path")).alias("extension")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").cast("bigint").alias("bytes")
    )
