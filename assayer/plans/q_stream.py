"""Queries on streams (T1-T4). The given tables are read as streams and drained; state,
checkpoints and written versions lie in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.plans import views as v
from assayer.plans.q_findings import CATS
from assayer.plans.q_trace import RANKED
from assayer.plans.registry import query
from assayer.session import scratch_dir
from assayer.sources import decision_log
from assayer.streaming import live


def _stream(spark, d, name):
    return live.stream_tables(spark, d, name, v.table(spark, d, name).schema)


@query("SELECT category, classification, count(*) AS n FROM v_cat GROUP BY 1, 2", CATS)
def running_counts(spark, d):
    """T1."""
    findings = _stream(spark, d, "orders").selectExpr(*v.FINDINGS)
    updates = live.drain(
        live.running_counts(findings, ["category", "classification"]), scratch_dir(spark, "counts"), scratch_dir(spark, "counts-state"), "update"
    )
    return live.current(updates, ["category", "classification"])


@query("SELECT cid, max(ordinal) AS ordinal, arg_max(classification, ordinal) AS classification, arg_max(comment, ordinal) AS comment FROM v_decisions GROUP BY 1")
def stream_upsert(spark, d):
    """The last action per finding, kept in a base and a log of batches."""
    table = scratch_dir(spark, "decisions")
    rows = _stream(spark, d, "events").selectExpr(*v.DECISIONS)
    live.upsert_stream(rows, table, scratch_dir(spark, "decisions-state")).awaitTermination()
    return decision_log.current(spark, table, rows.schema).select("cid", "ordinal", "classification", "comment")


@query("SELECT DISTINCT cid FROM v_decisions")
def stream_dedup(spark, d):
    """Each finding once, whenever its pages come."""
    table, rows = scratch_dir(spark, "pages"), _stream(spark, d, "events").selectExpr(*v.DECISIONS)
    live.first_arrivals(rows, table, scratch_dir(spark, "pages-state")).awaitTermination()
    return live.arrived(spark, table, rows.schema).select("cid")


@query(
    "SELECT cid, line, reason FROM v_elected",
    {**RANKED, "v_tagged": RANKED["v_tagged"].replace("coalesce(f.checker, '') AS checker", "'' AS checker").replace("coalesce(replace(replace(lower(trim(checker)), ' ', '_'), '-', '_'), '') AS c", "'' AS c")},
)
def stream_main_event(spark, d):
    """T4: elected without the checker, state is the best candidate."""
    updates = live.drain(live.running_main_event(_stream(spark, d, "lineitem").selectExpr(*v.TRACE)), scratch_dir(spark, "main"), scratch_dir(spark, "main-state"), "update")
    return live.current(updates, ["cid"]).select("cid", "line", "reason")
