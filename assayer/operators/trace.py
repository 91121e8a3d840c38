"""Event-trace operators.

A trace is a long table ``trace(cid, ordinal, step, tag, description, file, line,
main[, main_heuristic])``; ``ordinal`` is the list position and is unique inside
a cid. Everything per finding is a partial aggregate (``min``/``min_by``/``max_by``),
never a window, so one finding holding a third of all events is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions import text as t
from assayer.functions.frames import positions

# order of preference in an election
MAIN, LAST_NON_PATH, LAST_ANY = -1, 10, 20


def sink_rank(tag: Column, checker: Column) -> Column:
    """0 primary sink, 1 checker-prefixed variant, 2 secondary, NULL no sink."""
    return _rank(t.norm_tag(tag), t.norm_tag(checker))


def _rank(tag: Column, chk: Column) -> Column:
    """Rank of names that are already normalised."""
    head = F.substring_index(tag, "_", 1)
    prefix = F.concat(chk, F.lit("_"))
    suffix_head = F.substring_index(F.substring(tag, F.length(prefix) + 1, F.length(tag)), "_", 1)
    return (
        F.when(tag == "", None)
        .when((chk != "") & (tag == chk), 0)
        .when(tag.isin(*dim.STRONG_SINK_TAGS), 0)
        .when(head.isin(*dim.PATH_HEADS), None)
        .when(tag.isin(*dim.WEAK_SINK_TAGS), 2)
        .when(chk == "", None)
        .when(tag.startswith(prefix), F.when(suffix_head.isin(*dim.SECONDARY_SUFFIXES), 2).otherwise(1))
        .when(chk.startswith(head), 1)
    )


def is_path_event(tag: Column) -> Column:
    return _is_path(t.norm_tag(tag))


def _is_path(tag: Column) -> Column:
    return (tag != "") & F.substring_index(tag, "_", 1).isin(*dim.PATH_HEADS)


def is_sink_event(tag: Column, checker: Column) -> Column:
    return F.coalesce(sink_rank(tag, checker).isin(0, 1), F.lit(False))


def _preference(main: Column, rank: Column, path: Column) -> Column:
    """Sort key of one event; the smallest key of a finding is elected."""
    prio = F.when(main, MAIN).otherwise(F.coalesce(rank, F.when(path, LAST_ANY).otherwise(LAST_NON_PATH)))
    latest_first = main | rank.isNull()
    step = F.coalesce(F.col("step"), F.lit(0)).cast("bigint")
    return F.struct(
        prio.cast("int").alias("prio"),
        F.when(latest_first, -step).otherwise(step).alias("by_step"),
        F.col("ordinal").alias("ordinal"),
        F.col("line").cast("bigint").alias("line"),
    )


def _reason(best: Column) -> Column:
    return (
        F.when(best.isNull(), "")
        .when(best["prio"] == MAIN, "main_event")
        .when(best["prio"] < LAST_NON_PATH, "sink_event")
        .otherwise("last_event")
    )


def _with_checker(trace: DataFrame, findings: DataFrame | None) -> DataFrame:
    if "checker" in trace.columns:
        return trace
    if findings is None:
        return trace.withColumn("checker", F.lit(""))
    return trace.join(findings.select("cid", "checker"), "cid", "left")


def _ranked(events: DataFrame) -> DataFrame:
    """Add __rank and __path; names are normalised once per event."""
    named = events.withColumns({"__t": t.norm_tag(F.col("tag")), "__c": t.norm_tag(F.col("checker"))})
    ranked = named.withColumns({"__rank": _rank(F.col("__t"), F.col("__c")), "__path": _is_path(F.col("__t"))})
    return ranked.drop("__t", "__c")


def elect(trace: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Main event per finding: cid, ordinal, line, reason.

    Only events with a line stand. Main flag first (latest step), then sink rank
    (earliest step), then the last event off the path, then the last event.
    """
    events = _with_checker(trace, findings).where(F.coalesce("line", F.lit(0)) != 0)
    key = _preference(F.coalesce("main", F.lit(False)), F.col("__rank"), F.col("__path"))
    best = _ranked(events).groupBy("cid").agg(F.min(key).alias("best"))
    return best.select(
        "cid", F.col("best.ordinal").alias("ordinal"), F.col("best.line").alias("line"), _reason(F.col("best")).alias("reason")
    )


def _elections(trace: DataFrame, findings: DataFrame | None) -> DataFrame:
    """Both elections a re-marking needs, in one aggregate: with the flags as they
    stand, and with heuristic flags cleared."""
    events = _with_checker(trace, findings)
    if "main_heuristic" not in events.columns:
        events = events.withColumn("main_heuristic", F.lit(False))
    main = F.coalesce("main", F.lit(False))
    genuine = main & ~F.coalesce("main_heuristic", F.lit(False))
    rank, path = F.col("__rank"), F.col("__path")
    lined = F.coalesce("line", F.lit(0)) != 0
    return _ranked(events).groupBy("cid").agg(
        F.max(genuine).alias("has_genuine"),
        F.min(F.when(lined, _preference(main, rank, path))).alias("as_is"),
        F.min(F.when(lined, _preference(genuine, rank, path))).alias("cleared"),
    )


def mark_main(trace: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Flag one event as main where the source flagged none (E5).

    A genuine flag is never touched; a heuristic flag is decided again, so the
    call may be repeated once the checker is known.
    """
    if "main_heuristic" not in trace.columns:
        trace = trace.withColumn("main_heuristic", F.lit(False))
    chosen = _elections(trace, findings).select("cid", "has_genuine", F.col("cleared.ordinal").alias("__winner"))
    won = F.coalesce(F.col("ordinal") == F.col("__winner"), F.lit(False))
    return (
        trace.join(chosen, "cid")
        .withColumn("main_heuristic", F.when(F.col("has_genuine"), F.coalesce("main_heuristic", F.lit(False))).otherwise(won))
        .withColumn("main", F.when(F.col("has_genuine"), F.coalesce("main", F.lit(False))).otherwise(won))
        .drop("has_genuine", "__winner")
    )


def trace_line(trace: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Line and reason after marking: cid, event_line, event_reason.

    Without a genuine flag the elected event is itself marked main, so its reason
    reads 'main_event'. One aggregate; the marked trace is not needed.
    """
    e = _elections(trace, findings)
    best = F.when(F.col("has_genuine"), F.col("as_is")).otherwise(F.col("cleared"))
    reason = F.when(F.col("has_genuine"), _reason(F.col("as_is"))).otherwise(
        F.when(F.col("cleared").isNull(), "").otherwise("main_event")
    )
    return e.select("cid", F.coalesce(best["line"], F.lit(0)).alias("event_line"), reason.alias("event_reason"))


def apply_trace(findings: DataFrame, trace: DataFrame) -> DataFrame:
    """Override the line of a finding from its trace.

    Fallbacks when no event has a line: rest_main_line, instance_line, merged_line.
    Adds line_src and line_prev.
    """
    for name in ("rest_main_line", "instance_line", "merged_line", "line_prev"):
        if name not in findings.columns:
            findings = findings.withColumn(name, F.lit(0).cast("bigint"))
    if "line_src" not in findings.columns:
        findings = findings.withColumn("line_src", F.lit(""))
    joined = findings.join(trace_line(trace, findings), "cid", "left")
    ev = F.coalesce("event_line", F.lit(0))
    old = t.to_int(F.col("line"))
    fall = [("rest_main_line", "rest_main"), ("instance_line", "instance"), ("merged_line", "merged")]
    line, src = F.when(ev != 0, ev), F.when(ev != 0, F.col("event_reason"))
    for name, label in fall:
        line = line.when(t.to_int(F.col(name)) != 0, t.to_int(F.col(name)))
        src = src.when(t.to_int(F.col(name)) != 0, label)
    return (
        joined.withColumn("line_prev", F.when((ev != 0) & (old != 0) & (old != ev), old).otherwise(t.to_int(F.col("line_prev"))))
        .withColumn("line_src", src.otherwise(t.txt(F.col("line_src"))))
        .withColumn("line", line.otherwise(old))
        .drop("event_line", "event_reason")
    )


OVERLAY_TEXT = ("checker", "file", "function", "type", "severity")


def overlay_lines(findings: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay current lines from a second source (E7); adds ``line_fixed``.

    ``overlay(cid, ordinal, line, main_event_line, ...)``; the last row per cid
    counts. A main-event line is never replaced by an occurrence line.
    """
    extra = [c for c in OVERLAY_TEXT if c in overlay.columns and c in findings.columns]
    one = overlay.groupBy("cid").agg(
        F.max_by(
            F.struct(
                t.to_int(F.col("line")).alias("line"),
                t.to_int(F.col("main_event_line")).alias("main_event_line"),
                *[F.col(c).alias(c) for c in extra],
            ),
            "ordinal",
        ).alias("__o")
    )
    joined = findings.join(one, "cid", "left")
    main = F.coalesce(F.col("__o.main_event_line"), F.lit(0))
    new = F.coalesce(F.nullif(main, F.lit(0)), F.nullif(F.col("__o.line"), F.lit(0)), F.lit(0))
    settled = t.txt(F.col("line_src")).isin("main_event", "sink_event", "rest_main") & (main == 0)
    take = (new != 0) & ~settled
    old = t.to_int(F.col("line"))
    changed = take & (old != new)
    out = joined.withColumn("line_fixed", changed)
    if "line_prev" not in findings.columns:
        out = out.withColumn("line_prev", F.lit(0).cast("bigint"))
    out = (
        out.withColumn("line_prev", F.when(changed, old).otherwise(F.col("line_prev")))
        .withColumn(
            "line_src",
            F.when(take, F.when(main != 0, "rest_main").otherwise("rest")).otherwise(t.txt(F.col("line_src"))),
        )
        .withColumn("line", F.when(take, new).otherwise(old))
    )
    for name in extra:
        fill = (new != 0) & (t.txt(F.col(name)) == "")
        out = out.withColumn(name, F.when(fill, t.first_text(F.col(f"__o.{name}"))).otherwise(F.col(name)))
    return out.drop("__o")


def fill_traces(own: DataFrame, listed: DataFrame, stream_events: DataFrame) -> DataFrame:
    """Traces of findings that came without one, from their streams in rank order.

    ``own`` trace rows win. ``listed(cid, stream_rank)``: a stream lists a cid even
    with an empty trace, and the first listing stream decides.
    ``stream_events(cid, stream_rank, ...)`` has the columns of ``own`` otherwise.
    """
    have = own.select("cid").distinct()
    first = listed.groupBy("cid").agg(F.min("stream_rank").alias("stream_rank"))
    missing = first.join(have, "cid", "left_anti")
    filled = stream_events.join(missing, ["cid", "stream_rank"]).select(*own.columns)
    return own.unionByName(filled)


def line_columns(trace: DataFrame) -> DataFrame:
    """main_event_line: first main event's; last_event_line: highest step's."""
    return trace.groupBy("cid").agg(*_line_aggregates())


def _line_aggregates() -> list[Column]:
    last = F.struct(F.coalesce("step", F.lit(0)).alias("step"), (-F.col("ordinal")).alias("o"))
    return [
        F.coalesce(F.min_by("line", F.when(F.col("main"), F.col("ordinal"))), F.lit(0)).cast("bigint").alias("main_event_line"),
        F.coalesce(F.max_by("line", last), F.lit(0)).cast("bigint").alias("last_event_line"),
    ]


def event_facts(trace: DataFrame) -> DataFrame:
    """Per-event facts read from tag and description (columns f_*)."""
    return _prepared(trace).select("cid", "ordinal", *_event_columns())


def _prepared(trace: DataFrame) -> DataFrame:
    """Tag and description normalised once per event."""
    tag = F.replace(F.replace(F.lower(t.txt(F.col("tag"))), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    desc = t.strip(F.col("description"))
    return trace.select("cid", "ordinal", "description", tag.alias("__tag"), desc.alias("__desc"), F.lower(desc).alias("__low"))


def _event_columns() -> list[Column]:
    # Patterns of event descriptions
    tag, desc, low = F.col("__tag"), F.col("__desc"), F.col("__low")
    guard_text = low.rlike(r"!=\s*null|!=\s*0\b|!\s*\w+\b") | low.rlike(r"<\s*\w+|>=\s*0|within\s+bounds")
    true_guard = (tag == "condition") & (F.instr(low, "true branch") > 0) & guard_text

    def number(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(desc, pattern, group), F.lit("")).try_cast("bigint")

    overrun, buffer = tag.isin(*dim.OVERRUN_TAGS), tag.isin(*dim.BUFFER_TAGS)
    confirmed = tag.isin(*dim.CONFIRMING_TAGS)
    size = F.when(
        overrun,
        F.coalesce(
            number(r"(?i)array\s+(?:size|length)\s+(?:is\s+)?(\d+)"),
            number(r"(?i)array\s+[\"']?([\w.\->]+)[\"']?\s+of\s+(\d+)\s+bytes", 2),
        ),
    ).when(buffer, number(r"(?i)destination\s+(?:array|buffer|string)\s+['\"]\S+['\"]\s+of\s+size\s+(\d+)\s+bytes"))
    index = F.when(
        overrun,
        F.coalesce(
            number(r"(?i)index\s+(?:may\s+be\s+|is\s+)(-?\d+)"),
            number(r"(?i)index\s+[\"']?([\w.\->+ ]+)[\"']?\s+\(which\s+evaluates\s+to\s+(-?\d+)\)", 2),
        ),
    ).when(buffer, number(r"(?i)(?:maximum\s+)?size\s+argument\s+of\s+(\d+)\s+bytes"))
    null_var = F.when(
        (F.instr(tag, "null") > 0) | (F.instr(low, "null") > 0),
        F.nullif(
            F.regexp_extract(desc, r"(?i)pointer\s+[\"']?(\w+)[\"']?\s+(?:has\s+value\s+null|is\s+null)", 1), F.lit("")
        ),
    )
    assigns, returns = tag.isin("assignment", "var_assign_op"), tag.isin("return_constant", "return_value")
    now_value = r"(?i)value of\s+[\"']?(\w+)[\"']?\s+is\s+now\s+(-?\d+)"
    restated = r"(?i)\b(\w+)\s*=.*?[.;]\s*\1\s+is\s+(-?\d+)"
    returned = r"(?i)\"?(\w+)\(\)\"?\s+(?:may\s+)?return[s]?\s+(-?\d+)"

    def pair(kind: str, gate: Column, pattern: str) -> Column:
        return F.when(
            gate & desc.rlike(pattern),
            F.struct(
                F.lit(kind).alias("kind"),
                F.regexp_extract(desc, pattern, 1).alias("name"),
                F.regexp_extract(desc, pattern, 2).try_cast("bigint").alias("value"),
            ),
        )

    values = F.filter(
        F.array(pair("variable", assigns, now_value), pair("variable", assigns, restated), pair("return", returns, returned)),
        lambda x: x.isNotNull(),
    )
    return [
        (confirmed | (buffer & desc.rlike(r"(?i)unterminated|null.terminat"))).alias("f_defect"),
        (confirmed & ((F.instr(tag, "tainted") > 0) | (F.instr(tag, "user_input") > 0))).alias("f_taint"),
        (tag.isin(*dim.GUARD_TAGS) | true_guard).alias("f_guard"),
        true_guard.alias("f_guard_true"),
        size.alias("f_size"),
        index.alias("f_index"),
        null_var.alias("f_null_var"),
        values.alias("f_values"),
        (low.rlike("unterminated|null.terminat|no.*null|buffer.size") | (F.contains(low, F.lit("equals")) & low.rlike("size.*equals|equals.*size"))).alias("f_size_equal"),
        low.rlike("check|guard|compare|test|verify").alias("f_validates"),
        F.when(F.contains(low, F.lit("calling")), _sink_call(desc)[0]).alias("f_sink_precise"),
        F.when(F.contains(low, F.lit("calling")), _sink_call(desc)[1]).alias("f_sink_generic"),
    ]


def _sink_call(description: Column) -> tuple[Column, Column]:
    """Copy function named by an event: precise overflow text, else 'calling X'."""
    d = t.txt(description)
    # The two phrasings
    precise = F.lower(
        F.regexp_extract(
            d,
            r"[Cc]alling\s+['\"](\w+)['\"]\s+with\s+a\s+(?:maximum\s+)?size\s+argument\s+of\s+\d+\s+bytes\s+on\s+"
            r"destination\s+(?:array|buffer|string)",
            1,
        )
    )
    loose = r"[Cc]alling\s+['\"](\w+)['\"]|[Cc]alling\s+(\w+)\b"
    generic = F.lower(F.concat(F.regexp_extract(d, loose, 1), F.regexp_extract(d, loose, 2)))
    return F.when(precise.isin(*dim.SINKS), precise), F.when(generic.isin(*dim.SINKS), generic)


def trace_facts(trace: DataFrame) -> DataFrame:
    """One row of facts per finding (E10, E12): flags are any, scalars the last event's."""
    return event_facts(trace).groupBy("cid").agg(*_fact_aggregates())


def trace_summary(trace: DataFrame) -> DataFrame:
    """:func:`trace_facts` and :func:`described_variables` from one pass over the trace."""
    events = _prepared(trace).select("cid", "ordinal", *_event_columns(), *_described_columns())
    return events.groupBy("cid").agg(*_fact_aggregates(), *_described_aggregates())


def _fact_aggregates() -> list[Column]:
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal")))
    return [
        F.max("f_defect").alias("defect_confirmed"),
        F.max("f_taint").alias("taint_confirmed"),
        F.max("f_guard").alias("guard_on_path"),
        F.max("f_guard_true").alias("guard_takes_true"),
        last("f_size").alias("array_size"),
        last("f_index").alias("index_value"),
        F.coalesce(last("f_null_var"), F.lit("")).alias("null_var"),
        F.max("f_size_equal").alias("size_equal_in_trace"),
        F.max("f_validates").alias("trace_validates"),
        F.coalesce(last("f_sink_precise"), last("f_sink_generic"), F.lit("")).alias("trace_sink"),
        F.count(F.lit(1)).alias("n_events"),
    ]


def trace_values(trace: DataFrame) -> DataFrame:
    """Values named by a trace, last event wins: cid, kind, name, value.

    Kept long: one row per name, so no finding collects its whole trace."""
    e = event_facts(trace).select("cid", "ordinal", F.posexplode("f_values").alias("pos", "v"))
    return e.groupBy("cid", F.col("v.kind").alias("kind"), F.col("v.name").alias("name")).agg(
        F.max_by(F.col("v.value"), F.struct("ordinal", "pos")).alias("value")
    )


def trace_maps(trace: DataFrame) -> DataFrame:
    """The same values as two MAP columns, for findings of ordinary size."""
    v = trace_values(trace)

    def as_map(kind: str) -> Column:
        entry = F.when(F.col("kind") == kind, F.struct("name", "value"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    return v.groupBy("cid").agg(as_map("variable").alias("variables"), as_map("return").alias("return_values"))


def described_variables(trace: DataFrame) -> DataFrame:
    """Destination, source and sizes named by descriptions.

    The precise phrase overwrites (last one wins); generic phrases fill only
    what is still empty at their place in the trace.
    """
    return trace.select("cid", "ordinal", *_described_columns()).groupBy("cid").agg(*_described_aggregates())


def _described_columns() -> list[Column]:
    # phrases
    precise = (
        r"[Cc]alling\s+['\"][\w]+['\"]\s+with\s+a\s+(?:maximum\s+)?size\s+argument\s+of\s+(\d+)\s+bytes\s+on\s+"
        r"destination\s+(?:array|buffer|string)\s+['\"]([^'\"]+)['\"]"
    )
    d = t.txt(F.col("description"))
    is_precise = F.contains(d, F.lit("destination")) & d.rlike(precise)

    def named(kind: str) -> Column:
        pattern = kind + r"\s+(?:array|buffer|string)?\s*['\"]([^'\"]+)['\"]"
        return F.when(F.contains(d, F.lit(kind)) & ~is_precise & d.rlike(pattern), t.strip(F.regexp_extract(d, pattern, 1)))

    return [
        F.when(is_precise, t.strip(F.regexp_extract(d, precise, 2))).alias("precise_dest"),
        F.when(is_precise, F.regexp_extract(d, precise, 1).try_cast("bigint")).alias("size_bytes"),
        F.when(is_precise, F.nullif(F.regexp_extract(d, r"of\s+size\s+(\d+)\s+bytes", 1), F.lit("")).try_cast("bigint")).alias("buffer_bytes"),
        named("destination").alias("loose_dest"),
        named("source").alias("loose_src"),
    ]


def _described_aggregates() -> list[Column]:
    def pick(fn, c: str) -> Column:
        return fn(c, F.when(F.col(c).isNotNull(), F.col("ordinal")))

    return [
        F.coalesce(pick(F.max_by, "precise_dest"), pick(F.min_by, "loose_dest"), F.lit("")).alias("dest_var"),
        F.coalesce(pick(F.min_by, "loose_src"), F.lit("")).alias("src_var"),
        F.coalesce(pick(F.max_by, "size_bytes"), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.coalesce(pick(F.max_by, "buffer_bytes"), F.lit(0)).cast("bigint").alias("buffer_bytes"),
    ]


def trace_text(trace: DataFrame, part_size: int | None = None) -> DataFrame:
    """Descriptions and tags of a trace in order (E13): cid, text, tags, one row per cid.

    With ``part_size`` a longer trace goes on in further rows (cid, part) of so many consecutive events.
    """
    rows = trace.select("cid", "ordinal", t.txt(F.col("description")).alias("__d"), t.txt(F.col("tag")).alias("__g"))
    keys = ["cid"]
    if part_size is not None:
        rows, keys = positions(rows, ["cid"], "ordinal").withColumn("part", F.floor(F.col("position") / part_size).cast("bigint")), ["cid", "part"]
    events = F.array_sort(F.collect_list(F.struct("ordinal", F.col("__d").alias("d"), F.col("__g").alias("g"))))
    joined = lambda f, separator: F.array_join(F.transform("__e", lambda x: x[f]), separator)
    return rows.groupBy(*keys).agg(events.alias("__e")).select(*keys, joined("d", " | ").alias("text"), joined("g", ",").alias("tags"))


def synthetic_events(findings: DataFrame, trace: DataFrame) -> DataFrame:
    """One event for each finding without a trace."""
    bare = findings.join(trace.select("cid").distinct(), "cid", "left_anti")
    return bare.select(
        "cid",
        F.lit(1).cast("bigint").alias("step"),
        F.lit(0).cast("bigint").alias("ordinal"),
        t.txt(F.col("checker")).alias("tag"),
        t.txt(F.col("type")).alias("description"),
        t.txt(F.col("file")).alias("file"),
        t.to_int(F.col("line")).alias("line"),
        F.lit(False).alias("main"),
    )


def provenance_report(findings: DataFrame, trace: DataFrame, shown: int = 5) -> DataFrame:
    """Every line source of a finding and its first events (A10): one aggregate over the numbered trace."""
    placed = positions(trace, ["cid"], "ordinal")
    event = F.concat_ws(":", F.col("step").cast("string"), F.when(F.col("main"), "main").otherwise("-"), F.col("line").cast("string"), F.col("tag"))
    first = F.collect_list(F.when(F.col("position") < shown, F.struct("position", event.alias("x"))))  # ``shown`` entries at most
    report = placed.groupBy("cid").agg(
        F.count(F.lit(1)).alias("n_events"), *_line_aggregates(), F.array_join(F.transform(F.array_sort(first), lambda e: e["x"]), " ").alias("first_events")
    )
    return findings.join(report, "cid", "left").fillna({"n_events": 0, "main_event_line": 0, "last_event_line": 0, "first_events": ""})
