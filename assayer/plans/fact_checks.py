"""SQL of the facts that rules read: from the trace and the code of each finding, one view per family.

The views read ``v_code`` (cid, code, code_start_line, line, function, checker), its ``code_lines``
and ``v_trace``; nothing here is a function of the finding's number.
"""

from __future__ import annotations

import re

from assayer import dimensions as dim
from assayer.plans import q_code, q_trace
from assayer.plans import rule_checks as checks
from assayer.plans.registry import quoted_list


def renamed(views: dict[str, str], names: dict[str, str]) -> dict[str, str]:
    """The same views under other names, inside their texts too."""
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b") if names else None
    return {names.get(k, k): pattern.sub(lambda m: names[m[1]], text) for k, text in views.items()}


def prefixed(views: dict[str, str], prefix: str) -> dict[str, str]:
    return renamed(views, {k: prefix + k for k in views})


def first(*values: str) -> str:
    """First value that is neither NULL nor empty."""
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in values) + ", '')"


SHARED = "('BUFFER_SIZE', 'OVERRUN', 'INTEGER_OVERFLOW', 'STRING_NULL', 'REVERSE_INULL', 'FORWARD_NULL', 'RESOURCE_LEAK', 'DEADCODE')"
_ARGS = r"list_filter(list_transform(regexp_extract_all(a, '(?:[^,()]|\([^()]*\))+'), lambda x: trim(x)), lambda x: x <> '')"
_CALLED = r"regexp_extract(text, '\b' || sink_func || '\s*\(((?:[^()]|\([^()]*\))*)\)', 1)"


def scope(name: str, asked: str) -> dict[str, str]:
    """The first guard that names ``v`` of ``asked(cid, v)``, and whether its block covers the flagged line."""
    return {
        f"{name}_first": f"SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY g.cid ORDER BY g.i) AS rn FROM v_guard g JOIN {asked} a USING (cid) WHERE a.v <> '' AND (g.var = a.v OR contains(g.cond, a.v))) WHERE rn = 1",
        f"{name}_from": f"""
SELECT l.cid, l.i, l.rel, g.i AS g, l.text, sum(length(replace(l.text, '}}', '')) - length(replace(l.text, '{{', ''))) OVER (PARTITION BY l.cid ORDER BY l.i) AS depth,
 sum(CASE WHEN contains(l.text, '{{') THEN 1 ELSE 0 END) OVER (PARTITION BY l.cid ORDER BY l.i) AS opened FROM {name}_first g JOIN code_lines l ON l.cid = g.cid AND l.i >= g.i""",
        f"{name}_end": f"SELECT cid, min(i) AS e FROM {name}_from WHERE depth <= 0 AND opened > 0 GROUP BY 1",
        f"{name}_scope": f"""
SELECT cid, g, inside, leaves OR g < 3 OR inside AS covers FROM (SELECT f.cid, f.g, bool_or(regexp_matches(f.text, 'return|exit|goto')) AS leaves, coalesce(any_value(f.rel = f.g OR (f.rel > f.g AND f.rel < e.e)), false) AS inside
 FROM {name}_from f LEFT JOIN {name}_end e USING (cid) WHERE e.e IS NULL OR f.i <= e.e GROUP BY 1, 2)""",
    }


TRACE_FACTS = {
    "v_facts": q_trace._FACTS,
    "k_trace": f"""
SELECT cid, bool_or(g IN ({quoted_list(dim.CONFIRMING_TAGS)}) OR (g IN ({quoted_list(dim.BUFFER_TAGS)}) AND regexp_matches(d, '(?i)unterminated|null.terminat'))) AS defect_confirmed,
 bool_or(g = 'tainted_data') AS taint_confirmed, bool_or(g = 'check_return' OR (g = 'condition' AND contains(d, 'true branch'))) AS guard_on_path, bool_or(g = 'condition' AND contains(d, 'true branch')) AS guard_takes_true,
 arg_max(sz, CASE WHEN sz IS NOT NULL THEN ordinal END) AS array_size, arg_max(ix, CASE WHEN ix IS NOT NULL THEN ordinal END) AS index_value, arg_max(nv, CASE WHEN nv IS NOT NULL THEN ordinal END) AS null_var,
 coalesce(arg_max(sp, CASE WHEN sp IN ({quoted_list(dim.SINKS)}) THEN ordinal END), arg_max(sg, CASE WHEN sg IN ({quoted_list(dim.SINKS)}) THEN ordinal END), '') AS trace_sink,
 bool_or(regexp_matches(lower(d), 'check|guard|compare|test|verify')) AS trace_validates,
 bool_or(regexp_matches(lower(d), 'unterminated|null.terminat|no.*null|buffer.size|size.*equals|equals.*size')) AS size_equal_in_trace, count(*) AS n_events FROM v_facts GROUP BY cid""",
    "k_named": r"""
SELECT cid, coalesce(arg_max(pd, CASE WHEN pd IS NOT NULL THEN ordinal END), arg_min(ld, CASE WHEN ld IS NOT NULL THEN ordinal END), '') AS dest_var, coalesce(arg_min(ls, CASE WHEN ls IS NOT NULL THEN ordinal END), '') AS src_var,
 coalesce(arg_max(sb, CASE WHEN sb IS NOT NULL THEN ordinal END), 0) AS size_bytes
FROM (SELECT cid, ordinal, nullif(regexp_extract(description, 'argument of \d+ bytes on destination array ''(\w+)''', 1), '') AS pd, nullif(regexp_extract(description, 'argument of (\d+) bytes on destination', 1), '')::BIGINT AS sb,
 nullif(regexp_extract(description, 'destination buffer ''(\w+)''', 1), '') AS ld, nullif(regexp_extract(description, 'source string ''(\w+)''', 1), '') AS ls FROM v_trace) GROUP BY cid""",
    "k_base": f"""
SELECT c.cid, c.checker, c.function, c.code, c.code_start_line, c.line, CASE WHEN c.code = '' THEN 'GENERIC' ELSE {checks.RULE_SET} END AS rule_set, coalesce(defect_confirmed, false) AS defect_confirmed, coalesce(taint_confirmed, false) AS taint_confirmed,
 coalesce(guard_on_path, false) AS guard_on_path, coalesce(guard_takes_true, false) AS guard_takes_true, coalesce(size_equal_in_trace, false) AS size_equal_in_trace, coalesce(trace_validates, false) AS trace_validates, array_size, index_value,
 coalesce(null_var, '') AS null_var, coalesce(trace_sink, '') AS trace_sink, coalesce(n_events, 0) AS n_events, coalesce(dest_var, '') AS dest_var, coalesce(src_var, '') AS src_var, coalesce(size_bytes, 0) AS size_bytes
FROM v_code c LEFT JOIN k_trace USING (cid) LEFT JOIN k_named USING (cid)""",
}

_RELEASE = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dim.RELEASE_OF.items()) + " ELSE '' END"
_ORIGIN = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in dim.ORIGIN_TEXT.items()) + f" ELSE '{dim.UNKNOWN_ORIGIN}' END"

CALL_FACTS = {
    **q_code.SINK,
    "k_sink": f"SELECT b.cid, {first('b.trace_sink', 's.sink_func')} AS sink_func FROM k_base b JOIN v_sink s USING (cid)",
    "k_calls": rf"""
SELECT cid, sink_func, i, {_CALLED} AS a, row_number() OVER (PARTITION BY cid ORDER BY CASE WHEN line > 0 THEN abs(i - rel) ELSE 0 END, i) AS near, row_number() OVER (PARTITION BY cid ORDER BY i) AS rn
FROM code_lines JOIN k_sink USING (cid) WHERE sink_func <> '' AND regexp_matches(text, '\b' || sink_func || '\s*\(')""",
    "k_args": f"SELECT cid, CASE WHEN len(args) >= 2 THEN args[1] ELSE '' END AS arg_dest, CASE WHEN len(args) >= 2 THEN args[2] ELSE '' END AS arg_src FROM (SELECT cid, {_ARGS} AS args FROM k_calls WHERE near = 1)",
    "k_first": rf"""
SELECT cid, coalesce(regexp_matches(s3, 'sizeof\s*\(\s*\Q' || d3 || '\E') OR s3 = d3 OR (regexp_matches(s3, '\bsizeof\b') AND NOT regexp_matches(s3, '-\s*1\s*$|-\s*sizeof\s*\(')), false) AS full_size
FROM (SELECT cid, string_split_regex(args[1], '[.\->\[\s]')[1] AS d3, args[3] AS s3 FROM (SELECT cid, {_ARGS} AS args FROM k_calls WHERE rn = 1))""",
    "k_alloc": rf"SELECT cid, {_RELEASE.format('fn')} AS release_func FROM (SELECT cid, list_filter(regexp_extract_all(code, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)', 1), lambda f: f IN ({quoted_list(dim.RELEASE_OF)}))[1] AS fn FROM v_code)",
}

NAME_FACTS = {
    "k_names": rf"""
SELECT *, CASE rule_set WHEN 'REVERSE_INULL' THEN {first('null_var', 'src', 'dest', 'guess')} WHEN 'FORWARD_NULL' THEN {first('src', 'dest', 'guess')} ELSE {first('src', 'dest')} END AS var FROM (
 SELECT b.cid, b.rule_set, b.null_var, coalesce(a.arg_src, '') AS arg_src, coalesce(a.arg_dest, '') AS arg_dest, {first('a.arg_dest', 'b.dest_var')} AS dest, {first('a.arg_src', 'b.src_var')} AS src,
  {first(r"regexp_extract(b.code, '\b(\w+)\s*->\s*\w+', 1)", r"regexp_extract(b.code, '\*(\w+)', 1)", r"regexp_extract(b.code, '\b(\w+)\s*\[', 1)",
         rf"list_filter(regexp_extract_all(b.code, '\b([A-Za-z_][A-Za-z0-9_]*)\b', 1), lambda x: x NOT IN ({quoted_list(dim.C_KEYWORDS)}))[1]")} AS guess FROM k_base b LEFT JOIN k_args a USING (cid))""",
    "k_traced": f"SELECT cid, arg_src AS v FROM k_names WHERE rule_set IN {SHARED}",
    "k_guarded": f"SELECT cid, {first('arg_src', 'arg_dest')} AS v FROM k_names WHERE rule_set IN {SHARED}",
    "k_nullable": "SELECT cid, var AS v FROM k_names WHERE rule_set IN ('REVERSE_INULL', 'FORWARD_NULL')",
    **q_code.ORIGIN,
    "v_asked_of": "SELECT cid, v FROM k_traced",
    **q_code.GUARDS,
    **scope("k_arg", "k_guarded"),
    **scope("k_nul", "k_nullable"),
    **q_code.SUCCESS,
}

# what stands around a finding; queries put other rows in its place
AROUND = {"k_around": "SELECT cid, '' AS callee_taint, '' AS corroborated_by, -1 AS n_callers FROM v_code"}

CODE_FACTS = {
    **TRACE_FACTS,
    **CALL_FACTS,
    **NAME_FACTS,
    **AROUND,
    "v_known": rf"""
SELECT b.cid, b.checker, b.function, b.code, b.code_start_line, b.line, b.rule_set, b.defect_confirmed, b.taint_confirmed, b.guard_on_path, b.guard_takes_true, b.size_equal_in_trace, b.trace_validates, b.array_size, b.index_value, b.trace_sink, b.n_events,
 b.rule_set IN ('X') OR (k.sink_func IN ('strncpy', 'strncat') AND coalesce(x.full_size, false)) AS size_equal_in_code,
 n.src <> '' AND regexp_matches(b.code, '\b\Q' || n.src || '\E\b.*sizeof|sizeof.*\b\Q' || n.src || '\E\b') AS src_bounded,
 n.dest <> '' AND EXISTS (SELECT 1 FROM code_lines l WHERE l.cid = b.cid AND l.i < l.rel AND regexp_matches(l.text, '\bmemset\s*\(([^)]*)\)') AND contains(trim(regexp_extract(l.text, '\bmemset\s*\(([^)]*)\)', 1)), n.dest)) AS memset_before,
 coalesce(z.covers, false) AS null_guard_covers, coalesce(z.g + 1, 0) < b.line AS null_guard_before, coalesce(z.inside, false) AS null_guard_inside,
 b.rule_set = 'FORWARD_NULL' AND n.var <> '' AND EXISTS (SELECT 1 FROM v_success s WHERE s.cid = b.cid) AS guarded_by_flag,
 b.function = '' OR regexp_matches(b.function, '(?i)\bmain\b|\b_init\b|\b_fini\b|callback|hook|handler') AS caller_exempt, coalesce(g.covers, false) AS guard_covers,
 CASE WHEN coalesce(o.kind, '') <> '' THEN {_ORIGIN.format('o.kind')} WHEN d.callee_taint <> '' THEN d.callee_taint WHEN b.taint_confirmed THEN 'a tainted external source' ELSE '{dim.UNKNOWN_ORIGIN}' END AS origin,
 k.sink_func, r.release_func, d.corroborated_by, b.null_var, n.var, n.src, n.dest, CASE WHEN g.g IS NULL THEN 0 ELSE g.g + b.code_start_line END::BIGINT AS guard_line, coalesce(z.g + 1, 0)::BIGINT AS null_guard_line,
 b.size_bytes::BIGINT AS dest_size, coalesce(b.index_value, 0)::BIGINT AS copy_size, d.n_callers::BIGINT AS n_callers
FROM k_base b JOIN k_sink k USING (cid) JOIN k_names n USING (cid) JOIN k_alloc r USING (cid) JOIN k_around d USING (cid) LEFT JOIN k_first x USING (cid) LEFT JOIN k_arg_scope g USING (cid) LEFT JOIN k_nul_scope z USING (cid) LEFT JOIN v_origin o USING (cid)""",
}
CODE_FACTS["v_known"] = CODE_FACTS["v_known"].replace("b.rule_set IN ('X') OR (", "(")

_BLANK = ("origin", "sink_func", "release_func", "corroborated_by", "guard_line", "guard_covers")
_DEF = {"origin": "''", "sink_func": "''", "release_func": "''", "corroborated_by": "''", "guard_line": "0", "guard_covers": "false"}
#: Rules, scores and decisions over the facts.
RULED = CODE_FACTS | {
    "v_fact1": "SELECT * REPLACE (" + ", ".join(f"CASE WHEN rule_set = 'GENERIC' THEN {_DEF[c]} ELSE {c} END AS {c}" for c in _BLANK) + "), len(string_split(code, chr(10))) AS n_lines FROM v_known",
    "v_prior": """
SELECT cid, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN defect_confirmed THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN taint_confirmed THEN 0.15 ELSE 0 END::DOUBLE
 + CASE WHEN guard_on_path AND guard_takes_true THEN -0.3 ELSE 0 END::DOUBLE + CASE WHEN len(string_split(code, chr(10))) < 5 THEN -0.2 ELSE 0 END::DOUBLE)) + CASE WHEN corroborated_by <> '' THEN 0.15 ELSE 0 END::DOUBLE), 2) AS prior FROM v_known""",
    "v_fire1": "SELECT *, list_filter([" + ", ".join(checks.FIRST) + "], lambda x: x IS NOT NULL) AS ev1 FROM v_fact1",
    "v_fire": "SELECT cid, checker, rule_set, list_concat(ev1, list_filter([" + ", ".join(checks.LATER) + "], lambda x: x IS NOT NULL)) AS ev FROM v_fire1",
    "v_ev": "SELECT cid, e.seq AS seq, e.label AS label, e.polarity AS polarity, e.w AS w, e.text AS text FROM (SELECT cid, unnest(ev) AS e FROM v_fire)",
    "v_score": f"""
SELECT c.cid, coalesce(sum(w) FILTER (polarity = 'bug'), 0)::INT AS b, coalesce(sum(w) FILTER (polarity = 'fp'), 0)::INT AS f, coalesce(max(label IN ({quoted_list(checks.CRITICAL_BUG)})), false) AS cb,
 coalesce(max(label IN ({quoted_list(checks.CRITICAL_FP)})), false) AS cf, count(*) FILTER (label = 'insufficient_context') AS ins, coalesce(arg_max(w, (w, -seq)), 0) AS tw, coalesce(arg_max(polarity, (w, -seq)), '') AS tp FROM v_code c LEFT JOIN v_ev e USING (cid) GROUP BY 1""",
    "v_conf": """
SELECT *, CASE WHEN ins > 0 THEN greatest(0.0::DOUBLE, c1 - ins * 0.20::DOUBLE) ELSE c1 END AS c FROM (SELECT *, CASE WHEN (cb AND NOT cf AND fs < 0.3) OR (cf AND NOT cb AND bs < 0.3) THEN least(1.0::DOUBLE, c0 + 0.15::DOUBLE) ELSE c0 END AS c1 FROM (
 SELECT *, CASE WHEN b + f = 0 THEN 0.0::DOUBLE WHEN lo = 0 THEN least(1.0::DOUBLE, 0.55::DOUBLE + wi * 0.22::DOUBLE + dom * 0.15::DOUBLE) ELSE least(1.0::DOUBLE, 0.45::DOUBLE + (wi - lo) * 0.30::DOUBLE + wi * 0.12::DOUBLE + dom * 0.15::DOUBLE) END AS c0 FROM (
  SELECT *, CASE WHEN b + f > 0 THEN wi / (bs + fs) ELSE 0.0::DOUBLE END AS dom FROM (SELECT *, greatest(bs, fs) AS wi, least(bs, fs) AS lo FROM (SELECT *, b / 100.0::DOUBLE AS bs, f / 100.0::DOUBLE AS fs FROM v_score)))))""",
    # rounded by its decimal digits: DuckDB rounds a double just below a half upwards
    "v_decided": """
SELECT cid, b, f, round((CASE WHEN step = 'tie' THEN greatest(c, 0.5::DOUBLE) ELSE c END)::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE AS confidence, CASE WHEN step = 'tie' THEN CASE WHEN tp = 'bug' THEN 'Bug' ELSE 'False positive' END ELSE step END AS classification, c AS raw FROM (
 SELECT *, CASE WHEN b + f = 0 THEN 'Needs review' WHEN cb AND NOT cf AND b > f THEN 'Bug' WHEN cf AND NOT cb AND f > b THEN 'False positive'
  WHEN c >= 0.45 AND dom >= 0.62 AND wi - lo >= 0.12 THEN CASE WHEN b > f THEN 'Bug' ELSE 'False positive' END WHEN c >= 0.50 AND b > f THEN 'Bug' WHEN c >= 0.50 AND f > b THEN 'False positive'
  WHEN c >= 0.35 AND bs > fs + 0.15::DOUBLE THEN 'Bug' WHEN c >= 0.35 AND fs > bs + 0.15::DOUBLE THEN 'False positive' WHEN tw >= 75 AND tp IN ('bug', 'fp') AND abs(b - f) <= 2 THEN 'tie' ELSE 'Needs review' END AS step FROM v_conf)""",
    "v_reasons": """
SELECT d.cid, d.classification, CASE WHEN max(d.raw2) >= 0.80 THEN 'High confidence.' WHEN max(d.raw2) >= 0.55 THEN 'Moderate confidence — review recommended.' ELSE 'Low confidence — manual review required.' END || ' | ' ||
 coalesce(string_agg(r.label || ': ' || r.text, ' | ' ORDER BY CASE WHEN d.classification = 'Needs review' AND r.polarity = 'fp' THEN 1 ELSE 0 END, r.w DESC, r.seq), 'Insufficient evidence for automatic classification.') AS reasons
FROM (SELECT *, greatest(raw, confidence) AS raw2 FROM (SELECT cid, classification, raw, CASE WHEN raw < 0.5 THEN confidence ELSE raw END AS confidence FROM v_decided)) d
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cid, polarity ORDER BY w DESC, seq) AS rn FROM v_ev) r ON r.cid = d.cid AND ((d.classification = 'Bug' AND r.polarity = 'bug' AND rn <= 3) OR (d.classification = 'False positive' AND r.polarity = 'fp' AND rn <= 3)
 OR (d.classification = 'Needs review' AND r.polarity IN ('bug', 'fp') AND rn <= 2)) GROUP BY 1, 2""",
}
