"""SQL of the composed verdict: overrun facts, callers, second decision, corrections, final class.

Reads the facts and decisions of ``fact_checks``. Everything is written for any findings and code under the
names ``v_code`` and ``code_lines``; :func:`over` puts other ones in their place.
"""

from __future__ import annotations

from assayer import dimensions as dim
from assayer.operators import snippets as sn
from assayer.operators import verdicts as vd
from assayer.plans import fact_checks as fc
from assayer.plans import q_code, q_findings
from assayer.plans.registry import quoted_list

_LOOSE = r"'\*\s*\(\s*(\w+)\s*\+\s*([^\)]+)\)'"
_DECLARED = rf"'\b(?:{sn.TYPE_WORDS})\b[\w\s\*]*?\b\Q' || a.arr || '\E\s*\[\s*([^\]]+)\s*\]'"
_OWN = r"'\b\Q' || index_var || '\E\s*([<>!=]=?)\s*(\d+)'"
_NO_INDEX = "('', 'the offset', 'the index', 'index')"

OVERRUN = fc.prefixed(q_code.FLOW_AT, "o_") | {
    "k_declared": f"""
SELECT cid, size_expr, CASE WHEN regexp_matches(size_expr, '^\\d+$') THEN size_expr::BIGINT ELSE 0 END AS size FROM (SELECT l.cid, trim(regexp_extract(l.text, {_DECLARED}, 1)) AS size_expr, row_number() OVER (PARTITION BY l.cid ORDER BY l.i) AS rn
 FROM o_v_acc a JOIN code_lines l USING (cid) WHERE regexp_matches(l.text, {_DECLARED})) WHERE rn = 1""",
    "k_access": f"""
SELECT cid, rule_set, guard_covers, traced_index, {fc.first("arr", "loose_arr", "'the buffer'")} AS buffer, {fc.first("found_var", "CASE WHEN found_var IS NULL THEN " + fc.first("loose_var", "loose_idx") + " END", "'the offset'")} AS index_var,
 {fc.first("idx", "CASE WHEN found_var IS NULL THEN loose_idx END")} AS index_expr, CASE WHEN coalesce(size, 0) > 0 THEN size ELSE coalesce(array_size, 0) END::BIGINT AS bound, coalesce(size_expr, '') AS size_expr FROM (
 SELECT *, regexp_extract(trim(regexp_replace(loose_idx, '\\([^)]+\\)', '', 'g')), '^([A-Za-z_][A-Za-z0-9_]*)\\b', 1) AS loose_var FROM (
  SELECT k.cid, k.rule_set, k.guard_covers, nullif(k.index_value, 0) AS traced_index, k.array_size, a.arr, a.idx, a.index_var AS found_var, regexp_extract(k.code, {_LOOSE}, 1) AS loose_arr, trim(regexp_extract(k.code, {_LOOSE}, 2)) AS loose_idx, d.size, d.size_expr
  FROM v_known k LEFT JOIN o_v_acc a USING (cid) LEFT JOIN k_declared d USING (cid)))""",
    "k_flow": """
SELECT x.*, coalesce(a.expr, '') AS assign_expr, coalesce(g.cond, '') AS cond, coalesce(CASE WHEN g.op <> '' THEN g.op ELSE CASE g.back WHEN '<' THEN '>' WHEN '>' THEN '<' WHEN '<=' THEN '>=' WHEN '>=' THEN '<=' ELSE g.back END END, '') AS op,
 coalesce(CASE WHEN g.op <> '' THEN g.lim ELSE g.back_lim END, '') AS lim, coalesce(nullif(x.size_expr, ''), CASE WHEN x.bound > 0 THEN x.bound::VARCHAR ELSE '' END) AS bound_expr FROM k_access x LEFT JOIN o_v_assign a USING (cid) LEFT JOIN o_v_compared g USING (cid)""",
    "k_read": f"""
SELECT *, try_cast(CASE WHEN regexp_matches(lim, '^\\d+$') THEN lim END AS BIGINT) AS n, regexp_extract(cond, {_OWN}, 1) AS own_op, try_cast(nullif(regexp_extract(cond, {_OWN}, 2), '') AS BIGINT) AS own_n,
 {fc.first("regexp_extract(cond, '" + chr(92) + "b" + chr(92) + "Q' || index_var || '" + chr(92) + "E" + chr(92) + "b" + chr(92) + "s*<=?" + chr(92) + "s*(" + chr(92) + "w+)', 1)", "regexp_extract(cond, '(" + chr(92) + "w+)" + chr(92) + "s*>=?" + chr(92) + "s*" + chr(92) + "b" + chr(92) + "Q' || index_var || '" + chr(92) + "E" + chr(92) + "b', 1)")} AS named FROM k_flow""",
    "k_bound": f"""
SELECT *, op <> '' AND lim <> '' AND bound > 0 AND CASE WHEN n IS NOT NULL AND op = '<=' THEN n >= bound WHEN n IS NOT NULL AND op = '<' THEN n > bound WHEN n IS NULL AND op = '<=' THEN true ELSE false END AS is_off_by_one,
 op <> '' AND lim <> '' AND bound > 0 AND coalesce(CASE own_op WHEN '<' THEN own_n <= bound WHEN '<=' THEN own_n < bound END, false) AS guard_is_safe,
 CASE WHEN cond = '' OR index_var IN {_NO_INDEX} THEN 'none' WHEN NOT regexp_matches(cond, '\\b\\Q' || index_var || '\\E\\b') THEN 'irrelevant'
  WHEN traced_index IS NOT NULL AND bound > 0 THEN CASE WHEN traced_index >= 0 AND traced_index < bound THEN 'safe' ELSE 'unsafe' END
  WHEN named <> '' THEN CASE WHEN regexp_matches(named, '^\\d+$') AND bound > 0 THEN CASE WHEN named::BIGINT <= bound THEN 'safe' ELSE 'unsafe' END
   WHEN bound_expr <> '' AND (contains(bound_expr, named) OR contains(cond, 'sizeof') OR named = buffer) THEN 'safe' ELSE 'unknown' END
  WHEN guard_covers THEN 'safe' ELSE 'unknown' END AS index_guard,
 buffer NOT IN ('', 'the buffer', 'the array', 'array') AND index_var NOT IN {_NO_INDEX} AS named_access, coalesce(bound > 0 AND traced_index >= bound, false) AS oob FROM k_read""",
}

# names of a header file: a base size from the parts, twice that, and what the snippets ask for
SYMBOLS = {
    "v_symbols": """
WITH RECURSIVE d AS (SELECT max(p_size) AS m FROM part), chain AS (SELECT 'BASE' AS name, m AS value FROM d UNION ALL SELECT CASE name WHEN 'BASE' THEN 'TWICE' ELSE 'MAX' END, CASE name WHEN 'BASE' THEN value * 2 ELSE value - 36 END FROM chain WHERE name <> 'MAX')
SELECT name, 'define' AS kind, value FROM chain UNION ALL SELECT 'name', 'member', value FROM chain WHERE name = 'TWICE'"""
}
NAMED = {
    "k_access": OVERRUN["k_access"].replace("CASE WHEN coalesce(size, 0) > 0 THEN size ELSE coalesce(array_size, 0) END::BIGINT AS bound", "CASE WHEN coalesce(size, 0) > 0 THEN size ELSE coalesce((SELECT s.value FROM v_symbols s WHERE s.name = size_expr AND s.kind = 'define' AND s.value > 0), array_size, 0) END::BIGINT AS bound"),
}

# no caller says anything; queries with a call graph put its answers here
NO_CALLERS = {"k_told": "SELECT cid, '' AS caller_verdict FROM v_code"}

# calls on all lines of all snippets; the line that defines a function is no call of it
SITES = {
    "k_site": f"""
SELECT s.cid, s.cid::VARCHAR AS path, s.code_start_line + s.i AS line_no, s.i, trim(s.text) AS snippet, s.callee, c.function AS caller, c.code_start_line AS caller_start, c.code AS body FROM (
 SELECT DISTINCT cid, i, text, code_start_line, unnest(regexp_extract_all(text, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS callee FROM code_lines) s JOIN v_code c USING (cid) WHERE s.callee NOT IN ({quoted_list(dim.SKIPPED_CALLEES)}) AND NOT (s.callee = c.function AND s.i = 0)""",
    "k_site_lines": "SELECT cid AS site, i, text FROM code_lines",
}
NEIGHBOURS = {
    **q_code.TREE,
    "k_bodies": "SELECT s.name, string_agg(l.text, chr(10) ORDER BY l.line_no) AS body FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, start_line) AS rn FROM v_span) WHERE rn = 1) s JOIN file_lines l ON l.path = s.path AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY 1",
    "k_neighbours": """
SELECT name, string_agg(text, chr(10) || chr(10) ORDER BY kind, path, line, text) AS text FROM (
 SELECT callee AS name, 1 AS kind, path, caller_start AS line, max(body) AS text FROM k_site WHERE callee <> caller GROUP BY 1, 3, 4
 UNION ALL SELECT c.caller, 0, c.r[1], c.r[2], b.body FROM (SELECT caller, callee, min((path, line_no)) AS r FROM k_site WHERE callee <> caller GROUP BY 1, 2) c JOIN k_bodies b ON b.name = c.callee) WHERE trim(text) <> '' GROUP BY 1""",
}
_SIGNED = r"'^([A-Za-z_][\w\s\*]*?)\s+(\w+)\s*\(([^)]*)\)'"
CALLERS = {
    "k_heads": f"""
SELECT cid, arg_min(callee, i) FILTER (callee <> '') AS callee, arg_min(params, i) FILTER (signed) AS params FROM (SELECT cid, i, regexp_extract(s, '^[\\w\\s\\*]+\\b(\\w+)\\s*\\(', 1) AS callee, regexp_matches(s, {_SIGNED}) AS signed, trim(regexp_extract(s, {_SIGNED}, 3)) AS params
 FROM (SELECT cid, i, trim(text) AS s FROM code_lines) WHERE NOT regexp_matches(s, '^(#|//|/\\*|\\*)')) GROUP BY 1""",
    "k_params": f"""
SELECT cid, callee, CASE WHEN params IS NULL OR params = '' OR lower(params) = 'void' THEN [] ELSE list_filter(list_transform(string_split(params, ','),
 lambda p: coalesce(list_last(regexp_extract_all(replace(regexp_replace(p, '{sn.QUALIFIERS}', ' ', 'g'), '*', ' '), '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1)), '')), lambda x: x <> '') END AS names FROM k_heads""",
    "k_question": "SELECT b.cid, coalesce(p.callee, '') AS callee, coalesce(list_position(p.names, b.index_var), 0) AS arg_pos, coalesce(list_position(p.names, b.buffer), 0) AS buf_pos, b.bound FROM k_bound b JOIN k_params p USING (cid) WHERE b.rule_set = 'OVERRUN'",
    "k_distinct": "SELECT DISTINCT callee, arg_pos, buf_pos, bound FROM k_question WHERE callee <> '' AND arg_pos > 0",
    "k_passed": r"""
SELECT q.callee, q.arg_pos, q.buf_pos, q.bound, s.cid AS site, s.path, s.line_no, s.i, args[q.arg_pos] AS arg, args[q.buf_pos] AS passed FROM k_distinct q
 JOIN (SELECT *, """ + fc._ARGS + r""" AS args FROM (SELECT *, regexp_extract(snippet, '\b\Q' || callee || '\E\s*\(((?:[^()]|\([^()]*\))*)\)', 1) AS a FROM k_site WHERE snippet <> '')) s USING (callee)""",
    "k_weighed": rf"""
SELECT p.*, try_cast(CASE WHEN regexp_matches(arg, '^\d+$') THEN arg END AS BIGINT) AS value, coalesce(regexp_matches(arg, '{vd.INPUT_CALLS}'), false) AS input, coalesce(regexp_matches(arg, '\b(sizeof\s*\(|\b[\w]+\s*-\s*1\b)'), false) AS relative,
 coalesce(regexp_matches(arg, '^[A-Za-z_][A-Za-z0-9_]*$'), false) AND EXISTS (SELECT 1 FROM k_site_lines l WHERE l.site = p.site AND l.i <= p.i AND contains(regexp_extract(l.text, '\b(if|while|for)\s*\(([^)]+)\)', 2), p.arg)) AS guarded FROM k_passed p""",
    "k_told": """
SELECT q.cid, coalesce(CASE WHEN b > 0 AND f = 0 AND g = 0 THEN 'oob' WHEN g > 0 AND b = 0 THEN 'bounded_before' WHEN f > 0 AND b = 0 THEN 'bounded' WHEN b > 0 AND f = 0 THEN 'oob' END, '') AS caller_verdict FROM k_question q LEFT JOIN (
 SELECT callee, arg_pos, buf_pos, bound, count(*) FILTER (bound > 0 AND value >= bound) + count(*) FILTER (value IS NULL AND input) AS b, count(*) FILTER (bound > 0 AND value < bound) + count(*) FILTER (bound > 0 AND value IS NULL AND relative AND NOT input) AS f,
  count(*) FILTER (value IS NULL AND arg IS NOT NULL AND guarded) AS g FROM k_weighed GROUP BY ALL) USING (callee, arg_pos, buf_pos, bound)""",
}

_PLAIN = r"regexp_extract(regexp_replace({0}, '\s+', '', 'g'), '^\(?(\d+)\)?$', 1)"
_ENTRY = "CASE WHEN {cond} THEN {{'seq': {seq}, 'label': '{label}', 'polarity': '{polarity}', 'w': {w}, 'text': '{text}'}} END"
_ENTRIES = [
    _ENTRY.format(seq=k, cond=cond, label=label, polarity=polarity, w=w, text=text)
    for k, (cond, label, polarity, w, text) in enumerate(
        [
            ("known AND bound > 0 AND const < bound", "constant_index_within_bounds", "fp", 85, "the index is a constant inside the array"),
            ("known AND bound > 0 AND const >= bound", "constant_index_out_of_bounds", "bug", 90, "the index is a constant outside the array"),
            ("known AND kind IN ('network', 'file', 'env', 'args', 'convert')", "overrun_index_untrusted_origin", "bug", 62, "the index comes from outside"),
            ("known AND kind IN ('local', 'literal', 'bounded', 'safe')", "overrun_index_safe_origin", "fp", 60, "the index comes from a safe source"),
            ("known AND caller_verdict = 'oob'", "overrun_caller_passes_oob", "bug", 80, "callers pass values outside the array"),
            ("known AND caller_verdict = 'bounded_before'", "overrun_caller_bound_index", "fp", 72, "callers limit the index before the call"),
            ("known AND caller_verdict = 'bounded'", "overrun_caller_passes_bounded", "fp", 85, "every caller passes a value inside the array"),
        ]
    )
]
_DECISION = {k: fc.RULED[k] for k in ("v_score", "v_conf", "v_decided")}
CORRECTED = {
    **fc.renamed({k: x for k, x in q_code.ORIGIN.items() if k in ("v_asked_of", "v_begun", "v_walk", "v_origin")}, {k: f"x_{k}" for k in ("v_asked_of", "v_begun", "v_walk", "v_origin")}),
    "x_v_asked_of": "SELECT cid, index_var AS v FROM k_bound JOIN v_decided USING (cid) WHERE rule_set = 'OVERRUN' AND classification = 'Needs review'",
    "k_extra": f"""
SELECT cid, list_filter([{", ".join(_ENTRIES)}], lambda x: x IS NOT NULL) AS ev FROM (SELECT b.*, b.index_var NOT IN ('the offset', 'the index', 'index') AS known, coalesce(o.kind, '') AS kind, coalesce(t.caller_verdict, '') AS caller_verdict,
 try_cast(nullif({fc.first(_PLAIN.format("b.index_expr"), _PLAIN.format("b.assign_expr"))}, '') AS BIGINT) AS const FROM k_bound b LEFT JOIN x_v_origin o USING (cid) LEFT JOIN k_told t USING (cid) WHERE b.rule_set = 'OVERRUN')""",
    "x_v_ev": "SELECT cid, e.seq AS seq, e.label AS label, e.polarity AS polarity, e.w AS w, e.text AS text FROM (SELECT cid, unnest(ev) AS e FROM k_extra)",
    **fc.renamed(_DECISION, {"v_ev": "x_v_ev", "v_score": "x_v_score", "v_conf": "x_v_conf", "v_decided": "x_v_decided"}),
    "k_corrected": """
SELECT cid, CASE WHEN on_ AND c3 = 'Needs review' AND extra_class <> 'Needs review' AND extra_confidence >= 0.55 THEN extra_class ELSE c3 END AS classification,
 CASE WHEN on_ AND c3 = 'Needs review' AND extra_class <> 'Needs review' AND extra_confidence >= 0.55 THEN greatest(p3, extra_confidence - 0.05::DOUBLE) ELSE p3 END AS confidence FROM (
 SELECT *, CASE WHEN NOT on_ OR c2 <> 'Needs review' THEN c2 WHEN oob THEN 'Bug' WHEN index_guard = 'safe' THEN 'False positive' WHEN index_guard = 'unsafe' OR (index_guard IN ('irrelevant', 'none') AND named_access) THEN 'Bug' ELSE c2 END AS c3,
  CASE WHEN NOT on_ OR c2 <> 'Needs review' THEN p2 WHEN oob THEN 0.78 WHEN index_guard = 'safe' THEN 0.55 WHEN index_guard = 'unsafe' THEN 0.60 WHEN index_guard IN ('irrelevant', 'none') AND named_access THEN 0.55 ELSE p2 END::DOUBLE AS p3 FROM (
  SELECT *, CASE WHEN weak THEN CASE WHEN index_guard = 'unsafe' OR named_access THEN 'Bug' ELSE 'Needs review' END ELSE c1 END AS c2,
   CASE WHEN weak THEN CASE WHEN index_guard = 'unsafe' AND oob THEN 0.78 WHEN index_guard = 'unsafe' OR named_access THEN 0.60 ELSE 0.55 END ELSE p1 END::DOUBLE AS p2 FROM (
   SELECT *, on_ AND c1 = 'False positive' AND index_guard IN ('irrelevant', 'unsafe', 'unknown') AS weak FROM (
    SELECT b.*, x.classification AS extra_class, x.confidence AS extra_confidence, b.rule_set = 'OVERRUN' AS on_, CASE WHEN b.rule_set <> 'OVERRUN' THEN d.classification WHEN is_off_by_one THEN 'Bug' WHEN guard_is_safe AND d.classification = 'Bug' THEN 'False positive' ELSE d.classification END AS c1,
     CASE WHEN b.rule_set <> 'OVERRUN' THEN d.confidence WHEN is_off_by_one AND d.classification <> 'Bug' THEN greatest(d.confidence, 0.82) WHEN NOT is_off_by_one AND guard_is_safe AND d.classification = 'Bug' THEN greatest(d.confidence, 0.78) ELSE d.confidence END::DOUBLE AS p1
    FROM k_bound b JOIN v_decided d USING (cid) JOIN x_v_decided x USING (cid)))))""",
}

FATE = {
    "v_rcall": q_code.FATE["v_rcall"],
    "k_pool": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY distance, fn, i) AS rn FROM (SELECT r.*, k.trace_sink, CASE WHEN k.line > 0 THEN abs(r.i - r.rel) ELSE r.i + r.code_start_line END AS distance, lower(r.fn) = k.trace_sink AS focus,
 bool_or(lower(r.fn) = k.trace_sink) OVER (PARTITION BY r.cid) AS focused, bool_or(NOT r.benign) OVER (PARTITION BY r.cid) AS serious FROM v_rcall r JOIN v_known k USING (cid) WHERE k.rule_set = 'CHECKED_RETURN')
 WHERE CASE WHEN trace_sink <> '' AND focused THEN focus WHEN trace_sink = '' AND serious THEN NOT benign ELSE true END) WHERE rn = 1""",
    "v_fate": q_code.FATE["v_fate"].replace("v_chosen", "k_pool"),
}
FINAL = {
    **FATE,
    "k_final": """
SELECT k.cid, k.checker, CASE WHEN empty THEN 'Needs review' WHEN k.rule_set = 'CHECKED_RETURN' THEN CASE WHEN f.fate IS NULL THEN 'Needs review' WHEN f.fate = 'used' THEN 'False positive' WHEN f.fate = 'ignored' THEN 'Intentional' WHEN NOT f.critical AND f.benign THEN 'False positive' ELSE 'Bug' END
  WHEN lean THEN CASE WHEN bugs THEN 'Bug' ELSE 'Intentional' END WHEN k.rule_set IN ('DEADCODE', 'ARRAY_VS_SINGLETON', 'UNUSED_VALUE', 'CONSTANT_EXPRESSION_RESULT', 'NO_BREAK') AND k.c = 'False positive' THEN 'Intentional' ELSE k.c END AS classification,
 CASE WHEN k.used_fallback THEN least(0.60::DOUBLE, q) ELSE q END AS confidence FROM (SELECT *, CASE WHEN empty THEN 0.0 WHEN rule_set = 'CHECKED_RETURN' THEN NULL WHEN lean THEN 0.55 ELSE p END::DOUBLE AS q0 FROM (
  SELECT *, rule_set = 'UNUSED_VALUE' AND c = 'Needs review' AND bugs <> fps AS lean FROM (SELECT k.cid, k.checker, k.rule_set, k.code = '' AND k.n_events = 0 AS empty, x.classification AS c, x.confidence AS p, coalesce(d.used_fallback, false) AS used_fallback,
   EXISTS (SELECT 1 FROM v_ev e WHERE e.cid = k.cid AND e.polarity = 'bug') AS bugs, EXISTS (SELECT 1 FROM v_ev e WHERE e.cid = k.cid AND e.polarity = 'fp') AS fps FROM v_known k JOIN k_corrected x USING (cid) LEFT JOIN k_fallen d USING (cid)))) k
 LEFT JOIN v_fate f USING (cid), LATERAL (SELECT coalesce(q0, CASE WHEN f.fate IS NULL THEN 0.0 WHEN f.fate = 'used' THEN 0.80 WHEN f.fate = 'ignored' THEN 0.85 WHEN f.critical THEN 0.72 WHEN f.benign THEN 0.65 ELSE 0.52 END::DOUBLE) AS q)""",
    "k_fallen": "SELECT cid, false AS used_fallback FROM v_code",
}

ALONE = fc.RULED | OVERRUN | NO_CALLERS | CORRECTED | FINAL

NAMED_BOUNDS = ALONE | SYMBOLS | NAMED

# what the call graph, the bodies of callees and another scanner say
AROUND = {
    **q_code.TREE,
    "k_reads": f"""
SELECT name, list_filter([{quoted_list(dim.CALLEE_TAINT)}], lambda f: regexp_matches(body, '\\b' || f || '\\s*\\('))[1] AS fn FROM (SELECT s.name, string_agg(l.text, chr(10) ORDER BY l.line_no) AS body
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, start_line) AS rn FROM v_span) WHERE rn = 1) s JOIN file_lines l ON l.path = s.path AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY 1)""",
    "k_callee_taint": f"""
SELECT cid, arg_min(callee || '() (calls ' || fn || '() internally)', (strpos(code, callee || '('), callee)) AS callee_taint FROM (SELECT DISTINCT cid, code, unnest(regexp_extract_all(code, '\\b(\\w+)\\s*\\(', 1)) AS callee FROM v_code) c JOIN k_reads r ON r.name = c.callee AND r.fn IS NOT NULL
WHERE callee NOT IN ({quoted_list(dim.SKIPPED_CALLEES)}) GROUP BY 1""",
    "k_scanned": "SELECT path, line_no AS line, CASE WHEN contains(text, 'strcpy(') THEN 'unsafe-copy' WHEN contains(text, 'sprintf(') THEN 'unsafe-format' WHEN contains(text, 'atoi(') THEN 'unchecked-number' ELSE '' END AS rule_id FROM file_lines",
    "k_confirmed": "SELECT p.cid, arg_min(h.rule_id, h.line) AS corroborated_by FROM k_placed p JOIN k_scanned h ON h.path = p.path AND h.rule_id <> '' AND abs(h.line - p.line) <= 3 GROUP BY 1",
    "k_used": "SELECT callee, count(*) AS n FROM k_site WHERE callee <> caller GROUP BY 1",
    "k_around": r"""
SELECT c.cid, coalesce(t.callee_taint, '') AS callee_taint, coalesce(h.corroborated_by, '') AS corroborated_by, CASE WHEN c.name <> '' THEN coalesce(u.n, 0) ELSE -1 END AS n_callers
FROM (SELECT *, regexp_extract(function, '(\w+)\s*(?:\(.*)?$', 1) AS name FROM v_code) c LEFT JOIN k_callee_taint t USING (cid) LEFT JOIN k_confirmed h USING (cid) LEFT JOIN k_used u ON u.callee = c.name""",
}
PLACED = {"k_placed": q_code.PLACED.replace("cid % 140 AS line", "line")}
WHOLE = ALONE | SITES | CALLERS | AROUND | PLACED
CATEGORY = {"d_cat": q_findings.CATS["d_cat"]}


def over(views: dict[str, str], code: str, lines: str) -> dict[str, str]:
    """The views with other findings and code lines in the place of ``v_code`` and ``code_lines``."""
    return {k: fc.renamed({k: x}, {"v_code": code, "code_lines": lines})[k] for k, x in views.items()}


# the same over a source tree: code is the function around each finding, sites are those of all files
TREE = over(ALONE | CALLERS | AROUND, "t_code", "t_lines") | {
    "k_placed": q_code.PLACED,
    "t_code": """
SELECT c.cid, c.checker, c.function, p.line, coalesce(string_agg(l.text, chr(10) ORDER BY l.line_no), '') AS code, coalesce(max(s.start_line), greatest(max(p.line) - 25, 0) + 1)::BIGINT AS code_start_line
FROM v_code c JOIN k_placed p USING (cid) LEFT JOIN v_span s ON p.path = s.path AND p.line BETWEEN s.start_line AND s.end_line
JOIN file_lines l ON l.path = p.path AND l.line_no BETWEEN coalesce(s.start_line, greatest(p.line - 25, 0) + 1) AND coalesce(s.end_line, p.line + 25) GROUP BY 1, 2, 3, 4""",
    "t_lines": "SELECT cid, i, text, line - code_start_line AS rel, code_start_line, line FROM (SELECT cid, line, code_start_line, unnest(string_split(code, chr(10))) AS text, generate_subscripts(string_split(code, chr(10)), 1) - 1 AS i FROM t_code)",
    "k_site": """
SELECT v.path || '#' || s.start_line AS cid, v.path, v.line_no, v.line_no - s.start_line AS i, v.snippet, v.callee, s.name AS caller, s.start_line AS caller_start FROM v_site v JOIN v_span s ON v.path = s.path AND v.line_no BETWEEN s.start_line AND s.end_line
WHERE NOT (v.line_no = s.start_line AND v.callee = s.name) AND v.callee IN (SELECT function FROM v_code)""",
    "k_site_lines": "SELECT s.path || '#' || s.start_line AS site, l.line_no - s.start_line AS i, l.text FROM v_span s JOIN file_lines l ON l.path = s.path AND l.line_no BETWEEN s.start_line AND s.end_line",
}
VERDICTS = """
SELECT f.cid, f.checker, k.sink_func, k.origin, k.guard_line::BIGINT AS guard_line, CASE WHEN k.rule_set = 'OVERRUN' THEN b.index_guard ELSE 'none' END AS index_guard, f.classification, f.confidence, r.reasons
FROM k_final f JOIN v_fact1 k USING (cid) JOIN k_bound b USING (cid) JOIN v_reasons r USING (cid)"""
SUMMARY = """
SELECT coalesce(d_cat.category, 'Uncategorized') AS category, classification, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM k_final f LEFT JOIN d_cat ON upper(trim(f.checker)) = d_cat.k GROUP BY 1, 2"""
