"""Queries over source trees and snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions import text as t
from assayer.functions.frames import dealt
from assayer.operators import snippets as sn
from assayer.operators import source_tree as st
from assayer.operators import verdicts as vd
from assayer.plans import views as v
from assayer.plans.registry import flag, query, quoted_list

_SKIP = quoted_list(dim.SKIPPED_CALLEES)


def _facts(spark, d):
    return st.line_facts(v.files(spark, d))


def _snip(spark, d):
    return sn.prepare(dealt(v.code(spark, d), "cid"))


# --- source tree -----------------------------------------------------------------
# The shared files hold no braces in literals and comments but one kind, so the check
# strips those and counts braces.
TREE = {
    "v_depth": """
SELECT path, line_no, text, x, sum(length(x) - length(replace(x, '{', '')) - length(x) + length(replace(x, '}', ''))) OVER (PARTITION BY path ORDER BY line_no) AS depth
FROM (SELECT *, regexp_replace(text, '("[^"]*"|//.*$|/\\*.*?\\*/)', ' ', 'g') AS x FROM file_lines)""",
    "v_start": "SELECT *, coalesce(lag(depth) OVER (PARTITION BY path ORDER BY line_no), 0) = 0 AND regexp_matches(text, '^(void|int|unsigned) fn_') AS is_start FROM v_depth",
    "v_fn": """
SELECT *, max(CASE WHEN is_start THEN line_no END) OVER (PARTITION BY path ORDER BY line_no) AS s FROM v_start""",
    "v_span": """
SELECT path, s AS start_line, min(CASE WHEN depth = 0 AND x LIKE '%}%' THEN line_no END) AS end_line, max(CASE WHEN is_start THEN regexp_extract(text, '(fn_\\d+)', 1) END) AS name,
 max(CASE WHEN is_start THEN trim(text) END) AS signature FROM v_fn WHERE s IS NOT NULL GROUP BY 1, 2""",
    "v_site": f"""
SELECT * FROM (SELECT path, line_no, left(trim(text), 100) AS snippet, unnest(regexp_extract_all(text, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS callee FROM file_lines) WHERE callee NOT IN ({_SKIP})""",
}


@query("SELECT path, line_no::BIGINT AS line_no, text FROM file_lines")
def source_lines(spark, d):
    """G1."""
    return st.source_lines(v.files(spark, d)).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("SELECT name, path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, signature FROM v_span", TREE)
def function_spans(spark, d):
    """G2."""
    f = st.functions(_facts(spark, d))
    return f.select("name", "path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "signature")


_POINTS = "concat('src/m', CAST(CAST(floor((l_partkey % 5000) / 8) AS BIGINT) % 40 AS STRING), '/f', CAST(CAST(floor((l_partkey % 5000) / 8) AS BIGINT) AS STRING), '.c') AS path"


@query(
    f"""
SELECT p.cid, coalesce(s.name, '') AS fn_name, coalesce(s.start_line, 0)::BIGINT AS fn_start, coalesce(s.end_line, 0)::BIGINT AS fn_end
FROM (SELECT CAST((l_partkey * 8 + l_linenumber) * 1024 + l_suppkey % 1024 AS BIGINT) AS cid, {_POINTS}, l_orderkey % 150 AS line FROM lineitem) p
LEFT JOIN v_span s ON p.path = s.path AND p.line BETWEEN s.start_line AND s.end_line""",
    TREE,
)
def enclosing_function(spark, d):
    """G3."""
    p = v.table(spark, d, "lineitem").selectExpr("CAST((l_partkey * 8 + l_linenumber) * 1024 + l_suppkey % 1024 AS BIGINT) AS cid", _POINTS, "l_orderkey % 150 AS line")
    out = st.enclosing_function(p, st.functions(_facts(spark, d)))
    return out.select("cid", t.txt(F.col("fn_name")).alias("fn_name"), F.coalesce("fn_start", F.lit(0)).cast("bigint").alias("fn_start"), F.coalesce("fn_end", F.lit(0)).cast("bigint").alias("fn_end"))


PLACED = f"SELECT cid, concat('src/m', CAST(CAST(floor(cid / 8) AS BIGINT) % 40 AS STRING), '/f', CAST(CAST(floor(cid / 8) AS BIGINT) AS STRING), '.c') AS path, cid % 140 AS line FROM v_code"


def _placed(spark, d):
    """One finding per part, in the file that holds its function."""
    return v.code(spark, d).selectExpr("cid", f"{v.FILE_NO} AS file_no", "cid % 140 AS line", "function").selectExpr("cid", f"{v.FILE_PATH} AS path", "line", "function")


@query(
    """
SELECT p.cid, coalesce(string_agg(l.text, chr(10) ORDER BY l.line_no), '') AS code, coalesce(max(s.start_line), greatest(max(p.line) - 25, 0) + 1)::BIGINT AS code_start_line,
 CASE WHEN max(s.start_line) IS NOT NULL THEN 'function' ELSE 'window' END AS code_source
FROM v_placed p LEFT JOIN v_span s ON p.path = s.path AND p.line BETWEEN s.start_line AND s.end_line
JOIN file_lines l ON l.path = p.path AND l.line_no BETWEEN coalesce(s.start_line, greatest(p.line - 25, 0) + 1) AND coalesce(s.end_line, p.line + 25) GROUP BY 1""",
    {**TREE, "v_placed": PLACED},
)
def finding_code(spark, d):
    """The function around a finding, else 50 lines."""
    files = v.files(spark, d)
    return st.attach_code(_placed(spark, d), st.functions(st.line_facts(files)), files).select("cid", "code", "code_start_line", "code_source")


@query(
    """
SELECT p.cid, coalesce(n.s, p.line)::BIGINT AS search_line, coalesce(w.name, '') AS fn_name FROM v_named p LEFT JOIN (SELECT path, name, min(start_line) AS s FROM v_span GROUP BY 1, 2) n ON n.path = p.path AND n.name = p.function
LEFT JOIN v_span w ON w.path = p.path AND coalesce(n.s, p.line) BETWEEN w.start_line AND w.end_line""",
    {**TREE, "v_named": PLACED.replace("cid % 140 AS line", "cid % 140 AS line, CASE WHEN cid % 5 = 0 THEN 'gone' ELSE function END AS function")},
)
def anchored_functions(spark, d):
    """A named finding is looked up at its function's definition, any other at its line."""
    placed = _placed(spark, d).withColumn("function", F.when(F.col("cid") % 5 == 0, "gone").otherwise(F.col("function")))
    funcs = st.functions(_facts(spark, d))
    found = st.enclosing_function(st.anchor_by_name(placed, funcs), funcs, "search_line")
    return found.select("cid", F.col("search_line").cast("bigint").alias("search_line"), t.txt(F.col("fn_name")).alias("fn_name"))


@query(
    """
SELECT p.path, p.line, string_agg(lpad(l.line_no::VARCHAR, 5, ' ') || ' ' || CASE WHEN l.line_no = p.line THEN '>>>' ELSE '   ' END || ' ' || l.text, chr(10) ORDER BY l.line_no) AS snippet
FROM (SELECT DISTINCT path, line FROM v_placed) p JOIN file_lines l ON l.path = p.path AND l.line_no BETWEEN greatest(p.line - 14, 1) AND greatest(p.line + 15, 1) GROUP BY 1, 2""",
    {**TREE, "v_placed": PLACED},
)
def line_window(spark, d):
    """G4."""
    return st.line_window(_placed(spark, d), st.source_lines(v.files(spark, d)))


@query("SELECT callee, path, line_no::BIGINT AS line_no, snippet FROM v_site", TREE)
def call_sites(spark, d):
    """G5."""
    s = st.call_sites(st.source_lines(v.files(spark, d)))
    return s.select("callee", "path", F.col("line_no").cast("bigint").alias("line_no"), "snippet")


@query(
    "SELECT c.callee, c.path, c.line_no::BIGINT AS line_no, coalesce(s.name, '') AS caller, coalesce(s.start_line, 1)::BIGINT AS caller_start FROM v_site c LEFT JOIN v_span s ON c.path = s.path AND c.line_no BETWEEN s.start_line AND s.end_line WHERE c.callee IN (SELECT function FROM v_code)",
    TREE,
)
def callers(spark, d):
    """G6."""
    wanted = v.code(spark, d).select(F.col("function").alias("callee"))
    c = st.callers(wanted, st.call_sites(_facts(spark, d)))
    return c.select("callee", "path", F.col("line_no").cast("bigint").alias("line_no"), "caller", F.col("caller_start").cast("bigint").alias("caller_start"))


@query(
    f"""
SELECT cid, rank, callee FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY strpos(code, callee || '('), callee) AS rank FROM (SELECT DISTINCT cid, code, callee FROM (SELECT cid, code, unnest(regexp_extract_all(code, '\\b(\\w+)\\s*\\(', 1)) AS callee FROM v_code) WHERE callee NOT IN ({_SKIP})))"""
)
def callees(spark, d):
    """G7."""
    return sn.callees(v.code(spark, d)).select("cid", F.col("rank").cast("bigint").alias("rank"), "callee")


@query(
    f"""
SELECT c.cid, c.callee, f.path, f.signature FROM (SELECT cid, callee FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY strpos(code, callee || '('), callee) AS rank FROM (SELECT DISTINCT cid, code, callee FROM (SELECT cid, code, unnest(regexp_extract_all(code, '\\b(\\w+)\\s*\\(', 1)) AS callee FROM v_code) WHERE callee NOT IN ({_SKIP})))) c
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, start_line) AS rn FROM v_span) WHERE rn = 1) f ON f.name = c.callee""",
    TREE,
)
def callee_definitions(spark, d):
    """Callees with their first definition."""
    out = sn.callee_code(sn.callees(v.code(spark, d)), st.functions(_facts(spark, d)))
    return out.select("cid", "callee", "path", "signature")


@query(
    f"""
SELECT cid, arg_min(callee || '() (calls ' || fn || '() internally)', rank) AS callee_taint FROM (
 SELECT c.cid, c.rank, c.callee, list_filter([{quoted_list(dim.CALLEE_TAINT)}], lambda f: regexp_matches(b.body, '\\b' || f || '\\s*\\('))[1] AS fn
 FROM (SELECT cid, rank, callee FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY strpos(code, callee || '('), callee) AS rank FROM (SELECT DISTINCT cid, code, callee FROM (SELECT cid, code, unnest(regexp_extract_all(code, '\\b(\\w+)\\s*\\(', 1)) AS callee FROM v_code) WHERE callee NOT IN ({_SKIP})))) c
 JOIN (SELECT s.name, string_agg(l.text, chr(10) ORDER BY l.line_no) AS body FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, start_line) AS rn FROM v_span) WHERE rn = 1) s JOIN file_lines l ON l.path = s.path AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY 1) b ON b.name = c.callee)
WHERE fn IS NOT NULL GROUP BY 1""",
    TREE,
)
def callee_taint(spark, d):
    """First callee that reads outside data."""
    files = v.files(spark, d)
    # only first definitions get their text
    first = st.first_function(st.functions(st.line_facts(files)).drop("signature"))
    bodies = st.function_bodies(first, files)
    return vd.callee_taint(sn.callees(v.code(spark, d)), vd.reading_functions(bodies))


@query(
    "SELECT DISTINCT name FROM (SELECT function AS name FROM v_code UNION ALL SELECT 'legacy_' || cid % 50 FROM v_code) s WHERE NOT EXISTS (SELECT 1 FROM v_site c JOIN v_fn l ON l.path = c.path AND l.line_no = c.line_no WHERE c.callee = s.name AND NOT l.is_start)",
    TREE,
)
def no_callers(spark, d):
    """Definitions do not count here, or every function would have a site."""
    facts = _facts(spark, d)
    k = (F.col("cid") % 50).cast("string")
    named = v.code(spark, d).select(F.explode(F.array("function", F.concat(F.lit("legacy_"), k), F.concat(F.lit("on_hook_"), k))).alias("name"))
    return st.without_callers(named.distinct(), st.call_sites(facts), include_definitions=False)


# reported paths: exact, under another root, in another case, or unknown
_REPORTED = "concat(CASE cid % 4 WHEN 0 THEN '' WHEN 1 THEN '/build/x/' WHEN 2 THEN '/OTHER/' ELSE '/old/' END, CASE WHEN cid % 4 = 2 THEN upper(path) WHEN cid % 4 = 3 THEN concat('m_gone', CAST(cid AS STRING), regexp_replace(path, '^.*/', '/')) ELSE path END) AS file"


@query(
    """
SELECT file, resolved, score FROM (
 SELECT r.file, l.path AS resolved, CASE WHEN lower(r.file) = lower(l.path) THEN 3 WHEN ends_with(lower(r.file), '/' || lower(l.path)) THEN 3 WHEN ends_with(lower(r.file), regexp_extract(lower(l.path), '(/m\\d+/f\\d+\\.c)$', 1)) THEN 2 ELSE 1 END::BIGINT AS score,
  row_number() OVER (PARTITION BY r.file ORDER BY CASE WHEN lower(r.file) = lower(l.path) THEN 3 WHEN ends_with(lower(r.file), '/' || lower(l.path)) THEN 3 ELSE 1 END DESC, l.path) AS rn
 FROM (SELECT DISTINCT file FROM v_reported) r JOIN v_files l ON lower(regexp_extract(r.file, '([^/]+)$', 1)) = lower(regexp_extract(l.path, '([^/]+)$', 1))) WHERE rn = 1""",
    {"v_placed": PLACED, "v_reported": f"SELECT {_REPORTED} FROM v_placed"},
)
def path_resolution(spark, d):
    """G9."""
    return st.resolve_paths(_placed(spark, d).selectExpr(_REPORTED), v.files(spark, d).select("path"))


@query("SELECT count(DISTINCT file) AS checked, count(DISTINCT CASE WHEN cid % 11 <> 5 THEN file END) AS resolved FROM (SELECT cid, CASE WHEN cid % 11 = 5 THEN concat('gone/', CAST(cid AS STRING), '.h') ELSE path END AS file FROM v_placed)", {"v_placed": PLACED})
def path_coverage(spark, d):
    """G10, over every distinct path."""
    paths = _placed(spark, d).select(F.when(F.col("cid") % 11 == 5, F.concat(F.lit("gone/"), F.col("cid").cast("string"), F.lit(".h"))).otherwise(F.col("path")).alias("file"))
    return st.path_coverage(st.resolve_paths(paths, v.files(spark, d).select("path")))


HITS = ["file AS path", "line + CAST(cid % 5 AS BIGINT) AS line", "ordinal", "CASE WHEN cid % 6 = 0 THEN '' ELSE concat('rule-', CAST(cid % 9 AS STRING)) END AS rule_id"]


@query(
    """
SELECT f.cid, coalesce(arg_min(h.rule_id, h.ordinal), '') AS rule_id FROM v_findings f LEFT JOIN v_hits h ON f.file = h.path AND abs(h.line - f.line) <= 3 AND h.line > 0 AND h.rule_id <> '' GROUP BY 1""",
    {"v_hits": "SELECT " + ", ".join(HITS) + " FROM v_findings"},
)
def corroborated_within_3(spark, d):
    """G27."""
    f = v.findings(spark, d)
    return st.corroborate(f.withColumn("path", F.col("file")), f.selectExpr(*HITS)).select("cid", "rule_id")


# --- snippets --------------------------------------------------------------------
_SINKS = "|".join(dim.SINKS)
_RANK = "CASE x " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(dim.SINKS)) + " END"
SINK = {
    "v_line_sink": f"SELECT cid, i, rel, line, unnest(regexp_extract_all(text, '\\b({_SINKS})\\s*\\(', 1)) AS x FROM code_lines",
    "v_sink": f"""
SELECT c.cid, coalesce(s.x, '') AS sink_func FROM v_code c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY CASE WHEN abs(i - rel) <= 2 THEN abs(i - rel) ELSE 99 END,
 CASE WHEN abs(i - rel) <= 2 AND i > rel THEN 1 ELSE 0 END, {_RANK}) AS rn FROM v_line_sink) s ON s.cid = c.cid AND s.rn = 1""",
}


@query("SELECT cid, sink_func FROM v_sink", SINK)
def nearest_sink(spark, d):
    """G11."""
    s = _snip(spark, d)
    return s.select("cid", sn.nearest_sink(F.col("code"), F.col("lines"), F.col("rel"), F.col("line")).alias("sink_func"))


# calls of the shared snippets nest at most once
ARGS = {
    **SINK,
    "v_call": """
SELECT s.cid, s.sink_func, regexp_extract(l.text, s.sink_func || '\\s*\\(((?:[^()]|\\([^()]*\\))*)\\)', 1) AS a
FROM v_sink s JOIN (SELECT l.*, row_number() OVER (PARTITION BY l.cid ORDER BY abs(i - rel), i) AS rn FROM code_lines l JOIN v_sink USING (cid) WHERE sink_func <> '' AND regexp_matches(text, '\\b' || sink_func || '\\s*\\(')) l ON l.cid = s.cid AND l.rn = 1""",
    "v_args": """
SELECT cid, list_filter(list_transform(regexp_extract_all(a, '(?:[^,()]|\\([^()]*\\))+'), lambda x: trim(x)), lambda x: x <> '') AS args FROM v_call""",
}


@query("SELECT cid, array_to_string(args, ' ; ') AS args FROM v_args", ARGS)
def call_arguments(spark, d):
    """Arguments of the sink call nearest to the flagged line."""
    s = _snip(spark, d).withColumn("sink", sn.nearest_sink(F.col("code"), F.col("lines"), F.col("rel"), F.col("line")))
    args = sn.call_arguments_near(F.col("lines"), F.col("sink"), F.col("rel"), F.col("line"))
    return s.where("sink <> ''").select("cid", F.array_join(args, " ; ").alias("args"))


PARAMS = {"v_params": "SELECT cid, CASE WHEN cid % 7 = 0 THEN [] WHEN cid % 11 = 0 THEN ['len', 'n'] ELSE ['src', 'n'] END AS params FROM v_code"}


@query("SELECT cid, array_to_string(params, ',') AS params, coalesce(list_position(params, 'n'), 0)::BIGINT AS position FROM v_params", PARAMS)
def parameters(spark, d):
    """G13."""
    p = sn.parameter_names(F.col("lines"))
    return _snip(spark, d).select("cid", F.array_join(p, ",").alias("params"), F.array_position(p, F.lit("n")).cast("bigint").alias("position"))


ASSIGN = {
    "v_assign": """
SELECT cid, generate_subscripts(ts, 1) AS seq, unnest(ts) AS target, trim(unnest(ss)) AS source FROM (SELECT cid, regexp_extract_all(code, '(?m)(?:^|;)\\s*(?:\\w+\\s+)?(\\w+)\\s*=\\s*([^;]+);', 1) AS ts, regexp_extract_all(code, '(?m)(?:^|;)\\s*(?:\\w+\\s+)?(\\w+)\\s*=\\s*([^;]+);', 2) AS ss FROM v_code)"""
}


@query("SELECT cid, seq, target, source FROM v_assign", ASSIGN)
def assignments(spark, d):
    """G14."""
    a = _snip(spark, d).select("cid", F.posexplode(sn.assignments(F.col("code"))).alias("seq", "a"))
    return a.select("cid", (F.col("seq") + 1).cast("bigint").alias("seq"), F.col("a.target").alias("target"), F.col("a.source").alias("source"))


# walk over assignments to the first name on a line with a source, one step per recursion
_TAINT_ROWS = ", ".join(f"({i}, '{k}', '{f}')" for i, (k, f) in enumerate(dim.TAINT_ORDER))
ORIGIN = {
    **ASSIGN,
    "d_taint": f"SELECT * FROM (VALUES {_TAINT_ROWS}) AS x(p, kind, fn)",
    "v_present": "SELECT DISTINCT c.cid, p, kind, fn FROM (SELECT cid, unnest(regexp_extract_all(code, '\\b(\\w+)\\s*\\(', 1)) AS f FROM v_code) c JOIN d_taint ON fn = f",
    "v_hit": "SELECT l.cid, l.i, l.text, p.p, p.kind FROM code_lines l JOIN v_present p ON p.cid = l.cid AND regexp_matches(l.text, '\\b' || p.fn || '\\b')",
    "v_next": f"""
SELECT cid, target, list_filter(regexp_extract_all(arg_max(source, seq), '\\b([A-Za-z_]\\w*)\\b', 1), lambda x: x NOT IN ({quoted_list(dim.NOT_A_SOURCE)}))[1] AS nxt FROM v_assign GROUP BY 1, 2""",
    "v_asked_of": "SELECT cid, 'i' AS v FROM v_code",
    "v_begun": r"""
SELECT a.cid, a.v, regexp_matches(c.code, '\b\w+\s+\w*\s*\([^)]*\b\Q' || a.v || '\E\b[^)]*\)') AS is_p FROM v_asked_of a JOIN v_code c USING (cid) WHERE a.v <> '' AND regexp_matches(c.code, '\b\Q' || a.v || '\E\b')""",
    "v_walk": r"""
WITH RECURSIVE walk AS (
 SELECT s.cid, s.v AS cur, [s.v] AS seen, (SELECT min((h.p, h.i, h.kind)) FROM v_hit h WHERE h.cid = s.cid AND regexp_matches(h.text, '\b\Q' || s.v || '\E\b')) AS hit FROM v_begun s WHERE NOT s.is_p
 UNION ALL SELECT w.cid, n.nxt, list_append(w.seen, n.nxt), (SELECT min((h.p, h.i, h.kind)) FROM v_hit h WHERE h.cid = w.cid AND regexp_matches(h.text, '\b\Q' || n.nxt || '\E\b'))
 FROM walk w JOIN v_next n ON n.cid = w.cid AND n.target = w.cur WHERE w.hit IS NULL AND n.nxt IS NOT NULL AND NOT list_contains(w.seen, n.nxt))
SELECT cid, cur, hit[2] AS i, hit[3] AS kind FROM walk WHERE hit IS NOT NULL""",
    "v_origin": """
SELECT s.cid, CASE WHEN s.is_p THEN 'args' ELSE coalesce(w.kind, '') END AS kind, CASE WHEN s.is_p THEN 0 ELSE coalesce(w.i + 1, 0) END::BIGINT AS line, CASE WHEN s.is_p THEN s.v ELSE coalesce(w.cur, '') END AS var FROM v_begun s LEFT JOIN v_walk w USING (cid)""",
}


@query("SELECT c.cid, coalesce(o.kind, '') AS origin_kind, coalesce(o.line, 0)::BIGINT AS origin_line, coalesce(o.var, '') AS origin_var FROM v_code c LEFT JOIN v_origin o USING (cid)", ORIGIN)
def provenance(spark, d):
    """G15, for the index variable, however many assignments lie between."""
    s = sn.provenance(_snip(spark, d).withColumn("v", F.lit("i")), "v")
    return s.select("cid", "origin_kind", "origin_line", "origin_var")


@query(
    """
SELECT cid, rank, i::BIGINT + code_start_line AS line, trim(regexp_extract(text, '\\bn\\s*(?:[+\\-*/&|^]?=)\\s*([^;]+);', 1)) AS rhs FROM (
 SELECT *, row_number() OVER (PARTITION BY cid ORDER BY i DESC) AS rank FROM code_lines WHERE i < rel AND regexp_matches(text, '\\bn\\s*(?:[+\\-*/&|^]?=)\\s*([^;]+);'))"""
)
def reaching_definitions(spark, d):
    """G16."""
    s = _snip(spark, d).select("cid", "code_start_line", F.posexplode(sn.reaching_definitions(F.col("lines"), F.lit("n"), F.col("rel"))).alias("rank", "r"))
    return s.select("cid", (F.col("rank") + 1).cast("bigint").alias("rank"), (F.col("r.i") + F.col("code_start_line")).alias("line"), F.col("r.rhs").alias("rhs"))


@query(
    """
SELECT cid, trim(regexp_extract(text, '\\bi\\s*(?:[+\\-*/&|^]?=)\\s*([^;]+);', 1)) AS rhs FROM (
 SELECT *, row_number() OVER (PARTITION BY cid ORDER BY i DESC) AS rank FROM code_lines WHERE i < rel AND regexp_matches(text, '\\bi\\s*(?:[+\\-*/&|^]?=)\\s*([^;]+);')) WHERE rank = 1"""
)
def last_definition(spark, d):
    """G16 with one definition: an as-of lookup."""
    s = _snip(spark, d).select("cid", F.explode(sn.reaching_definitions(F.col("lines"), F.lit("i"), F.col("rel"), 1)).alias("r"))
    return s.select("cid", F.col("r.rhs").alias("rhs"))


@query(
    """
SELECT c.cid, count(l.i) FILTER (l.i < l.rel AND regexp_matches(l.text, '\\bmemset\\s*\\(([^)]*)\\)')) AS memsets,
 coalesce(max(l.i < l.rel AND regexp_matches(l.text, '\\bif\\b') AND regexp_matches(l.text, '\\bn\\b')), false)::INT::BIGINT AS checked,
 coalesce(min(CASE WHEN regexp_matches(l.text, '\\bmemset\\s*\\(\\s*buf\\s*,\\s*0\\s*,') THEN l.i + 1 END), 0)::BIGINT AS zeroed_at FROM v_code c JOIN code_lines l USING (cid) GROUP BY 1"""
)
def preceding_calls(spark, d):
    """Earlier calls, sanitizers and zeroing."""
    s, lines, rel = _snip(spark, d), F.col("lines"), F.col("rel")
    return s.select(
        "cid", F.size(sn.preceding_calls(lines, "memset", rel)).cast("bigint").alias("memsets"), flag(sn.is_sanitized(lines, F.lit("n"), r"\bif\b", rel)).alias("checked"),
        F.coalesce(sn.zeroing(lines, F.lit("buf")) + 1, F.lit(0)).cast("bigint").alias("zeroed_at"),
    )


GUARDS = {
    "v_guard": """
SELECT cid, i, rel, cond, regexp_extract(cond, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*(?:!=|==|<|>)', 1) AS var, regexp_matches(cond, '!=\\s*NULL|==\\s*NULL|!\\s*\\w+|\\w+\\s*!=\\s*0') AS is_null,
 regexp_matches(cond, '<\\s*\\w+|>\\s*\\w+|<=\\s*\\w+|>=\\s*\\w+|\\blen\\b|\\bsize\\b|\\blength\\b') AS is_bounds
FROM (SELECT *, trim(regexp_extract(text, '\\b(if|while)\\s*\\(([^)]+)\\)', 2)) AS cond FROM code_lines WHERE regexp_matches(text, '\\b(if|while)\\s*\\(([^)]+)\\)'))"""
}


@query("SELECT cid, i::BIGINT AS i, cond, var, is_null::INT::BIGINT AS is_null, is_bounds::INT::BIGINT AS is_bounds FROM v_guard", GUARDS)
def guard_lines(spark, d):
    """G18."""
    g = _snip(spark, d).select("cid", F.explode(sn.guards(F.col("lines"))).alias("g"))
    return g.select("cid", F.col("g.i").cast("bigint").alias("i"), F.col("g.cond").alias("cond"), F.col("g.var").alias("var"), flag(F.col("g.is_null")).alias("is_null"), flag(F.col("g.is_bounds")).alias("is_bounds"))


# block of the first guard naming n: from its line to where its braces close
SCOPE = {
    **GUARDS,
    "v_first": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY i) AS rn FROM v_guard WHERE var = 'n' OR contains(cond, 'n')) WHERE rn = 1",
    "v_from": """
SELECT l.cid, l.i, l.rel, g.i AS g, l.text, sum(length(l.text) - length(replace(l.text, '{', '')) - length(l.text) + length(replace(l.text, '}', ''))) OVER (PARTITION BY l.cid ORDER BY l.i) AS depth,
 sum(CASE WHEN l.text LIKE '%{%' THEN 1 ELSE 0 END) OVER (PARTITION BY l.cid ORDER BY l.i) AS opened FROM v_first g JOIN code_lines l ON l.cid = g.cid AND l.i >= g.i""",
    "v_end": "SELECT cid, min(CASE WHEN depth <= 0 AND opened > 0 THEN i END) AS e FROM v_from GROUP BY 1",
    "v_scope": """
SELECT f.cid, f.g, max(f.rel) AS rel, max(e.e) AS e, max(regexp_matches(f.text, 'return|exit|goto')) AS leaves FROM v_from f JOIN v_end e USING (cid) WHERE e.e IS NULL OR f.i <= e.e GROUP BY 1, 2""",
}


@query(
    """
SELECT c.cid, coalesce(s.g + 1, 0)::BIGINT AS guard_at, CASE WHEN g.cid IS NULL THEN '' WHEN g.is_null THEN 'null_check' WHEN g.is_bounds THEN 'bounds_check' ELSE 'other' END AS guard_kind,
 coalesce(s.leaves OR s.g < 3 OR s.rel = s.g OR (s.rel > s.g AND s.rel < s.e), false)::INT::BIGINT AS covers FROM v_code c LEFT JOIN v_scope s USING (cid) LEFT JOIN v_first g USING (cid)""",
    SCOPE,
)
def guard_scope(spark, d):
    """G19, for the size parameter."""
    s = sn.guard_scope(_snip(spark, d).withColumn("v", F.lit("n")), "v", "x")
    return s.select("cid", F.col("x_guard_at").alias("guard_at"), F.col("x_guard_kind").alias("guard_kind"), flag(F.col("x_guard_covers")).alias("covers"))


@query(
    """
SELECT c.cid, coalesce(f.i + c.code_start_line, 0)::BIGINT AS fault_line, coalesce(f.cond, '') AS cond FROM v_code c LEFT JOIN (
 SELECT * FROM (SELECT a.cid, a.i, a.cond, row_number() OVER (PARTITION BY a.cid ORDER BY a.i) AS rn FROM (
  SELECT l.cid, l.i, l.rel, trim(regexp_extract(l.text, '\\b(if|while)\\s*\\(([^)]+)\\)', 2)) AS cond FROM code_lines l WHERE l.i >= l.rel - 11 AND l.i <= l.rel AND regexp_matches(l.text, '\\b(if|while)\\s*\\(\\s*\\w+\\s*>\\s*\\w+')) a
  WHERE NOT EXISTS (SELECT 1 FROM code_lines b WHERE b.cid = a.cid AND b.i >= a.i AND b.i <= a.rel AND regexp_matches(b.text, '\\b(return|break|goto|exit|abort|longjmp)\\b')
   AND b.i < coalesce((SELECT min(z.i) FROM code_lines z WHERE z.cid = a.cid AND z.i > a.i AND trim(z.text) = '}' AND (SELECT contains(q.text, '{') FROM code_lines q WHERE q.cid = a.cid AND q.i = a.i)), 9999))) WHERE rn = 1) f USING (cid)"""
)
def fault_then_proceed(spark, d):
    """G20."""
    s = _snip(spark, d).select("cid", "code_start_line", sn.fault_then_proceed(F.col("lines"), F.col("rel")).alias("f"))
    return s.select("cid", F.coalesce(F.col("f.i") + F.col("code_start_line"), F.lit(0)).alias("fault_line"), t.txt(F.col("f.cond")).alias("cond"))


SUCCESS = {
    "v_brace": r"""
SELECT cid, i, rel, text, length(replace(text, '{', '')) - length(replace(text, '}', '')) AS d, regexp_matches(text, '\b(if|while)\s*\(([^)]+)\)') AS guard, trim(regexp_extract(text, '\b(if|while)\s*\(([^)]+)\)', 2)) AS cond,
 regexp_extract(text, '(\b\w+(?:->\w+)*)\s*\(', 1) AS call FROM code_lines""",
    # outwards from the flagged line, block by block, to the first one that a condition opens
    "v_opened": """
WITH RECURSIVE walk AS (
 SELECT cid, i, cond, greatest(d, 0) AS depth, d < 0 AND guard AS found FROM v_brace WHERE i = rel
 UNION ALL SELECT b.cid, b.i, b.cond, greatest(walk.depth + b.d, 0), walk.depth + b.d < 0 AND b.guard FROM walk JOIN v_brace b ON b.cid = walk.cid AND b.i = walk.i - 1 WHERE NOT walk.found)
SELECT cid, i, cond FROM walk WHERE found""",
    "v_flagged": r"""
SELECT cid, i, coalesce(nullif(regexp_extract(cond, '\b([A-Za-z_][A-Za-z0-9_]*)\s*==\s*(?:TRUE|true|1)\b', 1), ''), nullif(regexp_extract(cond, '\b([A-Za-z_][A-Za-z0-9_]*)\b', 1), '')) AS var FROM v_opened""",
    "v_success": r"""
SELECT cid, i, var, call FROM (SELECT f.cid, f.i, f.var, c.call, row_number() OVER (PARTITION BY f.cid ORDER BY s.i DESC, c.i) AS rn FROM v_flagged f
 JOIN v_brace s ON s.cid = f.cid AND s.i < f.i AND regexp_matches(s.text, '\b' || f.var || '\s*=\s*(?:TRUE|true|1)\b') JOIN v_brace c ON c.cid = f.cid AND c.i BETWEEN s.i - 6 AND s.i - 1 AND c.call <> '') WHERE rn = 1""",
}


@query("SELECT c.cid, coalesce(x.i + 1, 0)::BIGINT AS guard_at, coalesce(x.var, '') AS var, coalesce(x.call, '') AS call FROM v_code c LEFT JOIN v_success x USING (cid)", SUCCESS)
def guarded_success_calls(spark, d):
    """G21, every answer, whatever the flag is called."""
    s = sn.guarded_success_call(_snip(spark, d), "x")
    return s.select("cid", F.col("x_guard_at").alias("guard_at"), F.col("x_var").alias("var"), F.col("x_call").alias("call"))


@query(
    """
SELECT c.cid, 'stack' AS alloc, CASE WHEN cid % 9 = 0 THEN 'MAX' ELSE p_size::VARCHAR END AS size_expr, CASE WHEN cid % 9 = 0 THEN 0 ELSE p_size END::BIGINT AS size_bytes,
 CASE WHEN cid % 10 = 5 THEN 'malloc' ELSE '' END AS heap, CASE cid % 4 WHEN 0 THEN 32 WHEN 1 THEN 8 WHEN 2 THEN p_size * 3 ELSE 7 END::BIGINT AS constant
FROM v_code c JOIN part ON p_partkey = cid"""
)
def buffer_sizes(spark, d):
    """Declaration, allocation and constants."""
    s = v.code(spark, d).join(v.table(spark, d, "part").select(F.col("p_partkey").alias("cid"), "p_size"), "cid")
    k = F.col("cid") % 4
    expr = F.when(k == 0, "sizeof(int) * 8").when(k == 1, "sizeof(long)").when(k == 2, F.concat(F.col("p_size").cast("string"), F.lit(" * 3"))).otherwise("SEVEN")
    s = s.withColumn("b", sn.buffer_info(F.col("code"), F.lit("buf"))).withColumn("h", sn.buffer_info(F.col("code"), F.lit("p")))
    const = sn.resolve_constant(expr, F.concat(F.lit("#define SEVEN 7\n"), "code"))
    return s.select("cid", t.txt(F.col("b.alloc")).alias("alloc"), t.txt(F.col("b.size_expr")).alias("size_expr"), F.col("b.size_bytes").alias("size_bytes"), t.txt(F.col("h.alloc")).alias("heap"), const.alias("constant"))


# first matching form on the flagged line, the line before, the line after
_ACC = "CASE WHEN regexp_matches(text, '\\b(\\w+)\\s*\\[([^\\]]+)\\]') THEN 1 WHEN regexp_matches(text, '\\*\\s*\\(\\s*(\\w+)\\s*\\+\\s*([^\\)]+)\\)') THEN 2 WHEN regexp_matches(text, '\\*\\s*(\\w+)\\s*\\+\\s*([^;]+)') THEN 3 END"
ACCESS = {
    "v_acc": f"""
SELECT cid, i, arr, idx, CASE WHEN regexp_extract(p, '^([A-Za-z_][A-Za-z0-9_]*)\\b', 1) <> '' THEN regexp_extract(p, '^([A-Za-z_][A-Za-z0-9_]*)\\b', 1) ELSE idx END AS index_var, kind FROM (
 SELECT *, trim(regexp_replace(idx, '\\([^)]+\\)', '', 'g')) AS p, CASE WHEN contains(substr(text, CASE WHEN form = 1 THEN strpos(text, arr) ELSE strpos(text, '*') END), '=') THEN 'write' ELSE 'read' END AS kind FROM (
  SELECT *, CASE form WHEN 1 THEN regexp_extract(text, '\\b(\\w+)\\s*\\[([^\\]]+)\\]', 1) WHEN 2 THEN regexp_extract(text, '\\*\\s*\\(\\s*(\\w+)\\s*\\+\\s*([^\\)]+)\\)', 1) ELSE regexp_extract(text, '\\*\\s*(\\w+)\\s*\\+\\s*([^;]+)', 1) END AS arr,
   trim(CASE form WHEN 1 THEN regexp_extract(text, '\\b(\\w+)\\s*\\[([^\\]]+)\\]', 2) WHEN 2 THEN regexp_extract(text, '\\*\\s*\\(\\s*(\\w+)\\s*\\+\\s*([^\\)]+)\\)', 2) ELSE regexp_extract(text, '\\*\\s*(\\w+)\\s*\\+\\s*([^;]+)', 2) END) AS idx
  FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY abs(i - rel), i) AS rn FROM (SELECT *, {_ACC} AS form FROM code_lines) WHERE form IS NOT NULL AND abs(i - rel) <= 1) WHERE rn = 1))"""
}


@query(
    "SELECT a.cid, a.i::BIGINT AS i, a.arr AS array, a.idx AS index_expr, a.index_var, a.kind, CASE WHEN a.arr = 'buf' AND a.cid % 9 <> 0 THEN p_size ELSE 0 END::BIGINT AS size FROM v_acc a JOIN part ON p_partkey = a.cid", ACCESS
)
def array_access(spark, d):
    """Access at the flagged line and declared size."""
    found = F.filter(F.array(sn.array_access(F.col("lines"), F.col("rel"))), lambda a: a.isNotNull())
    s = _snip(spark, d).select("cid", "lines", F.explode(found).alias("a"))
    s = s.withColumn("d", sn.array_declaration(F.col("lines"), F.col("a.array")))
    return s.select(
        "cid", F.col("a.i").cast("bigint").alias("i"), F.col("a.array").alias("array"), F.col("a.index_expr").alias("index_expr"), F.col("a.index_var").alias("index_var"), F.col("a.kind").alias("kind"),
        F.coalesce(F.col("d.size"), F.lit(0)).cast("bigint").alias("size"),
    )


# assignment and guard around the place and the index that the access has
FLOW_AT = ACCESS | {
    "v_asked": "SELECT cid, i AS upto, index_var AS v FROM v_acc WHERE regexp_matches(index_var, '^[A-Za-z_][A-Za-z0-9_]*$')",
    "v_cond": r"SELECT cid, i, text, regexp_extract(text, '\b(if|while|for)\s*\(([^)]+)\)', 2) AS cond FROM code_lines",
    "v_assign": r"""
SELECT cid, upto, v, i, trim(regexp_extract(text, '\b' || v || '\s*=\s*([^;]+);', 1)) AS expr FROM (SELECT a.*, l.i, l.text, row_number() OVER (PARTITION BY a.cid ORDER BY l.i DESC) AS rn
 FROM v_asked a JOIN code_lines l ON l.cid = a.cid AND l.i <= a.upto AND regexp_matches(l.text, '\b' || a.v || '\s*=\s*([^;]+);')) WHERE rn = 1""",
    "v_own": "SELECT cid, max(l.i) AS i FROM v_asked a JOIN v_cond l USING (cid) WHERE l.i <= a.upto AND contains(l.cond, a.v) GROUP BY 1",
    "v_base": r"""
SELECT * FROM (SELECT cid, upto, regexp_extract(trim(regexp_replace(expr, '\(\s*\w+\s*\)', '', 'g')), '^([A-Za-z_][A-Za-z0-9_]*)\s*\[', 1) AS base FROM v_assign WHERE cid NOT IN (SELECT cid FROM v_own)) WHERE base <> ''""",
    "v_guard": r"""
SELECT g.cid, g.i, trim(l.cond) AS cond, g.name FROM (SELECT o.cid, o.i, '\b' || a.v AS name FROM v_own o JOIN v_asked a USING (cid)
 UNION ALL SELECT b.cid, max(l.i), '\b' || b.base || '\s*\[[^\]]+\]' FROM v_base b JOIN v_cond l ON l.cid = b.cid AND l.i <= b.upto AND contains(l.cond, b.base) GROUP BY b.cid, b.base) g JOIN v_cond l ON l.cid = g.cid AND l.i = g.i""",
    "v_compared": r"""
SELECT *, regexp_extract(cond, name || '\s*([<>!=]=?|==)\s*([^;)\s&|]+)', 1) AS op, trim(regexp_extract(cond, name || '\s*([<>!=]=?|==)\s*([^;)\s&|]+)', 2)) AS lim,
 regexp_extract(cond, '([^;)\s&|]+)\s*([<>!=]=?|==)\s*' || name, 2) AS back, trim(regexp_extract(cond, '([^;)\s&|]+)\s*([<>!=]=?|==)\s*' || name, 1)) AS back_lim FROM v_guard""",
}


@query(
    """
SELECT c.cid, coalesce(a.i + 1, 0)::BIGINT AS assign_at, coalesce(a.expr, '') AS assign_expr, coalesce(g.i + 1, 0)::BIGINT AS guard_at, coalesce(g.cond, '') AS guard_cond,
 coalesce(CASE WHEN g.op <> '' THEN g.op ELSE CASE g.back WHEN '<' THEN '>' WHEN '>' THEN '<' WHEN '<=' THEN '>=' WHEN '>=' THEN '<=' ELSE g.back END END, '') AS guard_op,
 coalesce(CASE WHEN g.op <> '' THEN g.lim ELSE g.back_lim END, '') AS guard_limit FROM v_code c LEFT JOIN v_assign a USING (cid) LEFT JOIN v_compared g USING (cid)""",
    FLOW_AT,
)
def index_flow_at_access(spark, d):
    """Assignment and guard of the index up to the access of each snippet."""
    s = _snip(spark, d).withColumn("acc", sn.array_access(F.col("lines"), F.col("rel")))
    s = sn.index_flow(s.withColumns({"v": t.txt(F.col("acc.index_var")), "a": F.coalesce(F.col("acc.i"), F.lit(-1))}), "lines", "v", "a", "x")
    return s.select("cid", *[F.col(f"x_{c}").alias(c) for c in ("assign_at", "assign_expr", "guard_at", "guard_cond", "guard_op", "guard_limit")])


_BOUND = [
    "event_id AS cid", "CASE event_id % 4 WHEN 0 THEN '<' WHEN 1 THEN '<=' WHEN 2 THEN '>' ELSE '==' END AS op",
    "CASE WHEN event_id % 5 = 0 THEN 'MAX' ELSE CAST(event_id % 30 AS STRING) END AS lim", "CAST(event_id % 25 AS BIGINT) AS size",
    "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 40 - 5 AS BIGINT) END AS traced", "(event_id % 2 = 0) AS covers", "CASE WHEN event_id % 7 = 0 THEN 'p' ELSE 'i' END AS v",
]


@query(
    """
SELECT cid, (CASE WHEN n IS NOT NULL AND op = '<=' THEN n >= size WHEN n IS NOT NULL AND op = '<' THEN n > size WHEN n IS NULL AND op = '<=' THEN true ELSE false END)::INT::BIGINT AS off_by_one,
 coalesce(CASE WHEN op = '<' THEN n <= size WHEN op = '<=' THEN n < size END, false)::INT::BIGINT AS safe,
 CASE WHEN v = 'p' THEN 'irrelevant' WHEN traced IS NOT NULL AND size > 0 THEN CASE WHEN traced >= 0 AND traced < size THEN 'safe' ELSE 'unsafe' END
  WHEN op IN ('<', '<=') THEN CASE WHEN n IS NOT NULL AND size > 0 THEN CASE WHEN n <= size THEN 'safe' ELSE 'unsafe' END WHEN n IS NULL THEN 'safe' WHEN contains('MAX', lim) THEN 'safe' ELSE 'unknown' END
  WHEN covers THEN 'safe' ELSE 'unknown' END AS status
FROM (SELECT *, try_cast(lim AS BIGINT) AS n FROM v_bound)""",
    {"v_bound": "SELECT " + ", ".join(_BOUND) + " FROM events"},
)
def bound_verdicts(spark, d):
    """G24."""
    b = v.table(spark, d, "events").selectExpr(*_BOUND)
    cond = F.concat_ws(" ", F.lit("i"), "op", "lim")
    return b.select(
        "cid", flag(sn.off_by_one(F.col("op"), F.col("lim"), F.col("size"))).alias("off_by_one"), flag(sn.guard_is_safe(cond, F.lit("i"), F.col("size"))).alias("safe"),
        sn.guard_status(cond, F.col("v"), F.col("traced"), F.col("size"), F.lit("MAX"), F.lit("buf"), F.col("covers")).alias("status"),
    )


@query(
    """
SELECT cid, i::BIGINT AS i, event, s AS text FROM (SELECT *, CASE WHEN s = '' OR regexp_matches(s, '^(//|/\\*|\\*)') THEN NULL WHEN regexp_matches(s, '(?:int|char|void|uint\\w*|size_t|BYTE|struct\\s+\\w+)\\s*\\*?\\s*n\\b') THEN 'declared'
 WHEN regexp_matches(s, '\\bn\\s*=') THEN CASE WHEN regexp_matches(s, '\\b(?:recv|fgets|read|getenv|scanf|fread)\\s*\\(') THEN 'taint-src' ELSE 'assigned' END WHEN i = rel AND regexp_matches(s, '\\bn\\b') THEN 'used' END AS event
 FROM (SELECT *, trim(text) AS s FROM code_lines)) WHERE event IS NOT NULL"""
)
def data_flow(spark, d):
    """G26."""
    e = _snip(spark, d).select("cid", F.explode(sn.data_flow(F.col("lines"), F.lit("n"), F.col("rel"))).alias("e"))
    return e.select("cid", F.col("e.i").cast("bigint").alias("i"), F.col("e.event").alias("event"), F.col("e.text").alias("text"))


@query(
    """
SELECT c.cid, coalesce('  Data flow for `n`:' || chr(10) || string_agg('    Line ' || lpad((e.i + e.code_start_line)::VARCHAR, 4, ' ') || ': ' || rpad(e.event, 10, ' ') || '  ' || e.s || CASE WHEN e.i = e.rel THEN '  ← DEFECT' ELSE '' END, chr(10) ORDER BY e.i), '') AS flow
FROM v_code c LEFT JOIN v_flow_rows e USING (cid) GROUP BY c.cid""",
    {"v_flow_rows": """
SELECT cid, i, rel, code_start_line, event, s FROM (SELECT *, CASE WHEN s = '' OR regexp_matches(s, '^(//|/\\*|\\*)') THEN NULL WHEN regexp_matches(s, '(?:int|char|void|uint\\w*|size_t|BYTE|struct\\s+\\w+)\\s*\\*?\\s*n\\b') THEN 'declared'
 WHEN regexp_matches(s, '\\bn\\s*=') THEN CASE WHEN regexp_matches(s, '\\b(?:recv|fgets|read|getenv|scanf|fread)\\s*\\(') THEN 'taint-src' ELSE 'assigned' END WHEN i = rel AND regexp_matches(s, '\\bn\\b') THEN 'used' END AS event
 FROM (SELECT *, trim(text) AS s FROM code_lines)) WHERE event IS NOT NULL"""},
)
def data_flow_texts(spark, d):
    """G26, rendered."""
    s, n = _snip(spark, d), F.lit("n")
    return s.select("cid", sn.data_flow_text(sn.data_flow(F.col("lines"), n, F.col("rel")), n, F.col("rel"), F.col("code_start_line")).alias("flow"))


_BEN = dim.RETURN_BENIGN.replace("(?i)", "").replace("'", "''")
_CRI = dim.RETURN_CRITICAL.replace("(?i)", "").replace("'", "''")
_IGN = dim.RETURN_IGNORED.replace("(?i)", "").replace("'", "''")
FATE = {
    "v_rcall": f"""
SELECT *, regexp_matches(fn, '(?i){_BEN}') AS benign, regexp_matches(fn, '(?i){_CRI}') AS critical FROM (SELECT l.cid, l.i, l.rel, l.text, l.code_start_line, c.function, unnest(regexp_extract_all(l.text, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS fn FROM code_lines l JOIN v_code c USING (cid))
WHERE lower(fn) NOT IN ({quoted_list(dim.RETURN_SKIP)}) AND lower(fn) <> lower(function)""",
    "v_chosen": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY abs(i - rel), fn, i) AS rn FROM (SELECT *, max(NOT benign) OVER (PARTITION BY cid) AS serious FROM v_rcall) WHERE NOT serious OR NOT benign) WHERE rn = 1""",
    "v_fate": f"""
SELECT *, CASE WHEN regexp_matches(text, '(?i){_IGN}') THEN 'ignored' WHEN regexp_matches(pre, '[+\\-*/%&|^<>]?=\\s*[^=]') OR regexp_matches(pre, '\\b(if|while|for|return|assert)\\s*\\(?\\s*$') OR regexp_matches(pre, '(&&|\\|\\||\\?|:)\\s*$') THEN 'used' ELSE 'discard' END AS fate
FROM (SELECT *, regexp_extract(text, '^(.*?)\\b' || fn || '\\s*\\(', 1) AS pre FROM v_chosen)""",
}


@query(
    """
SELECT c.cid, coalesce(f.fn, '') AS fate_call, coalesce(f.i + f.code_start_line, 0)::BIGINT AS fate_line, coalesce(f.fate, '') AS fate,
 CASE WHEN f.fate IS NULL THEN 'Needs review' WHEN f.fate = 'used' THEN 'False positive' WHEN f.fate = 'ignored' THEN 'Intentional' WHEN NOT f.critical AND f.benign THEN 'False positive' ELSE 'Bug' END AS fate_class,
 (CASE WHEN f.fate IS NULL THEN 0.0 WHEN f.fate = 'used' THEN 0.80 WHEN f.fate = 'ignored' THEN 0.85 WHEN f.critical THEN 0.72 WHEN f.benign THEN 0.65 ELSE 0.52 END)::DOUBLE AS fate_confidence
FROM v_code c LEFT JOIN v_fate f USING (cid)""",
    FATE,
)
def checked_return(spark, d):
    """G28."""
    s = sn.checked_return(_snip(spark, d).withColumn("trace_sink", F.lit("")))
    return s.select("cid", "fate_call", "fate_line", "fate", "fate_class", "fate_confidence")


@query(
    f"""
SELECT cid, CASE WHEN contains(x, '*') THEN 'multiplication' WHEN contains(x, '-') THEN 'subtraction' WHEN contains(x, '+') THEN 'addition' ELSE 'arithmetic' END AS operation,
 coalesce(ids[1], 'the operand') AS var, coalesce(ids[2], CASE WHEN contains(x, '*') THEN 'multiplier' WHEN contains(x, '-') THEN 'subtrahend' WHEN contains(x, '+') THEN 'addend' ELSE 'value' END) AS operand
FROM (SELECT *, list_filter(regexp_extract_all(x, '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1), lambda v: v NOT IN ({quoted_list(dim.C_KEYWORDS)}) AND NOT list_contains(calls, v)) AS ids FROM (
 SELECT cid, x, regexp_extract_all(x, '\\b(\\w+)\\s*\\(', 1) AS calls FROM (SELECT l.cid, trim(text) AS x FROM code_lines l WHERE i = rel)))"""
)
def overflow_operation(spark, d):
    """G29."""
    s = _snip(spark, d).select("cid", sn.overflow_operation(F.col("code"), F.col("lines"), F.col("rel")).alias("o"))
    return s.select("cid", "o.operation", "o.var", "o.operand")


@query(
    """
SELECT c.cid, coalesce(k.i, -1)::BIGINT AS call_at, coalesce(regexp_extract(k.text, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(([^)]*)\\)', 1), '') AS call, coalesce(g.i, -1)::BIGINT AS guard_at, coalesce(trim(regexp_extract(g.text, '\\b(if|while|for)\\s*\\(([^)]+)\\)', 2)), '') AS cond,
 coalesce(a.i, -1)::BIGINT AS assign_at, coalesce(trim(regexp_extract(a.text, '\\bi\\s*=\\s*([^;]+);', 1)), '') AS rhs, 2::BIGINT AS decl_line, CASE WHEN c.cid % 9 = 0 THEN 'MAX' ELSE p_size::VARCHAR END AS decl_size
FROM v_code c JOIN part ON p_partkey = c.cid
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY abs(i - rel), i) AS rn FROM code_lines WHERE regexp_matches(text, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(([^)]*)\\)')) k ON k.cid = c.cid AND k.rn = 1
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY i DESC) AS rn FROM code_lines WHERE i <= rel AND regexp_matches(text, '\\b(if|while|for)\\s*\\(([^)]+)\\)')) g ON g.cid = c.cid AND g.rn = 1
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY i DESC) AS rn FROM code_lines WHERE i <= rel AND regexp_matches(text, '\\bi\\s*=\\s*([^;]+);')) a ON a.cid = c.cid AND a.rn = 1"""
)
def nearest_above(spark, d):
    """Nearest call, guard and assignment; first declaration."""
    lines, rel = F.col("lines"), F.col("rel")
    s = _snip(spark, d).select(
        "cid", sn.nearest_call(lines, rel).alias("k"), sn.nearest_guard(lines, rel).alias("g"), sn.latest_assignment(lines, F.lit("i"), rel).alias("a"), sn.first_declaration(F.col("code"), F.lit("buf")).alias("d")
    )
    pos = lambda c: F.coalesce(F.col(f"{c}.i"), F.lit(-1)).cast("bigint")
    return s.select(
        "cid", pos("k").alias("call_at"), t.txt(F.col("k.fn")).alias("call"), pos("g").alias("guard_at"), t.txt(F.col("g.cond")).alias("cond"), pos("a").alias("assign_at"), t.txt(F.col("a.rhs")).alias("rhs"),
        F.col("d.line").alias("decl_line"), F.col("d.size_expr").alias("decl_size"),
    )
