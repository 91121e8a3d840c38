"""Queries over sources (S1-S9, S14). Reports, sheets and issue pages are derived by
Spark from the shared tables, 50 findings per page, and read back by the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import trace as tr
from assayer.functions import text as t
from assayer.functions.frames import dealt
from assayer.plans import views as v
from assayer.plans.q_trace import RANKED
from assayer.plans.registry import flag, query
from assayer.session import scratch_dir
from assayer.sources import issues_json, report_html, sinks, tabular, tree

PAGE_NO = "CAST(floor(cid / 50) AS BIGINT)"
_ROW = (
    "concat('<tr><td><a href=\"Code/p', CAST(cid AS STRING), '.html#L1\">', CAST(cid AS STRING), '</a></td><td>', checker, '</td><td>', file, ':', CAST(line AS STRING), "
    "'</td><td> <b>', function, '</b> </td><td>Out-of-bounds &amp; more</td><td>', severity, '</td></tr>')"
)
_HEAD = "<html><body><h1>Report</h1><table border=1><tr><th>CID</th><th>Checker</th><th>File</th><th>Function</th><th>Type</th><th>Severity</th></tr>"


def _reports(spark, d):
    rows = v.findings(spark, d).selectExpr("cid", f"{PAGE_NO} AS page_no", f"{_ROW} AS tr")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cid", "tr"))), lambda x: x["tr"]), "\n")
    return dealt(rows, "page_no").groupBy("page_no").agg(body.alias("body")).select(
        F.concat(F.lit("r"), F.col("page_no").cast("string")).alias("path"), F.concat(F.lit(_HEAD), "body", F.lit("</table><table><tr><td>1</td><td>X_Y_Z</td><td>a/b.c</td></tr></table></body></html>")).alias("html")
    )


# what the index scan reads back from a finding
_SCANNED = """
SELECT 'r' || CAST(floor(cid / 50) AS BIGINT) AS path, cid, CASE WHEN checker = 'deadcode' THEN '' ELSE checker END AS checker, 'Out-of-bounds & more' AS type, severity, file, line,
 CASE WHEN function <> 'N/A' THEN regexp_replace(function, '\\(.*\\)$', '') WHEN checker = 'deadcode' THEN 'deadcode' ELSE '' END AS function, 'Code/p' || cid || '.html' AS href FROM v_findings"""


@query(_SCANNED)
def scan_index(spark, d):
    """S1, S2."""
    return report_html.scan_index(_reports(spark, d)).drop("row_no")


@query(_SCANNED)
def pages_reread(spark, d):
    """Report pages written as files and read again."""
    root = scratch_dir(spark, "pages")
    sinks.write_files(_reports(spark, d).select(F.concat("path", F.lit(".html")).alias("path"), F.col("html").alias("content")), root)
    out = report_html.scan_index(report_html.read_pages(spark, root)).drop("row_no")
    return out.withColumn("path", F.regexp_replace(t.basename(F.col("path")), r"\.html$", ""))


@query("SELECT path, content, strlen(content) AS length FROM v_files")
def tree_reread(spark, d):
    """Source files written to folders and scanned again; build folders and other files stay out."""
    root, files = scratch_dir(spark, "tree"), v.files(spark, d)
    other = files.where("path LIKE '%7.c'")
    sinks.write_files(files.unionByName(other.withColumn("path", F.concat(F.lit("build/"), "path"))).unionByName(other.withColumn("path", F.concat("path", F.lit(".txt")))), root)
    return tree.scan_tree(spark, root).select("path", "content", "length")


# a third of the detail pages at the linked place, a third elsewhere, a third under a longer name
_LISTED = "concat(CASE cid % 3 WHEN 0 THEN 'Code/p' WHEN 1 THEN 'other/p' ELSE 'x/zp' END, CAST(cid AS STRING), '.html') AS rel_path"


@query(f"SELECT s.cid, l.rel_path AS detail_file FROM v_scanned s JOIN (SELECT cid, {_LISTED} FROM v_findings) l USING (cid)", {"v_scanned": _SCANNED})
def detail_links(spark, d):
    """S3."""
    listing = v.findings(spark, d).selectExpr(_LISTED, "cid AS ordinal")
    return report_html.resolve_links(report_html.scan_index(_reports(spark, d)), listing).select("cid", "detail_file")


_N = "CAST(p_size + 100 AS STRING)"
_DETAIL = (
    "concat('<html><body><pre>', chr(10), '(1) Event var_decl:', chr(10), 'Variable buf declared here.', chr(10), '  ', " + _N + ", '      char buf[10];', chr(10), "
    "'(2) Event overrun-local: Overrunning &lt;buf&gt;', chr(10), '(3) Event note:', chr(10), '  ', CAST(p_size + 104 AS STRING), '  memcpy(a, b);', chr(10), "
    "CASE WHEN p_partkey % 3 = 0 THEN concat('  ', CAST(p_size + 105 AS STRING), '  x = 1;', chr(10)) ELSE '' END, '(4) Event end: last', chr(10), "
    "CASE WHEN p_partkey % 2 = 0 THEN concat('  ', CAST(p_size + 109 AS STRING), '  y;') ELSE 'no code' END, chr(10), '</pre></body></html>')"
)


def _details(spark, d):
    return v.table(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS path", f"{_DETAIL} AS html")


@query(
    """
SELECT p_partkey::VARCHAR AS path, 1::BIGINT AS step, 'var_decl' AS tag, 'Variable buf declared here.' AS description, p_size::BIGINT + 100 AS line FROM part
UNION ALL SELECT p_partkey::VARCHAR, 2, 'overrun-local', 'Overrunning <buf>', CASE WHEN p_partkey % 3 = 0 THEN p_size::BIGINT + 105 ELSE 0 END FROM part
UNION ALL SELECT p_partkey::VARCHAR, 3, 'note', '', p_size::BIGINT + 104 FROM part
UNION ALL SELECT p_partkey::VARCHAR, 4, 'end', 'last', CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT + 109 ELSE 0 END FROM part"""
)
def detail_trace(spark, d):
    """Code lines fill the latest event that has no line yet."""
    return report_html.detail_trace(_details(spark, d)).drop("ordinal")


@query(
    """
SELECT p_partkey::VARCHAR AS path, '   ' || (p_size + 100) || '  char buf[10];' || chr(10) || '   ' || (p_size + 104) || '  memcpy(a, b);' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '   ' || (p_size + 105) || '  x = 1;' ELSE '' END
 || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '   ' || (p_size + 109) || '  y;' ELSE '' END AS source_code FROM part"""
)
def detail_source(spark, d):
    """Numbered source lines."""
    return report_html.detail_source(_details(spark, d))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages")
def html_anchors(spark, d):
    """S1-S3 mechanics on whole pages: every link."""
    return v.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1)).alias("href"))


@query("SELECT page_id, trim(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&amp;', '&')) AS item FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1)) AS x FROM pages)")
def html_list_rows(spark, d):
    """S1 mechanics on whole pages: text of every list item."""
    items = v.table(spark, d, "pages").select("page_id", F.explode(report_html.elements(F.col("html"), "li")).alias("x"))
    return items.select("page_id", report_html.cell_text(F.col("x")).alias("item"))


SHEET = [
    "CASE WHEN cid % 23 = 0 THEN concat('x', CAST(cid AS STRING)) ELSE CAST(cid AS STRING) END AS Issue_ID", "checker AS Checker", "severity AS Impact", "file AS `Source File`",
    "CASE WHEN cid % 17 = 0 THEN ' Various ' WHEN cid % 19 = 0 THEN 'n/a' ELSE CAST(line AS STRING) END AS `Line-Number`", "function AS Function_Name", "ordinal",
]


COMMENT = "concat('said ', chr(34), 'ok, ', comment, chr(34), chr(10), CASE WHEN cid % 3 = 0 THEN concat(chr(10), '; ') ELSE 'line, ' END, CAST(cid AS STRING)) AS Comment"


@query("""SELECT CASE WHEN cid % 23 = 0 THEN 'x' || cid ELSE cid::VARCHAR END AS issue, file, CASE WHEN cid % 17 = 0 THEN 'Various' WHEN cid % 19 = 0 THEN 'n/a' ELSE line::VARCHAR END AS line,
 'said "ok, ' || comment || '"' || chr(10) || CASE WHEN cid % 3 = 0 THEN chr(10) || '; ' ELSE 'line, ' END || cid AS comment FROM v_findings""")
def sheet_reread(spark, d):
    """A sheet with cells of several lines, written and read again in splits."""
    path = scratch_dir(spark, "sheet")
    sinks.write_table(v.findings(spark, d).selectExpr(*SHEET, COMMENT), path, "csv", by=None)
    rows = tabular.read_table(spark, path)
    return rows.select(F.col("Issue_ID").alias("issue"), F.col("`Source File`").alias("file"), t.strip(F.col("`Line-Number`")).alias("line"), F.col("Comment").alias("comment"))


@query(
    """
SELECT cid, checker, severity, file, CASE WHEN cid % 17 = 0 OR cid % 19 = 0 THEN 0 ELSE line END AS line, (cid % 17 = 0)::INT::BIGINT AS line_is_various,
 CASE WHEN function = 'N/A' THEN '' ELSE regexp_replace(function, '\\(.*\\)$', '') END AS function FROM v_findings WHERE cid % 23 <> 0"""
)
def sheet_findings(spark, d):
    """Fuzzy headings; rows without an integer id drop out."""
    f = tabular.findings_from_table(v.findings(spark, d).selectExpr(*SHEET))
    return f.select("cid", "checker", "severity", "file", "line", flag(F.col("line_is_various")).alias("line_is_various"), "function")


@query(
    """
SELECT f.cid, CASE WHEN e.line IS NULL THEN CASE WHEN f.cid % 17 = 0 THEN 0 ELSE f.line END ELSE e.line END AS line, CASE WHEN f.cid % 17 = 0 AND e.line IS NULL THEN 1 ELSE 0 END::BIGINT AS line_is_various
FROM v_findings f LEFT JOIN v_elected e USING (cid)""",
    RANKED,
)
def sheet_lines_from_whole_trace(spark, d):
    """A trace with any line gives the line and clears the flag, whether an event is flagged or not."""
    sheet = v.findings(spark, d)
    f = sheet.withColumn("line_is_various", F.col("cid") % 17 == 0)
    f = f.withColumn("line", F.when(F.col("line_is_various"), 0).otherwise(F.col("line")))
    out = tabular.settle_line(f, tr.trace_line(v.trace(spark, d), sheet))
    return out.select("cid", F.col("line").cast("bigint").alias("line"), flag(F.col("line_is_various")).alias("line_is_various"))


def _issue_struct():
    ev = lambda no, tag, line, main: F.struct(F.lit(no).alias("eventNumber"), F.lit(tag).alias("eventTag"), line.alias("lineNumber"), F.lit(main).alias("main"), F.lit("d").alias("eventDescription"))
    line = F.col("line")
    return F.struct(
        F.when(F.col("cid") % 5 != 0, F.col("cid")).alias("cid"), F.struct(F.col("cid").alias("cid")).alias("mergedDefectId"), F.col("checker").alias("checkerName"),
        F.col("type").alias("displayType"), F.col("severity").alias("displayImpact"), F.when(F.col("cid") % 2 == 0, F.col("file")).alias("mainEventFilePath"),
        F.concat(F.lit("alt"), "file").alias("filePathname"), F.when(F.col("cid") % 3 == 0, line).alias("mainEventLineNumber"), (line + 1000).alias("lineNumber"),
        F.col("function").alias("functionDisplayName"), F.array(ev(1, "var_decl", line, False), ev(2, "sink", line + 4, True)).alias("events"),
    )


def _object_pages(spark, d):
    """Search pages whose rows are objects."""
    rows = v.findings(spark, d).select("cid", F.expr(f"{PAGE_NO} AS page_no"), _issue_struct().alias("issue"))
    return dealt(rows, "page_no").groupBy("page_no").agg(F.to_json(F.struct(F.collect_list("issue").alias("rows"))).alias("value"))


def _positional_pages(spark, d):
    """Search pages whose rows are positional."""
    row = F.array(F.col("cid").cast("string"), "checker", "severity", "file", F.col("line").cast("string"))
    names = F.from_json(F.lit('[{"name":"cid"},{"name":"checkerName"},{"name":"","id":"displayImpact"},{"name":"mainEventFilePath"},{"name":"mainEventLineNumber"},{"name":"unused"}]'), "ARRAY<STRUCT<name: STRING, id: STRING>>")
    rows = v.findings(spark, d).select(F.expr(f"{PAGE_NO} AS page_no"), row.alias("row"))
    return dealt(rows, "page_no").groupBy("page_no").agg(F.to_json(F.struct(names.alias("columns"), F.collect_list("row").alias("rows"))).alias("value"))


@query("SELECT CAST(floor(cid / 50) AS BIGINT) AS page_no, cid, checker, severity, file, line, line AS rest_main_line, CASE WHEN line <> 0 THEN 'rest_main' ELSE 'rest' END AS line_src FROM v_findings")
def issues_from_pages(spark, d):
    """S7, S8 (older shape, no events)."""
    f = issues_json.findings_from_issues(issues_json.issue_rows(_positional_pages(spark, d)), v1=True)
    return f.select("page_no", "cid", "checker", "severity", "file", "line", "rest_main_line", "line_src")


@query(
    "SELECT cid, checker, type, CASE WHEN cid % 2 = 0 THEN file ELSE 'alt' || file END AS file, function, CASE WHEN cid % 3 = 0 AND line <> 0 THEN line ELSE line + 1000 END AS line, "
    "CASE WHEN cid % 3 = 0 AND line <> 0 THEN 'rest_main' ELSE 'rest' END AS line_src, 2::BIGINT AS n_events FROM v_findings"
)
def issue_findings(spark, d):
    """Object rows with events; the cid may be nested."""
    f = issues_json.findings_from_issues(issues_json.issue_rows(_object_pages(spark, d)))
    return f.select("cid", "checker", "type", "file", "function", "line", "line_src", F.size("events").cast("bigint").alias("n_events"))


@query(
    "SELECT cid, 0::BIGINT AS ordinal, 1::BIGINT AS step, 'var_decl' AS tag, line, 0::BIGINT AS main FROM v_findings UNION ALL SELECT cid, 1, 2, 'sink', line + 4, 1 FROM v_findings"
)
def issue_trace(spark, d):
    """Events of issue objects as a trace."""
    f = issues_json.findings_from_issues(issues_json.issue_rows(_object_pages(spark, d)))
    e = issues_json.trace_from_events(f)
    return e.select("cid", "ordinal", "step", "tag", "line", flag(F.col("main")).alias("main"))


@query(
    """
SELECT cid, o AS ordinal, s AS step, CASE s WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' ELSE 'd' END AS tag, line + s AS line, CASE WHEN s = 3 THEN 'deep.c' ELSE '' END AS file
FROM v_findings, (VALUES (0::BIGINT, 1::BIGINT), (1, 2), (2, 3), (3, 4)) AS t(o, s)"""
)
def flattened_events(spark, d):
    """Pre-order of event trees."""
    line = F.col("line")
    deep = F.struct(F.lit(3).alias("eventNumber"), F.lit("c").alias("eventTag"), (line + 3).alias("lineNumber"), F.struct(F.lit("deep.c").alias("filePathname")).alias("fileId"))
    mid = F.struct(F.lit(2).alias("eventNumber"), F.lit("b").alias("eventTag"), (line + 2).alias("lineNumber"), F.array(deep).alias("events"))
    top = F.struct(F.lit(1).alias("eventNumber"), F.lit("a").alias("eventTag"), (line + 1).alias("lineNumber"), F.array(mid).alias("events"))
    last = F.struct(F.lit(4).alias("eventNumber"), F.lit("d").alias("eventTag"), (line + 4).alias("lineNumber"))
    trees = v.findings(spark, d).select("cid", F.concat(F.lit("["), F.to_json(top), F.lit(","), F.to_json(last), F.lit("]")).alias("events"))
    return issues_json.flatten_events(trees).select("cid", "ordinal", "step", "tag", "line", "file")


LAYOUT = [
    "CASE WHEN ordinal % 31 = 0 THEN 'abc' ELSE CAST(cid AS STRING) END AS CID", "CASE WHEN ordinal % 2 = 0 THEN classification ELSE '' END AS Classification",
    "CASE WHEN ordinal % 2 = 1 AND ordinal % 7 <> 0 THEN classification END AS FinalClassification", "comment AS FinalComment", "'K' AS checker", "ordinal",
]


@query(
    "SELECT cid, classification, comment, 'K' AS checker FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY ordinal DESC) AS rn FROM v_decisions WHERE ordinal % 31 <> 0 AND (ordinal % 2 = 0 OR ordinal % 7 <> 0)) WHERE rn = 1"
)
def decisions_scan(spark, d):
    """S14."""
    return tabular.decisions_from_table(v.decisions(spark, d).selectExpr(*LAYOUT)).select("cid", "classification", "comment", "checker")


@query("SELECT count(*) AS rejected FROM v_decisions WHERE ordinal % 31 = 0 AND (ordinal % 2 = 0 OR ordinal % 7 <> 0)")
def decisions_rejected(spark, d):
    """Rows whose cid is no integer are counted."""
    return tabular.rejected_decisions(v.decisions(spark, d).selectExpr(*LAYOUT))
