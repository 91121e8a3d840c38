"""Views over the shared tables that play findings, traces, code and reports.

Each view is a list of SQL expressions that mean the same in Spark and in DuckDB,
so a query and its check read the same input. No window, no row filter: every view
keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = [
    "o_orderkey AS cid",
    "CASE o_orderkey % 12 WHEN 0 THEN 'BUFFER_SIZE' WHEN 1 THEN 'OVERRUN' WHEN 2 THEN 'FORWARD_NULL' WHEN 3 THEN 'RESOURCE_LEAK' "
    "WHEN 4 THEN 'CHECKED_RETURN' WHEN 5 THEN 'UNINIT' WHEN 6 THEN 'DIVIDE_BY_ZERO' WHEN 7 THEN 'STRING_NULL' WHEN 8 THEN 'deadcode' "
    "WHEN 9 THEN 'USE_AFTER_FREE' WHEN 10 THEN 'MISSING_LOCK' ELSE 'CUSTOM_RULE' END AS checker",
    "CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'High' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' ELSE 'Low' END AS severity",
    "concat('/src/m', CAST(o_custkey % 40 AS STRING), '/f', CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey % 97 END AS STRING), "
    "CASE WHEN o_orderkey % 5 = 0 THEN '.cpp' ELSE '.c' END) AS file",
    "CAST(o_orderkey % 900 AS BIGINT) AS line",
    "CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE concat('fn_', CAST(o_orderkey % 211 AS STRING), '()') END AS function",
    "CASE o_orderstatus WHEN 'F' THEN 'Bug' WHEN 'O' THEN 'False positive' ELSE 'Needs review' END AS classification",
    "(o_custkey % 3 = 0) AS accepted",
    "(o_custkey % 7 = 0) AS overridden",
    "o_orderkey AS ordinal",
    "concat('Type ', CAST(o_custkey % 4 AS STRING)) AS type",
    "concat('c', CAST(o_custkey % 3 AS STRING)) AS comment",
]

# The store lists some findings under another number and some without one.
SERVER = [
    "CASE WHEN cid % 11 = 0 THEN NULL WHEN cid % 10 < 7 THEN cid ELSE cid + 1000000 END AS cid",
    "checker",
    "concat('/build', file) AS file",
]

_Q = "chr(39)"
TRACE = [
    "l_orderkey AS cid",
    "CAST((l_partkey * 8 + l_linenumber) * 1024 + l_suppkey % 1024 AS BIGINT) AS ordinal",
    "CAST(l_linenumber AS BIGINT) AS step",
    "CASE l_suppkey % 12 WHEN 0 THEN 'var_decl' WHEN 1 THEN 'overrun-local' WHEN 2 THEN 'cond_true' WHEN 3 THEN 'buffer_size' "
    "WHEN 4 THEN 'buffer_size_warning' WHEN 5 THEN 'string_null_source' WHEN 6 THEN 'string_null' WHEN 7 THEN 'assignment' "
    "WHEN 8 THEN 'condition' WHEN 9 THEN 'tainted_data' WHEN 10 THEN 'check_return' ELSE 'return_constant' END AS tag",
    "CAST(l_partkey % 900 AS BIGINT) AS line",
    "(l_suppkey % 29 = 0) AS main",
    "'' AS file",
    "CASE l_suppkey % 12 "
    "WHEN 0 THEN concat('Variable ', chr(34), 'buf', chr(34), ' declared here.') "
    "WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN concat('Overrunning array \"buf\" of ', CAST(CAST(l_quantity AS INT) AS STRING), "
    "' bytes at byte offset 64 using index \"i\" (which evaluates to ', CAST(l_partkey % 64 AS STRING), ').') "
    "ELSE concat('index may be ', CAST(l_partkey % 64 AS STRING), ', array size is ', CAST(CAST(l_quantity AS INT) AS STRING)) END "
    f"WHEN 3 THEN CASE WHEN l_partkey % 2 = 0 THEN concat('Calling ', {_Q}, 'strncpy', {_Q}, ' with a maximum size argument of ', CAST(l_partkey % 50 AS STRING), "
    f"' bytes on destination array ', {_Q}, 'd', CAST(l_partkey % 5 AS STRING), {_Q}, ' of size 48 bytes.') "
    "ELSE 'might leave the destination string unterminated' END "
    f"WHEN 5 THEN concat('copy from source string ', {_Q}, 's', CAST(l_partkey % 7 AS STRING), {_Q}, ' into destination buffer ', {_Q}, 'dst', {_Q}) "
    "WHEN 6 THEN 'pointer \"p\" has value NULL' "
    "WHEN 7 THEN CASE WHEN l_partkey % 2 = 0 THEN concat('Assigning: \"n\" = get(). The value of \"n\" is now ', CAST(l_partkey % 100 AS STRING), '.') "
    "ELSE concat('idx = get(). idx is ', CAST(l_partkey % 100 AS STRING), '.') END "
    "WHEN 8 THEN 'Condition \"p != NULL\", taking true branch.' "
    f"WHEN 9 THEN concat('Calling ', {_Q}, CASE WHEN l_partkey % 2 = 0 THEN 'strcpy' ELSE 'log_it' END, {_Q}, ' with tainted data') "
    "WHEN 10 THEN 'Compare the result' "
    "WHEN 11 THEN concat('get() returns -', CAST(l_partkey % 9 AS STRING)) "
    "ELSE 'step' END AS description",
]

_K = "CAST(p_partkey % 211 AS STRING)"
_LINES = [
    f"CASE WHEN p_partkey % 7 = 0 THEN concat('int fn_', {_K}, '(void) {{') WHEN p_partkey % 11 = 0 THEN concat('unsigned fn_', {_K}, '(uint32_t len, int n) {{') "
    f"ELSE concat('void fn_', {_K}, '(const char *src, int n) {{') END",
    "concat('  char buf[', CASE WHEN p_partkey % 9 = 0 THEN 'MAX' ELSE CAST(p_size AS STRING) END, '];')",
    "CASE p_partkey % 4 WHEN 0 THEN concat('  int i = ', CAST(p_size % 9 AS STRING), ';') WHEN 1 THEN '  int i = atoi(src);' WHEN 2 THEN '  int i = n;' ELSE '  i = recv(s, buf, n);' END",
    "CASE p_partkey % 5 WHEN 0 THEN '  if (src != NULL) {' WHEN 1 THEN '  if (n < 0) { return; }' WHEN 2 THEN concat('  if (i < ', CAST(p_size AS STRING), ') {') "
    "WHEN 3 THEN '  while (i <= n) {' ELSE '  // checked by caller' END",
    "CASE p_partkey % 6 WHEN 0 THEN '  strcpy(buf, src);' WHEN 1 THEN '  strncpy(buf, src, sizeof(buf)-1);' WHEN 2 THEN '  strncpy(buf, src, sizeof(buf));' "
    "WHEN 3 THEN '  memcpy(buf, src, n);' WHEN 4 THEN '  sprintf(buf, fmt(n, i), src);' ELSE '  (void)close(n);' END",
    "CASE p_partkey % 8 WHEN 0 THEN '  buf[i] = 0;' WHEN 1 THEN '  free(src);' WHEN 2 THEN '  n = read(s, buf, n);' WHEN 3 THEN concat('  fn_', CAST((p_partkey * 7) % 211 AS STRING), '(buf, n);') "
    f"WHEN 4 THEN concat('  buf[n - 1] = ', {_Q}, chr(92), '0', {_Q}, ';') WHEN 5 THEN '  if (buf[i] == 0) x = buf[i];' WHEN 6 THEN '  y = *(buf + i);' ELSE '  len = (size_t)n * 2;' END",
    "CASE WHEN p_partkey % 5 IN (0, 2, 3) THEN '  }' ELSE '  i += 2;' END",
    "CASE p_partkey % 10 WHEN 0 THEN '  memset(buf, 0, sizeof(buf));' WHEN 1 THEN '  open_it(n);' WHEN 2 THEN '  printf(\"%d\", n / i);' WHEN 3 THEN '  /* fallthrough */' "
    "WHEN 4 THEN '  goto done;' WHEN 5 THEN '  p = malloc(n);' WHEN 6 THEN '  assert(0);' WHEN 7 THEN '  ok = TRUE;' WHEN 8 THEN '  if (n > INT_MAX) return;' ELSE '  // TODO: later' END",
    "concat('  if (len > ', CAST(p_size AS STRING), ') {')",
    "CASE WHEN p_partkey % 3 = 0 THEN '    return;' ELSE '    report(len);' END",
    "'  }'",
    "CASE WHEN p_partkey % 10 = 7 THEN '  if (ok == TRUE) {' ELSE '  {' END",
    f"concat('    fn_', CAST((p_partkey + 1) % 211 AS STRING), '(src, ', CASE p_partkey % 3 WHEN 0 THEN CAST(p_size % 60 AS STRING) WHEN 1 THEN 'n' ELSE 'atoi(src)' END, ', buf[n - 1]);')",
    "'  }'",
    "'}'",
]
CODE = [
    "p_partkey AS cid",
    "concat_ws(chr(10), " + ", ".join(_LINES) + ") AS code",
    "CAST(1 + (p_partkey % 50) * 10 AS BIGINT) AS code_start_line",
    "CAST(1 + (p_partkey % 50) * 10 + p_size % 15 AS BIGINT) AS line",
    "concat('fn_', CAST(p_partkey % 211 AS STRING)) AS function",
    "CASE p_partkey % 25 WHEN 0 THEN 'BUFFER_SIZE' WHEN 1 THEN 'OVERRUN' WHEN 2 THEN 'FORWARD_NULL' WHEN 3 THEN 'RESOURCE_LEAK' WHEN 4 THEN 'CHECKED_RETURN' "
    "WHEN 5 THEN 'UNINIT' WHEN 6 THEN 'DIVIDE_BY_ZERO' WHEN 7 THEN 'STRING_NULL' WHEN 8 THEN 'DEADCODE' WHEN 9 THEN 'USE_AFTER_FREE' WHEN 10 THEN 'MISSING_LOCK' "
    "WHEN 11 THEN 'CUSTOM_RULE' WHEN 12 THEN 'INTEGER_OVERFLOW' WHEN 13 THEN 'REVERSE_INULL' WHEN 14 THEN 'ARRAY_VS_SINGLETON' WHEN 15 THEN 'NEGATIVE_RETURNS' "
    "WHEN 16 THEN 'UNUSED_VALUE' WHEN 17 THEN 'SIZEOF_MISMATCH' WHEN 18 THEN 'CONSTANT_EXPRESSION_RESULT' WHEN 19 THEN 'NO_BREAK' WHEN 20 THEN 'SHIFT_OVERFLOW' "
    "WHEN 21 THEN 'OVERRUN_STATIC' WHEN 22 THEN 'CHECKED_QRS' WHEN 23 THEN 'OVERRUN_DYNAMIC' ELSE 'BUFFER_SIZE' END AS checker",
]

DECISIONS = [
    "user_id AS cid",
    "ts",
    "event_id AS ordinal",
    "CASE event_type WHEN 'error' THEN 'Bug' WHEN 'click' THEN 'False positive' WHEN 'view' THEN 'Intentional' "
    "WHEN 'purchase' THEN 'Accepted' ELSE 'Needs review' END AS classification",
    "concat('c', CAST(event_id % 3 AS STRING)) AS comment",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*FINDINGS)


def server(spark, sf_dir) -> DataFrame:
    return findings(spark, sf_dir).selectExpr(*SERVER)


def trace(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*TRACE)


def code(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*CODE)


def decisions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*DECISIONS)


FILE_NO = "CAST(floor(cid / 8) AS BIGINT)"
FILE_PATH = "concat('src/m', CAST(file_no % 40 AS STRING), '/f', CAST(file_no AS STRING), '.c')"


def files(spark, sf_dir) -> DataFrame:
    """Source files of eight functions each: path, content."""
    grouped = code(spark, sf_dir).selectExpr(f"{FILE_NO} AS file_no", "cid", "code").groupBy("file_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cid", "code"))), lambda x: x["code"]), "\n\n").alias("content")
    )
    return grouped.selectExpr(f"{FILE_PATH} AS path", "concat('#include <x.h>', chr(10), content) AS content")


def _select(exprs: list[str], source: str) -> str:
    return "SELECT " + ", ".join(exprs) + f" FROM {source}"


# The same views for the check; later ones read earlier ones.
SQL_VIEWS = {
    "v_findings": _select(FINDINGS, "orders"),
    "v_server": _select(SERVER, "v_findings"),
    "v_trace": _select(TRACE, "lineitem"),
    "v_code": _select(CODE, "part"),
    "v_decisions": _select(DECISIONS, "events"),
    "v_files": f"SELECT {FILE_PATH} AS path, concat('#include <x.h>', chr(10), content) AS content FROM "
    f"(SELECT {FILE_NO} AS file_no, string_agg(code, chr(10) || chr(10) ORDER BY cid) AS content FROM v_code GROUP BY 1)",
    # lines, zero-based index i and index rel of the flagged line
    "code_lines": "SELECT cid, i, text, line - code_start_line AS rel, code_start_line, line FROM (SELECT cid, line, code_start_line, "
    "unnest(string_split(code, chr(10))) AS text, generate_subscripts(string_split(code, chr(10)), 1) - 1 AS i FROM v_code)",
    "file_lines": "SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM v_files",
}
NEEDS = {
    "v_server": ["v_findings"], "v_files": ["v_code"], "code_lines": ["v_code"], "file_lines": ["v_files"],
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """A statement that starts with the views it reads, in order."""
    views = {**SQL_VIEWS, **(extra or {})}
    wanted: list[str] = []

    def visit(name: str) -> None:
        for other in views:
            if other != name and other not in wanted and _mentions(views[name], other):
                visit(other)
        if name not in wanted:
            wanted.append(name)

    for name in views:
        if _mentions(sql, name):
            visit(name)
    if not wanted:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in wanted) + "\n" + sql


def _mentions(sql: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", sql) is not None
