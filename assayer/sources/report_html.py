"""HTML report scans (S1-S4): index table, content-detected columns, detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions import text as t
from assayer.session import staged

# Column patterns
CID = r"^\d+$"
CHECKER = r"^[A-Z][A-Z_\d]+$"
LINE = r"^\d+$"
HASH = r"^[0-9a-fA-F]{16,}$"
IDENT = r"^[A-Za-z_][A-Za-z0-9_]*$"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files below a folder: path, html. One row per file; files are the unit of work."""
    return (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    )


def unescape(col: Column) -> Column:
    """Named entities that reports use; the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def cell_text(html: Column) -> Column:
    """Text of a cell: tags removed with the white space around them."""
    return t.strip(unescape(F.regexp_replace(html, r"\s*<[^>]*>\s*", "")))


def elements(html: Column, tag: str) -> Column:
    """Inner HTML of every ``<tag>`` element."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)


def first_href(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"']", 1)


def _first_index(cells: Column, test) -> Column:
    """Index of the first cell that passes ``test(text, index)``; NULL for none."""
    hits = F.filter(F.transform(cells, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def is_path(x: Column) -> Column:
    return ((F.instr(x, "/") > 0) | (F.instr(x, "\\") > 0)) & (F.length(x) > 3)


def is_checker(x: Column) -> Column:
    return x.rlike(CHECKER) & (F.length(x) > 3)


def report_rows(pages: DataFrame) -> DataFrame:
    """Data rows of the first table of each page: path, row_no, cells, raw cells, header columns."""
    first_table = F.regexp_extract("html", r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    rows = pages.select("path", elements(first_table, "tr").alias("trs"))
    head = F.get("trs", F.lit(0))
    ths = F.transform(elements(head, "th"), lambda x: F.lower(cell_text(x)))
    tds = F.transform(elements(head, "td"), lambda x: F.lower(cell_text(x)))
    header = (
        F.when(F.size(ths) > 0, ths).when(F.get(tds, F.lit(0)).isin(*dim.HEADER_WORDS), tds).otherwise(F.array().cast("array<string>"))
    )

    def last_index(words: list[str]) -> Column:
        at = F.transform("header", lambda x, i: F.when(x.isin(*words), i))
        return F.array_max(F.filter(at, lambda i: i.isNotNull()))

    return (
        rows.withColumn("header", header)
        .select(
            "path",
            last_index(["type"]).alias("type_col"),
            last_index(dim.FUNCTION_HEADERS).alias("function_col"),
            F.when(F.size("header") > 0, 1).otherwise(0).alias("start"),
            F.posexplode("trs").alias("row_no", "tr"),
        )
        .where(F.col("row_no") >= F.col("start"))
        .withColumn("raw", elements(F.col("tr"), "td"))
        .where(F.size("raw") >= 3)
        .withColumn("cells", F.transform("raw", cell_text))
        .drop("start")
    )


def findings_from_rows(rows: DataFrame) -> DataFrame:
    """Typed findings from row cells; the first matching cell wins."""
    cells = F.col("cells")
    rows = rows.withColumn("cid_idx", _first_index(cells, lambda x, i: x.rlike(CID))).where(F.col("cid_idx").isNotNull())
    other = lambda i: i != F.col("cid_idx")
    rows = rows.withColumn("file_idx", _first_index(cells, lambda x, i: other(i) & is_path(x)))
    place = t.txt(F.get(cells, F.col("file_idx")))
    with_line = r"^(.*?)\s*[:\s]\s*(\d+)\s*$"
    rows = (
        rows.withColumn("cid", F.get(cells, F.col("cid_idx")).try_cast("bigint"))
        .withColumn("checker", t.txt(F.get(cells, _first_index(cells, lambda x, i: other(i) & is_checker(x)))))
        .withColumn("file", F.when(place.rlike(with_line), t.strip(F.regexp_extract(place, with_line, 1))).otherwise(place))
        .withColumn("placed_line", t.to_int(F.regexp_extract(place, with_line, 2)))
        .withColumn("severity", t.txt(F.get(cells, _first_index(cells, lambda x, i: F.lower(x).isin(*dim.SEVERITIES)))))
    )
    free = _first_index(cells, lambda x, i: other(i) & ~F.coalesce(i == F.col("file_idx"), F.lit(False)) & x.rlike(LINE))
    line = F.when(F.col("placed_line") > 0, F.col("placed_line")).otherwise(t.to_int(F.get(cells, free)))

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"\(.*\)\s*$", "")

    def plausible(x: Column) -> Column:
        return ~F.lower(x).isin(*dim.NOT_A_FUNCTION) & ~x.rlike(HASH) & x.rlike(IDENT)

    headed = bare(t.txt(F.get(cells, F.col("function_col"))))
    guesses = F.filter(
        F.transform(cells, bare),
        lambda x: plausible(x)
        & (F.length(x) > 2)
        & ~x.isin(F.col("checker"), F.col("file"), F.col("severity"))
        & ~is_checker(x),
    )
    href = F.coalesce(F.nullif(first_href(F.get("raw", F.col("cid_idx"))), F.lit("")), first_href(F.col("tr")))
    return rows.select(
        "path",
        "row_no",
        "cid",
        "checker",
        t.txt(F.get(cells, F.col("type_col"))).alias("type"),
        "severity",
        "file",
        line.alias("line"),
        F.when(plausible(headed), headed).otherwise(t.txt(F.get(guesses, F.lit(0)))).alias("function"),
        F.substring_index(t.txt(href), "#", 1).alias("href"),
    )


def scan_index(pages: DataFrame) -> DataFrame:
    """Findings of report index pages."""
    return findings_from_rows(report_rows(pages))


def resolve_links(findings: DataFrame, listing: DataFrame) -> DataFrame:
    """Detail page of each finding (S3): adds detail_file ('' for none).

    ``listing(rel_path, ordinal)``. The linked path itself, then the last file of
    that name, then the first file whose name ends with it. Findings without a link meet no
    join. Only names that the path didn't answer are looked up, each once; for endings, file names are
    cut to the lengths that those names have, so a file gives one row per asked length, not per character.
    """
    rel = F.regexp_replace(F.replace(t.txt(F.col("href")), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    keyed = findings.withColumn("__rel", rel).withColumn("__name", t.basename(rel))
    by_path = listing.select(F.col("rel_path").alias("__rel"), F.col("rel_path").alias("__f1")).distinct()
    linked = staged(keyed.where("__name <> ''").join(by_path, "__rel", "left"), "links")
    files = listing.select("rel_path", "ordinal", t.basename(F.col("rel_path")).alias("n"))
    names = linked.where("__f1 IS NULL").select("__name").distinct()
    by_name = files.groupBy(F.col("n").alias("__name")).agg(F.max_by("rel_path", "ordinal").alias("__f2"))
    named = staged(names.join(by_name, "__name", "left"), "link-names")
    left_over = named.where("__f2 IS NULL").select("__name")
    lengths = [r[0] for r in left_over.select(F.length("__name")).distinct().collect()]  # as many as a file name has characters
    own = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda k: k <= F.length("n"))
    endings = files.select("rel_path", "ordinal", F.explode(F.transform(own, lambda k: F.substring(F.col("n"), F.length("n") - k + 1, k))).alias("__name"))
    tails = endings.join(left_over, "__name", "left_semi").groupBy("__name").agg(F.min_by("rel_path", "ordinal").alias("__f3"))
    found = named.join(tails, "__name", "left").select("__name", F.coalesce("__f2", "__f3").alias("__f"))
    parts = [
        keyed.where("__name = ''").withColumn("__f", F.lit("")),
        linked.where("__f1 IS NOT NULL").withColumnRenamed("__f1", "__f"),
        linked.where("__f1 IS NULL").drop("__f1").join(found, "__name", "left"),
    ]
    out = [x.select(*findings.columns, t.txt(F.col("__f")).alias("detail_file")) for x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


# Line formats of a detail page
EVENT_LINE = r"^\((\d+)\)\s+Event\s+([A-Za-z][\w.-]*)\s*:(.*)$"
CODE_LINE = r"^(\d+)\s+(.*)$"


def detail_lines(pages: DataFrame) -> DataFrame:
    """Text lines of detail pages, classified: path, pos, kind ('event', 'code', '')."""
    text = unescape(F.regexp_replace("html", r"<[^>]*>", ""))
    return (
        pages.select("path", F.posexplode(F.split(text, "\r\n|\r|\n")).alias("pos", "raw"))
        .withColumn("raw", t.strip(F.col("raw")))
        .withColumn("kind", F.when(F.col("raw").rlike(EVENT_LINE), "event").when(F.col("raw").rlike(CODE_LINE), "code").otherwise(""))
    )


def detail_trace(pages: DataFrame) -> DataFrame:
    """Event trace of detail pages (S4): path, ordinal, step, tag, description, line.

    A code line gives its number to the latest event that has none yet: events
    push, code lines pop. The stack level is a running sum that never falls below
    zero, and a pop at level L belongs to the last push that reached L. A page is
    one file, so a window per page is bounded.
    """
    lines = detail_lines(pages)
    by_page = Window.partitionBy("path").orderBy("pos")
    upto = by_page.rowsBetween(Window.unboundedPreceding, 0)
    number = t.to_int(F.regexp_extract("raw", CODE_LINE, 1))
    nxt, nxt_kind = F.lead("raw").over(by_page), F.lead("kind").over(by_page)
    marked = (
        lines.withColumn("number", F.when(F.col("kind") == "code", number).otherwise(F.lit(0)))
        .withColumn("own", t.strip(F.regexp_extract("raw", EVENT_LINE, 3)))
        .withColumn(
            "description",
            F.when(F.col("own") != "", F.col("own")).when(nxt_kind == "", t.txt(nxt)).otherwise(F.lit("")),
        )
        .where((F.col("kind") == "event") | (F.col("number") > 0))
        .withColumn("delta", F.when(F.col("kind") == "event", 1).otherwise(-1))
        .withColumn("s", F.sum("delta").over(upto))
        .withColumn("level", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
        .withColumn("before", F.coalesce(F.lag("level").over(by_page), F.lit(0)))
        .withColumn("slot", F.when(F.col("kind") == "event", F.col("level")).otherwise(F.col("before")))
    )
    same_slot = Window.partitionBy("path", "slot").orderBy("pos")
    owner = F.last(F.when(F.col("kind") == "event", F.col("pos")), ignorenulls=True).over(
        same_slot.rowsBetween(Window.unboundedPreceding, 0)
    )
    matched = marked.withColumn("owner", F.when((F.col("kind") == "event") | (F.col("before") > 0), owner))
    return (
        matched.where(F.col("owner").isNotNull())
        .groupBy("path", F.col("owner").cast("bigint").alias("ordinal"))
        .agg(
            F.max(F.when(F.col("kind") == "event", t.to_int(F.regexp_extract("raw", EVENT_LINE, 1)))).alias("step"),
            F.max(F.when(F.col("kind") == "event", F.regexp_extract("raw", EVENT_LINE, 2))).alias("tag"),
            F.max(F.when(F.col("kind") == "event", F.col("description"))).alias("description"),
            F.coalesce(F.max(F.when(F.col("kind") == "code", F.col("number"))), F.lit(0)).cast("bigint").alias("line"),
        )
    )


def detail_source(pages: DataFrame) -> DataFrame:
    """Numbered source lines of detail pages: path, source_code."""
    code = detail_lines(pages).where(F.col("kind") == "code")
    shown = F.concat(F.lpad(F.regexp_extract("raw", CODE_LINE, 1), 6, " "), F.lit("  "), F.regexp_extract("raw", CODE_LINE, 2))
    return code.groupBy("path").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown")))), lambda x: x["shown"]), "\n"
        ).alias("source_code")
    )
