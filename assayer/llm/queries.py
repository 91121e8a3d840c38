"""Registered queries of the corpus operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayer.llm import bpe, chat, fim, licenses, line_dedup, ngram_join, periodic, quality, substrings, suffixes, token_files, toxicity, warc
from assayer.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: A-Z in lower case, other letters as they are.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: White space between words and around lines.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP2_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(13, len(w)) - 1) AS win
  FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT len(win) AS n FROM item_windows
), doc_windows AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), found AS (
  SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t ON d.win = t.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, i, line, {LOWER.format(f"trim(line, {SPACES})")} AS line_key FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split)
), repeated AS (
  SELECT line_key, max(doc_id) AS keeper FROM lines WHERE length(line_key) >= 20 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines l LEFT JOIN repeated USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query(OP1_SQL)
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in the chat template, read back from it."""
    return chat.contract(spark, table(spark, sf_dir, "conversations"))


@query(OP2_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items found of every document, against the whole benchmark."""
    return suffixes.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base checks and the verdict of the rules for every document."""
    return quality.contract(table(spark, sf_dir, "documents"))


@query(OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand in three documents or more."""
    return line_dedup.contract(table(spark, sf_dir, "documents"))


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all categories and the verdict for every document."""
    return toxicity.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates that all documents hold."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of equal-length sequences, read back per document."""
    return token_files.written_and_read(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY d, n) AS keeper FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM g
"""


@query(OP8_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives, read back by the salvage reader."""
    return warc.contract(spark, table(spark, sf_dir, "pages"))


@query()
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by shared four-word shingles."""
    return ngram_join.contract(table(spark, sf_dir, "documents"))


@query()
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, digested."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 19) AS win FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1
), lost AS (
  SELECT DISTINCT doc_id, p FROM later, LATERAL (SELECT unnest(range(i, i + 20)) AS p)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


@query(OP11_SQL)
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of twenty words that start earlier too."""
    return substrings.contract(table(spark, sf_dir, "documents"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, a tenth of which is made periodic, and the text without the repeats."""
    return periodic.contract(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h IS NULL OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), cut AS (
  SELECT *, left(t, least(x, y)) AS p, t[least(x, y) + 1 : greatest(x, y)] AS m, t[greatest(x, y) + 1 :] AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""


@query(OP13_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two places and put in fill-in-the-middle order, and back."""
    return fim.contract(table(spark, sf_dir, "documents"))
