"""Column helpers for text, defaults and casts.

Missing text is ``''`` and a missing line is ``0`` at the boundary, so most
helpers fold NULL and blank into that convention first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\r\n\f\v"


def txt(col: Column) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def strip(col: Column) -> Column:
    """Trim all ASCII white space, not only blanks."""
    return F.trim(txt(col), F.lit(WHITESPACE))


def first_text(*cols: Column) -> Column:
    """First value that is neither NULL nor empty, else ``''``."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols], F.lit(""))


def to_int(col: Column, default: int = 0) -> Column:
    """Integer cast that falls back to ``default`` instead of failing."""
    return F.coalesce(F.trim(col.cast("string"), F.lit(WHITESPACE)).try_cast("bigint"), F.lit(default)).cast("bigint")


def first_nonzero(*cols: Column) -> Column:
    """First integer other than zero, else zero."""
    return F.coalesce(*[F.nullif(to_int(c), F.lit(0)) for c in cols], F.lit(0)).cast("bigint")


def coerce_cid(col: Column) -> Column:
    """Finding identifier as BIGINT; NULL when the text is not an integer."""
    text = strip(col)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def is_true(col: Column) -> Column:
    """Flag given as boolean, number or text."""
    return F.coalesce(F.lower(strip(col)).isin("true", "1", "yes"), F.lit(False))


def norm_tag(col: Column) -> Column:
    """Event tags compare in lower case with underscores only."""
    return F.replace(F.replace(F.lower(strip(col)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))


def basename(col: Column, both_separators: bool = False) -> Column:
    text = F.replace(txt(col), F.lit("\\"), F.lit("/")) if both_separators else txt(col)
    return F.substring_index(text, "/", -1)


def extension(col: Column) -> Column:
    """Lower-case extension with its dot; ``''`` for none or dot files."""
    return F.lower(F.regexp_extract(basename(col, True), r"^\.*[^.].*(\.[^.]*)$", 1))


def identifiers(col: Column) -> Column:
    return F.regexp_extract_all(txt(col), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), 1)


def quoted(col: Column) -> Column:
    """Make a value literal inside a regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(txt(col), F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


def word(col: Column) -> Column:
    """Regular expression for one whole word given by a column."""
    return F.concat(F.lit(r"\b"), quoted(col), F.lit(r"\b"))


def extract(text: Column, pattern: Column | str, group: int = 1) -> Column:
    """``regexp_extract`` whose pattern may be a column."""
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.call_function("regexp_extract", text, pat, F.lit(group))


def count_of(text: Column, char: str) -> Column:
    """Occurrences of one character."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def members(values) -> Column:
    """Array literal."""
    return F.array(*[F.lit(v) for v in values])


def matches(text: Column, pattern: Column | str) -> Column:
    """``rlike`` whose pattern may be a column.

    ``rlike`` compiles a column pattern for every value; ``regexp_instr`` keeps the
    last one, so the lines of one snippet share a single compilation.
    """
    return text.rlike(pattern) if isinstance(pattern, str) else F.call_function("regexp_instr", text, pattern) > 0
