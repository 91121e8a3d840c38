"""Fill-in-the-middle by counted quantifiers.

A text is cut at two places into prefix, middle and suffix, and the pieces are put in another
order behind marks. The cut is one match of a regular expression made for the row: with a and b
units before the two places it is ``(.{a}+)(.{b-a}+)(.*+)``, a unit being one code point. The
groups are possessive, so the match goes over the text once and never back. ``regexp_count``
gives the number of units; it counts blocks of 4096 first and then what is left, so that a
very long text doesn't become an array of its code points.

Everything is DataFrame functions in one projection: no row moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
UNIT = "."
#: Units that one match of the counting pattern takes.
BLOCK = 4096
ADDED = ("fim_units", "fim_form", "fim_prefix", "fim_middle", "fim_output")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later ones use more than once (a generator keeps them from being worked out again)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def units(text: Column) -> Column:
    """Code points of a text."""
    rest = F.regexp_replace(text, F.lit(f"(?s)\\A(?:{UNIT}{{{BLOCK}}})++"), F.lit(""))
    blocks = F.regexp_count(text, F.lit(f"(?s){UNIT}{{{BLOCK}}}"))
    return (F.lit(BLOCK).cast("long") * blocks + F.regexp_count(rest, F.lit(f"(?s){UNIT}"))).cast("long")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document, fixed by its id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1, text: str = "text") -> DataFrame:
    """All rows with ``fim_units`` (code points), ``fim_form``, ``fim_prefix``, ``fim_middle`` (code points) and ``fim_output``.

    ``fim_form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain: the text as it
    is, without lengths. Plain are NULL and empty texts (their output is empty), texts that hold a mark,
    rows without a doc_id, and ``plain_percent`` of the rest. Rows with the same doc_id are cut by the same
    draws. Input columns named like the new ones are replaced.
    """
    names = [c for c in docs.columns if c not in ADDED]
    rows = once(docs.select(*[F.col(f"`{c}`") for c in names]), __t=F.coalesce(F.col(text), F.lit("")), __h=F.array(*draws(F.col("doc_id"), seed)))
    rows = once(rows, fim_units=units(F.col("__t")))
    h = [F.element_at("__h", k) for k in (1, 2, 3, 4)]
    places = [F.pmod(x, F.col("fim_units") + 1) for x in h[:2]]
    marked = F.regexp_like("__t", F.lit("|".join(MARKS)))
    plain = (F.col("fim_units") == 0) | marked | h[0].isNull() | (h[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = once(rows, fim_form=form, __a=F.least(*places), __b=F.greatest(*places))
    cut = F.col("fim_form") != "plain"
    unit = lambda n: F.concat(F.lit(f"({UNIT}{{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit("(?s)\\A"), unit(F.col("__a")), unit(F.col("__b") - F.col("__a")), F.lit(f"({UNIT}*+)"))
    p, s, m = MARKS
    order = F.when(F.col("fim_form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    return rows.select(
        *[F.col(f"`{c}`") for c in names],
        "fim_units",
        "fim_form",
        F.when(cut, F.col("__a")).alias("fim_prefix"),
        F.when(cut, F.col("__b") - F.col("__a")).alias("fim_middle"),
        F.when(cut, F.regexp_replace(F.col("__t"), pattern, order)).otherwise(F.col("__t")).alias("fim_output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form. Texts that are cut hold no mark, so each mark's first place is its own."""
    p, s, m = MARKS
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{p}(.*?){s}(.*?){m}(.*+)"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{s}(.*?){p}(.*?){m}(.*+)"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def contract(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = once(transform(docs.select("doc_id", "text")).drop("text"), fim_restored=restored(F.col("fim_output"), F.col("fim_form")))
    return out.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix").alias("prefix_chars"),
        F.col("fim_middle").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"),
        F.sha2("fim_restored", 256).alias("restored_sha256"),
    )
