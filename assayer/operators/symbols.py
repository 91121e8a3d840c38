"""Sizes that have a name: defines and struct members of a source tree.

A snippet says ``char buf[MAX]``; what MAX is stands in another file. Defines and array members are gathered
per line, the first of a name counts, and expressions are folded along the names they use until no
further value is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import dimensions as dim
from assayer.functions import text as t
from assayer.functions.frames import spread_join
from assayer.operators.source_tree import source_lines
from assayer.session import staged

# A define, the head of a struct, an array member, an expression of one or two operands
DEFINE = r"^\s*#\s*define\s+([A-Za-z_]\w*)\s+(.+?)\s*(?://.*|/\*.*)?$"
STRUCT = r"^\s*(?:typedef\s+)?(?:struct|union)\b[^;()]*\{"
MEMBER = r"^\s*(?:\w+[\s*]+)+([A-Za-z_]\w*)\s*\[\s*([^\]]+?)\s*\]\s*;"
OPERATION = r"^(\w+)\s*(\*|\+|-|/|<<)\s*(\w+)$"


def _bare(expr: Column) -> Column:
    """An expression without outer brackets; sizeof of a plain type is its number of bytes."""
    sizes = F.create_map(*[F.lit(x) for p in dim.TYPE_BYTES.items() for x in p])
    size_of = r"sizeof\s*\(\s*(\w+)\s*\)"
    unit = F.try_element_at(sizes, F.regexp_extract(expr, size_of, 1)).cast("string")
    plain = F.when(unit.isNotNull(), F.call_function("regexp_replace", expr, F.lit(size_of), unit)).otherwise(expr)
    return t.strip(F.regexp_replace(t.strip(plain), r"^\(([^()]*)\)$", "$1"))


def symbols(files: DataFrame) -> DataFrame:
    """Names and their expressions: name, kind ('define' or 'member'), expr; the first of a name, defines before members."""
    lines = source_lines(files).where(F.col("text").rlike(r"[#{}\[]"))
    inside = F.last(F.when(F.col("text").rlike(STRUCT), 1).when(F.contains("text", F.lit("}")), 0), ignorenulls=True)
    lines = lines.withColumn("member", F.coalesce(inside.over(Window.partitionBy("path").orderBy("line_no")), F.lit(0)) == 1)
    defined = lines.select(
        "path", "line_no",
        F.when(F.col("text").rlike(DEFINE), F.struct(F.lit("define").alias("kind"), F.regexp_extract("text", DEFINE, 1).alias("name"), F.regexp_extract("text", DEFINE, 2).alias("expr")))
        .when(F.col("member") & F.col("text").rlike(MEMBER), F.struct(F.lit("member").alias("kind"), F.regexp_extract("text", MEMBER, 1).alias("name"), F.regexp_extract("text", MEMBER, 2).alias("expr"))).alias("s"),
    ).where("s IS NOT NULL")
    first = defined.groupBy("s.name").agg(F.min_by(F.struct("s.kind", "s.expr"), F.struct("s.kind", "path", "line_no")).alias("r"))
    return first.select("name", "r.kind", _bare(F.col("r.expr")).alias("expr"))


def number(text: Column) -> Column:
    """A decimal or hexadecimal literal, with its suffix; NULL for anything else."""
    digits = F.regexp_extract(text, r"^(\d+)[uUlL]*$", 1)
    hexed = F.regexp_extract(text, r"^0[xX]([0-9A-Fa-f]+)[uUlL]*$", 1)
    return F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("bigint")).when(digits != "", digits.try_cast("bigint"))


def symbol_values(found: DataFrame) -> DataFrame:
    """Folded values of ``symbols``: name, kind, value.

    Every round works out the expressions whose operands are known by now, so there are as many rounds as names
    stand behind each other; names that use themselves never get a value.
    """
    parts = found.select(
        "name", "kind", "expr",
        F.when(F.col("expr").rlike(OPERATION), F.regexp_extract("expr", OPERATION, 1)).otherwise(F.col("expr")).alias("a"),
        F.regexp_extract("expr", OPERATION, 2).alias("op"), F.regexp_extract("expr", OPERATION, 3).alias("b"),
    )
    open_ = staged(parts, "symbols")
    known, n = None, 0
    while True:
        rows = open_
        for side in ("a", "b"):
            rows = rows.withColumn(f"n{side}", number(F.col(side)))
            if known is not None:
                rows = spread_join(rows, known.select(F.col("name").alias(side), F.col("value").alias(f"v{side}")), side, ["name"], "left")
                rows = rows.withColumn(f"n{side}", F.coalesce(f"n{side}", f"v{side}")).drop(f"v{side}")
        a, b, op = F.col("na"), F.col("nb"), F.col("op")
        value = (
            F.when(op == "", a).when(op == "*", F.try_multiply(a, b)).when(op == "+", F.try_add(a, b)).when(op == "-", F.try_subtract(a, b))
            .when((op == "/") & (b != 0), F.expr("na div nb")).when((op == "<<") & b.between(0, 62), F.call_function("shiftleft", a, b.cast("int")))
        )
        done = staged(rows.select("name", "kind", "expr", value.alias("value")).where("value IS NOT NULL"), "symbol-values")
        size = done.count()
        if size == n:
            return done.select("name", "kind", "value")
        known, n = done, size


def bounds_by_name(df: DataFrame, values: DataFrame) -> DataFrame:
    """Bounds of accesses whose declared size is a name (needs bound_expr, bound, decl_size, array): the value of that name.

    Without a declaration in the snippet the array itself may be a member of a known size. A size written as a
    number stays; a value takes precedence over what the trace says.
    """
    asked = df.withColumn("__asked", F.when(F.col("decl_size") > 0, None).when(t.matches(F.col("bound_expr"), r"^[A-Za-z_]\w*$"), F.col("bound_expr")).when(F.col("declared"), None).otherwise(F.col("array")))
    named = values.select(F.col("name").alias("__asked"), F.col("kind").alias("__kind"), F.col("value").alias("__value"))
    out = spread_join(asked, named, "__asked", ["cid"], "left")
    # an array that is not declared here can only be a member, a size only a define
    fits = F.when(F.col("__asked") == F.col("bound_expr"), F.col("__kind") == "define").otherwise(F.col("__kind") == "member")
    return out.withColumn("bound", F.when(fits & (F.col("__value") > 0), F.col("__value")).otherwise(F.col("bound")).cast("bigint")).drop("__asked", "__kind", "__value")
