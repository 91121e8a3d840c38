"""Small fixed tables and exact positions inside large groups."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.session import staged


def fixed_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A constant relation. Its size is known to the planner, so joins with it
    are broadcast by the planner's own size check, without a hint."""

    def cell(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, (int, float)):
            return str(value)
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"'{text}'"

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def positions(
    df: DataFrame,
    keys: list[str],
    ordinal: str,
    out: str = "position",
    ties: tuple[str, ...] = (),
    large: int = 200_000,
    pieces: int = 256,
) -> DataFrame:
    """Zero-based position of each row inside its group, by ``ordinal``.

    A group of up to ``large`` rows is numbered by one window. A larger one is cut at
    quantiles of its ordinals into ``pieces`` blocks of about equal numbers of rows,
    which are numbered apart and moved up by the rows of the blocks before; only the
    block counts of such a group meet in one window. Groups are counted by partial
    aggregates. ``keys`` must not be NULL.
    """
    place = F.col(ordinal).cast("bigint")
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > large).select(*keys)
    shares = [(k + 1) / pieces for k in range(pieces - 1)]
    cuts = df.join(big, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(place, shares, 10 * pieces).alias("__cuts"))
    # the quantiles depend on the order in which partial sketches arrive: written once, so that all readers see the same blocks
    cuts = staged(cuts, "cuts")
    if cuts.isEmpty():
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal, *ties)) - 1).cast("bigint"))
    # equal cuts fall together, so ties of the ordinal stay in one block
    block = F.coalesce(F.size(F.filter("__cuts", lambda c: c < place)), F.lit(0))
    # one row per large group
    blocked = df.join(F.broadcast(cuts), keys, "left").withColumn("__block", F.when(F.col("__cuts").isNull(), 0).otherwise(block))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.where(F.col("__cuts").isNotNull())
        .groupBy(*keys, "__block")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(ordinal, *ties)
    return (
        blocked.drop("__cuts")
        .withColumn("__rn", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "__block"], "left")
        .withColumn(out, (F.coalesce("__offset", F.lit(0)) + F.col("__rn")).cast("bigint"))
        .drop("__block", "__rn", "__offset")
    )


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by ``keys`` in as many tasks as the session names for shuffles.

    For work bound by computation, not by bytes: a small table lies in few splits, and the
    adaptive planner merges small partitions unless their number is named.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def unsized(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and is not broadcast, whatever size is guessed for it.

    The planner guesses from the bytes of the files behind: exploded rows and texts put together are not in them.
    """
    return df.hint("merge")


def heavy_keys(df: DataFrame, key: str, share: float = 1 / 256) -> list:
    """Keys that hold more than ``share`` of all rows: at most 1 / share of them, so the list is bounded."""
    return [k for keys in heavy_pieces(df, key, share).values() for k in keys]


def heavy_pieces(df: DataFrame, key: str, share: float = 1 / 256) -> dict[int, list]:
    """The heavy keys by the number of pieces of ``share`` that they make, rounded up to a power of two."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.sum("n")).first()[0] or 0
    heavy: dict[int, list] = {}
    for value, n in counts.where(F.col("n") > every * share).collect() if every else []:
        heavy.setdefault(1 << (ceil(n / (every * share)) - 1).bit_length(), []).append(value)
    return heavy


def spread_join(big: DataFrame, small: DataFrame, key: str, spread_by: list[str], how: str = "inner", share: float = 1 / 256, pieces: int = 64, spread: bool = False) -> DataFrame:
    """Join on ``key`` whose heavy keys are dealt to many tasks.

    Rows of ``big`` with a heavy key get a salt by the hash of ``spread_by``, as many salts as the key has shares; the
    rows of ``small`` with that key are there once per salt, so all copies together are a few times 1 / share. All
    other rows keep the salt 0. ``how`` may be inner, left or left_semi, seen from ``big``; a left join deals out rows
    without a key into ``pieces``, too. Rows of ``small`` may be long, so they are not broadcast. ``spread`` keeps as many
    tasks as the session names for shuffles, where the joined rows are much more than both sides.
    """
    heavy = heavy_pieces(big, key, share)
    if not heavy and how != "left":
        return big.join(small.hint("merge"), key, how)
    salts = F.lit(1)
    for n, values in heavy.items():
        salts = F.when(F.col(key).isin(values), n).otherwise(salts)
    pieces_of = F.when(F.col(key).isNull(), pieces).otherwise(salts)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), pieces_of.cast("bigint")).cast("int"))
    copies = small.where(F.col(key).isNotNull()).withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    if spread:
        salted, copies = dealt(salted, key, "__salt"), dealt(copies, key, "__salt")
    return salted.join(copies.hint("merge"), [key, "__salt"], how).drop("__salt")


def latest(df: DataFrame, key: str, ordinal: str, columns: list[str]) -> DataFrame:
    """Last row per key by ordinal, as one partial aggregate (no window)."""
    rest = [c for c in columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("__row"))
    return picked.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def earliest(df: DataFrame, key: str, ordinal: str, columns: list[str]) -> DataFrame:
    """First row per key by ordinal, as one partial aggregate (no window)."""
    rest = [c for c in columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("__row"))
    return picked.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def indexed(array: Column) -> Column:
    """Array of text lines as structs (i, text), zero-based."""
    return F.transform(array, lambda x, i: F.struct(i.alias("i"), x.alias("text")))
