"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import scratch_dir, staged

__all__ = ["ceil_div", "components", "folder", "staged", "table", "text_slices", "words_table"]

#: UTF-8 bytes of text that one vectorised step takes at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared scratch folder, as a URI or path."""
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex[:8]}")


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold about ``limit`` bytes, one row at least."""
    if not len(column):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()))
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def words_table(keep: bytes) -> bytes:
    """A translation table: bytes of ``keep`` and from 0x80 stay, A-Z are lower-cased, all others turn into spaces."""
    lower = {c: c + 32 for c in range(65, 91)}
    kept = set(keep) | set(range(128, 256))
    return bytes(lower.get(c, c) if lower.get(c, c) in kept else 32 for c in range(256))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the component being its smallest node.

    Alternates the large-star and small-star steps until nothing changes. Minima of
    neighbours are partial aggregates, and the joins that hand them back are plain
    equi-joins whose hot nodes the adaptive skew join splits; each round is a written
    table. An empty input gives no rows; self-links count as nodes of their own.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("m < a").select("a", F.col("m"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = staged(small.where("a <> b").distinct(), f"{name}-edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    found = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.union(roots).union(loops.join(found.select("node"), "node", "left_anti").join(roots.select("node"), "node", "left_anti").distinct())
