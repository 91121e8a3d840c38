"""A table of decisions as base and log (W9, T2): what a batch writes follows the batch, not the table.

::

    <table>/log/batch=17/cid_bucket=3/...      changes of one batch, one row per cid
    <table>/base/generation=16/cid_bucket=3/...  merged rows of the buckets that changed up to batch 16

Rows are dealt to buckets by their cid. A batch writes only its own folder, so a repeated batch
gives the same folder. Readers merge the newest base of each bucket with the log behind it.
Compaction merges the log into the base and rewrites touched buckets alone; a generation counts only
once it is complete (its ``_SUCCESS``), so a lost executor or a compaction that was broken off leaves the
table as it was. A column named ``cid_bucket`` is not allowed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Rows without a cid lie in a bucket of their own.
LOOSE = -1


def bucket_of(cid: Column, buckets: int) -> Column:
    return F.when(cid.isNull(), LOOSE).otherwise(F.pmod(F.xxhash64(cid), F.lit(buckets)).cast("int"))


def _latest(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per cid, the last by (ordinal, batch); rows without a cid all stay."""
    keyed = rows.where("cid IS NOT NULL").groupBy("cid", "__bucket").agg(F.max_by(F.struct(*names), F.struct("ordinal", "__batch", F.xxhash64(*names))).alias("__row"))
    loose = rows.where("cid IS NULL").select(*names, "__bucket")
    return keyed.select(*[F.col(f"__row.{c}").alias(c) for c in names], "__bucket").unionByName(loose)


def folders(spark: SparkSession, where: str, name: str) -> list[int]:
    """Numbers n of the folders ``name=n`` in a folder; none where it is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found = (re.fullmatch(rf"{name}=(-?\d+)", f.getPath().getName()) for f in system.listStatus(path))
    return sorted(int(m[1]) for m in found if m)


def _complete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def state(spark: SparkSession, table: str) -> tuple[int, dict[int, int], list[int]]:
    """Last complete generation (-1: none), newest generation of each bucket, and batches behind it."""
    generations = [g for g in folders(spark, f"{table}/base", "generation") if _complete(spark, f"{table}/base/generation={g}")]
    newest = {b: g for g in generations for b in folders(spark, f"{table}/base/generation={g}", "cid_bucket")}
    last = max(generations, default=-1)
    batches = [b for b in folders(spark, f"{table}/log", "batch") if b > last and _complete(spark, f"{table}/log/batch={b}")]
    return last, newest, batches


def append(changes: DataFrame, table: str, batch: int, buckets: int = BUCKETS) -> None:
    """Write one batch of changes (cid, ordinal, ...); of a cid's changes in the batch the last one counts."""
    names = changes.columns
    rows = changes.withColumns({"__bucket": bucket_of(F.col("cid"), buckets), "__batch": F.lit(batch)})
    once = _latest(rows, names).withColumnRenamed("__bucket", "cid_bucket")
    once.write.mode("overwrite").partitionBy("cid_bucket").parquet(f"{table}/log/batch={batch}")


def _read(spark: SparkSession, schema: StructType, parts: list[tuple[str, int, int | None]]) -> DataFrame:
    """Rows of folders (path, batch, bucket or None: named by the folder) with ``__bucket`` and ``__batch``."""
    out = None
    for path, batch, bucket in parts:
        if bucket is None:
            rows = spark.read.schema(StructType([*schema.fields, *StructType.fromDDL("cid_bucket int").fields])).parquet(path)
            rows = rows.withColumnRenamed("cid_bucket", "__bucket")
        else:
            rows = spark.read.schema(schema).parquet(path).withColumn("__bucket", F.lit(bucket))
        rows = rows.withColumn("__batch", F.lit(batch))
        out = rows if out is None else out.unionByName(rows)
    return out


def _rows(spark: SparkSession, table: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame | None:
    """Base and log rows, of some buckets or of all; None where there are none."""
    _, newest, batches = state(spark, table)
    base: dict[int, list[int]] = {}
    for bucket, generation in newest.items():
        if buckets is None or bucket in buckets:
            base.setdefault(generation, []).append(bucket)
    parts = []
    for generation, some in base.items():
        every = set(some) == set(folders(spark, f"{table}/base/generation={generation}", "cid_bucket"))
        parts += [(f"{table}/base/generation={generation}", -1, None)] if every else [(f"{table}/base/generation={generation}/cid_bucket={b}", -1, b) for b in some]
    parts += [(f"{table}/log/batch={b}", b, None) for b in batches]
    if not parts:
        return None
    rows = _read(spark, schema, parts)
    return rows if buckets is None else rows.where(F.col("__bucket").isin(buckets))


def current(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The table: the last decision per cid. Columns that a batch did not have are NULL."""
    rows = _rows(spark, table, schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    return _latest(rows, schema.names).select(*schema.names)


def compact(spark: SparkSession, table: str, schema: StructType) -> int:
    """Merge the log into the base: a new generation of the touched buckets. Gives its number, -1 where there is nothing to do."""
    _, _, batches = state(spark, table)
    if not batches:
        return -1
    touched = sorted({b for batch in batches for b in folders(spark, f"{table}/log/batch={batch}", "cid_bucket")})
    merged = _latest(_rows(spark, table, schema, touched), schema.names).withColumnRenamed("__bucket", "cid_bucket")
    merged.repartition("cid_bucket").write.mode("overwrite").partitionBy("cid_bucket").parquet(f"{table}/base/generation={batches[-1]}")
    return batches[-1]


def vacuum(spark: SparkSession, table: str) -> list[str]:
    """Remove what no reader needs any more: merged batches, and buckets that have a newer generation. Gives the folders removed."""
    last, newest, _ = state(spark, table)
    old = [f"{table}/log/batch={b}" for b in folders(spark, f"{table}/log", "batch") if b <= last]
    for g in folders(spark, f"{table}/base", "generation"):
        old += [f"{table}/base/generation={g}/cid_bucket={b}" for b in folders(spark, f"{table}/base/generation={g}", "cid_bucket") if newest.get(b, g) > g]
    for folder in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return old
