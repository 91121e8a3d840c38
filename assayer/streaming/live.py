"""Incremental operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from assayer.functions.frames import earliest
from assayer.operators import trace as tr
from assayer.operators.categories import with_category
from assayer.sources import decision_log


def running_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts that move as findings arrive (T1); write with update mode."""
    if "category" in keys and "category" not in findings.columns:
        findings = with_category(findings)
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def first_arrivals(findings: DataFrame, table: str, checkpoint: str, key: str = "cid", order: str = "ordinal") -> StreamingQuery:
    """Rows of overlapping pages, each key once, however late or far apart they come.

    A micro-batch writes the first of its rows per key that no earlier batch has written. What is known
    is the written table itself, read by its key column only, so nothing is held in memory and no time
    limits it; a batch that is run again looks at the batches before it and gives the same rows. Rows
    without a key all stay.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = earliest(batch.where(F.col(key).isNotNull()), key, order, batch.columns).select(*batch.columns)
        before = [f"{table}/batch={b}" for b in decision_log.folders(spark, table, "batch") if b < batch_id]
        if before:
            known = spark.read.schema(batch.schema).parquet(*before).select(key).where(F.col(key).isNotNull())
            once = once.join(known, key, "left_anti").select(*batch.columns)
        once.unionByName(batch.where(F.col(key).isNull())).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return findings.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """What :func:`first_arrivals` has written."""
    written = [f"{table}/batch={b}" for b in decision_log.folders(spark, table, "batch")]
    return spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)


def running_main_event(trace: DataFrame) -> DataFrame:
    """Main event per finding as events arrive (T4); write with update mode.

    The state of a finding is the best candidate so far, never its trace."""
    return tr.elect(trace)


def upsert_stream(decisions: DataFrame, table: str, checkpoint: str, compact_every: int = 16) -> StreamingQuery:
    """Keep one decision per cid, the last action wins.

    Every micro-batch adds its changes to the log of the table, in a folder named by its batch id, so a
    batch that is run again gives the same table; every ``compact_every`` batches the log is merged into
    the buckets it touched. Read the table with :func:`assayer.sources.decision_log.current`.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        decision_log.append(batch, table, batch_id)
        if (batch_id + 1) % compact_every == 0:
            decision_log.compact(batch.sparkSession, table, batch.schema)

    return (
        decisions.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain(result: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote.

    In update mode each batch writes its changed rows with the batch id; the last
    row per key is the current state (see :func:`current`)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{table}/b={batch_id}")

    query = (
        result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = StructType(list(result.schema.fields) + [StructField("batch_id", LongType())])
    return result.sparkSession.read.option("recursiveFileLookup", True).schema(schema).parquet(table)


def current(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last written row per key of an update-mode result."""
    rest = [c for c in updates.columns if c not in keys and c != "batch_id"]
    picked = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def stream_tables(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A given table read as a stream of its files: one file, or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_folder:
        return stream.parquet(f"{folder}/{name}.parquet")
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
