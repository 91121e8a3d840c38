"""Session helpers: local test sessions and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "assayer") -> SparkSession:
    """A single-JVM session for tests and benches. Clusters bring their own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # long column expressions: no call site per function call
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables and stream checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Where that is unset,
    a session on one machine takes a temporary folder and any other one is refused:
    its executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# How Parquet is written where rows are long. By default a writer first looks at its sizes after 100 rows and
# keeps repeated texts once only up to a megabyte of them.
LONG_ROWS = {"parquet.page.size.row.check.min": "8", "parquet.block.size.row.check.min": "8", "parquet.dictionary.page.size": str(64 << 20)}


def for_long_rows(spark: SparkSession, *columns: str) -> None:
    """Let what the session writes from now on hold a few long rows in memory, not hundreds, and a text of many rows once.

    No least and greatest value is kept of the named ``columns``: writers compare whole texts and then drop the long ones.
    Only the layout of Parquet files depends on it; a setting that the session has already is kept.
    """
    for key, value in (LONG_ROWS | {f"parquet.column.statistics.enabled#{c}": "false" for c in columns}).items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared scratch folder and read it back.

    Cuts a long lineage: what follows is planned once over a plain scan, several
    readers share the result, and a lost executor costs no recomputation.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
