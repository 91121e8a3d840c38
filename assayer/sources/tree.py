"""Source tree scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import dimensions as dim


def _plain(root: str) -> str:
    """The folder without its scheme, as it stands inside the names of its files."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root).rstrip("/") + "/"


def list_tree(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Files below ``root``: path (relative), length. The content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        files = files.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    base = _plain(root)
    rel = F.substring_index(F.col("path"), base, -1)
    return files.load(root).select(rel.alias("path"), "length")


def scan_tree(spark: SparkSession, root: str, for_calls: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Source files: path, content, length.

    Extension is a listing glob, so unwanted files are not opened. Build and tool
    folders are left out. Files of any size are read; with ``max_bytes`` the caller
    leaves larger ones out, unopened.
    """
    exts = dim.CALL_INDEX_EXTENSIONS if for_calls else dim.SYMBOL_INDEX_EXTENSIONS
    pruned = dim.PRUNED_FOR_CALLS if for_calls else dim.PRUNED_FOLDERS
    base = _plain(root)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(exts) + "}")
        .load(root)
    )
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    rel = F.substring_index(F.col("path"), base, -1)
    folder = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in pruned) + ")/"
    return files.where(~rel.rlike(folder)).select(
        rel.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "length"
    )
