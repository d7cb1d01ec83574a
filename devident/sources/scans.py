"""Scan documents on disk: one XML file is one row."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from devident.functions.text import matched

# .../<ip>_<yyyymmdd>_<hhmmss>/<scan name>.xml, the folder possibly as <column>=<value>
_PATH = r"([^/=]*)_(\d{8}_\d{6})/[^/]*$"
# file stem: without the last suffix; a leading dot starts no suffix
_STEM = r"([^/]+?)(?:\.[^./]*)?$"


def read_scans(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """`path, target_ip, scan_ts, scan_name, xml` for every scan file below a folder."""
    return _documents(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True))


def listed_scans(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """`path, length, modified_us` of the scan files below a folder, which are listed and not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.unix_micros("modificationTime").alias("modified_us"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The columns of `read_scans` for files named one by one."""
    # characters that stand for others in a path pattern mean themselves here
    return _documents(spark.read.text([re.sub(r"([\\\[\]{}*?,])", r"\\\1", p) for p in paths], wholetext=True))


def _documents(texts: DataFrame) -> DataFrame:
    files = (
        texts
        # file names arrive with %XX escapes; a plus sign stands for itself
        .select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("xml"))
    )
    return files.select(
        "path",
        matched(F.col("path"), _PATH, 1).alias("target_ip"),
        matched(F.col("path"), _PATH, 2).alias("scan_ts"),
        F.regexp_extract("path", _STEM, 1).alias("scan_name"),
        "xml",
    )
