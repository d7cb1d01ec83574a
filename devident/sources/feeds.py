"""Truth and prompt feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from devident.session import materialize

_TRUTH = (
    "ip string, mac string, true_vendor string, true_product string, true_firmware_version string, "
    "accepted_cpes string, rubric_version string, label_status string, notes string"
)
_PROMPT = "name string, version string, notes string, text string"


#: of a line feed read with its broken lines: the text of a line that isn't an entry, NULL in entries
BROKEN = "broken_line"


def read_truth(spark: SparkSession, path: str, multi_line: bool = True, broken: bool = False) -> DataFrame:
    """Labelled entries, one per list element; a file with a single entry gives one row.

    A file that is not JSON throughout stops the read, as no entry of it can be trusted. In
    line-delimited feeds a broken line costs only itself: with `broken` it is a row with its text in `broken_line`, which the load
    stages report, else see `broken_lines`. `accepted_cpes` is kept as the JSON text it was given as, `[]` when absent. Pass
    `multi_line=False` for line-delimited feeds, which Spark splits inside files.
    """
    entries = _read(spark, path, _TRUTH, multi_line, broken)
    return entries.withColumn("accepted_cpes", F.coalesce("accepted_cpes", F.lit("[]")))


def read_prompts(spark: SparkSession, path: str, multi_line: bool = True, broken: bool = False) -> DataFrame:
    """Prompt versions `name, version, notes, text`; with `broken` as in `read_truth`."""
    return _read(spark, path, _PROMPT, multi_line, broken)


def sound_entries(feed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The entries of a feed, and its broken lines with the `reason`; None if it was read without them."""
    if BROKEN not in feed.columns:
        return feed, None
    broken = feed.filter(F.col(BROKEN).isNotNull()).withColumn("reason", F.lit("broken line"))
    return feed.filter(F.col(BROKEN).isNull()).drop(BROKEN), broken


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a line-delimited feed that are not JSON objects, as `line`."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    return lines.filter(kind.isNull() | ~kind.startswith("OBJECT")).select(F.col("value").alias("line"))


def _read(spark: SparkSession, path: str, schema: str, multi_line: bool, broken: bool) -> DataFrame:
    if multi_line:
        return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    lines = spark.read.schema(f"{schema}, {BROKEN} string").option("columnNameOfCorruptRecord", BROKEN).json(path)
    # written once: Spark refuses to tell broken lines from others without reading another column of the feed
    lines = materialize(lines)
    return lines if broken else lines.filter(F.col(BROKEN).isNull()).drop(BROKEN)
