"""Identifiers in model output and in accepted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from devident.fixed_values import BARE_CPE_OBJECT, DEFAULT_TIER, FENCED_OBJECT
from devident.functions.cpe import cpe_is_valid
from devident.functions.documents import elements, keys, kind, member, stored_text, text, to_json_text, with_json_value
from devident.functions.text import matched

# names of JSON kinds as they appear in stored error texts (fixed values)
_ERROR_KINDS = {"VOID": "NoneType", "BOOLEAN": "bool", "BIGINT": "int"}
_OTHER_ERROR_KIND = "float"


def extract_object(df: DataFrame, raw: str, out: str = "parsed") -> DataFrame:
    """The JSON object a free text holds, as a VARIANT column.

    The first fenced block counts if it is valid JSON; else the first brace-free object that has
    a `"cpe…` key, wherever in the text it is; else NULL.
    """
    found = df.withColumns(
        {
            "_fenced": matched(F.col(raw), FENCED_OBJECT, 1),
            "_bare": matched(F.col(raw), BARE_CPE_OBJECT, 0),
        }
    )
    fenced = with_json_value(found, "_fenced", "_fenced_value")
    both = with_json_value(
        fenced.withColumn("_bare", F.when(F.col("_fenced_value").isNull(), F.col("_bare"))), "_bare", "_bare_value"
    )
    return both.withColumn(out, F.coalesce("_fenced_value", "_bare_value")).drop(
        "_fenced", "_bare", "_fenced_value", "_bare_value"
    )


def filter_predictions(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Keep valid identifiers of the extracted object.

    Adds `parsed_output_json` (NULL when nothing is left), `n_dropped` (malformed items) and
    `filter_error` (the list is of a kind that cannot be read; such runs count as failed).
    """
    parts = df.withColumns(
        {"_cpes": member(F.col(parsed), "cpes"), "_cpe": member(F.col(parsed), "cpe")}
    ).withColumns({"_kind": kind(F.col("_cpes")), "_single": _string(F.col("_cpe"))})
    cpes, listed = F.col("_cpes"), F.col("_kind").isNotNull()
    # an object offers its keys, a text its characters; numbers, booleans and null cannot be read
    items = (
        F.when(F.col("_kind") == "ARRAY", F.transform(elements(cpes), lambda v: text(v)))
        .when(F.col("_kind") == "OBJECT", keys(cpes))
        .when(F.col("_kind") == "STRING", F.split(text(cpes), ""))
    )
    checked = parts.withColumn("_items", items).withColumns(
        {"_valid": F.filter("_items", cpe_is_valid), "_single_ok": cpe_is_valid(F.col("_single"))}
    )
    some = F.size("_valid") > 0
    stored = (
        F.when(listed, F.when(some, to_json_text(F.struct(F.col("_valid").alias("cpes")))))
        .when(F.col("_cpe").isNotNull(), F.when(F.col("_single_ok"), to_json_text(F.struct(F.col("_single").alias("cpe")))))
        .otherwise(F.nullif(F.to_json(F.col(parsed)), F.lit("{}")))
    )
    dropped = (
        F.when(listed, F.coalesce(F.size("_items") - F.size("_valid"), F.lit(0)))
        .when(F.col("_cpe").isNotNull(), (~F.col("_single_ok")).cast("int"))
        .otherwise(0)
    )
    name = F.lit(_OTHER_ERROR_KIND)
    for found, shown in _ERROR_KINDS.items():
        name = F.when(F.col("_kind") == found, shown).otherwise(name)
    error = F.when(
        listed & F.col("_items").isNull(), F.concat(F.lit("'"), name, F.lit("' object is not iterable"))
    )
    return checked.withColumns(
        {"parsed_output_json": stored, "n_dropped": dropped.cast("int"), "filter_error": error}
    ).drop("_cpes", "_cpe", "_kind", "_items", "_valid", "_single", "_single_ok")


def _string(v: Column) -> Column:
    return F.when(kind(v) == "STRING", text(v))


def _stored_list(document: Column) -> Column:
    """The predicted list of a stored document; empty when it has none."""
    cpes, cpe = member(document, "cpes"), member(document, "cpe")
    return F.coalesce(
        elements(cpes),
        F.when(kind(cpe) == "STRING", F.array(cpe)),
    )


def with_predictions(runs: DataFrame, json_column: str = "parsed_output_json") -> DataFrame:
    """Rows of `runs` repeated per predicted identifier: `pos` and `predicted_cpe` are added.

    Order and duplicates are kept. A run without predictions keeps one row with NULL `pos`;
    its list is read in the row itself, so no join is needed to find such runs.
    """
    others = [c for c in runs.columns if c != json_column]
    read = with_json_value(runs, json_column, "_document")
    listed = read.select(*others, _stored_list(F.col("_document")).alias("_list"))
    rows = listed.select(*others, F.posexplode_outer("_list").alias("pos", "_item"))
    return rows.select(*others, "pos", stored_text(F.col("_item")).alias("predicted_cpe"))


def predicted_cpes(runs: DataFrame, json_column: str = "parsed_output_json", key: str = "id") -> DataFrame:
    """One row `(run_id, pos, cpe)` per stored prediction."""
    rows = with_predictions(runs.select(F.col(key).alias("run_id"), json_column), json_column)
    return rows.filter(F.col("pos").isNotNull()).select("run_id", "pos", F.col("predicted_cpe").alias("cpe"))


def accepted_entries(truth: DataFrame) -> DataFrame:
    """One row `(truth_id, device_id, pos, cpe, tier)` per accepted identifier.

    Plain strings get the default tier, as do objects without one; an explicit null tier stays
    NULL; other elements are dropped. An object in place of the list offers its keys, a text its
    characters.
    """
    read = with_json_value(
        truth.select(F.col("id").alias("truth_id"), "device_id", "accepted_cpes_json"), "accepted_cpes_json", "_list"
    )
    top = F.col("_list")
    names = F.when(kind(top) == "OBJECT", keys(top)).when(kind(top) == "STRING", F.split(text(top), ""))
    items = F.coalesce(elements(top), F.transform(names, lambda n: n.cast("variant")))
    # outer: the filter Spark infers for a plain explode would repeat the parse
    rows = read.select("truth_id", "device_id", items.alias("_items")).select(
        "truth_id", "device_id", F.posexplode_outer("_items").alias("pos", "_item")
    )
    item = F.col("_item")
    plain = F.col("_kind") == "STRING"
    kept = rows.withColumn("_kind", kind(item)).filter(plain | member(item, "cpe").isNotNull())
    return kept.select(
        "truth_id",
        "device_id",
        "pos",
        F.when(plain, text(item)).otherwise(text(item, "$.cpe")).alias("cpe"),
        F.when(member(item, "tier").isNotNull(), text(item, "$.tier")).otherwise(DEFAULT_TIER).alias("tier"),
    )
