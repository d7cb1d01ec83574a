"""JSON documents in text columns, read strictly and inspected by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# closes the wrapped document, so that text after it is seen
_END = "--end of document--"


def with_json_value(df: DataFrame, document: str, out: str) -> DataFrame:
    """Add the document as a VARIANT; NULL for NULL, empty, broken text or text after the document.

    The parse is a column of its own, so that using its parts does not repeat it.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(document), F.lit(f',"{_END}"]')))
    closed = F.try_variant_get("_wrapped", "$[1]", "string") == F.lit(_END)
    value = F.when(closed, F.try_variant_get("_wrapped", "$[0]", "variant"))
    return df.withColumn("_wrapped", wrapped).withColumn(out, value).drop("_wrapped")


def kind(v: Column) -> Column:
    """`OBJECT`, `ARRAY`, `STRING`, `BOOLEAN`, `VOID` (a JSON null) or a number type; NULL without a value."""
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def member(v: Column, key: str) -> Column:
    """A member of an object as a VARIANT; NULL when the key is absent, a null VARIANT when it is null."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def elements(v: Column) -> Column:
    """The elements of an array as VARIANTs; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def keys(v: Column) -> Column:
    """The keys of an object as strings; NULL for anything else."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def text(v: Column, path: str = "$") -> Column:
    """A scalar as text; NULL for null, for a container and for an absent member."""
    return F.try_variant_get(v, path, "string")


def stored_text(v: Column) -> Column:
    """Any value as a text column stores it: booleans as 1 and 0, containers as JSON, null as NULL."""
    boolean = F.schema_of_variant(v) == "BOOLEAN"
    return F.when(boolean, F.try_variant_get(v, "$", "int").cast("string")).otherwise(
        F.coalesce(text(v), F.nullif(F.to_json(v), F.lit("null")))
    )


def to_json_text(c: Column) -> Column:
    """Nested value as JSON text; NULL members are written."""
    return F.to_json(c, {"ignoreNullFields": "false"})
