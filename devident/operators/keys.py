"""Generated keys and column defaults for appended rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from devident.functions.text import created_stamp
from devident.schemas import NOW_DEFAULTS, TABLES, TEXT_DEFAULTS
from devident.session import held, materialize, shuffle_partitions

# monotonically_increasing_id() keeps the partition above this bit
_ROW_BITS = 33


def with_keys(
    df: DataFrame, order_by: Sequence[str | Column], start: int | Column = 0, key: str = "id", costly: bool = False,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Number rows 1, 2, 3 … after `start` in the given order, without a single-task sort.

    Rows are range-partitioned by the order and written to the shared folder together with their
    place, which fixes it. One count per partition (read from the place column alone) then gives
    each partition its offset; only those counts, one row per partition, meet in one task.
    `order_by` should tell rows apart: it decides how a hot leading value is split over partitions.
    Range partitioning samples its input; `costly` writes the input down first, so that sampling
    does not repeat the work behind it. `then` is applied to the ordered rows before they are numbered: heavy
    work on each row, possibly dropping rows, that is done once and after the exchange. It must keep the order.
    """
    with held() as hold:
        ranged = (hold(df) if costly else df).repartitionByRange(shuffle_partitions(df.sparkSession), *order_by).sortWithinPartitions(*order_by)
        ranged = then(ranged) if then else ranged
        placed = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumns(
        {
            "_part": F.shiftright(F.col("_place"), _ROW_BITS),
            "_row": F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # one row per partition: bounded by the number of shuffle partitions
    keyed = placed.join(F.broadcast(offsets), "_part")
    base = F.lit(start) if isinstance(start, int) else start
    number = (base + F.col("_offset") + F.col("_row") + 1).cast("long")
    return keyed.select(number.alias(key), *[F.col(c) for c in ranged.columns])


def last_key(df: DataFrame, key: str = "id") -> int:
    """The highest key in use, 0 for an empty table (one aggregated value comes back)."""
    return df.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]


def with_defaults(df: DataFrame, table: str, now: str | None = None) -> DataFrame:
    """Complete appended rows to the table's columns.

    A default applies only where the column is absent; a listed NULL stays NULL.
    """
    stamps, texts = NOW_DEFAULTS.get(table, ()), TEXT_DEFAULTS.get(table, {})
    columns = []
    for field in TABLES[table].fields:
        if field.name in df.columns:
            value = F.col(field.name)
        elif field.name in stamps:
            value = created_stamp(now)
        else:
            value = F.lit(texts.get(field.name))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
