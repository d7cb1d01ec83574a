"""Constraints as jobs: Parquet enforces none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from devident.schemas import FOREIGN_KEYS, LOGICAL_KEYS, TABLES, UNIQUE_KEYS, required_columns
from devident.session import materialize


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose non-NULL reference has no parent."""
    parents = parent.select(F.col(key).alias(column))
    return child.filter(F.col(column).isNotNull()).join(parents, column, "left_anti").select(child.columns)


def duplicates(df: DataFrame, keys: Sequence[str], nulls: bool = False) -> DataFrame:
    """Keys held by several rows, with `n_rows`; keys with a NULL never clash unless `nulls`."""
    rows = df if nulls else df.na.drop(subset=list(keys))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a NULL in a required column, with the names of the columns missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])).withColumn(
        "missing", F.array_join(missing, ",")
    )


def checked(table: str, rows: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """`(sound, rejects)` of a batch for a table: rejects have `broken`, the names of all constraints that a row breaks.

    `tables`: what is stored, at least the table itself and its parents; a parent that isn't given has no rows. Required columns
    hold no NULL, references have a parent, and a key is neither stored nor held by a row of the batch with a smaller id; keys
    with a NULL clash with none. The batch is written once. Only its key columns are joined, and its rows meet the list of broken
    ones at the end. Rows without an id are told apart as well.
    """
    stored = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    references = [k for k in FOREIGN_KEYS if k.child == table]
    keys = [(kind, list(k)) for kind, listed in (("unique", UNIQUE_KEYS), ("logical key", LOGICAL_KEYS)) for t, k in listed if t == table]
    required = required_columns(table)
    needed = dict.fromkeys(["id", *required, *[k.column for k in references], *[c for _, k in keys for c in k]])
    narrow = stored.select("_row", *needed)
    tags = [F.when(F.col(c).isNull(), F.lit(f"not null {c}")) for c in required]
    for n, reference in enumerate(references):
        column, known = reference.column, f"_parent{n}"
        if reference.parent in tables:
            parents = tables[reference.parent].select(F.col("id").alias(column)).distinct().withColumn(known, F.lit(True))
            narrow = narrow.join(parents, column, "left")
        else:
            narrow = narrow.withColumn(known, F.lit(None).cast("boolean"))
        tags.append(F.when(F.col(column).isNotNull() & F.col(known).isNull(), F.lit(f"foreign key {column}")))
    for n, (kind, key) in enumerate(keys):
        first = narrow.na.drop(subset=key).groupBy(*key).agg(F.min(F.struct("id", "_row")).alias(f"_first{n}"))
        taken = tables[table].na.drop(subset=key).select(*key).distinct().withColumn(f"_taken{n}", F.lit(True))
        narrow = narrow.join(first, key, "left").join(taken, key, "left")
        later = F.col(f"_first{n}").isNotNull() & (F.col(f"_first{n}._row") != F.col("_row"))
        tags.append(F.when(F.col(f"_taken{n}").isNotNull() | later, F.lit(f"{kind} {','.join(key)}")))
    broken = narrow.select("_row", F.array_compact(F.array(*tags)).alias("broken")).filter(F.size("broken") > 0)
    broken = materialize(broken)
    sound = stored.join(broken, "_row", "left_anti").select(rows.columns)
    return sound, stored.join(broken, "_row").select(*rows.columns, "broken")


def violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """`rule, table_name, columns, n_rows` for every declared constraint of the given tables."""
    def counted(found: DataFrame, rule: str, table: str, columns: Sequence[str]) -> DataFrame:
        return found.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("columns"), "n_rows"
        )

    parts = [
        counted(orphans(tables[k.child], k.column, tables[k.parent]), "foreign key", k.child, [k.column])
        for k in FOREIGN_KEYS
        if k.child in tables and k.parent in tables
    ]
    parts += [
        counted(duplicates(tables[table], keys), rule, table, keys)
        for rule, listed in (("unique", UNIQUE_KEYS), ("logical key", LOGICAL_KEYS))
        for table, keys in listed
        if table in tables
    ]
    parts += [
        counted(null_violations(tables[table], required_columns(table)), "not null", table, required_columns(table))
        for table in TABLES
        if table in tables
    ]
    return reduce(DataFrame.unionByName, parts)
