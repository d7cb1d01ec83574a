"""Joins for keys that may be hot on the many side."""

from __future__ import annotations

from pyspark.sql import DataFrame


def outer_to_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer join to a side where one key may have very many rows.

    A skewed right side of an outer join cannot be split over tasks, either side of an inner join
    can. So the matches come from an inner join, and left rows without any from an anti join
    against the distinct keys.
    """
    matched = left.join(right, key)
    alone = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)
