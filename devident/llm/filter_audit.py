"""What each filter removes under every order of a chain of filters.

A text's failed filters are a mask. Texts fold to counts per part and mask, and from there a matrix does the rest: for mask m
and order p, the step at which a text goes is the least position in p of a filter of m, a min-plus product of the masks (0 where
a filter fails, infinite elsewhere) with the orders' inverse permutations. Counts are scattered to those steps.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devident.llm.text import SPACE
from devident.session import materialize

COPY = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_rules(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text; NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n_words = F.size(words)
    return {
        "A": n_words < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n_words.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, steps): all orders as rows of filter numbers, and for each mask and order the step of removal.

    Steps count from 1; a mask of no filter is removed at step n_filters + 1, which is after the end.
    """
    orders = np.array(list(permutations(range(n_filters))), dtype=np.int64).reshape(-1, n_filters)
    positions = np.empty_like(orders)
    np.put_along_axis(positions, orders, np.arange(1, n_filters + 1)[None, :], axis=1)
    never = n_filters + 1
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    cost = np.where(fails == 1, 0, never)
    steps = np.minimum((cost[:, None, :] + positions[None, :, :]).min(axis=2), never)
    return orders, steps


def scattered(weights: np.ndarray, orders: np.ndarray, steps: np.ndarray) -> dict[str, np.ndarray]:
    """The counts, each as a matrix of orders by steps, of `weights`: rows are masks, columns all, good and toxic texts."""
    n_orders, n_filters = orders.shape
    fails = ((np.arange(len(weights))[:, None] >> np.arange(n_filters)) & 1).astype(np.int64)
    at = np.arange(n_orders)[None, :] * (n_filters + 2) + steps
    lost = np.zeros((3, n_orders * (n_filters + 2)), dtype=np.int64)
    for column in range(3):
        np.add.at(lost[column], at, np.broadcast_to(weights[:, column, None], at.shape))
    removed, good, toxic = lost.reshape(3, n_orders, n_filters + 2)[:, :, 1 : n_filters + 1]
    step = np.arange(1, n_filters + 1)
    failing = fails[:, orders]  # mask, order, step: whether the mask fails the filter of that step
    redundant = np.einsum("m,mps->ps", weights[:, 0], failing * (steps[:, :, None] < step[None, None, :]))
    by_filter = np.bincount(orders.ravel(), weights=removed.ravel(), minlength=n_filters).astype(np.int64)
    return {
        "kept": weights[:, 0].sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": redundant,
        "unique_fails": weights[1 << np.arange(n_filters), 0][orders],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": by_filter[orders],
    }


def masks(docs: DataFrame, labels: DataFrame, part: str, text: str, rules: Mapping[str, Column]) -> DataFrame:
    """(part, mask, good, toxic, n): the number of rows of each part, failed filters and labels.

    The last bit of a mask is the copy filter: the same text stands under a smaller doc_id. It needs no join of rows:
    texts fold by a 128-bit digest with what their part and labels count, and per digest only the rows of the least doc_id
    pass. Hot groups fold before any exchange; what meets a digest's least doc_id is one row per part and label.
    """
    bits = reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(rules.values())], F.lit(0))
    rows = docs.select(
        F.col(f"`{part}`").cast("string").alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))).alias("digest"),
        bits.alias("mask"),
    )
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    counted = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    folded = counted.groupBy(
        "digest", "mask", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    ).agg(
        F.sum("n").alias("n"), least.alias("least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_unnamed"),
    )
    folded = materialize(folded)
    # only texts with more than one doc_id can fail
    first = folded.filter("least IS NOT NULL").groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.sum(F.col("n") - F.col("n_unnamed")).alias("rows"))
    first = first.filter("rows > 1").select(F.col("digest").alias("first_digest"), "first")
    met = folded.join(first, F.col("digest") == F.col("first_digest"), "left")
    passing = F.when(F.col("first").isNull(), F.col("n")).otherwise(
        F.col("n_unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    )
    split = met.select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask"), passing.alias("n")),
            F.struct((F.col("mask") + (1 << len(rules))).alias("mask"), (F.col("n") - passing).alias("n")),
        )),
    )
    return split.filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(
    docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", rules: Mapping[str, Column] | None = None
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each part, order
    of the filters and step.

    `rules`: failure conditions over `docs` by one-letter name; the filter `E`, texts equal to that of a smaller doc_id in the whole
    table, comes last. NULL parts are the part of the empty string, NULL and empty texts are one text. Repeated rows count
    each, and none of them is a copy of the other; rows without a doc_id are never copies and nothing is a copy of them. A label
    counts if any row of its doc_id has it; a doc_id without labels has none. No rows: no parts, so no rows.
    """
    rules = text_rules(F.col(f"`{text}`")) if rules is None else rules
    names = [*rules, COPY]
    orders, steps = removal_steps(len(names))
    spelled = np.array(["".join(names[f] for f in order) for order in orders])

    def report(key, table):
        weights = np.zeros((len(steps), 3), dtype=np.int64)
        mask, n = table.column("mask").to_numpy(), table.column("n").to_numpy()
        for column, chosen in enumerate((np.ones(len(n), bool), table.column("good").to_numpy(), table.column("toxic").to_numpy())):
            np.add.at(weights[:, column], mask[chosen], n[chosen])
        found = scattered(weights, orders, steps)
        n_steps = orders.shape[1]
        columns = [
            pa.array([key[0].as_py()] * orders.size), pa.array(np.repeat(spelled, n_steps)),
            pa.array(np.tile(np.arange(1, n_steps + 1, dtype=np.int32), len(orders))),
        ]
        return pa.table(columns + [pa.array(found[c].ravel()) for c in COUNTS], names=["part", "filter_order", "step", *COUNTS])

    return masks(docs, labels, part, text, rules).groupBy("part").applyInArrow(report, SCHEMA)
