"""Predictions against accepted identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from devident import fixed_values as fixed
from devident.functions.cpe import with_cpe_fields
from devident.operators.joins import outer_to_many
from devident.operators.outputs import with_predictions

SCORE_COLUMNS = [
    "model_run_id", "ground_truth_id", "predicted_cpe", "matched_accepted_cpe",
    "part_correct", "vendor_correct", "product_correct", "version_correct",
    "exact_match", "cve_lookup_valid", "best_match_tier", "match_score",
    "predicted_vendor", "predicted_product", "score_notes", "scorer_version",
]


def _tier_value(tier: Column, values: dict, default) -> Column:
    chosen = F.when(F.lit(False), F.lit(default))
    for name, value in values.items():
        chosen = chosen.when(tier == name, F.lit(value))
    return chosen.otherwise(F.lit(default))


def scoring_context(
    runs: DataFrame, inputs: DataFrame, sessions: DataFrame, truth: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """`model_run_id, device_id, ground_truth_id` per run whose input and session exist.

    `ground_truth_id` is the device's first label, NULL when it has none. Inputs, sessions and
    labels are joined with each other first, so that the runs are shuffled once.
    """
    first_truth = truth.groupBy("device_id").agg(F.min("id").alias("ground_truth_id"))
    targets = (
        inputs.select(F.col("id").alias("aggregated_input_id"), F.col("scan_session_id"))
        .join(sessions.select(F.col("id").alias("scan_session_id"), "device_id"), "scan_session_id")
        .join(first_truth, "device_id", "left")
        .drop("scan_session_id")
    )
    chosen = runs.select(F.col("id").alias("model_run_id"), "aggregated_input_id", *keep)
    return chosen.join(targets, "aggregated_input_id").select(
        "model_run_id", "device_id", "ground_truth_id", *keep
    )


def accepted_choices(accepted: DataFrame) -> DataFrame:
    """Candidates per label and (part, vendor, product): `_choices`, only the best tier, in list order.

    A group is part of one label row's own list, so it is never larger than that row was. Malformed
    identifiers have NULL keys, which match nothing.
    """
    fields = {"part": "_part", "vendor": "_vendor", "product": "_product", "version": "_version"}
    parsed = with_cpe_fields(accepted, "cpe", fields)
    rank = _tier_value(F.col("tier"), fixed.TIER_RANKS, 0)
    candidate = F.struct((-rank).alias("below"), "pos", F.col("_version").alias("version"), "cpe", "tier")
    grouped = parsed.groupBy(
        F.col("truth_id").alias("ground_truth_id"), "_part", "_vendor", "_product"
    ).agg(F.sort_array(F.collect_list(candidate)).alias("_ranked"))
    best = F.col("_ranked")[0]["below"]
    return grouped.withColumn("_choices", F.filter("_ranked", lambda c: c["below"] == best)).drop("_ranked")


def score_rows(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Score rows of `model_run_id, ground_truth_id, pos, predicted_cpe` (NULL `pos`: no prediction).

    The best match is found by one join that adds at most one row's worth of candidates per
    prediction: the tier decides first, then a fitting version, then the list order.
    """
    fields = {
        "part": "_part", "vendor": "predicted_vendor", "product": "predicted_product", "version": "_version",
    }
    predictions = with_cpe_fields(rows, "predicted_cpe", fields)
    choices = accepted_choices(accepted).withColumnsRenamed(
        {"_vendor": "predicted_vendor", "_product": "predicted_product"}
    )
    joined = predictions.join(
        choices, ["ground_truth_id", "_part", "predicted_vendor", "predicted_product"], "left"
    )
    fitting = F.filter(
        "_choices", lambda c: (c["version"] == F.col("_version")) | (c["version"] == "*")
    )
    found = joined.withColumn("_fit", F.try_element_at(fitting, F.lit(1))).withColumn(
        "_match", F.coalesce(F.col("_fit"), F.try_element_at(F.col("_choices"), F.lit(1)))
    )
    matched = F.col("_match").isNotNull()
    same_product = matched.cast("int")
    version_fits = F.col("_fit").isNotNull().cast("int")
    tier = F.col("_match.tier")
    note = F.when(F.col("pos").isNull(), fixed.NOTE_NO_PREDICTION).when(
        F.col("_part").isNull(), fixed.NOTE_MALFORMED
    )
    values = {
        "matched_accepted_cpe": F.col("_match.cpe"),
        "part_correct": same_product,
        "vendor_correct": same_product,
        "product_correct": same_product,
        "version_correct": version_fits,
        "exact_match": version_fits,
        "cve_lookup_valid": same_product,
        "best_match_tier": F.when(matched, tier).otherwise(fixed.NO_TIER),
        "match_score": F.when(matched, _tier_value(tier, fixed.TIER_SCORES, 0.0)).otherwise(0.0),
        "score_notes": note,
        "scorer_version": F.lit(fixed.SCORER_VERSION),
    }
    return found.withColumns(values).select(*SCORE_COLUMNS, "pos")


def score_predictions(context: DataFrame, predictions: DataFrame, accepted: DataFrame) -> DataFrame:
    """Score predictions given as rows `(run_id, pos, cpe)`.

    Runs with a label but without predictions give one NULL row. A run with very many predictions
    is split over tasks.
    """
    labelled = context.filter(F.col("ground_truth_id").isNotNull()).select("model_run_id", "ground_truth_id")
    rows = predictions.select(
        F.col("run_id").alias("model_run_id"), "pos", F.col("cpe").alias("predicted_cpe")
    )
    return score_rows(outer_to_many(labelled, rows, "model_run_id"), accepted)


def score_runs(
    runs: DataFrame, inputs: DataFrame, sessions: DataFrame, truth: DataFrame, accepted: DataFrame
) -> DataFrame:
    """Score the predictions stored in the runs' documents; runs without a label give no rows."""
    context = scoring_context(runs, inputs, sessions, truth, keep=["parsed_output_json"])
    labelled = context.filter(F.col("ground_truth_id").isNotNull())
    return score_rows(with_predictions(labelled), accepted)


def unscored_runs(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Complete runs without a score row."""
    scored = scores.select(F.col("model_run_id").alias("id")).distinct()
    return runs.filter(F.col("status") == fixed.STATUS_COMPLETE).join(scored, "id", "left_anti")


def score_status(
    requested: DataFrame, runs: DataFrame, inputs: DataFrame, sessions: DataFrame, truth: DataFrame, scores: DataFrame
) -> DataFrame:
    """What scoring would do with each requested `model_run_id`: `model_run_id, score_status`."""
    context = scoring_context(runs, inputs, sessions, truth).select(
        "model_run_id", "ground_truth_id", F.lit(True).alias("_found")
    )
    scored = scores.groupBy("model_run_id").agg(F.count(F.lit(1)).alias("_rows"))
    known = requested.select("model_run_id").join(context, "model_run_id", "left").join(scored, "model_run_id", "left")
    status = (
        F.when(F.col("_found").isNull(), "not found")
        .when(F.col("ground_truth_id").isNull(), "no truth")
        .when(F.col("_rows").isNotNull(), "already scored")
        .otherwise("scorable")
    )
    return known.select("model_run_id", status.alias("score_status"))


def replaced_runs(
    requested: DataFrame, runs: DataFrame, inputs: DataFrame, sessions: DataFrame, truth: DataFrame
) -> DataFrame:
    """`model_run_id` of the requested runs whose rows a rescore replaces: known ones with a label."""
    chosen = runs.join(requested.select(F.col("model_run_id").alias("id")).distinct(), "id", "left_semi")
    context = scoring_context(chosen, inputs, sessions, truth)
    return context.filter(F.col("ground_truth_id").isNotNull()).select("model_run_id")


def rescore(
    requested: DataFrame, runs: DataFrame, inputs: DataFrame, sessions: DataFrame, truth: DataFrame,
    accepted: DataFrame, scores: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """`(kept, fresh)`: score rows that stay, and new rows for the requested runs, of any status.

    Runs that are unknown or have no label keep their old rows.
    """
    chosen = runs.join(requested.select(F.col("model_run_id").alias("id")).distinct(), "id", "left_semi")
    replaced = replaced_runs(requested, runs, inputs, sessions, truth)
    kept = scores.join(replaced, "model_run_id", "left_anti").select(scores.columns)
    return kept, score_runs(chosen, inputs, sessions, truth, accepted)
