"""Reports over scores.

Every summary starts from `run_scores`: scores are aggregated per run first (with map-side partial
aggregation), so later joins and groupings see one row per run, not one per prediction.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from devident.fixed_values import NO_TIER
from devident.operators.joins import outer_to_many
from devident.session import held, materialize

Tables = Mapping[str, DataFrame]

_MEANS = [
    "match_score", "exact_match", "cve_lookup_valid", "vendor_correct", "product_correct",
    "version_correct", "part_correct",
]


def _round_even(c: Column, places: int = 4) -> Column:
    """Scale, round half to even, scale back: the way column frames round."""
    scale = F.lit(float(10**places))
    return F.rint(c * scale) / scale


def _sessions(tables: Tables) -> DataFrame:
    return tables["scan_sessions"].select(
        F.col("id").alias("scan_session_id"), "device_id", "target_ip", F.col("hostname").alias("scan_hostname")
    )


def _targets(tables: Tables, sessions: DataFrame) -> DataFrame:
    """Input, session and device columns per input.

    `sessions` may carry what belongs to a session; joined to it by the same key beforehand, that
    costs no further shuffle of the sessions.
    """
    inputs, devices = tables["aggregated_inputs"], tables["devices"]
    return inputs.select(
        F.col("id").alias("aggregated_input_id"), "scan_session_id",
        F.col("variant_name").alias("input_variant"), F.col("parser_version").alias("input_parser_version"),
    ).join(sessions, "scan_session_id").join(
        devices.select(
            F.col("id").alias("device_id"), "device_code", F.col("manufacturer").alias("device_manufacturer"),
            F.col("model").alias("device_model"), "device_type",
        ),
        "device_id",
    )


def _prompts(tables: Tables) -> DataFrame:
    return tables["prompts"].select(F.col("id").alias("prompt_id"), "prompt_name", "prompt_version")


_WIDE_COLUMNS = [
    "device_id", "device_code", "device_manufacturer", "device_model", "device_type",
    "scan_session_id", "target_ip", "scan_hostname", "scan_name", "nmap_version",
    "aggregated_input_id", "input_variant", "input_parser_version",
    "model_run_id", "model_name", "model_version", "temperature", "top_p", "max_tokens", "seed",
    "trial_number", "run_status", "run_started_at", "run_ended_at",
    "prompt_id", "prompt_name", "prompt_version",
    "ground_truth_id", "true_vendor", "true_product", "true_firmware_version", "rubric_version", "label_status",
    "score_id", "predicted_cpe", "predicted_vendor", "predicted_product", "matched_accepted_cpe",
    "part_correct", "vendor_correct", "product_correct", "version_correct",
    "exact_match", "cve_lookup_valid", "best_match_tier", "match_score", "score_notes", "scorer_version", "scored_at",
]


def scores_wide(tables: Tables, ordered: bool = True) -> DataFrame:
    """The atomic fact table: one row per score and scan run of its session, 49 columns.

    A session with several scan runs repeats its scores; one without keeps them with NULL scan
    columns. Dimensions meet each other first, labels at the grain of run and label, of which a run
    has few; the scores are joined last, by both keys at once, so that they are shuffled once.
    To be ordered the dimensions and then the joined rows are written down first: the files of a step
    go before the sort makes its own, and its sampling doesn't repeat the joins.
    """
    scans = tables["scan_runs"].select("scan_session_id", "scan_name", F.col("tool_version").alias("nmap_version"))
    runs = tables["model_runs"].select(
        F.col("id").alias("model_run_id"), "aggregated_input_id", "prompt_id", "model_name", "model_version",
        "temperature", "top_p", "max_tokens", "seed", "trial_number", F.col("status").alias("run_status"),
        F.col("started_at").alias("run_started_at"), F.col("ended_at").alias("run_ended_at"),
    )
    context = (
        runs.join(_targets(tables, outer_to_many(_sessions(tables), scans, "scan_session_id")), "aggregated_input_id")
        .join(_prompts(tables).withColumnRenamed("prompt_id", "_prompt"), F.col("prompt_id") == F.col("_prompt"), "left")
        .withColumn("prompt_id", F.col("_prompt"))
        .drop("_prompt")
    )
    truth = tables["ground_truth"].select(
        F.col("id").alias("ground_truth_id"), "true_vendor", "true_product", "true_firmware_version",
        "rubric_version", "label_status",
    )
    scores = tables["scores"].withColumnsRenamed({"id": "score_id", "created_at": "scored_at"})
    labelled = scores.select("model_run_id", "ground_truth_id").distinct().join(truth, "ground_truth_id")
    dimensions = labelled.join(context, "model_run_id")

    def joined(dimensions: DataFrame) -> DataFrame:
        return scores.join(dimensions, ["model_run_id", "ground_truth_id"]).select(*_WIDE_COLUMNS)

    if not ordered:
        return joined(dimensions)
    with held() as hold:
        wide = materialize(joined(hold(dimensions)))
    return wide.orderBy("device_code", "model_name", "model_run_id", "score_id")


def _per_run(grouped, score_key: str) -> DataFrame:
    sums = [F.sum(c).alias(f"sum_{c}") for c in _MEANS]
    counts = [F.count(c).alias(f"n_{c}") for c in _MEANS]
    return grouped.agg(
        F.count(score_key).alias("n_scores"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("best_match_tier").eqNullSafe(F.lit(NO_TIER))).alias("n_no_match"),
        F.min("match_score").alias("min_match_score"),
        F.max("match_score").alias("max_match_score"),
        *sums,
        *counts,
    )


def run_scores(tables: Tables, device: bool = True) -> DataFrame:
    """One row per scored run: counts and sums of its scores, its settings and `fan_out`.

    `fan_out` is how often the fact table repeats the run (scan runs of its session, at least 1).
    Without `device` only the run's own columns and prompt are there, and no other table is read.
    """
    # as in the fact table, a score without its label doesn't count
    labels = tables["ground_truth"].select(F.col("id").alias("ground_truth_id"))
    scores = tables["scores"].join(labels, "ground_truth_id", "left_semi") if device else tables["scores"]
    per_run = _per_run(scores.groupBy("model_run_id"), "id")
    runs = tables["model_runs"].select(
        F.col("id").alias("model_run_id"), "aggregated_input_id", "prompt_id", "model_name", "temperature"
    )
    joined = per_run.join(runs, "model_run_id")
    if not device:
        return joined.withColumn("fan_out", F.lit(1))
    fans = tables["scan_runs"].groupBy("scan_session_id").agg(F.count(F.lit(1)).alias("_scans"))
    sessions = _sessions(tables).join(fans, "scan_session_id", "left")
    targets = _targets(tables, sessions).select(
        "aggregated_input_id", "device_code", F.coalesce("_scans", F.lit(1)).alias("fan_out")
    )
    return joined.join(targets, "aggregated_input_id")


def with_prompts(runs: DataFrame, tables: Tables, how: str = "left") -> DataFrame:
    """Add prompt name and version at run grain."""
    return runs.join(_prompts(tables), "prompt_id", how)


def wide_run_scores(wide: DataFrame) -> DataFrame:
    """`run_scores` of a fact table that is already there; its repetitions are in its counts."""
    keys = [
        "model_run_id", "device_code", "model_name", "aggregated_input_id", "prompt_id", "prompt_name",
        "prompt_version", "temperature",
    ]
    return _per_run(wide.groupBy(*keys), "score_id").withColumn("fan_out", F.lit(1))


def _weighted(column: str) -> Column:
    return F.sum(F.col("fan_out") * F.col(column))


def _mean(metric: str) -> Column:
    return _round_even(_weighted(f"sum_{metric}") / _weighted(f"n_{metric}"))


def summary_by_model(runs: DataFrame) -> DataFrame:
    """Rates and averages per device and model."""
    return (
        runs.groupBy("device_code", "model_name")
        .agg(
            _weighted("n_scores").alias("n_predictions"),
            F.count("model_run_id").alias("n_runs"),
            _mean("match_score").alias("avg_match_score"),
            _mean("exact_match").alias("exact_match_rate"),
            _mean("cve_lookup_valid").alias("cve_valid_rate"),
            _mean("vendor_correct").alias("vendor_correct_rate"),
            _mean("product_correct").alias("product_correct_rate"),
            _mean("version_correct").alias("version_correct_rate"),
            _mean("part_correct").alias("part_correct_rate"),
            _round_even(_weighted("n_no_match") / _weighted("n_rows")).alias("no_match_rate"),
        )
        .orderBy(F.asc_nulls_last("device_code"), F.asc_nulls_last("model_name"))
    )


def summary_by_prompt(runs: DataFrame) -> DataFrame:
    """The same metrics per model and prompt version, over all devices.

    Needs the prompt columns (`with_prompts`). Runs are folded per device first, which turns the
    count of distinct devices into a plain count.
    """
    key = ["model_name", "prompt_name", "prompt_version"]
    metrics = ["match_score", "exact_match", "cve_lookup_valid", "vendor_correct", "product_correct"]
    folded = runs.groupBy(*key, "device_code").agg(
        F.count("model_run_id").alias("n_runs"),
        _weighted("n_scores").alias("n_scores"),
        *[_weighted(f"{kind}_{m}").alias(f"{kind}_{m}") for m in metrics for kind in ("sum", "n")],
    )

    def mean(metric: str) -> Column:
        return _round_even(F.sum(f"sum_{metric}") / F.sum(f"n_{metric}"))

    return (
        folded.groupBy(*key)
        .agg(
            F.sum("n_scores").alias("n_predictions"),
            F.sum("n_runs").alias("n_runs"),
            F.count("device_code").alias("n_devices"),
            mean("match_score").alias("avg_match_score"),
            mean("exact_match").alias("exact_match_rate"),
            mean("cve_lookup_valid").alias("cve_valid_rate"),
            mean("vendor_correct").alias("vendor_correct_rate"),
            mean("product_correct").alias("product_correct_rate"),
        )
        .orderBy(*[F.asc_nulls_last(c) for c in key])
    )


def variance_by_config(runs: DataFrame) -> DataFrame:
    """Spread of the runs' mean scores per input, model, prompt and temperature."""
    key = ["aggregated_input_id", "model_name", "prompt_id", "temperature"]
    means = runs.withColumn("run_mean", F.try_divide("sum_match_score", "n_match_score"))
    return (
        means.groupBy(*key)
        .agg(
            F.count("model_run_id").alias("n_trials"),
            _round_even(F.avg("run_mean")).alias("mean_match_score"),
            _round_even(F.stddev_samp("run_mean")).alias("stdev_match_score"),
            _round_even(F.min("run_mean")).alias("min_match_score"),
            _round_even(F.max("run_mean")).alias("max_match_score"),
        )
        .orderBy(*[F.asc_nulls_last(c) for c in key])
    )


def run_manifest(tables: Tables, ordered: bool = True) -> DataFrame:
    """One row per run, scored or not; sums are NULL where nothing was scored."""
    scored = tables["scores"].groupBy("model_run_id").agg(
        F.count("id").alias("n_predictions_scored"),
        F.sum("exact_match").alias("n_exact"),
        F.sum("cve_lookup_valid").alias("n_cve_valid"),
    )
    targets = _targets(tables, _sessions(tables)).select("aggregated_input_id", "device_code")
    runs = tables["model_runs"].withColumnRenamed("id", "model_run_id")
    manifest = (
        runs.join(scored, "model_run_id", "left")
        .join(targets, "aggregated_input_id")
        .join(_prompts(tables), "prompt_id", "left")
        .select(
            "model_run_id", "device_code", "aggregated_input_id", "model_name", "model_version",
            "prompt_name", "prompt_version", "temperature", "top_p", "seed", "trial_number", "status",
            "started_at", "ended_at", "error_text",
            F.coalesce("n_predictions_scored", F.lit(0)).cast("long").alias("n_predictions_scored"),
            "n_exact", "n_cve_valid",
        )
    )
    return manifest.orderBy("device_code", "model_name", "model_run_id") if ordered else manifest


def _average(places: int = 3) -> Column:
    return F.round(F.sum("sum_match_score") / F.sum("n_match_score"), places)


def head_to_head(tables: Tables) -> DataFrame:
    """Models side by side per device; scan runs do not repeat scores here."""
    return (
        run_scores(tables)
        .groupBy("device_code", "model_name")
        .agg(
            F.sum("n_scores").alias("n_predictions"),
            _average().alias("avg_match"),
            F.sum("sum_exact_match").alias("exact"),
            F.sum("sum_cve_lookup_valid").alias("cve_valid"),
        )
        .orderBy("device_code", F.desc("avg_match"))
    )


def prompt_effect(tables: Tables) -> DataFrame:
    """Prompts compared over all their runs; runs without a prompt drop out."""
    return (
        with_prompts(run_scores(tables, device=False), tables, "inner")
        .groupBy("prompt_name", "prompt_version")
        .agg(_average().alias("avg_match"), F.count("model_run_id").alias("n_runs"))
        .orderBy(F.desc("avg_match"))
    )


def repeat_variance(tables: Tables) -> DataFrame:
    """Configurations run more than once, averaged over predictions."""
    return (
        run_scores(tables, device=False)
        .groupBy("aggregated_input_id", "model_name", "prompt_id")
        .agg(
            F.count("model_run_id").alias("trials"),
            _average().alias("avg_match"),
            F.round(F.min("min_match_score"), 3).alias("min_match"),
            F.round(F.max("max_match_score"), 3).alias("max_match"),
        )
        .filter(F.col("trials") > 1)
    )


def report_tables(tables: Tables) -> dict[str, DataFrame]:
    """The five report tables.

    The run totals are written to the shared folder once; the three summaries read them from there.
    """
    runs = materialize(with_prompts(run_scores(tables), tables))
    return {
        # files in a folder have no order to speak of
        "scores_wide": scores_wide(tables, ordered=False),
        "summary_by_model": summary_by_model(runs),
        "summary_by_prompt": summary_by_prompt(runs),
        "variance_by_config": variance_by_config(runs),
        "run_manifest": run_manifest(tables),
    }
