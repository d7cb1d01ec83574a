"""The nine tables: columns, defaults and constraints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _struct(ddl: str) -> T.StructType:
    """A schema from DDL text; Spark's own reader of such text needs a session, which an import doesn't have."""
    fields = [column.split() for column in ddl.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], not rest) for name, kind, *rest in fields])


TABLES: dict[str, T.StructType] = {
    "devices": _struct(
        "id long not null, device_code string not null, mac string, display_name string, "
        "manufacturer string, model string, firmware_version string, device_type string, notes string, "
        "created_at string"
    ),
    "scan_sessions": _struct(
        "id long not null, device_id long not null, target_ip string, hostname string, started_at string, "
        "ended_at string, network_name string, environment_notes string, operator string, "
        "protocol_version string"
    ),
    "scan_runs": _struct(
        "id long not null, scan_session_id long not null, scan_name string, command string, "
        "stdout_text string, stderr_text string, exit_code int, started_at string, ended_at string, "
        "tool_name string, tool_version string, parsed_data_json string"
    ),
    "aggregated_inputs": _struct(
        "id long not null, scan_session_id long not null, variant_name string, parser_version string, "
        "input_payload_json string, created_at string, notes string"
    ),
    "prompts": _struct(
        "id long not null, prompt_name string, prompt_version string, prompt_text string not null, "
        "created_at string, notes string"
    ),
    "experiments": _struct(
        "id long not null, name string not null, model_name string, model_version string, prompt_id long, "
        "temperature double, top_p double, seed long, notes string, created_at string"
    ),
    "model_runs": _struct(
        "id long not null, aggregated_input_id long not null, experiment_id long, prompt_id long, "
        "trial_number int, model_name string, model_version string, temperature double, top_p double, "
        "max_tokens int, seed long, conversation_history_json string, raw_output_text string, "
        "parsed_output_json string, started_at string, ended_at string, status string, error_text string"
    ),
    "ground_truth": _struct(
        "id long not null, device_id long not null, true_vendor string, true_product string, "
        "true_firmware_version string, accepted_cpes_json string, rubric_version string, "
        "label_status string, notes string, created_at string, updated_at string"
    ),
    "scores": _struct(
        "id long not null, model_run_id long not null, ground_truth_id long not null, predicted_cpe string, "
        "matched_accepted_cpe string, part_correct int, vendor_correct int, product_correct int, "
        "version_correct int, exact_match int, cve_lookup_valid int, best_match_tier string, "
        "match_score double, predicted_vendor string, predicted_product string, score_notes string, "
        "scorer_version string, created_at string"
    ),
}

# What a store notes beside the tables
LEDGERS: dict[str, T.StructType] = {
    "files_read": _struct("path string not null, length long not null, modified_us long not null"),
}

# Columns that get the append time when the writer does not list them
NOW_DEFAULTS: dict[str, tuple[str, ...]] = {
    "devices": ("created_at",),
    "scan_sessions": ("started_at",),
    "scan_runs": ("started_at",),
    "aggregated_inputs": ("created_at",),
    "prompts": ("created_at",),
    "experiments": ("created_at",),
    "model_runs": ("started_at",),
    "ground_truth": ("created_at", "updated_at"),
    "scores": ("created_at",),
}
TEXT_DEFAULTS: dict[str, dict[str, str]] = {"model_runs": {"status": "pending"}}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str


FOREIGN_KEYS = [
    ForeignKey("scan_sessions", "device_id", "devices"),
    ForeignKey("scan_runs", "scan_session_id", "scan_sessions"),
    ForeignKey("aggregated_inputs", "scan_session_id", "scan_sessions"),
    ForeignKey("experiments", "prompt_id", "prompts"),
    ForeignKey("model_runs", "aggregated_input_id", "aggregated_inputs"),
    ForeignKey("model_runs", "experiment_id", "experiments"),
    ForeignKey("model_runs", "prompt_id", "prompts"),
    ForeignKey("ground_truth", "device_id", "devices"),
    ForeignKey("scores", "model_run_id", "model_runs"),
    ForeignKey("scores", "ground_truth_id", "ground_truth"),
]

UNIQUE_KEYS = [("devices", ["device_code"]), ("devices", ["mac"])]
LOGICAL_KEYS = [("prompts", ["prompt_name", "prompt_version"]), ("ground_truth", ["device_id"])]


def required_columns(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if not f.nullable]
