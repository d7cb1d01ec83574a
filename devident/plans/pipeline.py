"""The stages over a store, from scan files to reports. Each can be rerun alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from devident.fixed_values import INPUT_VARIANT, PARSER_VERSION, SCANNER_TOOL_NAME
from devident.operators import baseline, inference, integrity, registry, reports, scoring
from devident.operators.extract import host_json, primary_hosts, rejected_documents
from devident.operators.keys import last_key, with_defaults, with_keys
from devident.operators.outputs import accepted_entries
from devident.operators.payload import payload_text
from devident.sources.reports import report_dir, write_report
from devident.sources.scans import listed_scans, read_files
from devident.sources.feeds import sound_entries
from devident.session import materialize
from devident.store import Store


def ingest_rows(
    scans: DataFrame, devices: DataFrame, starts: dict[str, int] | None = None, now: str | None = None
) -> dict[str, DataFrame]:
    """New rows of four tables for a batch of scan documents (`ingest_batch`)."""
    return ingest_batch(scans, devices, starts, now)[0]


def ingest_batch(
    scans: DataFrame, devices: DataFrame, starts: dict[str, int] | None = None, now: str | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """New rows of four tables for a batch of scan documents, and the documents refused for the mac of another device.

    `scans` has `device_code, scan_name, xml, seq` and optionally `operator, network_name`; `seq`
    is the ingest order. Each usable document gives one session, scan run and input, so one
    numbering serves all three; documents are parsed once. `starts` holds the last keys in use.
    What is not usable is told by `ingest_rejects`.
    """
    starts = starts or {}
    for optional in ("operator", "network_name"):
        if optional not in scans.columns:
            scans = scans.withColumn(optional, F.lit(None).cast("string"))

    def parse(raw: DataFrame) -> DataFrame:
        return primary_hosts(raw).select(
            "device_code", "scan_name", "xml", "seq", "operator", "network_name", "command", "tool_version",
            "start_time", "end_time", "exit_code", "ip", "mac", "vendor", "hostname",
            host_json().alias("parsed_data_json"),
            payload_text().alias("input_payload_json"),
        )

    # raw documents are dealt by their order, and only then parsed: what the parse makes is never shuffled
    raw = scans.filter(F.col("device_code").isNotNull()).select(
        "device_code", "scan_name", "xml", "seq", "operator", "network_name"
    )
    documents = with_keys(raw, ["seq"], key="_n", then=parse)
    # a document's place among all is its place among the sightings as well
    seen = documents.select("device_code", "mac", "vendor", F.col("_n").alias("seq"))
    granted = materialize(registry.claims(devices, seen))
    refused = materialize(registry.refused(devices, seen, granted).select(F.col("seq").alias("_n")))
    clashing = documents.join(refused, "_n", "left_semi")
    if refused.limit(1).count():  # what is left is numbered anew, without gaps
        numbers = with_keys(documents.select("_n").join(refused, "_n", "left_anti"), ["_n"], key="_m")
        documents = documents.join(numbers, "_n").drop("_n").withColumnRenamed("_m", "_n")
    added = registry.new_devices(devices, seen, now, starts.get("devices"), granted)
    codes = devices.select("id", "device_code").unionByName(added.select("id", "device_code"))
    placed = documents.join(codes.withColumnRenamed("id", "device_id"), "device_code")

    def key(table: str):
        return (F.col("_n") + F.lit(starts.get(table, 0))).alias("id")

    session = (F.col("_n") + F.lit(starts.get("scan_sessions", 0))).alias("scan_session_id")
    sessions = placed.select(
        key("scan_sessions"), "device_id", F.col("ip").alias("target_ip"), "hostname",
        # listed even when NULL: the default must not apply
        F.col("start_time").alias("started_at"), F.col("end_time").alias("ended_at"),
        "network_name", "operator",
    )
    runs = documents.select(
        key("scan_runs"), session, "scan_name", "command", F.col("xml").alias("stdout_text"), "exit_code",
        F.lit(SCANNER_TOOL_NAME).alias("tool_name"), "tool_version", "parsed_data_json",
    )
    inputs = documents.select(
        key("aggregated_inputs"), session, F.lit(INPUT_VARIANT).alias("variant_name"),
        F.lit(PARSER_VERSION).alias("parser_version"), "input_payload_json",
    )
    tables = {
        "devices": added,
        "scan_sessions": with_defaults(sessions, "scan_sessions", now),
        "scan_runs": with_defaults(runs, "scan_runs", now),
        "aggregated_inputs": with_defaults(inputs, "aggregated_inputs", now),
    }
    return tables, clashing.drop("_n")


def ingest_rejects(scans: DataFrame) -> DataFrame:
    """Documents of a batch that give no rows, with the `reason`: no device code, malformed, or no live host."""
    coded = F.col("device_code").isNotNull()
    nameless = scans.filter(~coded).withColumn("reason", F.lit("no device code"))
    return rejected_documents(scans.filter(coded)).select(*scans.columns, "reason").unionByName(nameless)


def ingest(store: Store, scans: DataFrame, now: str | None = None, notes: dict[str, DataFrame] | None = None) -> DataFrame:
    """Append a batch of scan documents to the store; returns the documents that gave no rows.

    The four tables, and rows of the store's ledgers in `notes`, are published together: a batch that fails on the way leaves
    the store as it was.
    """
    tables = ("devices", "scan_sessions", "scan_runs", "aggregated_inputs")
    starts = {name: last_key(store.table(name)) for name in tables}
    rows, clashing = ingest_batch(scans, store.table("devices"), starts, now)
    with store.change() as change:
        for name, table in {**rows, **(notes or {})}.items():
            change.append(name, table)
    kept = [F.col(c) if c in clashing.columns else F.lit(None).cast(t).alias(c) for c, t in scans.dtypes]
    return ingest_rejects(scans).unionByName(clashing.select(*kept, F.lit("mac of another device").alias("reason")))


def ingest_folder(
    store: Store, path: str, name: Callable[[DataFrame], DataFrame], pattern: str = "*.xml", now: str | None = None
) -> DataFrame | None:
    """Ingest the scan files below a folder that the store hasn't read yet; returns the documents that gave no rows, None
    without a new file.

    `name` adds `device_code` and `seq` to what `read_scans` returns. A file counts as read by its path, length and modification
    time, noted in the same version of the store as its rows; files that are known are listed, but not opened.
    """
    unread = materialize(listed_scans(store.spark, path, pattern).join(store.table("files_read"), ["path", "length", "modified_us"], "left_anti"))
    # as many paths as Spark's own list of the files to read has
    paths = [r.path for r in unread.select("path").orderBy("path").collect()]
    if not paths:
        return None
    return ingest(store, name(read_files(store.spark, paths)), now, {"files_read": unread})


def append_checked(store: Store, table: str, rows: DataFrame) -> DataFrame:
    """Append the rows of a batch that break no constraint; returns the others with all that each one breaks (`broken`)."""
    sound, rejects = integrity.checked(table, rows, store.tables())
    store.append(table, sound)
    return rejects


def load_truth(store: Store, entries: DataFrame, now: str | None = None) -> DataFrame:
    """Upsert labels; returns the entries that resolve to no device, and the broken ones of a feed that was read with them."""
    entries, broken = sound_entries(entries)
    devices = store.table("devices")
    store.replace("ground_truth", registry.upsert_truth(store.table("ground_truth"), entries, devices, now))
    unresolved = registry.truth_rejects(entries, devices)
    return unresolved if broken is None else unresolved.unionByName(broken, allowMissingColumns=True)


def load_prompts(store: Store, feed: DataFrame, now: str | None = None) -> DataFrame | None:
    """Upsert prompts; returns the broken lines of a feed that was read with them, None of others."""
    feed, broken = sound_entries(feed)
    store.replace("prompts", registry.upsert_prompts(store.table("prompts"), feed, now))
    return broken


def _append_keyed(store: Store, table: str, rows: DataFrame, order_by: list[str], now: str | None) -> None:
    keyed = with_keys(rows, order_by, last_key(store.table(table)), costly=True)
    store.append(table, with_defaults(keyed.drop("pos"), table, now))


def add_baselines(store: Store, now: str | None = None) -> DataFrame:
    """Baseline runs for inputs that have none; returns what became of each of these (`id, baseline_status`)."""
    inputs, scans, runs = (store.table(t) for t in ("aggregated_inputs", "scan_runs", "model_runs"))
    status = materialize(baseline.baseline_status(baseline.missing_baselines(inputs, runs), inputs, scans, runs))
    _append_keyed(store, "model_runs", baseline.build_baselines(inputs, scans, runs, now), ["aggregated_input_id"], now)
    return status


def redo_baselines(store: Store, requested: DataFrame, now: str | None = None) -> DataFrame:
    """Replace the baselines of requested inputs (`id`) and drop their scores, both or neither.

    Only the buckets of the runs and scores concerned are written. Returns the class each request had before
    (`id, baseline_status`).
    """
    inputs, scans, runs = (store.table(t) for t in ("aggregated_inputs", "scan_runs", "model_runs"))
    status = materialize(baseline.baseline_status(requested, inputs, scans, runs))
    replaced = materialize(baseline.replaced_baselines(requested, inputs, runs))
    fresh = baseline.baseline_runs(inputs.join(requested.select("id").distinct(), "id", "left_semi"), scans, now)
    keyed = with_defaults(with_keys(fresh, ["aggregated_input_id"], last_key(runs), costly=True), "model_runs", now)
    with store.change() as change:
        change.delete("scores", replaced.select(F.col("id").alias("model_run_id")))
        change.delete("model_runs", replaced)
        change.append("model_runs", keyed)
    return status


def run_models(
    store: Store, asked: DataFrame, backend: Callable[[str, str], inference.Backend], tasks: int | None = None,
    rounds: int | None = None, folder: str | None = None,
) -> DataFrame:
    """Answer requests (`aggregated_input_id, prompt_id`, settings) and append the runs.

    With `rounds` and a shared `folder`, answers are kept there round by round (`infer_in_rounds`): called again after a failure with
    the same folder, only requests without an answer are asked. Returns the requests that name an unknown input or prompt.
    """
    inputs, prompts = store.table("aggregated_inputs"), store.table("prompts")
    requests = inference.build_requests(asked, inputs, prompts)
    if folder:
        answered = inference.infer_in_rounds(requests, backend, folder, rounds or 16, tasks)
    else:
        answered = inference.infer(requests, backend, tasks)
    order = ["aggregated_input_id", "prompt_id", "model_name", "started_at"]
    _append_keyed(store, "model_runs", inference.run_records(answered), order, None)
    return inference.rejected_requests(asked, inputs, prompts)


def score_new(store: Store, now: str | None = None) -> None:
    """Score complete runs that have no score rows yet; doing it again adds nothing."""
    truth = store.table("ground_truth")
    runs = scoring.unscored_runs(store.table("model_runs"), store.table("scores"))
    rows = scoring.score_runs(
        runs, store.table("aggregated_inputs"), store.table("scan_sessions"), truth, accepted_entries(truth)
    )
    _append_keyed(store, "scores", rows, ["model_run_id", "pos"], now)


def _classes(store: Store, requested: DataFrame) -> DataFrame:
    """What scoring makes of requested runs, fixed before the tables change."""
    return materialize(
        scoring.score_status(
            requested, store.table("model_runs"), store.table("aggregated_inputs"), store.table("scan_sessions"),
            store.table("ground_truth"), store.table("scores"),
        )
    )


def score_selected(store: Store, requested: DataFrame, now: str | None = None) -> DataFrame:
    """Score named runs (`model_run_id`) of any status that have no score rows yet; returns each one's class."""
    truth = store.table("ground_truth")
    classes = _classes(store, requested)
    chosen = store.table("model_runs").join(
        requested.select(F.col("model_run_id").alias("id")).distinct(), "id", "left_semi"
    )
    scored = store.table("scores").select(F.col("model_run_id").alias("id")).distinct()
    rows = scoring.score_runs(
        chosen.join(scored, "id", "left_anti"), store.table("aggregated_inputs"), store.table("scan_sessions"),
        truth, accepted_entries(truth),
    )
    _append_keyed(store, "scores", rows, ["model_run_id", "pos"], now)
    return classes


def rescore(store: Store, requested: DataFrame, now: str | None = None) -> DataFrame:
    """Replace the score rows of named runs; returns the class that each one had. Only the runs' buckets are written."""
    classes = _classes(store, requested)
    runs, inputs, sessions = (store.table(t) for t in ("model_runs", "aggregated_inputs", "scan_sessions"))
    truth, scores = store.table("ground_truth"), store.table("scores")
    replaced = materialize(scoring.replaced_runs(requested, runs, inputs, sessions, truth))
    chosen = runs.join(replaced.select(F.col("model_run_id").alias("id")), "id", "left_semi")
    fresh = scoring.score_runs(chosen, inputs, sessions, truth, accepted_entries(truth))
    keyed = with_keys(fresh, ["model_run_id", "pos"], last_key(scores), costly=True).drop("pos")
    with store.change() as change:
        change.delete("scores", replaced)
        change.append("scores", with_defaults(keyed, "scores", now))
    return classes


def export(store: Store, path: str | None = None, fmt: str = "parquet") -> dict[str, str]:
    """Write the five report tables, by default to a folder of the store named after the time."""
    return write_report(reports.report_tables(store.tables()), path or report_dir(f"{store.root}/reports"), fmt)
