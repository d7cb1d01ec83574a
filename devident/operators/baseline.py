"""Scanner baseline: the scanner's own identifiers as runs of a model."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from devident.fixed_values import SCANNER_MODEL_NAME, STATUS_COMPLETE
from devident.functions.cpe import cpe_normalize
from devident.functions.documents import to_json_text
from devident.functions.text import run_stamp
from devident.operators.extract import CPE_SCHEMA, parse_documents, raw_cpes
from devident.session import materialize


def scanner_cpes(scans: DataFrame, xml: str = "xml", out: str = "cpes") -> DataFrame:
    """Add the normalised distinct identifiers of each document; malformed documents get an empty list."""
    documents = parse_documents(scans, xml, CPE_SCHEMA)
    known = F.filter(F.transform(raw_cpes(F.col("doc.host")), cpe_normalize), lambda c: c.isNotNull())
    return documents.withColumn(out, F.array_distinct(known)).drop("doc", "malformed")


#: slots of the filter of wanted sessions, 64 to a row: a table of at most 2^20 rows
SESSION_SLOTS = 1 << 26


def of_sessions(scan_runs: DataFrame, sessions: DataFrame, slots: int = SESSION_SLOTS) -> DataFrame:
    """The scan runs that may belong to the sessions: a fixed-size filter, before anything is read of their documents.

    Session ids are hashed to `slots` slots, 64 of them the bits of one row, by one aggregation; its result can't grow beyond
    that, so it is broadcast, and no document is moved. A million sessions let 2 % of the others pass; very many let all
    pass, and cost no more than that.
    """
    slot = F.pmod(F.xxhash64("scan_session_id"), F.lit(slots)).cast("int")
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63))
    taken = sessions.groupBy(word.alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_taken")
    )
    met = scan_runs.withColumn("_word", word).join(F.broadcast(taken), "_word")
    return met.filter(F.getbit("_taken", bit) == 1).select(scan_runs.columns)


#: comes before every id, as NULL does
_BEFORE_IDS = Decimal(-(2**63) - 1)


def session_cpes(scan_runs: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """`scan_session_id, cpes, tool_version` over all documents of a session, of `sessions` only if given.

    Only documents of those sessions, and of the few that share a slot with them (`of_sessions`), are parsed.

    Identifiers come in first-seen order by scan run. They are made distinct, with partial
    aggregation, before a session's list is built, so a list holds distinct identifiers only,
    however many documents repeat them. So are the versions, of which the first counts.
    """
    if sessions is not None:
        scan_runs = of_sessions(scan_runs, sessions)
    full = scan_runs.select("id", "scan_session_id", "tool_version", F.nullif("stdout_text", F.lit("")).alias("xml"))
    # each document is reduced to its version and its identifiers where it is read: no text is shuffled
    version = F.when(F.col("xml").isNotNull(), F.col("tool_version"))
    listed = scanner_cpes(full).select(
        "scan_session_id",
        (F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(_BEFORE_IDS)) * F.lit(2**32)).alias("place"),
        F.concat(F.array(version), "cpes").alias("items"),
    )
    if sessions is not None:  # inner: a semi join would be moved below the parse, and with it the texts
        listed = listed.join(sessions.select("scan_session_id").distinct(), "scan_session_id")
    # outer: the filter Spark infers for a plain explode would repeat the parse
    items = listed.select("scan_session_id", "place", F.posexplode_outer("items").alias("pos", "item"))
    # one number for id and position: the least of it is taken by hash, that of a struct would need a sort
    first_seen = items.groupBy("scan_session_id", "item", (F.col("pos") == 0).alias("is_version")).agg(
        F.min(F.col("place") + F.col("pos")).alias("seen")
    )
    found, is_version = F.struct("seen", "item"), F.col("is_version")
    merged = first_seen.groupBy("scan_session_id").agg(
        F.collect_list(F.when(~is_version, found)).alias("found"),
        F.min(F.when(is_version & F.col("item").isNotNull(), found)).alias("version"),
    )
    return merged.select(
        "scan_session_id",
        F.transform(F.sort_array("found"), lambda s: s["item"]).alias("cpes"),
        F.col("version.item").alias("tool_version"),
    )


def missing_baselines(inputs: DataFrame, runs: DataFrame) -> DataFrame:
    """Inputs without a baseline run."""
    have = runs.filter(F.col("model_name") == SCANNER_MODEL_NAME).select(
        F.col("aggregated_input_id").alias("id")
    ).distinct()
    return inputs.join(have, "id", "left_anti")


def baseline_runs(inputs: DataFrame, scan_runs: DataFrame, now: str | None = None) -> DataFrame:
    """One run per given input, without key; inputs whose session has no scan runs are skipped.

    See `baseline_status` for what becomes of each request.
    """
    # read three times: once for the filter, once behind it, once for the runs
    wanted = materialize(inputs.select(F.col("id").alias("aggregated_input_id"), "scan_session_id"))
    found = wanted.join(session_cpes(scan_runs, wanted), "scan_session_id")

    def absent(kind: str) -> Column:
        return F.lit(None).cast(kind)

    stamp = run_stamp(now)
    return found.select(
        "aggregated_input_id",
        absent("long").alias("experiment_id"),
        absent("long").alias("prompt_id"),
        F.lit(1).alias("trial_number"),
        F.lit(SCANNER_MODEL_NAME).alias("model_name"),
        F.coalesce("tool_version", F.lit("")).alias("model_version"),
        absent("double").alias("temperature"),
        absent("double").alias("top_p"),
        absent("int").alias("max_tokens"),
        absent("long").alias("seed"),
        absent("string").alias("conversation_history_json"),
        absent("string").alias("raw_output_text"),
        to_json_text(F.struct("cpes")).alias("parsed_output_json"),
        stamp.alias("started_at"),
        stamp.alias("ended_at"),
        F.lit(STATUS_COMPLETE).alias("status"),
        absent("string").alias("error_text"),
    )


def build_baselines(inputs: DataFrame, scan_runs: DataFrame, runs: DataFrame, now: str | None = None) -> DataFrame:
    """Baseline runs for every input that has none; doing it again adds nothing."""
    return baseline_runs(missing_baselines(inputs, runs), scan_runs, now)


def baseline_status(requested: DataFrame, inputs: DataFrame, scan_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """What adding a baseline would do with each requested input: `id, baseline_status`."""
    known = inputs.select("id", "scan_session_id", F.lit(True).alias("_found"))
    scanned = scan_runs.select("scan_session_id").distinct().withColumn("_scanned", F.lit(True))
    have = runs.filter(F.col("model_name") == SCANNER_MODEL_NAME).select(
        F.col("aggregated_input_id").alias("id")
    ).distinct().withColumn("_have", F.lit(True))
    status = (
        F.when(F.col("_found").isNull(), "input not found")
        .when(F.col("_have").isNotNull(), "has a baseline")
        .when(F.col("_scanned").isNull(), "no scan runs")
        .otherwise("to add")
    )
    asked = requested.select("id").distinct().join(known, "id", "left")
    return asked.join(scanned, "scan_session_id", "left").join(have, "id", "left").select(
        "id", status.alias("baseline_status")
    )


def replaced_baselines(requested: DataFrame, inputs: DataFrame, runs: DataFrame) -> DataFrame:
    """`id, aggregated_input_id` of the runs that a rebuild for requested inputs (`id`) replaces: of each the first."""
    chosen = inputs.join(requested.select("id").distinct(), "id", "left_semi")
    baselines = runs.filter(F.col("model_name") == SCANNER_MODEL_NAME).select("id", "aggregated_input_id")
    return (
        baselines.join(chosen.select(F.col("id").alias("aggregated_input_id")), "aggregated_input_id", "left_semi")
        .groupBy("aggregated_input_id")
        .agg(F.min("id").alias("id"))
        .select("id", "aggregated_input_id")
    )


def rebuild_baselines(
    requested: DataFrame, inputs: DataFrame, scan_runs: DataFrame, runs: DataFrame, scores: DataFrame,
    now: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(runs kept, scores kept, fresh runs)` for requested inputs (`id`).

    Of an input's baselines the first is replaced; its score rows go with it.
    """
    chosen = inputs.join(requested.select("id").distinct(), "id", "left_semi")
    replaced = replaced_baselines(requested, inputs, runs).select("id")
    kept = runs.join(replaced, "id", "left_anti").select(runs.columns)
    kept_scores = scores.join(
        replaced.select(F.col("id").alias("model_run_id")), "model_run_id", "left_anti"
    ).select(scores.columns)
    return kept, kept_scores, baseline_runs(chosen, scan_runs, now)
