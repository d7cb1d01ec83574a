"""Named queries: every operator over the driver's whole tables (see `binding.py`)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from devident.fixed_values import CPE_FIELDS
from devident.functions.cpe import cpe_is_valid, cpe_normalize, cpe_parse
from devident.functions.text import strip
from devident.operators import baseline, extract, inference, integrity, outputs, registry, reports, scoring
from devident.operators.keys import last_key, with_defaults, with_keys
from devident.operators.payload import payload_text
from devident.plans import binding, pipeline
from devident.session import configure, shared_folder, shuffle_partitions
from devident.sources.feeds import read_prompts, read_truth
from devident.sources.reports import write_report
from devident.sources.scans import read_scans
from devident.store import Store, register

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir.rstrip("/"))

    run.__doc__, run.__name__ = fn.__doc__, fn.__name__
    QUERIES[fn.__name__] = run
    return fn


def _joined(items: str | Column) -> Column:
    return F.array_join(items, "|")


# --- reports ---------------------------------------------------------------


@query
def summary_by_model(spark, sf_dir):
    """Accuracy per device and model: predictions scored and summarised in one plan."""
    return reports.summary_by_model(reports.run_scores(binding.scored_tables(spark, sf_dir)))


@query
def summary_by_prompt(spark, sf_dir):
    tables = binding.scored_tables(spark, sf_dir)
    return reports.summary_by_prompt(reports.with_prompts(reports.run_scores(tables), tables))


@query
def variance_by_config(spark, sf_dir):
    return reports.variance_by_config(reports.run_scores(binding.scored_tables(spark, sf_dir), device=False))


@query
def run_manifest(spark, sf_dir):
    return reports.run_manifest(binding.scored_tables(spark, sf_dir))


def _keyed_scores(spark, sf_dir) -> DataFrame:
    rows = binding.fresh_scores(spark, sf_dir)
    keyed = with_keys(rows, ["model_run_id", "pos", "predicted_cpe"], costly=True)
    return with_defaults(keyed.drop("pos"), "scores", binding.NOW)


@query
def scores_wide(spark, sf_dir):
    tables = binding.base_tables(spark, sf_dir)
    return reports.scores_wide({**tables, "scores": _keyed_scores(spark, sf_dir)})


@query
def wide_summary(spark, sf_dir):
    """The model summary taken from the wide fact table instead of from run totals."""
    wide = reports.scores_wide(binding.scored_tables(spark, sf_dir), ordered=False)
    return reports.summary_by_model(reports.wide_run_scores(wide))


@query
def head_to_head(spark, sf_dir):
    return reports.head_to_head(binding.scored_tables(spark, sf_dir))


@query
def baseline_against_models(spark, sf_dir):
    """Scanner baseline and models kept apart by model name."""
    table = reports.head_to_head(binding.scored_tables(spark, sf_dir))
    scanner = F.col("model_name") == "nmap"
    return table.groupBy("device_code").agg(
        F.max(F.when(scanner, F.col("avg_match"))).alias("scanner_match"),
        F.max(F.when(~scanner, F.col("avg_match"))).alias("best_model_match"),
    )


@query
def prompt_effect(spark, sf_dir):
    return reports.prompt_effect(binding.scored_tables(spark, sf_dir))


@query
def repeat_variance(spark, sf_dir):
    return reports.repeat_variance(binding.scored_tables(spark, sf_dir))


@query
def sql_views(spark, sf_dir):
    """The tables as views for plain SQL."""
    register(binding.scored_tables(spark, sf_dir))
    return spark.sql(
        """
        WITH per_run AS (
          SELECT model_run_id, best_match_tier, count(*) AS n FROM scores GROUP BY model_run_id, best_match_tier
        )
        SELECT device_type, best_match_tier, sum(n) AS n_predictions, count(DISTINCT model_run_id) AS n_runs
        FROM per_run
        JOIN model_runs AS run ON run.id = model_run_id
        JOIN aggregated_inputs AS input ON input.id = run.aggregated_input_id
        JOIN scan_sessions AS session ON session.id = input.scan_session_id
        JOIN devices AS device ON device.id = session.device_id
        GROUP BY device_type, best_match_tier
        """
    )


@query
def report_roundtrip(spark, sf_dir):
    """The report sink: written as Parquet and read back."""
    tables = binding.scored_tables(spark, sf_dir)
    summary = reports.summary_by_prompt(reports.with_prompts(reports.run_scores(tables), tables))
    return spark.read.parquet(write_report({"summary_by_prompt": summary}, shared_folder(spark))["summary_by_prompt"])


@query
def report_counts(spark, sf_dir):
    """All five report tables written and read back: their sizes."""
    tables = binding.base_tables(spark, sf_dir)
    scored = {**tables, "scores": _keyed_scores(spark, sf_dir)}
    written = write_report(reports.report_tables(scored), shared_folder(spark))
    counts = [
        spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("report"), "n_rows")
        for name, path in written.items()
    ]
    return reduce(DataFrame.unionByName, counts)


# --- scoring ---------------------------------------------------------------


@query
def score_predictions(spark, sf_dir):
    return binding.fresh_scores(spark, sf_dir)


def _old_scores(spark, sf_dir) -> DataFrame:
    """Score rows already there: one per line item of a large quantity."""
    lines = binding.load(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 45)
    return with_defaults(
        lines.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("model_run_id"),
            F.lit(0).alias("ground_truth_id"),
            F.lit("old").alias("predicted_cpe"),
            F.lit(0.0).alias("match_score"),
        ),
        "scores",
        binding.NOW,
    )


@query
def unscored_runs(spark, sf_dir):
    runs = scoring.unscored_runs(binding.model_runs(spark, sf_dir), _old_scores(spark, sf_dir))
    return runs.select("id", "aggregated_input_id", "model_name", "status")


@query
def score_new(spark, sf_dir):
    """Incremental scoring of stored output documents, keys continuing after the last."""
    tables, old = binding.base_tables(spark, sf_dir), _old_scores(spark, sf_dir)
    truth = tables["ground_truth"]
    rows = scoring.score_runs(
        scoring.unscored_runs(tables["model_runs"], old), tables["aggregated_inputs"], tables["scan_sessions"],
        truth, outputs.accepted_entries(truth),
    )
    start = old.agg(F.max("id")).first()[0]
    return with_keys(rows, ["model_run_id", "pos"], start, costly=True).select("id", *scoring.SCORE_COLUMNS, "pos")


@query
def store_scoring(spark, sf_dir):
    """Stored runs scored through a store, twice: the second time adds nothing."""
    store = Store(spark, shared_folder(spark))
    for name, table in binding.base_tables(spark, sf_dir).items():
        store.replace(name, table)
    for _ in range(2):
        pipeline.score_new(store, binding.NOW)
    models = store.table("model_runs").select(F.col("id").alias("model_run_id"), "model_name")
    return store.table("scores").join(models, "model_run_id").groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n_scores"), F.sum("match_score").alias("total_score"), F.max("id").alias("last_key")
    )


@query
def score_status(spark, sf_dir):
    tables = binding.base_tables(spark, sf_dir)
    requested = binding.load(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("model_run_id"))
    return scoring.score_status(
        requested, tables["model_runs"], tables["aggregated_inputs"], tables["scan_sessions"],
        tables["ground_truth"], _old_scores(spark, sf_dir),
    )


@query
def rescore(spark, sf_dir):
    """Urgent runs scored again; all other old rows stay."""
    tables = binding.base_tables(spark, sf_dir)
    truth = tables["ground_truth"]
    requested = (
        binding.load(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select(F.col("o_orderkey").alias("model_run_id"))
    )
    kept, fresh = scoring.rescore(
        requested, tables["model_runs"], tables["aggregated_inputs"], tables["scan_sessions"], truth,
        outputs.accepted_entries(truth), _old_scores(spark, sf_dir),
    )
    columns = ["model_run_id", "predicted_cpe", "best_match_tier", "match_score"]
    return kept.select(*columns).unionByName(fresh.select(*columns))


# --- identifiers and model output ------------------------------------------


def _short_cpes(spark, sf_dir) -> DataFrame:
    """Identifiers of many forms, one per line item, from the line and its part."""
    lines = binding.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    parts = binding.load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    number, flag = F.col("l_linenumber"), F.col("l_returnflag")
    vendor, product = F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))
    text = (
        F.when(number == 1, F.concat(F.lit(" cpe:/a:"), vendor, F.lit(":"), product, F.lit("\n")))
        .when(number == 2, F.concat(F.lit("cpe:/h:"), vendor))
        .when(number == 3, F.concat(F.lit("cpe:/o:"), vendor, F.lit("::"), F.col("p_size").cast("string")))
        .when(number == 4, F.concat(F.lit("cpe:2.3:a:"), vendor, F.lit(":"), product, F.lit(":")))
        .when(number == 5, F.concat(F.lit("cpe:/a:"), vendor, F.lit(":"), product, F.repeat(F.lit(":x"), 9)))
        .when((number == 6) & (flag == "R"), F.lit("not an identifier"))
        .when((number == 7) & (flag == "R"), F.concat(F.lit("cpe:2.3:a:*:"), product, F.lit(":1" + binding.WILD)))
        .when((number == 7) & (flag == "A"), F.concat(F.lit("cpe:2.3:z:-:"), product, F.lit(":1" + binding.WILD)))
        .otherwise(F.concat(F.lit("cpe:2.3:o:"), vendor, F.lit(":"), product, F.lit(":1" + binding.WILD)))
    )
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", text.alias("cpe")
    )


@query
def cpe_normalize_lines(spark, sf_dir):
    return _short_cpes(spark, sf_dir).withColumn("normalized", cpe_normalize(F.col("cpe")))


@query
def cpe_parse_lines(spark, sf_dir):
    parsed = _short_cpes(spark, sf_dir).withColumn("_f", cpe_parse(F.col("cpe")))
    return parsed.select("l_orderkey", "l_linenumber", *[F.col(f"_f.{f}").alias(f) for f in CPE_FIELDS])


@query
def cpe_validate_lines(spark, sf_dir):
    return _short_cpes(spark, sf_dir).withColumn("valid", cpe_is_valid(F.col("cpe")).cast("int"))


def _raw_outputs(spark, sf_dir) -> DataFrame:
    """Free texts of models, one per order: fenced, bare, broken or without an object."""
    orders = binding.load(spark, sf_dir, "orders").repartition(shuffle_partitions(spark), "o_orderkey")
    urgency = F.substring("o_orderpriority", 1, 1)
    stored = binding.stored_output()
    body = F.coalesce(
        stored, F.when(F.col("o_orderstatus") == "P", '{"cpes": null}').otherwise('{"cpes": []}')
    )
    text = (
        F.when(urgency == "1", F.concat(F.lit("The scan shows\n```json\n"), body, F.lit("\n```\nand ```json {}```")))
        .when(urgency == "2", F.concat(F.lit("I think "), body, F.lit(" is right")))
        .when(urgency == "3", F.concat(F.lit("```{broken}``` so "), body))
        .when(urgency == "4", F.concat(F.lit('```{"cpes": broken}``` so '), body))
        .otherwise(F.concat(F.lit("No idea about "), F.col("o_orderkey").cast("string")))
    )
    return orders.select(F.col("o_orderkey").alias("id"), text.alias("raw_output_text"))


@query
def extract_object(spark, sf_dir):
    found = outputs.extract_object(_raw_outputs(spark, sf_dir), "raw_output_text")
    return found.select("id", F.to_json("parsed").alias("object_json"))


@query
def filter_predictions(spark, sf_dir):
    found = outputs.extract_object(_raw_outputs(spark, sf_dir), "raw_output_text")
    return outputs.filter_predictions(found).select("id", "parsed_output_json", "n_dropped", "filter_error")


@query
def predicted_cpes(spark, sf_dir):
    return outputs.predicted_cpes(binding.model_runs(spark, sf_dir))


@query
def accepted_entries(spark, sf_dir):
    return outputs.accepted_entries(binding.ground_truth(spark, sf_dir))


# --- scan documents --------------------------------------------------------


@query
def scan_meta(spark, sf_dir):
    documents = extract.scan_meta(extract.parse_documents(binding.scan_documents(spark, sf_dir)))
    return documents.select("seq", "command", "tool_version", "start_time", "end_time", "exit_code")


@query
def primary_hosts(spark, sf_dir):
    return extract.primary_hosts(binding.scan_documents(spark, sf_dir), details=["hostname"]).select(
        "seq", "ip", "mac", "vendor", "hostname"
    )


@query
def os_identity(spark, sf_dir):
    return extract.primary_hosts(binding.scan_documents(spark, sf_dir), details=["os"]).select(
        "seq", _joined("os_guesses").alias("guesses"), _joined("os_cpes").alias("cpes")
    )


@query
def open_services(spark, sf_dir):
    hosts = extract.primary_hosts(binding.scan_documents(spark, sf_dir), details=["services"])
    return extract.open_services(hosts).select(
        "seq", "service_pos", "port", "protocol", "service", "product", "version",
        _joined("cpes").alias("cpes"), F.size("scripts").alias("n_scripts"),
    )


@query
def scripts(spark, sf_dir):
    hosts = extract.primary_hosts(binding.scan_documents(spark, sf_dir), details=["port_scripts", "scripts"])
    return extract.host_scripts(hosts).select("seq", "scope", "port", "id", "output")


@query
def host_json(spark, sf_dir):
    hosts = extract.primary_hosts(binding.scan_documents(spark, sf_dir)).withColumn("j", extract.host_json())
    def at(path: str) -> Column:
        return F.get_json_object("j", path)

    return hosts.select(
        "seq", at("$.ip").alias("ip"), at("$.hostname").alias("hostname"), at("$.os_cpes[0]").alias("os_cpe"),
        at("$.services[0].product").alias("product"), at("$.services[0].cpes[0]").alias("cpe"),
        at("$.services[0].scripts.banner").alias("banner"), at("$.host_scripts.uptime").alias("uptime"),
        at("$.post_scripts.dns").alias("post_dns"),
    )


@query
def bad_documents(spark, sf_dir):
    return extract.rejected_documents(binding.scan_documents(spark, sf_dir)).select("seq", "reason")


@query
def payload_texts(spark, sf_dir):
    hosts = extract.primary_hosts(binding.scan_documents(spark, sf_dir))
    return hosts.select("seq", payload_text().alias("payload"))


@query
def ingest_tables(spark, sf_dir):
    """A batch of documents turned into rows of four tables, shown joined."""
    known = binding.devices(spark, sf_dir).filter(F.col("device_type") == "router")
    rows = pipeline.ingest_rows(binding.scan_documents(spark, sf_dir), known, now=binding.NOW)
    sessions = rows["scan_sessions"].withColumnsRenamed({"id": "scan_session_id", "started_at": "session_start"})
    runs = rows["scan_runs"].withColumnRenamed("id", "scan_run_id")
    inputs = rows["aggregated_inputs"].select(
        F.col("id").alias("input_id"), "scan_session_id", "variant_name",
        "input_payload_json",
    )
    added = rows["devices"].select(F.col("id").alias("device_id"), F.col("manufacturer").alias("new_manufacturer"))
    return (
        sessions.join(runs, "scan_session_id")
        .join(inputs, "scan_session_id")
        .join(added, "device_id", "left")
        .select(
            "scan_session_id", "scan_run_id", "input_id", "device_id", "new_manufacturer", "target_ip", "hostname",
            "session_start", sessions["ended_at"], "scan_name", "command", "exit_code", "tool_version",
            "variant_name", "input_payload_json",
        )
    )


@query
def scan_files(spark, sf_dir):
    """One scan file per supplier, written below a folder per target and time, then read."""
    key = F.col("s_suppkey")
    files = binding.load(spark, sf_dir, "supplier").select(
        F.format_string("10.1.%d.%d_20240101_%06d", F.floor(key / 256), key % 256, F.col("s_nationkey")).alias("folder"),
        F.concat(F.lit('<nmaprun args="'), F.col("s_name"), F.lit('">\n<host/></nmaprun>')).alias("value"),
    )
    path = shared_folder(spark)
    # a folder is one task's, which itself puts its files in place: the driver would move one after the other. Nobody reads the
    # folder before the job has ended
    dealt = files.repartition(shuffle_partitions(spark), "folder")
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("folder").text(path)
    scans = read_scans(spark, path, "*.txt")
    return scans.select("target_ip", "scan_ts", strip(F.col("xml")).alias("xml"))


@query
def store_rescore(spark, sf_dir):
    """Urgent runs scored again through a store, which writes the buckets of these runs only: all score rows afterwards."""
    store = _filled_store(spark, sf_dir)
    requested = (
        binding.load(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("model_run_id"))
    )
    pipeline.rescore(store, requested, binding.NOW)
    return store.table("scores").select("id", *scoring.SCORE_COLUMNS)


@query
def store_baselines(spark, sf_dir):
    """Baselines of all building customers rebuilt through a store: all runs afterwards, new ones with their lists, and the scores left."""
    store = _filled_store(spark, sf_dir)
    new = F.col("id") > last_key(store.table("model_runs"))
    store.replace("scan_runs", with_defaults(binding.document_runs(spark, sf_dir), "scan_runs", binding.NOW))
    customers = binding.load(spark, sf_dir, "customer")
    pipeline.redo_baselines(store, customers.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id")), binding.NOW)
    runs = store.table("model_runs").select(
        F.lit("run").alias("kind"), "id", "aggregated_input_id", "model_name",
        F.when(new, F.col("model_version")).alias("model_version"), F.when(new, F.col("parsed_output_json")).alias("listed"),
    )
    scores = store.table("scores").select(F.lit("score").alias("kind"), "id", F.col("model_run_id").alias("aggregated_input_id"))
    return runs.unionByName(scores, allowMissingColumns=True)


def _filled_store(spark, sf_dir) -> Store:
    store = Store(spark, shared_folder(spark), buckets=16)
    with store.change() as change:
        for name, table in binding.base_tables(spark, sf_dir).items():
            change.replace(name, table)
        change.replace("scores", _old_scores(spark, sf_dir))
    return store


# --- scanner baseline ------------------------------------------------------


@query
def scanner_cpes(spark, sf_dir):
    found = baseline.scanner_cpes(binding.scan_documents(spark, sf_dir))
    return found.select("seq", _joined("cpes").alias("cpes"))


@query
def session_cpes(spark, sf_dir):
    merged = baseline.session_cpes(binding.document_runs(spark, sf_dir))
    return merged.select("scan_session_id", _joined("cpes").alias("cpes"), "tool_version")


@query
def missing_baselines(spark, sf_dir):
    missing = baseline.missing_baselines(
        binding.aggregated_inputs(spark, sf_dir), binding.model_runs(spark, sf_dir)
    )
    return missing.select("id", "scan_session_id")


_BASELINE_COLUMNS = ["aggregated_input_id", "model_name", "model_version", "parsed_output_json", "status", "started_at"]


@query
def build_baselines(spark, sf_dir):
    rows = baseline.build_baselines(
        binding.aggregated_inputs(spark, sf_dir), binding.document_runs(spark, sf_dir),
        binding.model_runs(spark, sf_dir), binding.NOW,
    )
    return rows.select(*_BASELINE_COLUMNS)


@query
def rebuild_baselines(spark, sf_dir):
    """Baselines of all building customers replaced; row counts of what is kept and made."""
    customers = binding.load(spark, sf_dir, "customer")
    requested = customers.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    kept, kept_scores, fresh = baseline.rebuild_baselines(
        requested, binding.aggregated_inputs(spark, sf_dir), binding.document_runs(spark, sf_dir),
        binding.model_runs(spark, sf_dir), _old_scores(spark, sf_dir), binding.NOW,
    )

    def tagged(df: DataFrame, table: str, key: str) -> DataFrame:
        return df.select(F.lit(table).alias("kind"), F.col(key).alias("key"))

    return (
        tagged(kept, "run kept", "id")
        .unionByName(tagged(kept_scores, "score kept", "id"))
        .unionByName(tagged(fresh, "run for input", "aggregated_input_id"))
    )


# --- devices, labels, prompts ----------------------------------------------


@query
def upsert_devices(spark, sf_dir):
    known = binding.devices(spark, sf_dir).filter(F.col("device_type") == "router")
    seen = binding.load(spark, sf_dir, "orders").select(
        binding.device_code(F.col("o_custkey")).alias("device_code"),
        F.concat(F.lit("mac-"), F.col("o_custkey").cast("string")).alias("mac"),
        F.lower("o_orderpriority").alias("vendor"),
        F.col("o_orderkey").alias("seq"),
    )
    return registry.upsert_devices(known, seen, binding.NOW).select("id", "device_code", "mac", "manufacturer")


@query
def device_claims(spark, sf_dir):
    """Devices after sightings whose macs clash, with stored devices and with each other: no mac is given twice."""
    known = binding.devices(spark, sf_dir).filter(F.col("device_type") == "router")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    mac = F.when(key % 5 != 0, F.concat(F.lit("mac-"), (customer + F.when(key % 3 == 0, 1).otherwise(0)).cast("string")))
    seen = binding.load(spark, sf_dir, "orders").select(
        binding.device_code(customer).alias("device_code"), mac.alias("mac"), F.lower("o_orderpriority").alias("vendor"), key.alias("seq"),
    )
    return registry.upsert_devices(known, seen, binding.NOW).select("id", "device_code", "mac", "manufacturer")


def _truth_feed(spark, sf_dir) -> DataFrame:
    """Labelled entries, one per order: known, unknown and blank macs."""
    customer = F.col("o_custkey").cast("string")
    mac = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" \t"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("other-"), customer))
        .otherwise(F.concat(F.lit(" mac-"), customer, F.lit("\n")))
    )
    return binding.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        mac.alias("mac"),
        F.lower("o_orderstatus").alias("true_vendor"),
        F.concat(F.lit("product-"), F.col("o_orderkey").cast("string")).alias("true_product"),
        F.lit(None).cast("string").alias("true_firmware_version"),
        F.when(F.col("o_orderstatus") == "F", "[]").otherwise('["cpe:2.3:bad"]').alias("accepted_cpes"),
        F.lit("2.0").alias("rubric_version"),
        F.lit("draft").alias("label_status"),
        F.lit(None).cast("string").alias("notes"),
    )


@query
def resolve_truth(spark, sf_dir):
    resolved = registry.resolve_by_mac(_truth_feed(spark, sf_dir), binding.devices(spark, sf_dir))
    return resolved.select("seq", "mac", "device_id", "device_code")


@query
def truth_rejects(spark, sf_dir):
    rejects = registry.truth_rejects(_truth_feed(spark, sf_dir), binding.devices(spark, sf_dir))
    return rejects.select("seq", "mac", "reason")


@query
def upsert_truth(spark, sf_dir):
    table = registry.upsert_truth(
        binding.ground_truth(spark, sf_dir), _truth_feed(spark, sf_dir), binding.devices(spark, sf_dir), "2024-02-02 00:00:00"
    )
    return table.select(
        "id", "device_id", "true_vendor", "true_product", F.length("accepted_cpes_json").alias("list_length"),
        "rubric_version", "label_status", "created_at", "updated_at",
    )


def _conversation_prompts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Prompt table and feed from conversation turns: conversation is the name, turn the version."""
    turns = binding.load(spark, sf_dir, "conversations").withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))
    name, version = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    table = with_defaults(
        turns.filter(F.col("role") != "assistant").select(
            F.col("seq").alias("id"), name.alias("prompt_name"), version.alias("prompt_version"),
            F.col("text").alias("prompt_text"), F.col("role").alias("notes"),
        ),
        "prompts",
        binding.NOW,
    )
    feed = turns.filter(F.col("role") != "system").select(
        "seq", name.alias("name"), version.alias("version"), F.lit("revised").alias("notes"),
        F.concat(F.lit("revised: "), F.col("text")).alias("text"),
    )
    return table, feed


@query
def upsert_prompts(spark, sf_dir):
    table, feed = _conversation_prompts(spark, sf_dir)
    return registry.upsert_prompts(table, feed, "2024-02-02 00:00:00").select(
        "id", "prompt_name", "prompt_version", "prompt_text", "notes", "created_at"
    )


@query
def list_prompts(spark, sf_dir):
    return registry.list_prompts(_conversation_prompts(spark, sf_dir)[0])


@query
def truth_feed(spark, sf_dir):
    """The truth feed written as JSON lines and read back."""
    path = shared_folder(spark)
    feed = _truth_feed(spark, sf_dir)
    feed.select(
        "mac", "true_vendor", "true_product",
        F.when(F.col("true_vendor") != "f", F.array(F.struct(F.col("true_product").alias("cpe")))).alias("accepted_cpes"),
    ).write.json(path)
    return read_truth(spark, path, multi_line=False).select("mac", "true_vendor", "true_product", "accepted_cpes")


@query
def prompt_feed(spark, sf_dir):
    """The prompt feed written as JSON lines and read back."""
    path = shared_folder(spark)
    _conversation_prompts(spark, sf_dir)[1].drop("seq").write.json(path)
    return read_prompts(spark, path, multi_line=False)


# --- requests and inference ------------------------------------------------

_SETTINGS = [inference.ModelSettings("model-a", "1"), inference.ModelSettings("model-b", "2", 0.7, 0.9, 512, None)]


def _asked(spark, sf_dir) -> DataFrame:
    """One request per order; prompt 9 and the negative inputs do not exist."""
    orders = binding.load(spark, sf_dir, "orders")
    asked = orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderstatus") == "P", -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias("aggregated_input_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", 9).otherwise(
            F.substring("o_orderpriority", 1, 1).cast("long")
        ).cast("long").alias("prompt_id"),
    )
    return inference.with_settings(asked, _SETTINGS[0])


@query
def build_requests(spark, sf_dir):
    requests = inference.build_requests(
        _asked(spark, sf_dir), binding.aggregated_inputs(spark, sf_dir), binding.prompts(spark, sf_dir)
    )
    return requests.select(
        "request_id", "aggregated_input_id", "prompt_id", "model_name", "temperature", "max_tokens", "seed",
        F.col("messages")[0]["content"].alias("system_text"), F.col("messages")[1]["content"].alias("user_text"),
    )


@query
def rejected_requests(spark, sf_dir):
    rejects = inference.rejected_requests(
        _asked(spark, sf_dir), binding.aggregated_inputs(spark, sf_dir), binding.prompts(spark, sf_dir)
    )
    return rejects.select("request_id", "reason")


@query
def sweep_grid(spark, sf_dir):
    return inference.sweep(binding.aggregated_inputs(spark, sf_dir), [1, 2, 3, 4], _SETTINGS)


def _stub():
    """A maker of a model without a model: it answers from the texts alone.

    Made inside a function, so that it travels to the executors by value.
    """

    class Stub:
        def __init__(self, name, version):
            self.name, self.supports_seed = name, name != "model-b"

        def chat(self, messages, *, temperature, top_p, seed, max_tokens):
            place = messages[0]["content"].rsplit(" for ", 1)[1].lower()
            segment = messages[1]["content"].rsplit(" ", 1)[1].lower()
            if segment == "machinery":
                raise ValueError("cannot answer " + segment)
            if segment == "household":
                return '  {"cpes": null}  '
            good = f"cpe:2.3:h:{segment}:{place}:{max_tokens}:*:*:*:*:*:*:*"
            return f'  Found by {self.name}\n```json\n{{"cpes": ["{good}", "bad"]}}\n```  '

    return Stub


def _answers(spark, sf_dir) -> DataFrame:
    asked = inference.sweep(binding.aggregated_inputs(spark, sf_dir), [1, 2, 3, 4], _SETTINGS)
    requests = inference.build_requests(
        asked, binding.aggregated_inputs(spark, sf_dir), binding.prompts(spark, sf_dir)
    )
    return inference.infer(requests, _stub())


@query
def infer_stub(spark, sf_dir):
    return _answers(spark, sf_dir).select(
        "aggregated_input_id", "prompt_id", "model_name", "seed", "raw_output_text", "status", "error_text"
    )


@query
def run_records(spark, sf_dir):
    return inference.run_records(_answers(spark, sf_dir)).select(
        "aggregated_input_id", "prompt_id", "model_name", "temperature", "max_tokens", "seed",
        "parsed_output_json", "status", "error_text",
    )


# --- keys, constraints -----------------------------------------------------


@query
def generated_keys(spark, sf_dir):
    """Line items numbered in the order of all their columns."""
    lines = binding.load(spark, sf_dir, "lineitem").drop("l_shipdate")
    order = ["l_orderkey", "l_linenumber", *[c for c in lines.columns if c not in ("l_orderkey", "l_linenumber")]]
    return with_keys(lines.select(*order), order, 100).select("id", "l_orderkey", "l_linenumber", "l_extendedprice")


@query
def column_defaults(spark, sf_dir):
    """Absent columns take the default, a listed NULL stays NULL."""
    orders = binding.load(spark, sf_dir, "orders")
    listed = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("aggregated_input_id"),
        F.when(F.col("o_orderstatus") == "F", "done").alias("started_at"),
    )
    return with_defaults(listed, "model_runs", binding.NOW).select("id", "aggregated_input_id", "started_at", "status")


@query
def orphans(spark, sf_dir):
    """Runs whose device lost its label row."""
    found = integrity.orphans(
        binding.model_runs(spark, sf_dir), "aggregated_input_id", binding.ground_truth(spark, sf_dir)
    )
    return found.select("id", "aggregated_input_id")


@query
def duplicates(spark, sf_dir):
    return integrity.duplicates(binding.load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def null_violations(spark, sf_dir):
    runs = binding.model_runs(spark, sf_dir)
    found = integrity.null_violations(runs, ["prompt_id", "parsed_output_json", "temperature"])
    return found.select("id", "missing")


@query
def checked_rows(spark, sf_dir):
    """Batches for three tables with faults of every kind: each row with the constraints it breaks."""
    tables = binding.base_tables(spark, sf_dir)
    customers, orders = binding.load(spark, sf_dir, "customer"), binding.load(spark, sf_dir, "orders")
    k, o = F.col("c_custkey"), F.col("o_orderkey")

    def spelled(prefix: str, number: Column) -> Column:
        return F.concat(F.lit(prefix), number.cast("string"))

    devices = customers.select(
        (k + 10**6).alias("id"),
        F.when(k % 7 == 0, None).when(k % 5 == 0, binding.device_code(k)).when(k % 3 == 0, spelled("new-", F.floor(k / 10))).otherwise(spelled("new-", k * 100)).alias("device_code"),
        F.when(k % 4 == 0, spelled("mac-", k)).when(k % 11 == 0, None).otherwise(spelled("nm-", F.floor(k / 2))).alias("mac"),
    )
    truth = customers.select(
        F.when(k % 13 != 0, k).alias("id"), F.when(k % 6 == 0, None).when(k % 5 == 0, -k).otherwise(F.floor(k / 2) + 1).alias("device_id"),
    )
    runs = orders.select(
        o.alias("id"), F.when(o % 9 == 0, None).when(o % 4 == 0, F.col("o_custkey") + 10**9).otherwise(F.col("o_custkey")).alias("aggregated_input_id"),
        F.when(o % 3 == 0, 99).when(o % 3 == 1, 1).cast("long").alias("prompt_id"), F.when(o % 10 == 0, 5).cast("long").alias("experiment_id"),
    )
    parts = []
    for name, rows in (("devices", devices), ("ground_truth", truth), ("model_runs", runs)):
        full = with_defaults(rows, name, binding.NOW)
        sound, rejects = integrity.checked(name, full, tables)
        told = rejects.select("id", F.array_join(F.array_sort("broken"), "; ").alias("broken")).unionByName(sound.select("id", F.lit("").alias("broken")))
        parts.append(told.select(F.lit(name).alias("table_name"), "id", "broken"))
    return reduce(DataFrame.unionByName, parts)


@query
def violations(spark, sf_dir):
    """Every declared constraint, with the number of rows that break it."""
    return integrity.violations({**binding.base_tables(spark, sf_dir), "scores": _old_scores(spark, sf_dir)})
