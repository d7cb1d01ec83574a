"""The model's tables derived from the driver's tables, row by row.

Every model table is a projection (or a key join) of a driver table, so its size grows with it:
devices, sessions and inputs are customers, runs are orders, predictions are line items, scan
documents are orders. `oracles.py` states the same formulas in SQL. Plans (not rows) are kept per
session and folder.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from devident.functions.text import let
from devident.operators import scoring
from devident.operators.keys import with_defaults
from devident.operators.outputs import accepted_entries
from devident.session import shuffle_partitions

VENDORS = ["economy", "large", "medium", "promo", "small", "standard"]
PRODUCTS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
TIERS = ["exact", "partial", "related", "odd", None]
NOW = "2024-01-01 00:00:00"
ACCEPTED = 16
WILD = ":*:*:*:*:*:*:*"


@lru_cache
def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _cpe(part: Column, vendor: Column, product: Column, version: Column) -> Column:
    return _text("cpe:2.3:", part, ":", vendor, ":", product, ":", version, WILD)


def _ip(key: Column) -> Column:
    return _text("10.", F.floor(key / 65536) % 256, ".", F.floor(key / 256) % 256, ".", key % 256)


def device_code(key: Column) -> Column:
    return _text("Customer#", F.lpad(key.cast("string"), 9, "0"))


@lru_cache
def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return with_defaults(
        load(spark, sf_dir, "customer").select(
            key.alias("id"),
            F.col("c_name").alias("device_code"),
            _text("mac-", key).alias("mac"),
            F.lower("c_mktsegment").alias("manufacturer"),
            F.when(F.col("c_acctbal") < 1000, "camera").otherwise("router").alias("device_type"),
        ),
        "devices",
        NOW,
    )


@lru_cache
def scan_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return with_defaults(
        load(spark, sf_dir, "customer").select(
            key.alias("id"),
            key.alias("device_id"),
            _ip(key).alias("target_ip"),
            F.when(F.col("c_mktsegment") != "HOUSEHOLD", _text("host-", key)).alias("hostname"),
        ),
        "scan_sessions",
        NOW,
    )


@lru_cache
def aggregated_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return with_defaults(
        load(spark, sf_dir, "customer").select(
            key.alias("id"),
            key.alias("scan_session_id"),
            F.lit("plain-text").alias("variant_name"),
            F.lit("1.0").alias("parser_version"),
            _text("Device: ", F.col("c_name"), "\nSegment: ", F.col("c_mktsegment")).alias("input_payload_json"),
        ),
        "aggregated_inputs",
        NOW,
    )


@lru_cache
def scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two per BUILDING session, none for MACHINERY, else one."""
    segment = F.col("c_mktsegment")
    numbers = (
        F.when(segment == "BUILDING", F.array(F.lit(0), F.lit(1)))
        .when(segment == "MACHINERY", F.array().cast("array<int>"))
        .otherwise(F.array(F.lit(0)))
    )
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.explode(numbers).alias("n"))
    return with_defaults(
        rows.select(
            (F.col("c_custkey") * 2 + F.col("n")).alias("id"),
            F.col("c_custkey").alias("scan_session_id"),
            _text("scan-", F.col("n")).alias("scan_name"),
            _text("7.", F.col("n")).alias("tool_version"),
        ),
        "scan_runs",
        NOW,
    )


@lru_cache
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defaults(
        load(spark, sf_dir, "region").select(
            F.col("r_regionkey").alias("id"),
            F.lower("r_name").alias("prompt_name"),
            F.lit("1.0").alias("prompt_version"),
            _text("Identify the device for ", F.col("r_name")).alias("prompt_text"),
        ),
        "prompts",
        NOW,
    )


def _predicted(index: Column) -> Column:
    """A stored prediction of an order, from its own columns."""
    sound = _cpe(
        F.when(index % 2 == 0, "o").otherwise("a"),
        _word(VENDORS, F.col("o_custkey") + index),
        _word(PRODUCTS, F.col("o_orderkey") + index),
        F.when(F.col("o_orderstatus") == "O", "*").otherwise((index % 4).cast("string")),
    )
    return F.when((F.col("o_orderstatus") == "P") & (index == 3), "cpe:2.3:bad").otherwise(sound)


def _predicted_list() -> Column:
    size = F.floor(F.col("o_totalprice") / 100000).cast("int")
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), _predicted))


def _quoted(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda c: _text('"', c, '"')), ", ")


def stored_output() -> Column:
    """JSON text: a list, a single identifier, or NULL."""
    def written(listed: Column) -> Column:
        return (
            F.when(F.size(listed) == 1, _text('{"cpe": ', _quoted(listed), "}"))
            .when(F.size(listed) > 1, _text('{"cpes": [', _quoted(listed), "]}"))
        )

    return let(_predicted_list(), written)


@lru_cache
def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("o_orderpriority") == "5-LOW"
    failed = F.month("o_orderdate") == 12
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return with_defaults(
        load(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("aggregated_input_id"),
            F.when(~low, F.substring("o_orderpriority", 1, 1).cast("long")).alias("prompt_id"),
            F.lit(1).alias("trial_number"),
            F.when(low, "nmap").otherwise(_text("model-", F.lower("o_orderstatus"))).alias("model_name"),
            F.lit("1").alias("model_version"),
            F.when(~low, F.when(F.col("o_totalprice") < 250000, 0.0).otherwise(0.7)).alias("temperature"),
            F.when(~low, 1.0).alias("top_p"),
            F.when(~low, 2048).alias("max_tokens"),
            F.when(~low, F.lit(42)).alias("seed"),
            stored_output().alias("parsed_output_json"),
            stamp.alias("started_at"),
            stamp.alias("ended_at"),
            F.when(failed, "error").otherwise("complete").alias("status"),
            F.when(failed, "timeout").alias("error_text"),
        ),
        "model_runs",
        NOW,
    )


def _accepted(index: Column) -> Column:
    """An accepted identifier of a customer; entries come in pairs of the same product."""
    pair = F.floor(index / 2)
    return _cpe(
        F.when(pair % 2 == 0, "o").otherwise("a"),
        _word(VENDORS, F.col("c_nationkey") + pair),
        _word(PRODUCTS, F.col("c_custkey") + pair),
        F.when(index % 3 == 0, "*").otherwise((index % 4).cast("string")),
    )


def _entry(index: Column) -> Column:
    tier = F.get(F.array(*[F.lit(t) for t in TIERS]), (index % len(TIERS)).cast("int"))
    quoted_tier = F.coalesce(_text('"', tier, '"'), F.lit("null"))
    return F.when(index == 5, _text('"', _accepted(index), '"')).otherwise(
        _text('{"cpe": "', _accepted(index), '", "tier": ', quoted_tier, "}")
    )


@lru_cache
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a positive balance are labelled."""
    entries = F.transform(F.sequence(F.lit(0), F.lit(ACCEPTED - 1)), _entry)
    customers = load(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)
    return with_defaults(
        customers.select("c_custkey", "c_nationkey", "c_mktsegment").repartition(shuffle_partitions(spark), "c_custkey").select(
            F.col("c_custkey").alias("id"),
            F.col("c_custkey").alias("device_id"),
            F.lower("c_mktsegment").alias("true_vendor"),
            _text("device-", F.col("c_nationkey")).alias("true_product"),
            _text("[", F.array_join(entries, ", "), "]").alias("accepted_cpes_json"),
            F.lit("1.0").alias("rubric_version"),
            F.lit("verified").alias("label_status"),
        ),
        "ground_truth",
        NOW,
    )


@lru_cache
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`run_id, pos, cpe` from line items and their parts."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    sound = _cpe(
        F.when(F.col("l_linestatus") == "O", "o").otherwise("a"),
        F.lower("p_type"),
        F.split_part("p_name", F.lit(" "), F.lit(2)),
        F.when(F.col("l_returnflag") == "N", "*").otherwise((F.col("p_size") % 4).cast("string")),
    )
    malformed = (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_linenumber") - 1).alias("pos"),
        F.when(malformed, "cpe:2.3:bad").otherwise(sound).alias("cpe"),
    )


@lru_cache
def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables but scores and experiments."""
    makers = (
        devices, scan_sessions, scan_runs, aggregated_inputs, prompts, model_runs, ground_truth,
    )
    return {make.__name__: make(spark, sf_dir) for make in makers}


@lru_cache
def fresh_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows (no key yet) of all complete runs, from the line-item predictions."""
    tables = base_tables(spark, sf_dir)
    truth = tables["ground_truth"]
    context = scoring.scoring_context(
        tables["model_runs"], tables["aggregated_inputs"], tables["scan_sessions"], truth, keep=["status"]
    )
    complete = context.filter(F.col("status") == "complete")
    return scoring.score_predictions(complete, predictions(spark, sf_dir), accepted_entries(truth))


@lru_cache
def scored_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables the reports read. Score keys are unique but not consecutive: reports only count them."""
    tables = base_tables(spark, sf_dir)
    rows = fresh_scores(spark, sf_dir).withColumn("id", F.monotonically_increasing_id())
    return {**tables, "scores": with_defaults(rows, "scores", NOW)}


@lru_cache
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan document per order, built from its own columns; see `FIXTURES.md` for the cases.

    `seq, scan_session_id, scan_name, device_code, xml`
    """
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    status, month = F.col("o_orderstatus"), F.month("o_orderdate")
    urgency = F.substring("o_orderpriority", 1, 1).cast("int")
    vendor, product = _word(VENDORS, customer), _word(PRODUCTS, key)

    def when(condition: Column, *parts) -> Column:
        return F.when(condition, _text(*parts)).otherwise("")

    def either(condition: Column, yes: str, no: str) -> Column:
        return F.when(condition, F.lit(yes)).otherwise(no)

    head = _text(
        '<?xml version="1.0"?>\n<!DOCTYPE nmaprun>\n<nmaprun args="scan ', key, '" version="7.', month,
        '" startstr="', F.date_format("o_orderdate", "yyyy-MM-dd"), '">',
    )
    before = when(urgency <= 2, '<prescript><script id="dns" output=" pre ', key, ' "/></prescript>')
    after = when(
        urgency.between(2, 3), '<postscript><script id="dns" output="post ', key,
        '"/><script id="mdns" output="m ', key, '"/></postscript>',
    )
    down = when(
        status == "P", '<host><status state="down"/><address addr="10.255.0.1" addrtype="ipv4"/><ports>',
        '<port protocol="tcp" portid="1"><state state="open"/><service name="d"><cpe>cpe:/a:down:host</cpe>',
        "</service></port></ports></host>",
    )
    addresses = _text(
        when(month != 11, '<address addr="10.0.0.1" addrtype="ipv4"/><address addr="', _ip(customer), '" addrtype="ipv4"/>'),
        '<address addr="mac-', customer, '" addrtype="mac" vendor="', vendor, '"/>',
    )
    names = when(urgency == 1, '<hostnames><hostname name="h', key, '"/><hostname name="other"/></hostnames>')
    host_scripts = when(
        urgency >= 2, "<hostscript>",
        when(urgency == 2, '<script id="nbstat" output="NetBIOS name: NB', key, ', user"/>'),
        '<script id="uptime" output="up ', key, '"/>',
        when(urgency == 4, '<script id="clock" output="c"/><script id="uptime" output=" later ', key, '"/>'),
        when(urgency == 5, '<script id="blank" output="  "/>'),
        "</hostscript>",
    )
    system = _text(
        '<os><osmatch name="OS ', month, '"', when(urgency != 3, ' accuracy="', F.lit(90) + urgency, '"'),
        '><osclass cpe="cpe:/o:', vendor, ":os", month, '">',
        when(status == "F", "<cpe>cpe:/o:", vendor, ":os", month, "</cpe>"),
        when(status == "O", "<cpe> cpe:/o:", vendor, ":alt:", urgency, " </cpe>"),
        "</osclass></osmatch></os>",
    )
    ports = _text(
        '<ports><port protocol="tcp" portid="22"><state state="open"/><service name="ssh" product="', product,
        '" version="', urgency, '"><cpe>cpe:/a:', vendor, ":", product, ":", urgency,
        '</cpe></service><script id="banner" output="', F.repeat(F.lit("b"), 190 + urgency * 4), '"/></port>',
        '<port protocol="tcp" portid="80"><state state="', either(status == "P", "closed", "open"),
        '"/><service name="http"><cpe> cpe:/a:x:web </cpe><cpe/></service></port>',
        '<port protocol="udp" portid="443">', when(month > 6, '<state state="open"/>'), "</port></ports>",
    )
    host = _text(
        "<host>", when(status != "O", '<status state="up"/>'), addresses, names, host_scripts, system, ports, "</host>",
    )
    second = when(
        status == "F", '<host><status state="up"/>',
        when(month != 11, '<address addr="10.254.0.1" addrtype="ipv4"/>'), "<ports>",
        '<port protocol="tcp" portid="9"><state state="open"/><service><cpe>cpe:/h:acme:second', month,
        "</cpe></service></port></ports></host>",
    )
    end = when(
        urgency != 5, '<runstats><finished timestr="day ', F.dayofmonth("o_orderdate"), '" exit="',
        either(urgency == 4, "error", "success"), '"/></runstats>',
    )
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    return orders.repartition(shuffle_partitions(spark), "o_orderkey").select(
        key.alias("seq"),
        customer.alias("scan_session_id"),
        _text("scan-", key).alias("scan_name"),
        device_code(customer).alias("device_code"),
        # December documents were cut off
        _text(head, before, down, host, second, after, end, when(month != 12, "</nmaprun>")).alias("xml"),
    )


def document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan runs that hold the scan documents: several per session."""
    return scan_documents(spark, sf_dir).select(
        F.col("seq").alias("id"),
        "scan_session_id",
        "scan_name",
        F.col("xml").alias("stdout_text"),
        F.when(F.col("seq") % 2 == 0, F.lit("7.94")).alias("tool_version"),
    )
