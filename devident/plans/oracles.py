"""The same queries in SQL, stated from the driver's columns and run by another engine."""

from __future__ import annotations

from devident.plans.binding import ACCEPTED, NOW, PRODUCTS, TIERS, VENDORS, WILD


def _list(words) -> str:
    return "[" + ", ".join("NULL" if w is None else f"'{w}'" for w in words) + "]"


def _word(words, index: str) -> str:
    return f"{_list(words)}[CAST((({index}) % {len(words)}) + 1 AS INTEGER)]"


def _cpe(part: str, vendor: str, product: str, version: str) -> str:
    return f"'cpe:2.3:' || ({part}) || ':' || ({vendor}) || ':' || ({product}) || ':' || ({version}) || '{WILD}'"


def _even(value: str) -> str:
    return f"round_even(CAST({value} AS DOUBLE) * 10000, 0) / 10000"


_IP = "'10.' || ({k} // 65536) % 256 || '.' || ({k} // 256) % 256 || '.' || {k} % 256"
_CODE = "'Customer#' || lpad(CAST({k} AS VARCHAR), 9, '0')"

# --- model tables ------------------------------------------------------------

_TABLES: dict[str, tuple[str, tuple[str, ...]]] = {}


def _table(name: str, sql: str, *needs: str) -> None:
    _TABLES[name] = (sql, needs)


def _with(*names: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _TABLES[name][1]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_TABLES[n][0]})" for n in ordered) + "\n"


_table(
    "devices",
    f"""SELECT c_custkey AS id, c_name AS device_code, 'mac-' || c_custkey AS mac,
        lower(c_mktsegment) AS manufacturer, CAST(NULL AS VARCHAR) AS model,
        CASE WHEN c_acctbal < 1000 THEN 'camera' ELSE 'router' END AS device_type, '{NOW}' AS created_at
        FROM customer""",
)
_table(
    "scan_sessions",
    f"""SELECT c_custkey AS id, c_custkey AS device_id, {_IP.format(k='c_custkey')} AS target_ip,
        CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'host-' || c_custkey END AS hostname FROM customer""",
)
_table(
    "aggregated_inputs",
    """SELECT c_custkey AS id, c_custkey AS scan_session_id, 'plain-text' AS variant_name, '1.0' AS parser_version,
       'Device: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment AS input_payload_json FROM customer""",
)
_table(
    "scan_runs",
    """SELECT c_custkey * 2 + n AS id, c_custkey AS scan_session_id, 'scan-' || n AS scan_name, '7.' || n AS tool_version
       FROM customer, (VALUES (0), (1)) t(n)
       WHERE (c_mktsegment = 'BUILDING') OR (c_mktsegment <> 'MACHINERY' AND n = 0)""",
)
_table(
    "prompts",
    """SELECT CAST(r_regionkey AS BIGINT) AS id, lower(r_name) AS prompt_name, '1.0' AS prompt_version,
       'Identify the device for ' || r_name AS prompt_text FROM region""",
)
_PREDICTED = (
    "CASE WHEN o_orderstatus = 'P' AND i = 3 THEN 'cpe:2.3:bad' ELSE "
    + _cpe(
        "CASE WHEN i % 2 = 0 THEN 'o' ELSE 'a' END",
        _word(VENDORS, "o_custkey + i"),
        _word(PRODUCTS, "o_orderkey + i"),
        "CASE WHEN o_orderstatus = 'O' THEN '*' ELSE CAST(i % 4 AS VARCHAR) END",
    )
    + " END"
)
_table(
    "model_runs",
    """SELECT o_orderkey AS id, o_custkey AS aggregated_input_id, o_orderstatus, o_orderpriority,
       CASE WHEN NOT low THEN CAST(left(o_orderpriority, 1) AS BIGINT) END AS prompt_id,
       CAST(1 AS INTEGER) AS trial_number,
       CASE WHEN low THEN 'nmap' ELSE 'model-' || lower(o_orderstatus) END AS model_name, '1' AS model_version,
       CASE WHEN NOT low THEN CASE WHEN o_totalprice < 250000 THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END END AS temperature,
       CASE WHEN NOT low THEN 1.0::DOUBLE END AS top_p,
       CASE WHEN NOT low THEN CAST(2048 AS INTEGER) END AS max_tokens,
       CASE WHEN NOT low THEN CAST(42 AS BIGINT) END AS seed,
       CAST(floor(o_totalprice / 100000) AS BIGINT) AS n_stored,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started_at,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ended_at,
       CASE WHEN month(o_orderdate) = 12 THEN 'error' ELSE 'complete' END AS status,
       CASE WHEN month(o_orderdate) = 12 THEN 'timeout' END AS error_text
       FROM (SELECT *, o_orderpriority = '5-LOW' AS low FROM orders)""",
)
_table(
    "stored",
    f"""SELECT o_orderkey AS run_id, CAST(i AS INTEGER) AS pos, {_PREDICTED} AS cpe FROM
        (SELECT *, unnest(range(CAST(floor(o_totalprice / 100000) AS BIGINT))) AS i FROM orders)""",
)
_table(
    "ground_truth",
    f"""SELECT c_custkey AS id, c_custkey AS device_id, lower(c_mktsegment) AS true_vendor,
        'device-' || c_nationkey AS true_product, CAST(NULL AS VARCHAR) AS true_firmware_version,
        '1.0' AS rubric_version, 'verified' AS label_status, '{NOW}' AS created_at, '{NOW}' AS updated_at
        FROM customer WHERE c_acctbal >= 0""",
)
_table(
    "accepted",
    f"""SELECT truth_id, pos, part, vendor, product, version, tier,
        {_cpe('part', 'vendor', 'product', 'version')} AS cpe,
        CASE tier WHEN 'exact' THEN 3 WHEN 'partial' THEN 2 WHEN 'related' THEN 1 ELSE 0 END AS rank
        FROM (SELECT c_custkey AS truth_id, CAST(i AS INTEGER) AS pos,
              CASE WHEN (i // 2) % 2 = 0 THEN 'o' ELSE 'a' END AS part,
              {_word(VENDORS, 'c_nationkey + i // 2')} AS vendor,
              {_word(PRODUCTS, 'c_custkey + i // 2')} AS product,
              CASE WHEN i % 3 = 0 THEN '*' ELSE CAST(i % 4 AS VARCHAR) END AS version,
              CASE WHEN i = 5 THEN 'exact' ELSE {_word(TIERS, 'i')} END AS tier
              FROM customer, range({ACCEPTED}) t(i) WHERE c_acctbal >= 0)""",
)
_table(
    "line_predictions",
    f"""SELECT l_orderkey AS run_id, CAST(l_linenumber - 1 AS INTEGER) AS pos,
        CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'cpe:2.3:bad' ELSE
        {_cpe("CASE WHEN l_linestatus = 'O' THEN 'o' ELSE 'a' END", 'lower(p_type)', "split_part(p_name, ' ', 2)",
              "CASE WHEN l_returnflag = 'N' THEN '*' ELSE CAST(p_size % 4 AS VARCHAR) END")} END AS cpe
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
)


def _scored(name: str, predictions: str, runs: str) -> None:
    """Score rows of the runs that `runs` selects from model_runs (with a label)."""
    _table(
        name,
        f"""SELECT run_id AS model_run_id, truth_id AS ground_truth_id, cpe AS predicted_cpe, matched AS matched_accepted_cpe,
            ok AS part_correct, ok AS vendor_correct, ok AS product_correct, fits AS version_correct,
            fits AS exact_match, ok AS cve_lookup_valid,
            CASE WHEN ok = 1 THEN tier ELSE 'none' END AS best_match_tier,
            CAST(CASE WHEN ok = 1 THEN CASE tier WHEN 'exact' THEN 1 WHEN 'partial' THEN 0.5 WHEN 'related' THEN 0.25
                 ELSE 0 END ELSE 0 END AS DOUBLE) AS match_score,
            CASE WHEN sound THEN split_part(cpe, ':', 4) END AS predicted_vendor,
            CASE WHEN sound THEN split_part(cpe, ':', 5) END AS predicted_product,
            CASE WHEN pos IS NULL THEN 'no predicted CPEs' WHEN NOT sound THEN 'malformed CPE string' END AS score_notes,
            '1.0' AS scorer_version, pos
            FROM (
              SELECT p.*, a.cpe AS matched, a.tier, CAST(a.cpe IS NOT NULL AS INTEGER) AS ok,
                     CAST(coalesce(a.version = split_part(p.cpe, ':', 6) OR a.version = '*', false) AS INTEGER) AS fits,
                     coalesce(p.cpe <> 'cpe:2.3:bad', false) AS sound,
                     row_number() OVER (PARTITION BY p.rid ORDER BY a.rank DESC,
                       (a.version = split_part(p.cpe, ':', 6) OR a.version = '*') DESC, a.pos) AS choice
              FROM (SELECT row_number() OVER () AS rid, r.id AS run_id, r.aggregated_input_id AS truth_id, q.pos, q.cpe
                    FROM model_runs r JOIN ground_truth g ON g.device_id = r.aggregated_input_id
                    LEFT JOIN {predictions} q ON q.run_id = r.id WHERE {runs}) p
              LEFT JOIN accepted a ON a.truth_id = p.truth_id AND a.part = split_part(p.cpe, ':', 3)
                AND a.vendor = split_part(p.cpe, ':', 4) AND a.product = split_part(p.cpe, ':', 5)
                AND p.cpe <> 'cpe:2.3:bad')
            WHERE choice = 1""",
        "model_runs",
        "ground_truth",
        "accepted",
        predictions,
    )


_scored("scores", "line_predictions", "r.status = 'complete'")
_table("old_scores", "SELECT l_orderkey AS model_run_id, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_quantity >= 45")
_scored(
    "new_scores", "stored", "r.status = 'complete' AND r.id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)"
)
_scored("stored_scores", "stored", "r.status = 'complete'")
_scored("urgent_scores", "stored", "r.o_orderpriority = '1-URGENT'")

_SCORE_COLUMNS = (
    "model_run_id, ground_truth_id, predicted_cpe, matched_accepted_cpe, part_correct, vendor_correct, "
    "product_correct, version_correct, exact_match, cve_lookup_valid, best_match_tier, match_score, "
    "predicted_vendor, predicted_product, score_notes, scorer_version"
)
_table(
    "keyed_scores",
    "SELECT row_number() OVER (ORDER BY model_run_id, pos NULLS FIRST, predicted_cpe NULLS FIRST) AS id, * FROM scores",
    "scores",
)
# customers are devices, sessions and inputs at once
_table(
    "targets",
    f"""SELECT c_custkey AS device_id, c_name AS device_code, lower(c_mktsegment) AS device_manufacturer,
        CAST(NULL AS VARCHAR) AS device_model, CASE WHEN c_acctbal < 1000 THEN 'camera' ELSE 'router' END AS device_type,
        c_custkey AS scan_session_id, {_IP.format(k='c_custkey')} AS target_ip,
        CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'host-' || c_custkey END AS scan_hostname,
        c_custkey AS aggregated_input_id, 'plain-text' AS input_variant, '1.0' AS input_parser_version FROM customer""",
)
_table(
    "run_facts",
    """SELECT id AS model_run_id, aggregated_input_id, prompt_id, prompt_name, prompt_version, model_name, model_version,
       temperature, top_p, max_tokens, seed, trial_number, status AS run_status, started_at AS run_started_at,
       ended_at AS run_ended_at, error_text
       FROM model_runs LEFT JOIN (SELECT id AS prompt_id, prompt_name, prompt_version FROM prompts) USING (prompt_id)""",
    "model_runs", "prompts",
)
_table(
    "labels_of",
    """SELECT id AS ground_truth_id, true_vendor, true_product, true_firmware_version, rubric_version, label_status
       FROM ground_truth""",
    "ground_truth",
)
_table(
    "wide",
    f"""SELECT * EXCLUDE (id, pos, error_text), id AS score_id, '{NOW}' AS scored_at
        FROM keyed_scores JOIN run_facts USING (model_run_id) JOIN targets USING (aggregated_input_id)
        JOIN labels_of USING (ground_truth_id)
        LEFT JOIN (SELECT scan_session_id, scan_name, tool_version AS nmap_version FROM scan_runs) USING (scan_session_id)""",
    "keyed_scores", "run_facts", "targets", "labels_of", "scan_runs",
)
_table("facts", "SELECT * FROM scores JOIN run_facts USING (model_run_id) JOIN targets USING (aggregated_input_id)", "scores", "run_facts", "targets")

ORACLES: dict[str, str] = {}

_SUMMARY_BY_MODEL = _with("wide") + f"""
SELECT device_code, model_name, count(score_id) AS n_predictions, count(DISTINCT model_run_id) AS n_runs,
  {_even('avg(match_score)')} AS avg_match_score, {_even('avg(exact_match)')} AS exact_match_rate,
  {_even('avg(cve_lookup_valid)')} AS cve_valid_rate, {_even('avg(vendor_correct)')} AS vendor_correct_rate,
  {_even('avg(product_correct)')} AS product_correct_rate, {_even('avg(version_correct)')} AS version_correct_rate,
  {_even('avg(part_correct)')} AS part_correct_rate,
  {_even("avg(CASE WHEN best_match_tier = 'none' THEN 1 ELSE 0 END)")} AS no_match_rate
FROM wide GROUP BY device_code, model_name"""
ORACLES["summary_by_model"] = _SUMMARY_BY_MODEL
ORACLES["wide_summary"] = _SUMMARY_BY_MODEL
_SUMMARY_BY_PROMPT = _with("wide") + f"""
SELECT model_name, prompt_name, prompt_version, count(score_id) AS n_predictions,
  count(DISTINCT model_run_id) AS n_runs, count(DISTINCT device_code) AS n_devices,
  {_even('avg(match_score)')} AS avg_match_score, {_even('avg(exact_match)')} AS exact_match_rate,
  {_even('avg(cve_lookup_valid)')} AS cve_valid_rate, {_even('avg(vendor_correct)')} AS vendor_correct_rate,
  {_even('avg(product_correct)')} AS product_correct_rate
FROM wide GROUP BY model_name, prompt_name, prompt_version"""
ORACLES["summary_by_prompt"] = _SUMMARY_BY_PROMPT
ORACLES["report_roundtrip"] = _SUMMARY_BY_PROMPT
ORACLES["variance_by_config"] = _with("wide") + f"""
SELECT aggregated_input_id, model_name, prompt_id, temperature, count(model_run_id) AS n_trials,
  {_even('avg(m)')} AS mean_match_score, {_even('stddev_samp(m)')} AS stdev_match_score,
  {_even('min(m)')} AS min_match_score, {_even('max(m)')} AS max_match_score
FROM (SELECT aggregated_input_id, model_name, prompt_id, temperature, model_run_id, avg(match_score) AS m
      FROM wide GROUP BY ALL)
GROUP BY aggregated_input_id, model_name, prompt_id, temperature"""
ORACLES["run_manifest"] = _with("scores", "run_facts", "targets") + """
SELECT model_run_id, device_code, aggregated_input_id, model_name, model_version, prompt_name, prompt_version,
  temperature, top_p, seed, trial_number, run_status AS status, run_started_at AS started_at, run_ended_at AS ended_at,
  error_text, coalesce(n, 0) AS n_predictions_scored, n_exact, n_cve_valid
FROM run_facts JOIN targets USING (aggregated_input_id)
LEFT JOIN (SELECT model_run_id, count(*) AS n, CAST(sum(exact_match) AS BIGINT) AS n_exact,
             CAST(sum(cve_lookup_valid) AS BIGINT) AS n_cve_valid FROM scores GROUP BY model_run_id) USING (model_run_id)"""
ORACLES["scores_wide"] = _with("wide") + "SELECT * FROM wide"
_AVERAGE = "round(sum(match_score) / count(match_score), 3) AS avg_match"
_SIDE_BY_SIDE = f"""SELECT device_code, model_name, count(*) AS n_predictions, {_AVERAGE},
  CAST(sum(exact_match) AS BIGINT) AS exact, CAST(sum(cve_lookup_valid) AS BIGINT) AS cve_valid
FROM facts GROUP BY ALL"""
ORACLES["head_to_head"] = _with("facts") + _SIDE_BY_SIDE
ORACLES["baseline_against_models"] = _with("facts") + f"""
SELECT device_code, max(avg_match) FILTER (WHERE model_name = 'nmap') AS scanner_match,
  max(avg_match) FILTER (WHERE model_name <> 'nmap') AS best_model_match FROM ({_SIDE_BY_SIDE}) GROUP BY device_code"""
ORACLES["prompt_effect"] = _with("facts") + f"""
SELECT prompt_name, prompt_version, {_AVERAGE}, count(DISTINCT model_run_id) AS n_runs
FROM facts WHERE prompt_id IS NOT NULL GROUP BY ALL"""
ORACLES["repeat_variance"] = _with("facts") + f"""
SELECT * FROM (
  SELECT aggregated_input_id, model_name, prompt_id, count(DISTINCT model_run_id) AS trials, {_AVERAGE},
    min(match_score) AS min_match, max(match_score) AS max_match FROM facts GROUP BY ALL) WHERE trials > 1"""
ORACLES["sql_views"] = _with("facts") + """
SELECT device_type, best_match_tier, count(*) AS n_predictions, count(DISTINCT model_run_id) AS n_runs
FROM facts GROUP BY ALL"""
ORACLES["report_counts"] = _with("wide") + """
SELECT 'scores_wide' AS report, count(*) AS n_rows FROM wide
UNION ALL SELECT 'summary_by_model', count(*) FROM (SELECT DISTINCT device_code, model_name FROM wide)
UNION ALL SELECT 'summary_by_prompt', count(*) FROM (SELECT DISTINCT model_name, prompt_name, prompt_version FROM wide)
UNION ALL SELECT 'variance_by_config', count(*) FROM (SELECT DISTINCT aggregated_input_id, model_name, prompt_id, temperature FROM wide)
UNION ALL SELECT 'run_manifest', count(*) FROM orders"""

ORACLES["score_predictions"] = _with("scores") + f"SELECT {_SCORE_COLUMNS}, pos FROM scores"
ORACLES["unscored_runs"] = _with("model_runs", "old_scores") + """
SELECT id, aggregated_input_id, model_name, status FROM model_runs
WHERE status = 'complete' AND id NOT IN (SELECT model_run_id FROM old_scores)"""
ORACLES["score_new"] = _with("new_scores", "old_scores") + f"""
SELECT (SELECT max(id) FROM old_scores) + row_number() OVER (ORDER BY model_run_id, pos NULLS FIRST) AS id,
  {_SCORE_COLUMNS}, pos FROM new_scores"""
ORACLES["store_scoring"] = _with("stored_scores") + """
SELECT r.model_name, count(*) AS n_scores, sum(x.match_score) AS total_score, max(x.id) AS last_key
FROM (SELECT *, row_number() OVER (ORDER BY model_run_id, pos NULLS FIRST) AS id FROM stored_scores) x
JOIN model_runs r ON r.id = x.model_run_id GROUP BY r.model_name"""
ORACLES["score_status"] = _with("model_runs", "ground_truth", "old_scores") + """
SELECT o_orderkey * 2 AS model_run_id, CASE WHEN mr.id IS NULL THEN 'not found' WHEN g.id IS NULL THEN 'no truth'
  WHEN mr.id IN (SELECT model_run_id FROM old_scores) THEN 'already scored' ELSE 'scorable' END AS score_status
FROM orders o LEFT JOIN model_runs mr ON mr.id = o.o_orderkey * 2 LEFT JOIN ground_truth g ON g.device_id = mr.aggregated_input_id"""
ORACLES["rescore"] = _with("urgent_scores", "old_scores") + """
SELECT model_run_id, 'old' AS predicted_cpe, CAST(NULL AS VARCHAR) AS best_match_tier, CAST(0 AS DOUBLE) AS match_score
FROM old_scores WHERE model_run_id NOT IN (SELECT model_run_id FROM urgent_scores)
UNION ALL SELECT model_run_id, predicted_cpe, best_match_tier, match_score FROM urgent_scores"""

ORACLES["store_rescore"] = _with("urgent_scores", "old_scores") + f"""
SELECT id, model_run_id, CAST(0 AS BIGINT) AS ground_truth_id, 'old' AS predicted_cpe, CAST(NULL AS VARCHAR) AS matched_accepted_cpe,
  CAST(NULL AS INTEGER) AS part_correct, CAST(NULL AS INTEGER) AS vendor_correct, CAST(NULL AS INTEGER) AS product_correct,
  CAST(NULL AS INTEGER) AS version_correct, CAST(NULL AS INTEGER) AS exact_match, CAST(NULL AS INTEGER) AS cve_lookup_valid,
  CAST(NULL AS VARCHAR) AS best_match_tier, CAST(0 AS DOUBLE) AS match_score, CAST(NULL AS VARCHAR) AS predicted_vendor,
  CAST(NULL AS VARCHAR) AS predicted_product, CAST(NULL AS VARCHAR) AS score_notes, CAST(NULL AS VARCHAR) AS scorer_version
FROM old_scores WHERE model_run_id NOT IN (SELECT model_run_id FROM urgent_scores)
UNION ALL SELECT (SELECT max(id) FROM old_scores) + row_number() OVER (ORDER BY model_run_id, pos NULLS FIRST), {_SCORE_COLUMNS}
FROM urgent_scores"""

# --- identifiers -------------------------------------------------------------

_table(
    "short_cpes",
    f"""SELECT *, CASE
          WHEN n = 1 THEN ' cpe:/a:' || v || ':' || p || chr(10)
          WHEN n = 2 THEN 'cpe:/h:' || v
          WHEN n = 3 THEN 'cpe:/o:' || v || '::' || p_size
          WHEN n = 4 THEN 'cpe:2.3:a:' || v || ':' || p || ':'
          WHEN n = 5 THEN 'cpe:/a:' || v || ':' || p || repeat(':x', 9)
          WHEN n = 6 AND f = 'R' THEN 'not an identifier'
          WHEN n = 7 AND f = 'R' THEN 'cpe:2.3:a:*:' || p || ':1{WILD}'
          WHEN n = 7 AND f = 'A' THEN 'cpe:2.3:z:-:' || p || ':1{WILD}'
          ELSE 'cpe:2.3:o:' || v || ':' || p || ':1{WILD}' END AS cpe
        FROM (SELECT l_orderkey, l_linenumber, l_linenumber AS n, l_returnflag AS f, lower(p_type) AS v,
              split_part(p_name, ' ', 2) AS p, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)""",
)
ORACLES["cpe_normalize_lines"] = _with("short_cpes") + f"""
SELECT l_orderkey, l_linenumber, cpe, CASE
    WHEN n = 1 THEN 'cpe:2.3:a:' || v || ':' || p || ':*{WILD}'
    WHEN n = 2 THEN NULL
    WHEN n = 3 THEN 'cpe:2.3:o:' || v || ':*:' || p_size || '{WILD}'
    WHEN n = 4 THEN 'cpe:2.3:a:' || v || ':' || p || ':{WILD}'
    WHEN n = 5 THEN 'cpe:2.3:a:' || v || ':' || p || repeat(':x', 9)
    WHEN n = 6 AND f = 'R' THEN NULL
    ELSE cpe END AS normalized FROM short_cpes"""
_FIELDS = ["part", "vendor", "product", "version", "update", "edition", "language", "sw_edition", "target_sw", "target_hw", "other"]
ORACLES["cpe_parse_lines"] = _with("short_cpes") + "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CASE WHEN len(string_split(cpe, ':')) = 13 AND cpe LIKE 'cpe:2.3:%' THEN split_part(cpe, ':', {i + 3}) END AS \"{name}\""
    for i, name in enumerate(_FIELDS)
) + " FROM short_cpes"
ORACLES["cpe_validate_lines"] = _with("short_cpes") + """
SELECT l_orderkey, l_linenumber, cpe, CAST(len(string_split(cpe, ':')) = 13 AND cpe LIKE 'cpe:2.3:%'
  AND split_part(cpe, ':', 3) IN ('h', 'o', 'a') AND split_part(cpe, ':', 4) NOT IN ('', '*')
  AND split_part(cpe, ':', 5) NOT IN ('', '*') AS INTEGER) AS valid FROM short_cpes"""
_table(
    "outputs",
    """SELECT r.id, left(r.o_orderpriority, 1) AS u, r.o_orderstatus AS s, r.n_stored AS n,
       list(q.cpe ORDER BY q.pos) FILTER (WHERE q.cpe IS NOT NULL) AS cpes,
       list(q.cpe ORDER BY q.pos) FILTER (WHERE q.cpe <> 'cpe:2.3:bad') AS good
       FROM model_runs r LEFT JOIN stored q ON q.run_id = r.id GROUP BY ALL""",
    "model_runs", "stored",
)
_JSON_LIST = "'[\"' || array_to_string({0}, '\",\"') || '\"]'"
ORACLES["extract_object"] = _with("outputs") + f"""
SELECT id, CASE WHEN u IN ('4', '5') THEN NULL
  WHEN n = 0 AND s = 'P' THEN '{{"cpes":null}}' WHEN n = 0 THEN '{{"cpes":[]}}'
  WHEN n = 1 THEN '{{"cpe":"' || cpes[1] || '"}}' ELSE '{{"cpes":' || {_JSON_LIST.format('cpes')} || '}}' END AS object_json
FROM outputs"""
ORACLES["filter_predictions"] = _with("outputs") + f"""
SELECT id, CASE WHEN u IN ('4', '5') OR n = 0 THEN NULL
  WHEN n = 1 THEN '{{"cpe":"' || cpes[1] || '"}}' ELSE '{{"cpes":' || {_JSON_LIST.format('good')} || '}}' END AS parsed_output_json,
  CAST(CASE WHEN u IN ('4', '5') THEN 0 ELSE coalesce(len(cpes), 0) - coalesce(len(good), 0) END AS INTEGER) AS n_dropped,
  CASE WHEN u IN ('1', '2', '3') AND n = 0 AND s = 'P' THEN '''NoneType'' object is not iterable' END AS filter_error
FROM outputs"""
ORACLES["predicted_cpes"] = _with("stored") + "SELECT run_id, pos, cpe FROM stored"
ORACLES["accepted_entries"] = _with("accepted") + "SELECT truth_id, truth_id AS device_id, pos, cpe, tier FROM accepted"

# --- scan documents ----------------------------------------------------------

_table(
    "docs",
    f"""SELECT o_orderkey AS seq, o_custkey AS c, o_orderstatus AS s, month(o_orderdate) AS m, day(o_orderdate) AS d,
        strftime(o_orderdate, '%Y-%m-%d') AS day_text, CAST(left(o_orderpriority, 1) AS INTEGER) AS u,
        {_word(VENDORS, 'o_custkey')} AS v, {_word(PRODUCTS, 'o_orderkey')} AS p,
        {_IP.format(k='o_custkey')} AS ip, {_CODE.format(k='o_custkey')} AS device_code FROM orders""",
)
_table(
    "hosts",
    """SELECT *, CASE WHEN u = 1 THEN 'h' || seq WHEN u = 2 THEN 'NB' || seq || ',' END AS hostname,
       'cpe:/a:' || v || ':' || p || ':' || u AS cpe22, 'cpe:/o:' || v || ':os' || m AS oscpe,
       'OS ' || m || CASE WHEN u <> 3 THEN ' (' || (90 + u) || '%)' ELSE '' END AS guess,
       repeat('b', 190 + u * 4) AS banner
       FROM docs WHERE m NOT IN (11, 12)""",
    "docs",
)
ORACLES["scan_meta"] = _with("docs") + """
SELECT seq, CASE WHEN m <> 12 THEN 'scan ' || seq END AS command, CASE WHEN m <> 12 THEN '7.' || m END AS tool_version,
  CASE WHEN m <> 12 THEN day_text END AS start_time, CASE WHEN m <> 12 AND u <> 5 THEN 'day ' || d END AS end_time,
  CAST(CASE WHEN m <> 12 AND u <> 5 THEN CASE WHEN u = 4 THEN 0 ELSE 1 END END AS INTEGER) AS exit_code FROM docs"""
ORACLES["primary_hosts"] = _with("hosts") + "SELECT seq, ip, 'mac-' || c AS mac, v AS vendor, hostname FROM hosts"
ORACLES["os_identity"] = _with("hosts") + """
SELECT seq, guess AS guesses, oscpe || CASE WHEN s = 'O' THEN '|cpe:/o:' || v || ':alt:' || u ELSE '' END AS cpes FROM hosts"""
_table(
    "services",
    """SELECT seq, s, m, 0 AS k, 22 AS port, 'tcp' AS protocol, 'ssh' AS service, p AS product,
         CAST(u AS VARCHAR) AS version, cpe22 AS cpes, 1 AS n_scripts FROM hosts
       UNION ALL SELECT seq, s, m, 1, 80, 'tcp', 'http', NULL, NULL, ' cpe:/a:x:web ', 0 FROM hosts WHERE s <> 'P'
       UNION ALL SELECT seq, s, m, 2, 443, 'udp', NULL, NULL, NULL, '', 0 FROM hosts WHERE m > 6""",
    "hosts",
)
ORACLES["open_services"] = _with("services") + """
SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY k) - 1 AS INTEGER) AS service_pos, CAST(port AS INTEGER) AS port,
  protocol, service, product, version, cpes, CAST(n_scripts AS INTEGER) AS n_scripts FROM services"""
ORACLES["scripts"] = _with("hosts") + """
SELECT seq, 'pre' AS scope, CAST(NULL AS INTEGER) AS port, 'dns' AS id, 'pre ' || seq AS output FROM hosts WHERE u <= 2
UNION ALL SELECT seq, 'post', NULL, 'dns', 'post ' || seq FROM hosts WHERE u IN (2, 3)
UNION ALL SELECT seq, 'post', NULL, 'mdns', 'm ' || seq FROM hosts WHERE u IN (2, 3)
UNION ALL SELECT seq, 'host', NULL, 'nbstat', 'NetBIOS name: NB' || seq || ', user' FROM hosts WHERE u = 2
UNION ALL SELECT seq, 'host', NULL, 'uptime', CASE WHEN u = 4 THEN 'later ' ELSE 'up ' END || seq FROM hosts WHERE u >= 2
UNION ALL SELECT seq, 'host', NULL, 'clock', 'c' FROM hosts WHERE u = 4
UNION ALL SELECT seq, 'port', 22, 'banner', banner FROM hosts"""
ORACLES["host_json"] = _with("hosts") + """
SELECT seq, ip, hostname, oscpe AS os_cpe, p AS product, cpe22 AS cpe, banner,
  CASE WHEN u >= 2 THEN CASE WHEN u = 4 THEN 'later ' ELSE 'up ' END || seq END AS uptime,
  CASE WHEN u IN (2, 3) THEN 'post ' || seq END AS post_dns FROM hosts"""
ORACLES["bad_documents"] = _with("docs") + """
SELECT seq, CASE WHEN m = 12 THEN 'malformed document' ELSE 'no live host' END AS reason FROM docs WHERE m IN (11, 12)"""
_table(
    "payloads",
    """SELECT seq, array_to_string(list_filter([
        'Device: ' || device_code, 'Scan:   scan-' || seq, 'IP:     ' || ip,
        'Hostname: ' || coalesce(hostname, 'unknown'), 'Vendor (nmap): ' || v, '',
        'OS Guesses:', '  ' || guess, '',
        'Open Ports:',
        printf('  %-12s %-10s %s', '22/tcp', 'ssh', p || ' ' || u), '    nmap CPE: ' || cpe22,
        '    [banner] ' || left(banner, 200),
        CASE WHEN s <> 'P' THEN printf('  %-12s %-10s %s', '80/tcp', 'http', '') END,
        CASE WHEN s <> 'P' THEN '    nmap CPE:  cpe:/a:x:web ' END,
        CASE WHEN m > 6 THEN printf('  %-12s %-10s %s', '443/udp', '', '') END, '',
        CASE WHEN u >= 2 THEN 'Host Scripts:' END,
        CASE WHEN u = 2 THEN '  [nbstat]' END, CASE WHEN u = 2 THEN '  NetBIOS name: NB' || seq || ', user' END,
        CASE WHEN u >= 2 THEN '  [uptime]' END, CASE WHEN u >= 2 THEN CASE WHEN u = 4 THEN '  later ' ELSE '  up ' END || seq END,
        CASE WHEN u = 4 THEN '  [clock]' END, CASE WHEN u = 4 THEN '  c' END, CASE WHEN u >= 2 THEN '' END,
        CASE WHEN u <= 3 THEN 'Discovery Scripts:' END, CASE WHEN u <= 3 THEN '  [dns]' END,
        CASE WHEN u = 1 THEN '  pre ' || seq WHEN u IN (2, 3) THEN '  post ' || seq END,
        CASE WHEN u IN (2, 3) THEN '  [mdns]' END, CASE WHEN u IN (2, 3) THEN '  m ' || seq END,
        CASE WHEN u <= 3 THEN '' END,
        'nmap CPE Guesses (all services):', '  ' || cpe22, CASE WHEN s <> 'P' THEN '   cpe:/a:x:web ' END
       ], lambda x: x IS NOT NULL), chr(10)) AS payload FROM hosts""",
    "hosts",
)
ORACLES["payload_texts"] = _with("payloads") + "SELECT seq, payload FROM payloads"
ORACLES["ingest_tables"] = _with("payloads", "devices") + f"""
SELECT n AS scan_session_id, n AS scan_run_id, n AS input_id, coalesce(k.id, a.id) AS device_id,
  a.vendor AS new_manufacturer, h.ip AS target_ip, h.hostname, h.day_text AS session_start,
  CASE WHEN h.u <> 5 THEN 'day ' || h.d END AS ended_at, 'scan-' || h.seq AS scan_name, 'scan ' || h.seq AS command,
  CAST(CASE WHEN h.u <> 5 THEN CASE WHEN h.u = 4 THEN 0 ELSE 1 END END AS INTEGER) AS exit_code,
  '7.' || h.m AS tool_version, 'plain-text' AS variant_name, y.payload AS input_payload_json
FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM hosts) h JOIN payloads y ON y.seq = h.seq
LEFT JOIN (SELECT * FROM devices WHERE device_type = 'router') k ON k.device_code = h.device_code
LEFT JOIN (SELECT device_code, vendor, (SELECT max(id) FROM devices WHERE device_type = 'router')
             + row_number() OVER (ORDER BY first) AS id
           FROM (SELECT device_code, min(seq) AS first, arg_min(v, seq) AS vendor FROM hosts
                 WHERE device_code NOT IN (SELECT device_code FROM devices WHERE device_type = 'router') GROUP BY device_code)
          ) a ON a.device_code = h.device_code"""

ORACLES["scan_files"] = """
SELECT '10.1.' || s_suppkey // 256 || '.' || s_suppkey % 256 AS target_ip,
  '20240101_' || lpad(CAST(s_nationkey AS VARCHAR), 6, '0') AS scan_ts,
  '<nmaprun args="' || s_name || '">' || chr(10) || '<host/></nmaprun>' AS xml FROM supplier"""

# --- scanner baseline --------------------------------------------------------

_table(
    "doc_cpes",
    f"""SELECT seq, c, k, cpe || repeat(':*', 13 - len(string_split(cpe, ':'))) AS cpe FROM (
        SELECT seq, c, 1 AS k, 'cpe:2.3:a:' || v || ':' || p || ':' || u AS cpe FROM docs WHERE m <> 12
        UNION ALL SELECT seq, c, 2, 'cpe:2.3:a:x:web' FROM docs WHERE m <> 12 AND s <> 'P'
        UNION ALL SELECT seq, c, 3, 'cpe:2.3:o:' || v || ':os' || m FROM docs WHERE m <> 12
        UNION ALL SELECT seq, c, 4, 'cpe:2.3:o:' || v || ':alt:' || u FROM docs WHERE m <> 12 AND s = 'O'
        UNION ALL SELECT seq, c, 5, 'cpe:2.3:h:acme:second' || m FROM docs WHERE m <> 12 AND s = 'F')""",
    "docs",
)
ORACLES["scanner_cpes"] = _with("doc_cpes") + """
SELECT d.seq, coalesce(string_agg(x.cpe, '|' ORDER BY x.k), '') AS cpes FROM docs d LEFT JOIN doc_cpes x ON x.seq = d.seq GROUP BY d.seq"""
_table(
    "merged",
    """SELECT d.c, d.tool_version, coalesce(x.cpes, []) AS cpes FROM
       (SELECT c, CASE WHEN count(*) FILTER (WHERE seq % 2 = 0) > 0 THEN '7.94' END AS tool_version FROM docs GROUP BY c) d
       LEFT JOIN (SELECT c, list(cpe ORDER BY first) AS cpes FROM
                  (SELECT c, cpe, min(seq * 10 + k) AS first FROM doc_cpes GROUP BY c, cpe) GROUP BY c) x ON x.c = d.c""",
    "docs", "doc_cpes",
)
ORACLES["session_cpes"] = _with("merged") + """
SELECT c AS scan_session_id, array_to_string(cpes, '|') AS cpes, tool_version FROM merged"""
ORACLES["missing_baselines"] = _with("aggregated_inputs", "model_runs") + """
SELECT id, scan_session_id FROM aggregated_inputs
WHERE NOT EXISTS (SELECT 1 FROM model_runs r WHERE r.aggregated_input_id = aggregated_inputs.id AND r.model_name = 'nmap')"""
ORACLES["build_baselines"] = _with("merged", "aggregated_inputs", "model_runs") + f"""
SELECT i.id AS aggregated_input_id, 'nmap' AS model_name, coalesce(x.tool_version, '') AS model_version,
  CASE WHEN len(x.cpes) = 0 THEN '{{"cpes":[]}}' ELSE '{{"cpes":' || {_JSON_LIST.format('x.cpes')} || '}}' END AS parsed_output_json,
  'complete' AS status, '{NOW}' AS started_at
FROM aggregated_inputs i JOIN merged x ON x.c = i.scan_session_id
WHERE i.id NOT IN (SELECT aggregated_input_id FROM model_runs WHERE model_name = 'nmap')"""
ORACLES["rebuild_baselines"] = _with("aggregated_inputs", "model_runs", "old_scores", "docs") + """,
gone AS (SELECT min(r.id) AS id FROM model_runs r JOIN customer ON c_custkey = r.aggregated_input_id
         WHERE c_mktsegment = 'BUILDING' AND r.model_name = 'nmap' GROUP BY r.aggregated_input_id)
SELECT 'run kept' AS kind, id AS key FROM model_runs WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'score kept', id FROM old_scores WHERE model_run_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'run for input', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT c FROM docs)"""

ORACLES["store_baselines"] = _with("aggregated_inputs", "model_runs", "old_scores", "merged") + f""",
gone AS (SELECT min(r.id) AS id FROM model_runs r JOIN customer ON c_custkey = r.aggregated_input_id
         WHERE c_mktsegment = 'BUILDING' AND r.model_name = 'nmap' GROUP BY r.aggregated_input_id)
SELECT 'run' AS kind, id, aggregated_input_id, model_name, CAST(NULL AS VARCHAR) AS model_version, CAST(NULL AS VARCHAR) AS listed
FROM model_runs WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'run', (SELECT max(id) FROM model_runs) + row_number() OVER (ORDER BY i.id), i.id, 'nmap', coalesce(x.tool_version, ''),
  CASE WHEN len(x.cpes) = 0 THEN '{{"cpes":[]}}' ELSE '{{"cpes":' || {_JSON_LIST.format('x.cpes')} || '}}' END
FROM aggregated_inputs i JOIN merged x ON x.c = i.scan_session_id JOIN customer ON c_custkey = i.id WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'score', id, model_run_id, NULL, NULL, NULL FROM old_scores WHERE model_run_id NOT IN (SELECT id FROM gone)"""

# --- devices, labels, prompts ------------------------------------------------

ORACLES["device_claims"] = f"""WITH RECURSIVE known AS (
  SELECT c_custkey AS id, c_name AS device_code, 'mac-' || c_custkey AS mac, lower(c_mktsegment) AS manufacturer FROM customer WHERE c_acctbal >= 1000
), sighted AS (
  SELECT {_CODE.format(k='o_custkey')} AS device_code, CASE WHEN o_orderkey % 5 <> 0 THEN 'mac-' || (o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) END AS mac,
    lower(o_orderpriority) AS vendor, o_orderkey AS seq FROM orders
), open AS (
  SELECT device_code, mac, arg_min(vendor, seq) AS vendor, row_number() OVER (ORDER BY min(seq)) AS i FROM sighted
  WHERE device_code NOT IN (SELECT device_code FROM known) AND (mac IS NULL OR mac NOT IN (SELECT mac FROM known))
  GROUP BY device_code, mac
), made AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS codes, CAST([] AS VARCHAR[]) AS macs, false AS granted
  UNION ALL
  SELECT o.i, CASE WHEN ok THEN list_append(codes, device_code) ELSE codes END, CASE WHEN ok AND mac IS NOT NULL THEN list_append(macs, mac) ELSE macs END, ok
  FROM (SELECT open.*, codes, macs, NOT list_contains(codes, device_code) AND (mac IS NULL OR NOT list_contains(macs, mac)) AS ok
        FROM made JOIN open ON open.i = made.i + 1) o
)
SELECT * FROM known
UNION ALL SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY i), device_code, mac, vendor FROM open WHERE i IN (SELECT i FROM made WHERE granted)"""

ORACLES["upsert_devices"] = _with("devices") + f"""
SELECT id, device_code, mac, manufacturer FROM devices WHERE device_type = 'router'
UNION ALL SELECT (SELECT max(id) FROM devices WHERE device_type = 'router') + row_number() OVER (ORDER BY first), device_code, mac, vendor
FROM (SELECT {_CODE.format(k='o_custkey')} AS device_code, 'mac-' || o_custkey AS mac,
        arg_min(lower(o_orderpriority), o_orderkey) AS vendor, min(o_orderkey) AS first
      FROM orders JOIN devices ON id = o_custkey WHERE device_type <> 'router' GROUP BY o_custkey)"""
_table(
    "feed",
    """SELECT o_orderkey AS seq, o_custkey AS c, o_orderstatus AS s, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS known,
       CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '4-NOT SPECIFIED' THEN 'other-' || o_custkey ELSE 'mac-' || o_custkey END AS mac
       FROM orders""",
)
ORACLES["resolve_truth"] = _with("feed", "devices") + """
SELECT seq, feed.mac, id AS device_id, device_code FROM feed JOIN devices ON devices.mac = feed.mac"""
ORACLES["truth_rejects"] = _with("feed") + """
SELECT seq, mac, CASE WHEN mac = '' THEN 'missing mac' ELSE 'unknown mac' END AS reason FROM feed WHERE NOT known"""
ORACLES["upsert_truth"] = _with("feed", "ground_truth") + f""",
latest AS (SELECT c, arg_max(lower(s), seq) AS vendor, max(seq) AS last, min(seq) AS first,
             CASE WHEN arg_max(s, seq) = 'F' THEN 2 ELSE 15 END AS len FROM feed WHERE known GROUP BY c)
SELECT g.id, g.device_id, coalesce(l.vendor, g.true_vendor) AS true_vendor,
  coalesce('product-' || l.last, g.true_product) AS true_product,
  CAST(coalesce(l.len, a.len) AS INTEGER) AS list_length,
  CASE WHEN l.c IS NULL THEN g.rubric_version ELSE '2.0' END AS rubric_version,
  CASE WHEN l.c IS NULL THEN g.label_status ELSE 'draft' END AS label_status,
  g.created_at, CASE WHEN l.c IS NULL THEN g.updated_at ELSE '2024-02-02 00:00:00' END AS updated_at
FROM ground_truth g LEFT JOIN latest l ON l.c = g.device_id JOIN (SELECT truth_id, 2 + 30 + sum(length(t)) AS len FROM
   (SELECT truth_id, CASE WHEN pos = 5 THEN '"' || cpe || '"' ELSE '{{"cpe": "' || cpe || '", "tier": ' || coalesce('"' || tier || '"', 'null') || '}}' END AS t
    FROM accepted_list) GROUP BY truth_id) a ON a.truth_id = g.id
UNION ALL
SELECT (SELECT max(id) FROM ground_truth) + row_number() OVER (ORDER BY first), c, vendor, 'product-' || last, CAST(len AS INTEGER), '2.0', 'draft',
  '2024-02-02 00:00:00', '2024-02-02 00:00:00' FROM latest WHERE c NOT IN (SELECT device_id FROM ground_truth)"""
ORACLES["upsert_truth"] = ORACLES["upsert_truth"].replace("accepted_list", "accepted").replace(
    _with("feed", "ground_truth"), _with("feed", "ground_truth", "accepted")
)
_table("turns", "SELECT *, conv_id * 1000 + turn AS seq FROM conversations")
ORACLES["upsert_prompts"] = _with("turns") + f"""
SELECT seq AS id, CAST(conv_id AS VARCHAR) AS prompt_name, CAST(turn AS VARCHAR) AS prompt_version,
  CASE WHEN role = 'system' THEN text ELSE 'revised: ' || text END AS prompt_text,
  CASE WHEN role = 'system' THEN role ELSE 'revised' END AS notes, '{NOW}' AS created_at
FROM turns WHERE role <> 'assistant'
UNION ALL SELECT (SELECT max(seq) FROM turns WHERE role <> 'assistant') + row_number() OVER (ORDER BY seq), CAST(conv_id AS VARCHAR),
  CAST(turn AS VARCHAR), 'revised: ' || text, 'revised', '2024-02-02 00:00:00' FROM turns WHERE role = 'assistant'"""
ORACLES["list_prompts"] = _with("turns") + """
SELECT seq AS id, CAST(conv_id AS VARCHAR) AS prompt_name, CAST(turn AS VARCHAR) AS prompt_version, role AS notes
FROM turns WHERE role <> 'assistant'"""
ORACLES["truth_feed"] = """
SELECT CASE o_orderpriority WHEN '5-LOW' THEN ' ' || chr(9) WHEN '4-NOT SPECIFIED' THEN 'other-' || o_custkey
         ELSE ' mac-' || o_custkey || chr(10) END AS mac,
  lower(o_orderstatus) AS true_vendor, 'product-' || o_orderkey AS true_product,
  CASE WHEN o_orderstatus = 'F' THEN '[]' ELSE '[{"cpe":"product-' || o_orderkey || '"}]' END AS accepted_cpes FROM orders"""
ORACLES["prompt_feed"] = """
SELECT CAST(conv_id AS VARCHAR) AS name, CAST(turn AS VARCHAR) AS version, 'revised' AS notes, 'revised: ' || text AS text
FROM conversations WHERE role <> 'system'"""

# --- requests and inference --------------------------------------------------

_table(
    "asked",
    """SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'P' THEN -o_custkey - 1 ELSE o_custkey END AS aggregated_input_id,
       CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 9 ELSE CAST(left(o_orderpriority, 1) AS BIGINT) END AS BIGINT) AS prompt_id FROM orders""",
)
ORACLES["build_requests"] = _with("asked", "aggregated_inputs", "prompts") + """
SELECT request_id, aggregated_input_id, prompt_id, 'model-a' AS model_name, CAST(0 AS DOUBLE) AS temperature,
  CAST(2048 AS INTEGER) AS max_tokens, CAST(42 AS BIGINT) AS seed, prompt_text AS system_text, input_payload_json AS user_text
FROM asked JOIN aggregated_inputs i ON i.id = aggregated_input_id JOIN prompts p ON p.id = prompt_id"""
ORACLES["rejected_requests"] = _with("asked") + """
SELECT request_id, CASE WHEN aggregated_input_id < 0 THEN 'unknown input' ELSE 'unknown prompt' END AS reason
FROM asked WHERE aggregated_input_id < 0 OR prompt_id = 9"""
_table(
    "grid",
    """SELECT c_custkey AS aggregated_input_id, prompt_id, model_name, model_version, temperature, top_p, max_tokens, seed,
         lower(c_mktsegment) AS segment, lower(r_name) AS place
       FROM customer, (SELECT CAST(unnest([1, 2, 3, 4]) AS BIGINT) AS prompt_id) q,
         (VALUES ('model-a', '1', CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(2048 AS INTEGER), CAST(42 AS BIGINT)),
                 ('model-b', '2', CAST(0.7 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(512 AS INTEGER), NULL))
         t(model_name, model_version, temperature, top_p, max_tokens, seed)
       JOIN region ON r_regionkey = prompt_id""",
)
ORACLES["sweep_grid"] = _with("grid") + """
SELECT aggregated_input_id, prompt_id, model_name, model_version, temperature, top_p, max_tokens, seed FROM grid"""
_GOOD = "'cpe:2.3:h:' || segment || ':' || place || ':' || max_tokens || '" + WILD + "'"
ORACLES["infer_stub"] = _with("grid") + f"""
SELECT aggregated_input_id, prompt_id, model_name, seed,
  CASE segment WHEN 'machinery' THEN '' WHEN 'household' THEN '{{"cpes": null}}'
    ELSE 'Found by ' || model_name || chr(10) || '```json' || chr(10) || '{{"cpes": ["' || {_GOOD} || '", "bad"]}}' || chr(10) || '```' END AS raw_output_text,
  CASE segment WHEN 'machinery' THEN 'error' ELSE 'complete' END AS status,
  CASE segment WHEN 'machinery' THEN 'cannot answer machinery' END AS error_text FROM grid"""
ORACLES["run_records"] = _with("grid") + f"""
SELECT aggregated_input_id, prompt_id, model_name, temperature, max_tokens, seed,
  CASE WHEN segment NOT IN ('machinery', 'household') THEN '{{"cpes":["' || {_GOOD} || '"]}}' END AS parsed_output_json,
  CASE WHEN segment IN ('machinery', 'household') THEN 'error' ELSE 'complete' END AS status,
  CASE segment WHEN 'machinery' THEN 'cannot answer machinery' WHEN 'household' THEN '''NoneType'' object is not iterable' END AS error_text
FROM grid"""

# --- keys, constraints -------------------------------------------------------

ORACLES["generated_keys"] = """
SELECT 100 + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
  l_tax, l_returnflag, l_linestatus) AS id, l_orderkey, l_linenumber, l_extendedprice FROM lineitem"""
ORACLES["column_defaults"] = f"""
SELECT o_orderkey AS id, o_custkey AS aggregated_input_id, CASE WHEN o_orderstatus = 'F' THEN 'done' END AS started_at, 'pending' AS status
FROM orders"""
ORACLES["orphans"] = """
SELECT o_orderkey AS id, o_custkey AS aggregated_input_id FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""
ORACLES["duplicates"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
ORACLES["null_violations"] = _with("model_runs") + """
SELECT id, array_to_string(list_filter([CASE WHEN prompt_id IS NULL THEN 'prompt_id' END,
  CASE WHEN n_stored = 0 THEN 'parsed_output_json' END, CASE WHEN temperature IS NULL THEN 'temperature' END], lambda x: x IS NOT NULL), ',') AS missing
FROM model_runs WHERE prompt_id IS NULL OR n_stored = 0"""
ORACLES["checked_rows"] = _with("devices", "ground_truth", "aggregated_inputs", "prompts") + f""",
new_devices AS (
  SELECT c_custkey + 1000000 AS id,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN {_CODE.format(k='c_custkey')}
      WHEN c_custkey % 3 = 0 THEN 'new-' || c_custkey // 10 ELSE 'new-' || c_custkey * 100 END AS device_code,
    CASE WHEN c_custkey % 4 = 0 THEN 'mac-' || c_custkey WHEN c_custkey % 11 = 0 THEN NULL ELSE 'nm-' || c_custkey // 2 END AS mac FROM customer
), new_truth AS (
  SELECT CASE WHEN c_custkey % 13 <> 0 THEN c_custkey END AS id, c_custkey AS k,
    CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey // 2 + 1 END AS device_id FROM customer
), new_runs AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS input,
    CASE o_orderkey % 3 WHEN 0 THEN 99 WHEN 1 THEN 1 END AS prompt_id, CASE WHEN o_orderkey % 10 = 0 THEN 5 END AS experiment_id FROM orders
), told AS (
  SELECT 'devices' AS table_name, id, [CASE WHEN device_code IS NULL THEN 'not null device_code' END,
    CASE WHEN device_code IN (SELECT device_code FROM devices) OR id > min(id) OVER (PARTITION BY device_code) AND device_code IS NOT NULL THEN 'unique device_code' END,
    CASE WHEN mac IN (SELECT mac FROM devices) OR id > min(id) OVER (PARTITION BY mac) AND mac IS NOT NULL THEN 'unique mac' END] AS broken FROM new_devices
  UNION ALL
  SELECT 'ground_truth', id, [CASE WHEN id IS NULL THEN 'not null id' END, CASE WHEN device_id IS NULL THEN 'not null device_id' END,
    CASE WHEN device_id NOT IN (SELECT id FROM devices) THEN 'foreign key device_id' END,
    CASE WHEN device_id IN (SELECT device_id FROM ground_truth)
      OR device_id IS NOT NULL AND k <> first(k) OVER (PARTITION BY device_id ORDER BY id NULLS FIRST) THEN 'logical key device_id' END] FROM new_truth
  UNION ALL
  SELECT 'model_runs', id, [CASE WHEN input IS NULL THEN 'not null aggregated_input_id' END,
    CASE WHEN input NOT IN (SELECT id FROM aggregated_inputs) THEN 'foreign key aggregated_input_id' END,
    CASE WHEN experiment_id IS NOT NULL THEN 'foreign key experiment_id' END,
    CASE WHEN prompt_id NOT IN (SELECT id FROM prompts) THEN 'foreign key prompt_id' END] FROM new_runs
)
SELECT table_name, id, coalesce(array_to_string(list_sort(list_filter(broken, lambda x: x IS NOT NULL)), '; '), '') AS broken FROM told"""
ORACLES["violations"] = _with("old_scores", "ground_truth") + """
SELECT * FROM (VALUES
  ('foreign key', 'scan_sessions', 'device_id', CAST(0 AS BIGINT)), ('foreign key', 'scan_runs', 'scan_session_id', 0),
  ('foreign key', 'aggregated_inputs', 'scan_session_id', 0), ('foreign key', 'model_runs', 'aggregated_input_id', 0),
  ('foreign key', 'model_runs', 'prompt_id', 0), ('foreign key', 'ground_truth', 'device_id', 0),
  ('unique', 'devices', 'device_code', 0), ('unique', 'devices', 'mac', 0),
  ('logical key', 'prompts', 'prompt_name,prompt_version', 0), ('logical key', 'ground_truth', 'device_id', 0),
  ('not null', 'devices', 'id,device_code', 0), ('not null', 'scan_sessions', 'id,device_id', 0),
  ('not null', 'scan_runs', 'id,scan_session_id', 0), ('not null', 'aggregated_inputs', 'id,scan_session_id', 0),
  ('not null', 'prompts', 'id,prompt_text', 0), ('not null', 'model_runs', 'id,aggregated_input_id', 0),
  ('not null', 'ground_truth', 'id,device_id', 0), ('not null', 'scores', 'id,model_run_id,ground_truth_id', 0)
) t("rule", table_name, "columns", n_rows)
UNION ALL SELECT 'foreign key', 'scores', 'model_run_id', count(*) FROM old_scores WHERE model_run_id NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'foreign key', 'scores', 'ground_truth_id', count(*) FROM old_scores WHERE 0 NOT IN (SELECT id FROM ground_truth)"""
