"""Scan documents to typed columns: one schema, array expressions, no Python per row."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from devident.fixed_values import NETBIOS_NAME, NETBIOS_SCRIPT
from devident.functions.documents import to_json_text
from devident.functions.text import filled, let, matched, strip

# Elements that may repeat are arrays; where only the first counts, `_first` picks it.
_SCRIPT = "array<struct<_id string, _output string>>"
_OS = "array<struct<osmatch array<struct<_name string, _accuracy string, osclass array<struct<_cpe string, cpe array<string>>>>>>>"
_HOST = {
    "status": "array<struct<_state string>>",
    "address": "array<struct<_addr string, _addrtype string, _vendor string>>",
    "hostnames": "array<struct<hostname array<struct<_name string>>>>",
    "hostscript": f"array<struct<script {_SCRIPT}>>",
    "os": _OS,
    "ports": f"""array<struct<port array<struct<
      _protocol string, _portid string,
      state array<struct<_state string>>,
      service array<struct<_name string, _product string, _version string, cpe array<string>>>,
      script {_SCRIPT}>>>>""",
}
_ROOT = {
    "_args": "string", "_version": "string", "_startstr": "string",
    "prescript": f"array<struct<script {_SCRIPT}>>", "postscript": f"array<struct<script {_SCRIPT}>>",
    "runstats": "array<struct<finished array<struct<_timestr string, _exit string>>>>",
}
# as much of the ports as their scripts need
_PORT_SCRIPTS = f"array<struct<port array<struct<_portid string, state array<struct<_state string>>, script {_SCRIPT}>>>>"
# what each detail of a primary host is read from: elements of the host, and of the document
DETAILS = {
    "meta": ((), ("_args", "_version", "_startstr", "runstats")),
    "hostname": (("hostnames", "hostscript"), ()),
    "os": (("os",), ()),
    "services": (("ports",), ()),
    "port_scripts": (("ports",), ()),
    "scripts": (("hostscript",), ("prescript", "postscript")),
}


def scan_schema(details: Collection[str] = DETAILS) -> str:
    """The schema of what some details read. The parser passes over other elements, but still finds a document malformed by them."""
    of_host, of_root = ({name for d in details for name in DETAILS[d][side]} for side in (0, 1))
    kinds = _HOST if "services" in details else _HOST | {"ports": _PORT_SCRIPTS}
    host = ", ".join(f"{name}: {kind}" for name, kind in kinds.items() if name in of_host | {"status", "address"})
    root = "".join(f"{name} {kind}, " for name, kind in _ROOT.items() if name in of_root)
    return f"{root}host array<struct<{host}>>, _corrupt string"


SCAN_SCHEMA = scan_schema()
# only what identifier extraction reads
CPE_SCHEMA = f"""
  host array<struct<
    status array<struct<_state string>>,
    os {_OS},
    ports array<struct<port array<struct<
      state array<struct<_state string>>,
      service array<struct<cpe array<string>>>>>>>>>,
  _corrupt string"""
_OPTIONS = {"ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_corrupt"}
# what may follow the root element: white space, processing instructions and comments, which are cut before
_AFTER_ROOT = r"(?s)</nmaprun\s*>(?!(?:\s++|<\?.*?\?>)*+\z)"
_NO_MARKUP = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _each(items: Column) -> Column:
    """The array, or an empty one when the element is absent."""
    return F.coalesce(items, F.array())


def parse_documents(df: DataFrame, xml: str = "xml", schema: str = SCAN_SCHEMA) -> DataFrame:
    """Add `doc` (the parsed document) and `malformed` (the text is not one well-formed document)."""
    parsed = df.withColumn("_doc", F.from_xml(F.col(xml), schema, _OPTIONS))
    # an end tag within a comment or a CDATA section ends nothing; few documents have either
    marked = F.contains(F.col(xml), F.lit("<!--")) | F.contains(F.col(xml), F.lit("<![CDATA["))
    plain = F.when(marked, F.regexp_replace(F.col(xml), _NO_MARKUP, "")).otherwise(F.col(xml))
    broken = F.col("_doc").isNull() | F.col("_doc._corrupt").isNotNull() | plain.rlike(_AFTER_ROOT)
    return parsed.withColumn("malformed", broken).withColumn(
        "doc", F.when(~F.col("malformed"), F.col("_doc"))
    ).drop("_doc")


def collect_scripts(scripts: Column) -> Column:
    """Named scripts with non-blank output, `array<struct<id, output>>`.

    A repeated id keeps its first place and its last output.
    """
    shown = F.filter(
        F.transform(_each(scripts), lambda s: F.struct(s["_id"].alias("id"), strip(s["_output"]).alias("output"))),
        lambda s: (F.length(s["id"]) > 0) & (F.length(s["output"]) > 0),
    )
    def distinct(listed: Column) -> Column:
        names = F.array_distinct(F.transform(listed, lambda s: s["id"]))
        last = lambda n: _last(F.filter(listed, lambda s: s["id"] == n))
        return F.when(F.size(names) == F.size(listed), listed).otherwise(F.transform(names, last))

    return let(shown, distinct)


def merge_scripts(pre: Column, post: Column) -> Column:
    """Both lists as one; a post script replaces a pre script of the same id in its place."""
    kept = F.transform(
        pre,
        lambda a: F.coalesce(_last(F.filter(post, lambda b: b["id"] == a["id"])), a),
    )
    added = F.filter(post, lambda b: ~F.exists(pre, lambda a: a["id"] == b["id"]))
    return F.concat(kept, added)


def live_hosts(hosts: Column) -> Column:
    """Hosts that are up; a host without a status counts as up, a status without a state does not."""
    def up(host: Column) -> Column:
        status = _first(host["status"])
        return status.isNull() | status["_state"].eqNullSafe(F.lit("up"))

    return F.filter(_each(hosts), up)


def _address(host: Column, kind: str) -> Column:
    return _last(F.filter(_each(host["address"]), lambda a: a["_addrtype"] == kind))


def host_addresses(host: Column) -> Column:
    """`struct<ip, mac, vendor>`; the last address of each kind counts."""
    return F.struct(
        _address(host, "ipv4")["_addr"].alias("ip"),
        _address(host, "mac")["_addr"].alias("mac"),
        _address(host, "mac")["_vendor"].alias("vendor"),
    )


def primary_host(hosts: Column) -> Column:
    """The first live host with an ipv4 address, NULL when there is none."""
    return _first(F.filter(live_hosts(hosts), lambda h: F.length(_address(h, "ipv4")["_addr"]) > 0))


def hostname(host: Column) -> Column:
    """The first host name; without one, the name the first NetBIOS host script reports."""
    given = _first(_first(host["hostnames"])["hostname"])["_name"]
    script = _first(
        F.filter(_each(_first(host["hostscript"])["script"]), lambda s: s["_id"] == NETBIOS_SCRIPT)
    )
    return F.when(filled(given).isNull() & script.isNotNull(), matched(script["_output"], NETBIOS_NAME, 1)).otherwise(given)


def _os_matches(host: Column) -> Column:
    return _each(_first(host["os"])["osmatch"])


def os_guesses(host: Column) -> Column:
    """`name (accuracy%)`, or the bare name without an accuracy; nameless matches are skipped."""
    return F.transform(
        F.filter(_os_matches(host), lambda m: F.length(m["_name"]) > 0),
        lambda m: F.when(
            F.length(m["_accuracy"]) > 0, F.concat(m["_name"], F.lit(" ("), m["_accuracy"], F.lit("%)"))
        ).otherwise(m["_name"]),
    )


def _raw_os_cpes(host: Column) -> Column:
    """Identifiers of all OS classes, attribute before children, stripped."""
    classes = F.flatten(F.transform(_os_matches(host), lambda m: _each(m["osclass"])))
    texts = F.flatten(
        F.transform(
            classes,
            lambda c: F.concat(
                F.filter(F.array(c["_cpe"]), lambda t: F.length(t) > 0),
                F.filter(_each(c["cpe"]), lambda t: F.length(t) > 0),
            ),
        )
    )
    return F.transform(texts, strip)


def os_cpes(host: Column) -> Column:
    """Distinct OS identifiers in document order."""
    return F.array_distinct(F.filter(_raw_os_cpes(host), lambda t: F.length(t) > 0))


def _open_ports(host: Column) -> Column:
    return F.filter(_each(_first(host["ports"])["port"]), lambda p: _first(p["state"])["_state"] == "open")


def _service_cpes(port: Column) -> Column:
    return F.filter(_each(_first(port["service"])["cpe"]), lambda t: F.length(t) > 0)


def services(host: Column) -> Column:
    """Open ports with service, product, version, identifiers as written and scripts."""
    def service(port: Column) -> Column:
        found = _first(port["service"])
        return F.struct(
            strip(port["_portid"]).try_cast("int").alias("port"),
            port["_protocol"].alias("protocol"),
            found["_name"].alias("service"),
            found["_product"].alias("product"),
            found["_version"].alias("version"),
            _service_cpes(port).alias("cpes"),
            collect_scripts(port["script"]).alias("scripts"),
        )

    return F.transform(_open_ports(host), service)


def port_scripts(host: Column) -> Column:
    """Open ports with number and scripts only."""
    return F.transform(
        _open_ports(host),
        lambda p: F.struct(strip(p["_portid"]).try_cast("int").alias("port"), collect_scripts(p["script"]).alias("scripts")),
    )


def raw_cpes(hosts: Column) -> Column:
    """Identifiers of all live hosts, per host services before OS, stripped."""
    return F.flatten(
        F.transform(
            live_hosts(hosts),
            lambda h: F.concat(
                F.flatten(F.transform(_open_ports(h), lambda p: F.transform(_service_cpes(p), strip))),
                _raw_os_cpes(h),
            ),
        )
    )


def scan_meta(documents: DataFrame) -> DataFrame:
    """Add `command, tool_version, start_time, end_time, exit_code` of parsed documents.

    The exit code is 1 for a successful scan, 0 for any other finish, NULL without a finish.
    """
    finishes = F.flatten(F.transform(_each(F.col("doc.runstats")), lambda r: _each(r["finished"])))
    with_finish = documents.withColumn("_finish", _first(finishes))
    return with_finish.withColumns(
        {
            "command": F.col("doc._args"),
            "tool_version": F.col("doc._version"),
            "start_time": F.col("doc._startstr"),
            "end_time": F.col("_finish._timestr"),
            "exit_code": F.when(
                F.col("_finish").isNotNull(), F.col("_finish._exit").eqNullSafe(F.lit("success")).cast("int")
            ),
        }
    ).drop("_finish")


def primary_hosts(scans: DataFrame, xml: str = "xml", details: Collection[str] = DETAILS) -> DataFrame:
    """One row per usable document: its columns, the primary host's addresses, and the details asked for.

    Details are the scan's `meta` data, `hostname`, `os` (guesses and identifiers), `services`, or `port_scripts` for
    services with port and scripts only, and `scripts` (of the host, pre and post); only what these need is read of a document, since building its values costs far more than passing over it. Documents
    that are malformed or have no live host with an ipv4 address give no row, whatever is asked for; see `rejected_documents`.
    """
    documents = parse_documents(scans, xml, scan_schema(details))
    if "meta" in details:
        documents = scan_meta(documents)
    # the host passes a generator: a filter on it is then not pushed below the parse, repeating it
    hosts = documents.withColumn("_host", F.explode_outer(F.array(primary_host(F.col("doc.host"))))).filter(
        F.col("_host").isNotNull()
    )
    host = F.col("_host")
    made = {"_address": host_addresses(host)}
    if "hostname" in details:
        made["hostname"] = hostname(host)
    if "os" in details:
        made |= {"os_guesses": os_guesses(host), "os_cpes": os_cpes(host)}
    if "services" in details or "port_scripts" in details:
        made["services"] = services(host) if "services" in details else port_scripts(host)
    if "scripts" in details:
        made |= {
            "host_scripts": collect_scripts(_first(host["hostscript"])["script"]),
            "pre_scripts": collect_scripts(_first(F.col("doc.prescript"))["script"]),
            "post_scripts": collect_scripts(_first(F.col("doc.postscript"))["script"]),
        }
    return hosts.withColumns(made).withColumns(
        {"ip": F.col("_address.ip"), "mac": F.col("_address.mac"), "vendor": F.col("_address.vendor")}
    ).drop("doc", "malformed", "_host", "_address")


def rejected_documents(scans: DataFrame, xml: str = "xml") -> DataFrame:
    """Documents ingest refuses, with the `reason`: malformed, or no live host."""
    documents = parse_documents(scans, xml, scan_schema(()))
    reason = F.when(F.col("malformed"), "malformed document").when(
        primary_host(F.col("doc.host")).isNull(), "no live host"
    )
    # as above: through a generator
    return (
        documents.withColumn("reason", F.explode_outer(F.array(reason)))
        .filter(F.col("reason").isNotNull())
        .drop("doc", "malformed")
    )


def open_services(hosts: DataFrame) -> DataFrame:
    """One row per open port of the primary hosts; `service_pos` counts from 0."""
    kept = [c for c in hosts.columns if c not in _NESTED]
    rows = hosts.select(*kept, F.posexplode_outer("services").alias("service_pos", "_service"))
    return rows.filter(F.col("service_pos").isNotNull()).select(*kept, "service_pos", "_service.*")


def host_scripts(hosts: DataFrame) -> DataFrame:
    """One row per script: `scope` (host, pre, post or port), `port` for port scripts, `id`, `output`."""
    kept = [c for c in hosts.columns if c not in _NESTED]
    def tagged(scripts: Column, scope: str, port: Column) -> Column:
        return F.transform(
            scripts,
            lambda s: F.struct(F.lit(scope).alias("scope"), port.alias("port"), s["id"].alias("id"), s["output"].alias("output")),
        )

    none = F.lit(None).cast("int")
    everything = F.concat(
        tagged(F.col("pre_scripts"), "pre", none),
        tagged(F.col("post_scripts"), "post", none),
        tagged(F.col("host_scripts"), "host", none),
        F.flatten(F.transform("services", lambda v: tagged(v["scripts"], "port", v["port"]))),
    )
    rows = hosts.select(*kept, F.explode_outer(everything).alias("_script"))
    return rows.filter(F.col("_script").isNotNull()).select(*kept, "_script.*")


_NESTED = {"services", "host_scripts", "pre_scripts", "post_scripts", "os_guesses", "os_cpes"}


def _script_map(scripts: Column) -> Column:
    return F.map_from_arrays(F.transform(scripts, lambda s: s["id"]), F.transform(scripts, lambda s: s["output"]))


def host_json() -> Column:
    """The nested host record of `primary_hosts` as JSON text."""
    service = lambda s: F.struct(
        *[s[name].alias(name) for name in ("port", "protocol", "service", "product", "version", "cpes")],
        _script_map(s["scripts"]).alias("scripts"),
    )
    return to_json_text(
        F.struct(
            "ip", "mac", "vendor", "hostname", "os_guesses", "os_cpes",
            F.transform("services", service).alias("services"),
            *[_script_map(F.col(name)).alias(name) for name in ("host_scripts", "pre_scripts", "post_scripts")],
        )
    )
