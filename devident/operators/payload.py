"""Text payload of a host, as the models read it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from devident import fixed_values as fixed
from devident.functions.text import filled
from devident.operators.extract import merge_scripts


def _lines(items: Column, line) -> Column:
    return F.transform(items, line)


def _or_line(lines: Column, fallback: str) -> Column:
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(fallback)))


def _cut(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def _script_section(title: str, scripts: Column) -> Column:
    """Title, two lines per script and a blank line; nothing at all without scripts."""
    body = F.flatten(
        F.transform(
            scripts,
            lambda s: F.array(
                F.concat(F.lit("  ["), s["id"], F.lit("]")),
                F.concat(F.lit("  "), _cut(s["output"], fixed.HOST_SCRIPT_CUT)),
            ),
        )
    )
    section = F.concat(F.array(F.lit(title)), body, F.array(F.lit("")))
    return F.when(F.size(scripts) > 0, section).otherwise(F.array().cast("array<string>"))


def _service_lines(service: Column) -> Column:
    port = F.concat(service["port"].cast("string"), F.lit("/"), F.coalesce(service["protocol"], F.lit("None")))
    product = F.concat_ws(" ", filled(service["product"]), filled(service["version"]))
    head = F.format_string(fixed.PAYLOAD_PORT_LINE, port, F.coalesce(service["service"], F.lit("")), product)
    return F.concat(
        F.array(head),
        F.transform(service["cpes"], lambda c: F.concat(F.lit(fixed.PAYLOAD_PORT_CPE), c)),
        F.transform(
            service["scripts"],
            lambda s: F.concat(F.lit("    ["), s["id"], F.lit("] "), _cut(s["output"], fixed.PORT_SCRIPT_CUT)),
        ),
    )


def payload_text(device_code: str = "device_code", scan_name: str = "scan_name") -> Column:
    """Plain text for one row of `primary_hosts` that also has a device code and a scan name."""
    def named(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    blank = F.array(F.lit(""))
    header = F.array(
        named(fixed.PAYLOAD_DEVICE, F.col(device_code)),
        named(fixed.PAYLOAD_SCAN, F.col(scan_name)),
        named(fixed.PAYLOAD_IP, F.col("ip")),
        named(fixed.PAYLOAD_HOSTNAME, F.coalesce(filled(F.col("hostname")), F.lit(fixed.PAYLOAD_UNKNOWN))),
        named(fixed.PAYLOAD_VENDOR, F.coalesce(filled(F.col("vendor")), F.lit(fixed.PAYLOAD_UNKNOWN))),
        F.lit(""),
        F.lit(fixed.PAYLOAD_OS),
    )
    guesses = _lines(F.col("os_guesses"), lambda g: F.concat(F.lit("  "), g))
    ports = F.flatten(F.transform("services", _service_lines))
    cpes = F.transform(
        F.flatten(F.transform("services", lambda s: s["cpes"])), lambda c: F.concat(F.lit("  "), c)
    )
    return F.array_join(
        F.concat(
            header,
            _or_line(guesses, fixed.PAYLOAD_NO_OS),
            blank,
            F.array(F.lit(fixed.PAYLOAD_PORTS)),
            _or_line(ports, fixed.PAYLOAD_NONE),
            blank,
            _script_section(fixed.PAYLOAD_HOST_SCRIPTS, F.col("host_scripts")),
            _script_section(
                fixed.PAYLOAD_DISCOVERY, merge_scripts(F.col("pre_scripts"), F.col("post_scripts"))
            ),
            F.array(F.lit(fixed.PAYLOAD_CPES)),
            _or_line(cpes, fixed.PAYLOAD_NONE),
        ),
        "\n",
    )
