"""Report sink: one directory per report table."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame

from devident.fixed_values import REPORT_STAMP_FORMAT


def report_dir(base: str, at: datetime | None = None) -> str:
    """Timestamped directory name for a report."""
    return f"{base.rstrip('/')}/report_{(at or datetime.now()).strftime(REPORT_STAMP_FORMAT)}"


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every table below `path` as Parquet or CSV with a header; returns the directories."""
    written = {}
    for name, table in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        writer = table.write.mode("errorifexists")
        if fmt == "csv":
            writer = writer.option("header", "true").option("escape", '"')
        writer.format(fmt).save(target)
        written[name] = target
    return written
