"""Scan files written and read: all of them, by many tasks."""

import re

from devident.plans.catalog import QUERIES


def test_files_of_many_tasks(spark, rows, tmp_path):
    suppliers = [(i, f"Supplier#{i}", i % 5) for i in range(300, 340)] + [(300, "Supplier#again", 0), (None, "Supplier#none", 1)]
    rows("s_suppkey long, s_name string, s_nationkey int", suppliers).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    found = QUERIES["scan_files"](spark, str(tmp_path))
    tasks = {re.search(r"part-(\d+)", f).group(1) for f in found.inputFiles()}
    assert len(tasks) > 1
    got = found.collect()
    names = sorted(n for r in got for n in re.findall(r"Supplier#\w+", r.xml))
    assert names == sorted(n for _, n, _ in suppliers)
    assert {r.target_ip for r in got} >= {f"10.1.1.{i - 256}" for i in range(300, 340)}
