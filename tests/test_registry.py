import json

import pytest

from devident.operators import integrity, registry
from devident.operators.keys import with_defaults
from devident.schemas import TABLES
from devident.sources.feeds import read_prompts, read_truth


@pytest.fixture
def devices(rows):
    return with_defaults(rows("id long, device_code string, mac string, manufacturer string", [(1, "a", "m1", "old"), (4, "b", None, None)]), "devices", "t0")


def test_devices_are_reused_unchanged_or_created(devices, rows):
    seen = rows(
        "device_code string, mac string, vendor string, seq long",
        [("a", "m9", "new", 1), ("z", "m5", "V5", 3), ("c", "m2", "V2", 2), ("z", "m6", "V6", 9)],
    )
    table = registry.upsert_devices(devices, seen, "t1")
    assert sorted((r.id, r.device_code, r.mac, r.manufacturer, r.created_at) for r in table.collect() if r.mac) == [
        (1, "a", "m1", "old", "t0"), (5, "c", "m2", "V2", "t1"), (6, "z", "m5", "V5", "t1"),
    ]
    again = registry.upsert_devices(table, seen, "t2")
    assert again.count() == table.count()


ENTRY = "seq long, mac string, true_vendor string, true_product string, true_firmware_version string, accepted_cpes string, rubric_version string, label_status string, notes string"


def test_truth_upsert_and_rejects(devices, rows, spark):
    truth = spark.createDataFrame(
        [(7, 4, "keep", None, None, "[]", "1", "x", "n", "t0", "t0"), (8, 1, "old", "old", "old", "[1]", "1", "x", "n", "t0", "t0")],
        TABLES["ground_truth"],
    )
    entries = rows(
        ENTRY,
        [
            (1, " m1\t", "first", "p", "f", '["a"]', "2", "y", None),
            (2, "m1", "second", None, "f", '["b"]', "2", "y", None),
            (3, "  ", "v", "p", "f", "[]", "2", "y", None),
            (4, None, "v", "p", "f", "[]", "2", "y", None),
            (5, "M1", "case", "p", "f", "[]", "2", "y", None),
        ],
    )
    table = {r.id: r for r in registry.upsert_truth(truth, entries, devices, "t1").collect()}
    assert set(table) == {7, 8}
    assert (table[8].true_vendor, table[8].true_product, table[8].accepted_cpes_json, table[8].notes) == ("second", None, '["b"]', None)
    assert (table[8].created_at, table[8].updated_at) == ("t0", "t1")
    assert (table[7].true_vendor, table[7].updated_at) == ("keep", "t0")
    assert sorted((r.seq, r.reason) for r in registry.truth_rejects(entries, devices).collect()) == [
        (3, "missing mac"), (4, "missing mac"), (5, "unknown mac"),
    ]
    inserted = registry.upsert_truth(truth.filter("id = 7"), entries, devices, "t1").filter("device_id = 1").first()
    assert (inserted.id, inserted.true_vendor, inserted.created_at, inserted.updated_at) == (8, "second", "t1", "t1")


def test_prompt_upsert(rows, spark):
    prompts = spark.createDataFrame(
        [(1, "p", "1", "text", "t0", "n"), (2, "p", "1", "twin", "t0", "n"), (3, "q", "1", "text", "t0", "n")], TABLES["prompts"]
    )
    feed = rows(
        "name string, version string, notes string, text string, seq long",
        [("p", "1", "n1", "T1", 1), ("p", "2", None, "T2", 2), ("p", "2", "n3", "T3", 3)],
    )
    table = registry.upsert_prompts(prompts, feed, "t1")
    found = sorted((r.id, r.prompt_name, r.prompt_version, r.prompt_text, r.notes, r.created_at) for r in table.collect())
    assert found == [
        (1, "p", "1", "T1", "n1", "t0"), (2, "p", "1", "twin", "n", "t0"), (3, "q", "1", "text", "n", "t0"), (4, "p", "2", "T3", "n3", "t1"),
    ]
    assert registry.upsert_prompts(table, feed, "t2").count() == 4
    assert [r.id for r in registry.list_prompts(table).collect()] == [1, 2, 3, 4]


def test_feeds(spark, tmp_path):
    entry = {"mac": "m", "true_vendor": "v", "accepted_cpes": ["a", {"cpe": "b", "tier": None}, {"cpe": "c"}]}
    (tmp_path / "one.json").write_text(json.dumps(entry))
    (tmp_path / "many.json").write_text(json.dumps([entry, {"mac": "n"}], indent=2))
    one = read_truth(spark, str(tmp_path / "one.json")).collect()
    assert [(r.mac, json.loads(r.accepted_cpes), r.notes) for r in one] == [("m", entry["accepted_cpes"], None)]
    many = read_truth(spark, str(tmp_path / "many.json")).orderBy("mac").collect()
    assert [(r.mac, r.accepted_cpes) for r in many][1] == ("n", "[]")
    (tmp_path / "p.json").write_text(json.dumps([{"name": "a", "version": "1", "text": "line\nline"}]))
    assert [tuple(r) for r in read_prompts(spark, str(tmp_path / "p.json")).collect()] == [("a", "1", None, "line\nline")]


def test_integrity(devices, rows):
    sessions = rows("id long, device_id long", [(1, 1), (2, 99), (3, None)])
    assert [r.id for r in integrity.orphans(sessions, "device_id", devices).collect()] == [2]
    frame = rows("k string, v int", [("a", 1), ("a", 1), ("b", 1), (None, 1), (None, 1)])
    assert [tuple(r) for r in integrity.duplicates(frame, ["k", "v"]).collect()] == [("a", 1, 2)]
    assert integrity.duplicates(frame, ["k", "v"], nulls=True).count() == 2
    assert [r.missing for r in integrity.null_violations(frame, ["k", "v"]).collect()] == ["k", "k"]
    counts = {(r.rule, r.table_name, r.columns): r.n_rows for r in integrity.violations({"devices": devices, "scan_sessions": sessions}).collect()}
    assert counts[("foreign key", "scan_sessions", "device_id")] == 1
    assert counts[("not null", "scan_sessions", "id,device_id")] == 1
    assert counts[("unique", "devices", "mac")] == 0
