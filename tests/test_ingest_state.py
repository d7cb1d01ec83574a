"""What an ingest knows of before: macs of other devices, files read, lines that are broken."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from devident.operators.registry import claims, new_devices, refused, upsert_devices
from devident.plans import pipeline
from devident.sources.feeds import read_prompts, read_truth
from devident.store import Store
from tests.test_pipeline import document

SEEN = "device_code string, mac string, vendor string, seq long"
DEVICE = "id long, device_code string, mac string"


def one_after_the_other(devices, seen):
    """Made devices and refused sightings, as a loop over the sightings decides."""
    codes, macs, made, out = {c for _, c, _ in devices}, {m for *_, m in devices if m is not None}, [], []
    for code, mac, vendor, seq in sorted(seen, key=lambda s: s[3]):
        if code is None or code in codes:
            continue
        if mac is not None and mac in macs:
            out.append(seq)
            continue
        codes.add(code)
        macs |= {mac} - {None}
        made.append((code, mac, vendor, seq))
    return made, out


@pytest.mark.parametrize("seed", range(8))
def test_macs_are_given_once(rows, seed):
    rng = random.Random(seed)
    devices = [(i, f"c{i}", rng.choice([None, f"m{i}"])) for i in range(4)]
    seen = [(rng.choice([None, *(f"c{i}" for i in range(14))]), rng.choice([None, *(f"m{i}" for i in range(10))]), rng.choice([None, "v", "w"]), i) for i in range(rng.choice([0, 30, 60]))]
    made, out = one_after_the_other(devices, seen)
    known, sightings = rows(DEVICE, devices), rows(SEEN, seen)
    granted = claims(known, sightings)
    assert sorted((r.device_code, r.mac, r.vendor, r.seq) for r in granted.collect()) == sorted(made)
    assert sorted(r.seq for r in refused(known, sightings, granted).collect()) == sorted(out)
    added = new_devices(known, sightings, "t", 10).orderBy("id").collect()
    assert [(r.id, r.device_code, r.mac, r.manufacturer) for r in added] == [(11 + i, *m[:3]) for i, m in enumerate(made)]


def test_a_long_chain_of_clashes(rows):
    seen = [(f"c{i + d}", f"m{i}", None, 2 * i + d) for i in range(12) for d in (0, 1)]
    made, _ = one_after_the_other([], seen)
    granted = claims(rows(DEVICE, []), rows(SEEN, seen))
    assert sorted((r.device_code, r.mac) for r in granted.collect()) == sorted(m[:2] for m in made)


def test_known_devices_stay(rows):
    known = rows(DEVICE, [(1, "a", "m1"), (2, "b", None)])
    full = rows("id long", [(1,), (2,)]).join(known, "id").select("id", "device_code", "mac", *[F.lit(None).cast("string").alias(c) for c in ("display_name", "manufacturer", "model", "firmware_version", "device_type", "notes", "created_at")])
    got = upsert_devices(full, rows(SEEN, [("a", "m9", "x", 1), ("c", "m1", "x", 2), ("b", "m1", "x", 3), ("c", "m2", "y", 4)]), "t")
    assert sorted((r.id, r.device_code, r.mac) for r in got.collect()) == [(1, "a", "m1"), (2, "b", None), (3, "c", "m2")]


def test_documents_of_a_clash_are_returned_and_keys_have_no_gap(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "device_code string, scan_name string, xml string, seq long, extra int"
    data = [("a", "s1", document("m1"), 1, 7), ("b", "s2", document("m1"), 2, 7), ("a", "s3", document("m5"), 3, 7), ("b", "s4", document("m2"), 4, 7),
            ("b", "s5", document("m1"), 5, 7), ("c", "s6", "<broken", 6, 7), ("d", "s7", document("m2"), 7, 7)]
    rejects = pipeline.ingest(store, spark.createDataFrame(data, schema), "t")
    assert sorted((r.scan_name, r.reason) for r in rejects.collect()) == [
        ("s2", "mac of another device"), ("s6", "malformed document"), ("s7", "mac of another device")]
    assert sorted((r.id, r.device_code, r.mac) for r in store.table("devices").collect()) == [(1, "a", "m1"), (2, "b", "m2")]
    assert sorted((r.id, r.scan_session_id, r.scan_name) for r in store.table("scan_runs").collect()) == [(1, 1, "s1"), (2, 2, "s3"), (3, 3, "s4"), (4, 4, "s5")]
    assert sorted((r.id, r.device_id) for r in store.table("scan_sessions").collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_files_are_read_once(spark, tmp_path, monkeypatch):
    root = tmp_path / "scans [1]"
    store = Store(spark, str(tmp_path / "store"))
    name = lambda scans: scans.withColumns({"device_code": F.concat(F.lit("d-"), "target_ip"), "seq": F.col("path")})

    def put(ip, mac, file="a, {b}+c.xml"):
        folder = root / f"{ip}_20240102_030405"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / file).write_text(document(mac))

    put("10.0.0.1", "m1")
    put("10.0.0.2", "m2")
    spelled = str(root).replace("[", "\\[").replace("]", "\\]")
    assert pipeline.ingest_folder(store, spelled, name, now="t").count() == 0
    assert sorted(r.device_code for r in store.table("devices").collect()) == ["d-10.0.0.1", "d-10.0.0.2"]
    runs, version = store.table("scan_runs").count(), store.version()["version"]

    from devident.plans import pipeline as module

    with monkeypatch.context() as m:  # a second ingest opens no file
        m.setattr(module, "read_files", lambda *a: pytest.fail("a known file was opened"))
        assert pipeline.ingest_folder(store, spelled, name, now="t") is None
    assert store.table("scan_runs").count() == runs == 2 and store.version()["version"] == version
    put("10.0.0.3", "m3")
    changed = root / "10.0.0.1_20240102_030405" / "a, {b}+c.xml"
    os.utime(changed, (1_600_000_000, 1_600_000_000))  # as a new file: what it holds may have changed
    opened = []
    real = module.read_files
    monkeypatch.setattr(module, "read_files", lambda spark, paths: (opened.extend(paths), real(spark, paths))[1])
    pipeline.ingest_folder(store, spelled, name, now="t")
    assert sorted(p.split("_2024")[0][-8:] for p in opened) == ["10.0.0.1", "10.0.0.3"]
    assert store.table("scan_runs").count() == 4 and store.table("files_read").count() == 4 and store.table("devices").count() == 3


def test_a_failed_ingest_notes_no_file(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "10.0.0.1_20240102_030405").mkdir()
    (tmp_path / "10.0.0.1_20240102_030405" / "a.xml").write_text(document("m1"))
    with pytest.raises(Exception):
        pipeline.ingest_folder(store, str(tmp_path), lambda scans: scans.withColumns({"device_code": F.raise_error(F.lit("no")), "seq": F.lit(1)}))
    assert store.table("files_read").count() == 0 and store.version()["version"] == 0


def test_broken_lines_are_rejects(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    pipeline.ingest(store, spark.createDataFrame([("a", "s1", document("m1"), 1)], "device_code string, scan_name string, xml string, seq long"), "t")
    lines = [json.dumps({"mac": "m1", "true_vendor": "v"}), "{broken", json.dumps({"mac": "m9"}), '"text"']
    (tmp_path / "truth.jsonl").write_text("\n".join(lines))
    entries = read_truth(spark, str(tmp_path / "truth.jsonl"), multi_line=False, broken=True).withColumn("seq", F.monotonically_increasing_id())
    rejects = sorted((r.reason, r.mac, r.broken_line) for r in pipeline.load_truth(store, entries, "t").collect())
    assert rejects[-1] == ("unknown mac", "m9", None) and ("broken line", None, "{broken") in rejects and len(rejects) == 3
    assert [r.true_vendor for r in store.table("ground_truth").collect()] == ["v"]
    (tmp_path / "prompts.jsonl").write_text('{"name": "p", "version": "1", "text": "x"}\nnothing')
    feed = read_prompts(spark, str(tmp_path / "prompts.jsonl"), multi_line=False, broken=True).withColumn("seq", F.lit(1))
    assert [(r.broken_line, r.reason) for r in pipeline.load_prompts(store, feed, "t").collect()] == [("nothing", "broken line")]
    assert store.table("prompts").count() == 1
    plain = read_truth(spark, str(tmp_path / "truth.jsonl"), multi_line=False)
    assert plain.count() == 2 and "broken_line" not in plain.columns
