"""Versions of a store: one publish per change, deletes that touch the buckets of their keys only."""

import os

import pytest
from pyspark.sql import functions as F

from devident.operators.keys import with_defaults
from devident.plans import pipeline
from devident.store import Store
from tests.test_pipeline import document

SCANS = "device_code string, scan_name string, xml string, seq long"


def files(store, name):
    return {
        os.path.relpath(os.path.join(d, f), store.root): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(f"{store.root}/{name}") for f in names if f.endswith(".parquet")
    }


def named(store, name):
    """The files that the newest version reads."""
    return {os.path.relpath(f.removeprefix("file:"), store.root) for f in store.table(name).inputFiles()}


def scores(rows, numbers, note="old"):
    made = rows("id long, model_run_id long", [(i, r) for i, r in numbers]).withColumns({"ground_truth_id": F.lit(1), "score_notes": F.lit(note)})
    return with_defaults(made, "scores", "t")


def test_delete_writes_touched_buckets_only(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path), buckets=16)
    store.append("scores", scores(rows, [(i, i // 3) for i in range(300)]))
    store.append("scores", scores(rows, [(300 + i, i) for i in range(100)], "more"))
    before, read_before = files(store, "scores"), named(store, "scores")
    assert read_before == set(before) and store.table("scores").count() == 400
    old = store.table("scores")
    gone = rows("model_run_id long", [(7,), (7,), (60,), (10**9,)])
    with store.change() as change:
        change.delete("scores", gone)
        change.append("scores", scores(rows, [(1000, 7)], "new"))
    now = store.table("scores")
    assert now.filter("model_run_id IN (7, 60)").select("id", "score_notes").collect() == [(1000, "new")]
    assert now.count() == 400 - 8 + 1 and now.filter("model_run_id = 8").count() == 4
    # old files are as they were, most of them are still read, and at most three buckets were written anew
    after = files(store, "scores")
    assert all(after[f] == t for f, t in before.items())
    kept = named(store, "scores") & set(before)
    assert {f.split("bucket=")[1].split("/")[0] for f in set(before) - kept} == {f.split("bucket=")[1].split("/")[0] for f in named(store, "scores") - kept}
    assert len({f.split("bucket=")[1].split("/")[0] for f in set(before) - kept}) <= 3 and len(kept) > len(before) / 2
    assert old.count() == 400  # frames of the version before stay readable
    with store.change() as change:
        change.delete("scores", rows("model_run_id long, id long", [(8, 24), (8, 10**6)]))
        change.delete("scores", rows("model_run_id long", []))
    assert sorted(r.id for r in store.table("scores").filter("model_run_id = 8").collect()) == [25, 26, 308]


def test_a_hot_key_is_spread_and_buckets_are_kept(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    store.append("scores", scores(rows, [(i, 5) for i in range(500)]))
    assert len(files(store, "scores")) > 1
    again = Store(spark, str(tmp_path), buckets=64)  # a table keeps its number of buckets until it is replaced
    again.append("scores", scores(rows, [(1000, 5)]))
    with again.change() as change:
        change.delete("scores", rows("model_run_id long", [(5,)]))
    assert again.table("scores").count() == 0 and again.table("scores").columns == store.table("scores").columns
    again.replace("scores", scores(rows, [(1, 1)]))
    assert again.version()["tables"]["scores"][0]["of"] == 64


def test_a_failed_change_shows_nothing(spark, rows, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    batch = lambda *r: spark.createDataFrame(list(r), SCANS)
    pipeline.ingest(store, batch(("a", "s1", document("m1"), 1)), "t")
    before, number = {n: store.table(n).count() for n in ("devices", "scan_sessions", "scan_runs", "aggregated_inputs")}, store.version()["version"]
    assert set(before.values()) == {1}
    from devident import store as module

    written = module.Change._write
    calls = []

    def failing(self, name, rows, buckets):
        calls.append(name)
        if len(calls) == 3:
            raise OSError("disk full")
        return written(self, name, rows, buckets)

    monkeypatch.setattr(module.Change, "_write", failing)
    with pytest.raises(OSError):
        pipeline.ingest(store, batch(("b", "s2", document("m2"), 1)), "t")
    monkeypatch.undo()
    assert len(calls) == 3 and store.version()["version"] == number
    assert {n: store.table(n).count() for n in before} == before
    pipeline.ingest(store, batch(("b", "s2", document("m2"), 1)), "t")
    assert {n: store.table(n).count() for n in before} == {n: 2 for n in before}
    assert sorted(r.id for r in store.table("scan_runs").collect()) == [1, 2]


def test_two_writers(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        with store.change() as change:
            change.append("scores", scores(rows, [(1, 1)]))
            Store(spark, str(tmp_path)).append("scores", scores(rows, [(2, 2)]))
    assert [r.id for r in store.table("scores").collect()] == [2]


def test_drafts_and_empty_writes(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("scores", scores(rows, []))
    store.append("prompts", with_defaults(rows("id long, prompt_text string", [(1, "x")]), "prompts", "t"))
    os.makedirs(f"{tmp_path}/prompts/left-behind")
    (tmp_path / "_versions" / ".draft-1").write_text("{")
    assert store.table("scores").count() == 0 and store.table("prompts").count() == 1 and store.version()["version"] == 2


def test_checked_appends(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path))
    devices = lambda *r: with_defaults(rows("id long, device_code string, mac string", list(r)), "devices", "t")
    assert pipeline.append_checked(store, "devices", devices((1, "a", "m1"), (2, "b", None), (3, "c", None))).count() == 0
    rejects = pipeline.append_checked(store, "devices", devices((4, "a", "m4"), (5, None, "m1"), (None, "e", "m6"), (6, "f", "m7"), (7, "f", "m7"), (8, "g", None)))
    assert sorted((r.id or 0, sorted(r.broken)) for r in rejects.collect()) == [
        (0, ["not null id"]), (4, ["unique device_code"]), (5, ["not null device_code", "unique mac"]), (7, ["unique device_code", "unique mac"])]
    assert sorted(r.id for r in store.table("devices").collect()) == [1, 2, 3, 6, 8]
    truth = with_defaults(rows("id long, device_id long", [(1, 1), (2, 99), (3, 1), (4, None), (5, 8)]), "ground_truth", "t")
    rejects = pipeline.append_checked(store, "ground_truth", truth)
    assert sorted((r.id, r.broken) for r in rejects.collect()) == [(2, ["foreign key device_id"]), (3, ["logical key device_id"]), (4, ["not null device_id"])]
    assert pipeline.append_checked(store, "ground_truth", truth.filter("false")).count() == 0 and store.table("ground_truth").count() == 2
    runs = with_defaults(rows("id long, aggregated_input_id long, experiment_id long", [(1, 5, 7)]), "model_runs", "t")
    assert pipeline.append_checked(store, "model_runs", runs).first().broken == ["foreign key aggregated_input_id", "foreign key experiment_id"]
