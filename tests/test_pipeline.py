"""From scan files to reports over a store."""

import json

import pytest
from pyspark.sql import functions as F

from devident.operators.inference import ModelSettings, sweep
from devident.plans import pipeline
from devident.sources.feeds import read_prompts, read_truth
from devident.sources.reports import report_dir
from devident.sources.scans import read_scans
from devident.store import Store

TAIL = ":*" * 7


def document(mac, *cpes, start=True):
    found = "".join(f"<cpe>cpe:/a:{c}</cpe>" for c in cpes)
    head = ' startstr="Mon"' if start else ""
    return (
        f'<?xml version="1.0"?><nmaprun args="x" version="7"{head}><host><status state="up"/><address addr="10.0.0.1" addrtype="ipv4"/>'
        f'<address addr="{mac}" addrtype="mac" vendor="Acme"/><ports><port protocol="tcp" portid="80"><state state="open"/>'
        f"<service name=\"http\">{found}</service></port></ports></host></nmaprun>"
    )


@pytest.fixture
def backend():
    class Model:
        def chat(self, messages, *, temperature, top_p, seed, max_tokens):
            return '```json\n{"cpes": ["cpe:2.3:a:v:one:2%s", "no"]}\n```' % (":*" * 7)

    return lambda name, version: Model()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("scans")
    for ip, mac, text in [
        ("10.0.0.1", "m1", document("m1", "v:one:1", "v:two")),
        ("10.0.0.2", "m2", document("m2", start=False)),
        ("10.0.0.3", "m3", "<nmaprun"),
    ]:
        folder = root / f"{ip}_20240102_030405"
        folder.mkdir()
        (folder / "01-full.scan.xml").write_text(text)
    scans = read_scans(spark, str(root))
    assert sorted((r.target_ip, r.scan_ts, r.scan_name) for r in scans.collect()) == [
        (f"10.0.0.{i}", "20240102_030405", "01-full.scan") for i in (1, 2, 3)
    ]
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    assert store.table("devices").count() == 0
    named = scans.withColumns({"device_code": F.concat(F.lit("dev-"), "target_ip"), "seq": F.col("path"), "operator": F.lit("me")})
    pipeline.ingest(store, named, "t1")
    return store


def test_ingest(store):
    devices = store.table("devices").orderBy("id").collect()
    assert [(r.id, r.device_code, r.mac, r.manufacturer) for r in devices] == [
        (1, "dev-10.0.0.1", "m1", "Acme"), (2, "dev-10.0.0.2", "m2", "Acme"),
    ]
    sessions = store.table("scan_sessions").orderBy("id").collect()
    # a scan without a start time keeps NULL: the default must not apply
    assert [(r.id, r.device_id, r.started_at, r.operator) for r in sessions] == [(1, 1, "Mon", "me"), (2, 2, None, "me")]
    runs = store.table("scan_runs").orderBy("id").collect()
    assert [(r.id, r.scan_session_id, r.exit_code, r.started_at, r.tool_name) for r in runs] == [(1, 1, None, "t1", "nmap"), (2, 2, None, "t1", "nmap")]
    assert json.loads(runs[0].parsed_data_json)["services"][0]["cpes"] == ["cpe:/a:v:one:1", "cpe:/a:v:two"]
    inputs = store.table("aggregated_inputs").orderBy("id").collect()
    assert inputs[1].input_payload_json.startswith("Device: dev-10.0.0.2\nScan:   01-full.scan\n")


def test_a_second_batch_continues_keys_and_reuses_devices(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "device_code string, scan_name string, xml string, seq long"

    def batch(*rows):
        pipeline.ingest(store, spark.createDataFrame(list(rows), schema), "t")

    batch(("a", "s1", document("m1"), 1))
    batch(("b", "s2", document("m2"), 1), ("a", "s3", document("m9"), 2), ("b", "s4", document("m3"), 3))
    batch(("c", "s5", document("m4"), 1))
    devices = sorted((r.id, r.device_code, r.mac) for r in store.table("devices").collect())
    assert devices == [(1, "a", "m1"), (2, "b", "m2"), (3, "c", "m4")]
    sessions = sorted((r.id, r.device_id) for r in store.table("scan_sessions").collect())
    assert sessions == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 3)]
    runs = sorted((r.id, r.scan_session_id, r.scan_name) for r in store.table("scan_runs").collect())
    assert runs == [(i, i, f"s{i}") for i in range(1, 6)]
    assert sorted(r.scan_session_id for r in store.table("aggregated_inputs").collect()) == [1, 2, 3, 4, 5]


def test_documents_that_give_no_rows_are_returned(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    data = [("a", "s1", document("m1"), 1), (None, "s2", document("m2"), 2), ("b", "s3", "<nmaprun><host>", 3),
            ("c", "s4", "<nmaprun/>", 4), ("d", "s5", document("m5").replace("</nmaprun>", "<!-- </nmaprun> --></nmaprun>"), 5)]
    rejects = pipeline.ingest(store, spark.createDataFrame(data, "device_code string, scan_name string, xml string, seq long"), "t")
    assert sorted((r.scan_name, r.reason) for r in rejects.collect()) == [
        ("s2", "no device code"), ("s3", "malformed document"), ("s4", "no live host"),
    ]
    for name in ("scan_sessions", "scan_runs", "aggregated_inputs", "devices"):
        assert store.table(name).count() == 2, name


def test_stages_and_their_repetition(store, spark, tmp_path, backend):
    truth = {"mac": "m1", "true_vendor": "v", "accepted_cpes": [{"cpe": f"cpe:2.3:a:v:one:1{TAIL}", "tier": "partial"}, "junk"]}
    (tmp_path / "truth.json").write_text(json.dumps([truth, {"mac": "m9"}]))
    entries = read_truth(spark, str(tmp_path / "truth.json")).withColumn("seq", F.monotonically_increasing_id())
    assert [r.mac for r in pipeline.load_truth(store, entries, "t2").collect()] == ["m9"]
    (tmp_path / "prompts.json").write_text(json.dumps([{"name": "p", "version": "1", "text": "Name it."}]))
    feed = read_prompts(spark, str(tmp_path / "prompts.json")).withColumn("seq", F.lit(1))
    for _ in range(2):
        pipeline.load_prompts(store, feed, "t2")
        pipeline.load_truth(store, entries, "t3")
    assert (store.table("prompts").count(), store.table("ground_truth").count()) == (1, 1)

    for _ in range(2):  # the second time adds nothing
        pipeline.add_baselines(store, "t4")
    baselines = store.table("model_runs").orderBy("id").collect()
    assert [(r.id, r.aggregated_input_id, r.model_name, r.model_version, r.status) for r in baselines] == [
        (1, 1, "nmap", "7", "complete"), (2, 2, "nmap", "7", "complete"),
    ]
    assert [len(json.loads(r.parsed_output_json)["cpes"]) for r in baselines] == [2, 0]

    asked = sweep(store.table("aggregated_inputs"), [1, 5], [ModelSettings("m")])
    rejects = pipeline.run_models(store, asked, backend)
    assert {r.reason for r in rejects.collect()} == {"unknown prompt"}
    assert store.table("model_runs").count() == 4

    for _ in range(2):
        pipeline.score_new(store, "t5")
    scores = store.table("scores").orderBy("id").collect()
    assert [(r.id, r.model_run_id, r.best_match_tier, r.match_score, r.exact_match) for r in scores] == [
        (1, 1, "partial", 0.5, 1), (2, 1, "none", 0.0, 0), (3, 3, "partial", 0.5, 0),
    ]

    pipeline.rescore(store, spark.createDataFrame([(1,)], "model_run_id long"), "t6")
    assert sorted((r.id, r.model_run_id, r.created_at) for r in store.table("scores").collect()) == [(3, 3, "t5"), (4, 1, "t6"), (5, 1, "t6")]

    pipeline.redo_baselines(store, spark.createDataFrame([(1,)], "id long"), "t7")
    assert sorted((r.id, r.model_name) for r in store.table("model_runs").collect()) == [(2, "nmap"), (3, "m"), (4, "m"), (5, "nmap")]
    assert [r.model_run_id for r in store.table("scores").collect()] == [3]
    pipeline.score_selected(store, spark.createDataFrame([(5,), (3,)], "model_run_id long"), "t8")
    assert sorted(r.model_run_id for r in store.table("scores").collect()) == [3, 5, 5]

    path = report_dir(str(tmp_path))
    written = pipeline.export(store, path, "csv")
    assert set(written) == {"scores_wide", "summary_by_model", "summary_by_prompt", "variance_by_config", "run_manifest"}
    manifest = spark.read.csv(written["run_manifest"], header=True)
    assert manifest.count() == 4
    store.register()
    assert spark.sql("SELECT count(*) FROM scores JOIN model_runs r ON r.id = model_run_id").first()[0] == 3


def test_unfinished_snapshots_are_not_read(store, tmp_path):
    import os

    before = store.table("prompts").count()
    os.makedirs(f"{store.root}/prompts/snapshot-999999")
    assert store.table("prompts").count() == before
