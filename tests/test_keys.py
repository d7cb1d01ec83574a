from pyspark.sql import functions as F

from devident.operators.keys import last_key, with_defaults, with_keys


def test_keys_are_consecutive_in_order_with_a_hot_value(spark):
    """Half of the rows share the leading value; the whole order still splits them."""
    frame = spark.range(20000).select(
        F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.col("id") % 97).alias("run"),
        (F.col("id") * 7919 % 20000).alias("pos"),
    )
    keyed = with_keys(frame, ["run", "pos"], 40).toPandas().sort_values("id")
    assert list(keyed["id"]) == list(range(41, 20041))
    assert list(map(tuple, keyed[["run", "pos"]].values)) == sorted(map(tuple, keyed[["run", "pos"]].values))


def test_keys_of_nothing(spark):
    assert with_keys(spark.range(0), ["id"], key="k").count() == 0
    assert last_key(spark.range(0)) == 0


def test_defaults_apply_to_absent_columns_only(rows):
    frame = rows("id long, device_id long, started_at string", [(1, 1, None)])
    row = with_defaults(frame, "scan_sessions", "now").first()
    assert row.started_at is None
    assert with_defaults(frame.drop("started_at"), "scan_sessions", "now").first().started_at == "now"
    run = with_defaults(rows("id long, aggregated_input_id long", [(1, 1)]), "model_runs", "now").first()
    assert (run.status, run.started_at, run.ended_at) == ("pending", "now", None)


def test_feeds_and_paths(spark, tmp_path):
    import pytest

    from devident.sources.feeds import broken_lines, read_prompts, read_truth
    from devident.sources.scans import read_scans

    (tmp_path / "lines.json").write_text('{"name": "p", "version": "1", "text": "x"}\n{"name": "q", \n')
    feed = str(tmp_path / "lines.json")
    assert [r.name for r in read_prompts(spark, feed, multi_line=False).collect()] == ["p"]
    assert [r.line for r in broken_lines(spark, feed).collect()] == ['{"name": "q", ']
    (tmp_path / "truth.json").write_text('[{"mac": "m1"}, {"mac": ]')
    with pytest.raises(Exception):
        read_truth(spark, str(tmp_path / "truth.json")).collect()
    folder = tmp_path / "scans" / "10.0.0.1_20240101_000001"
    folder.mkdir(parents=True)
    for name in ("a+b c.xml", "50%.v1.xml", "plain.xml"):
        (folder / name).write_text("<nmaprun/>")
    found = {r.scan_name: r.path for r in read_scans(spark, str(tmp_path / "scans")).collect()}
    assert set(found) == {"a+b c", "50%.v1", "plain"} and found["a+b c"].endswith("a+b c.xml")
