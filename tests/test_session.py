"""The session's settings: what joins broadcast."""

import pytest

from devident.operators import inference
from devident.session import BROADCAST_BYTES, configure

STATIC, ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def limits(spark):
    yield spark.conf
    for name in (STATIC, ADAPTIVE):
        spark.conf.unset(name)
    configure(spark)


@pytest.mark.parametrize("given,limit", [("10485760b", BROADCAST_BYTES), ("1g", BROADCAST_BYTES), ("100k", 100 << 10), ("-1", -1)])
def test_broadcast_limit(spark, limits, given, limit):
    for name in (STATIC, ADAPTIVE):
        limits.set(name, given)
    configure(spark)
    read = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    assert {-1 if limits.get(name) == "-1" else read(limits.get(name)) for name in (STATIC, ADAPTIVE)} == {limit}


def test_default_limit(spark, limits):
    limits.unset(STATIC)
    limits.unset(ADAPTIVE)
    configure(spark)
    assert int(limits.get(STATIC)) == BROADCAST_BYTES and limits.get(ADAPTIVE, None) is None


def test_requests_of_many_inputs_are_not_broadcast(spark, tmp_path):
    """Files of 1 MB that hold a hundred thousand inputs, each with eight requests."""
    configure(spark).range(200_000).selectExpr("id", "concat('payload ', id) AS input_payload_json").write.parquet(str(tmp_path / "inputs"))
    inputs = spark.read.parquet(str(tmp_path / "inputs"))
    prompts = spark.createDataFrame([(1, "text")], "id long, prompt_text string")
    asked = inference.sweep(inputs, [1, 2], [inference.ModelSettings("a"), inference.ModelSettings("b")])
    plan = inference.build_requests(asked, inputs, prompts)._jdf.queryExecution().sparkPlan().toString()
    assert "aggregated_input_id" in plan and not any("BroadcastHashJoin" in line and "aggregated_input_id" in line for line in plan.splitlines())
