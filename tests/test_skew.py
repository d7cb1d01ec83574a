"""A third of all rows on one key, without broadcasts: joins are split, results stay whole."""

import pytest
from pyspark.sql import functions as F

from devident.operators.outputs import accepted_entries
from devident.operators.scoring import score_predictions, scoring_context

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    before = {name: spark.conf.get(name, None) for name in SMALL}
    for name, value in SMALL.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_hot_run_and_device_are_split(spark, small_partitions):
    n, third = 300_000, 100_000
    ids = spark.range(0, n, 1, 8).withColumn("_mixed", F.xxhash64("id"))
    run = F.when(F.col("id") < third, F.lit(0)).otherwise(F.pmod("_mixed", F.lit(5000)))
    tail = ":*" * 7
    predictions = ids.select(
        run.alias("run_id"), F.col("id").cast("int").alias("pos"),
        F.concat(F.lit("cpe:2.3:a:v:p"), F.pmod("_mixed", F.lit(3)).cast("string"), F.lit(":1" + tail)).alias("cpe"),
    )
    # runs of an even number and run 0 belong to device 0
    keys = spark.range(5000)
    inputs = keys.select("id", F.col("id").alias("scan_session_id"))
    sessions = keys.select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("device_id"))
    runs = keys.select("id", F.col("id").alias("aggregated_input_id"))
    truth = keys.select(
        "id", F.col("id").alias("device_id"), F.lit('["cpe:2.3:a:v:p0:*%s"]' % tail).alias("accepted_cpes_json")
    )
    context = scoring_context(runs, inputs, sessions, truth)
    scores = score_predictions(context, predictions, accepted_entries(truth)).select("model_run_id", "match_score", "pos")
    totals = scores.groupBy().agg(F.count("pos"), F.sum("match_score"))
    row = totals.collect()[0]
    hits = ids.filter(F.pmod("_mixed", F.lit(3)) == 0).count()
    assert tuple(row) == (n, float(hits))
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("skew=true") >= 2, plan
