"""Baselines of a few sessions parse the documents of a few sessions; costly rows keep their parallelism."""

from pyspark.sql import functions as F

from devident.operators.baseline import baseline_runs, of_sessions, session_cpes
from devident.operators.keys import with_keys
from devident.plans import binding, catalog
from devident.session import shuffle_partitions

SF_DIR = "/root/testdata/sf0.001"
RUN = "id long, scan_session_id long, tool_version string, stdout_text string"


def document(*cpes):
    found = "".join(f"<cpe>cpe:/a:{c}</cpe>" for c in cpes)
    return f'<nmaprun><host><ports><port><state state="open"/><service>{found}</service></port></ports></host></nmaprun>'


def metric(plan, node, name):
    """The metric of the nodes of an executed plan whose name begins so."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        if p.nodeName().startswith(node) and p.metrics().contains(name):
            out.append(p.metrics().apply(name).value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_only_wanted_documents_are_parsed(spark, rows):
    runs = [(i, i % 5000, "7", document(f"v:p{i % 5000}")) for i in range(10_000)]
    wanted = rows("scan_session_id long", [(3,), (4998,), (3,), (10**6,), (None,)])
    passed = of_sessions(rows(RUN, runs), wanted)
    assert {r.scan_session_id for r in passed.collect()} >= {3, 4998} and passed.count() <= 20
    found = session_cpes(rows(RUN, runs), wanted)
    got = {r.scan_session_id: r.cpes for r in found.collect()}
    assert {k: len(v) for k, v in got.items()} == {3: 1, 4998: 1}
    # what the generator behind the parse gives: one row per parsed document
    parsed = metric(found._jdf.queryExecution().executedPlan(), "Generate", "numOutputRows")
    assert parsed and max(parsed) <= 20
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("from_xml") <= 2 and "BroadcastHashJoin" in text


def test_few_slots_let_others_pass_but_not_through(spark, rows):
    runs = rows(RUN, [(i, i, "7", document(f"v:p{i}")) for i in range(40)])
    wanted = rows("scan_session_id long", [(3,), (7,)])
    assert of_sessions(runs, wanted, 2).count() > 2
    assert sorted(r.scan_session_id for r in session_cpes(runs, wanted).collect()) == [3, 7]
    assert of_sessions(runs, wanted.filter("false")).count() == 0
    inputs = rows("id long, scan_session_id long", [(11, 3), (12, 3), (13, None), (14, 99)])
    assert sorted(r.aggregated_input_id for r in baseline_runs(inputs, runs, "t").collect()) == [11, 12]


def test_documents_are_dealt_by_number_not_by_bytes(spark):
    n = shuffle_partitions(spark)
    for frame in (binding.scan_documents(spark, SF_DIR), binding.ground_truth(spark, SF_DIR), catalog._raw_outputs(spark, SF_DIR)):
        assert frame.rdd.getNumPartitions() == n
    seen = with_keys(spark.range(1000).select("id", F.spark_partition_id().alias("p")), ["id"], key="k", then=lambda d: d.withColumn("at", F.spark_partition_id()))
    assert seen.select("at").distinct().count() == n and [r.k - r.id for r in seen.collect()] == [1] * 1000


def test_very_many_sessions_still_keep_others_out(spark):
    runs = spark.range(2_000_000).withColumnRenamed("id", "scan_session_id")
    passed = of_sessions(runs, runs.filter("scan_session_id % 2 = 0")).groupBy((F.col("scan_session_id") % 2).alias("other")).count()
    counts = {r.other: r["count"] for r in passed.collect()}
    assert counts[0] == 1_000_000 and counts.get(1, 0) < 30_000


def test_identifiers_are_merged_by_hash_in_first_seen_order(spark, rows):
    runs = [
        (7, 1, "b", document("v:p", "v:q")), (7, 1, "a", document("v:q", "v:r")), (None, 1, None, document("v:s", "v:r")),
        (-2, 1, "", "<broken"), (2**40, 2, "c", None), (-(2**63), 2, "d", ""), (9, 3, "e", document()), (9, None, "f", document("v:t")),
    ]
    merged = session_cpes(rows(RUN, runs))
    cut = len(":*" * 8)
    got = {r.scan_session_id: ([c[:-cut].split(":")[-1] for c in r.cpes], r.tool_version) for r in merged.collect()}
    assert got == {1: (["s", "r", "p", "q"], ""), 2: ([], None), 3: ([], "e"), None: (["t"], "f")}
    assert "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()
