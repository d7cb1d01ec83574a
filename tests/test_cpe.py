import pytest
from pyspark.sql import functions as F

from devident.functions.cpe import cpe_is_valid, cpe_normalize, cpe_parse, with_cpe_fields

S8 = ":*" * 8
CASES = [
    ("cpe:/h:linksys:wrt54gs", "cpe:2.3:h:linksys:wrt54gs" + S8, False, False),
    ("cpe:/o:linux", None, False, False),
    ("cpe:/a:x::1", "cpe:2.3:a:x:*:1" + ":*" * 7, False, False),
    ("cpe:2.3:a:x:y", "cpe:2.3:a:x:y" + S8, False, False),
    ("cpe:2.3:a:x", None, False, False),
    ("cpe:2.3:a:x:y:", "cpe:2.3:a:x:y:" + ":*" * 7, False, False),
    ("cpe:2.3:a:x:y" + S8, "cpe:2.3:a:x:y" + S8, True, True),
    ("cpe:2.3:a:*:y" + S8, "cpe:2.3:a:*:y" + S8, True, False),
    ("cpe:2.3:a:-:y" + S8, "cpe:2.3:a:-:y" + S8, True, True),
    ("cpe:2.3:z:x:y" + S8, "cpe:2.3:z:x:y" + S8, True, False),
    ("cpe:2.3:a::y" + S8, "cpe:2.3:a::y" + S8, True, False),
    ("cpe:2.3:a:*x:y" + S8, "cpe:2.3:a:*x:y" + S8, True, True),
    ("cpe:/a:1:2:3:4:5:6:7:8:9:10:11", "cpe:2.3:a:1:2:3:4:5:6:7:8:9:10:11", False, False),
    (" cpe:/a:x:y\n", "cpe:2.3:a:x:y" + S8, False, False),
    (" cpe:/a:x:y ", "cpe:2.3:a:x:y" + S8, False, False),
    ("cpe:/:::", "cpe:2.3:*:*:*:*" + ":*" * 7, False, False),
    ("CPE:/a:x:y", None, False, False),
    ("", None, False, False),
    (None, None, False, False),
]


@pytest.fixture(scope="module")
def results(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, c string")
    frame = frame.select(
        "i", cpe_normalize(F.col("c")).alias("n"), cpe_parse(F.col("c")).alias("p"), cpe_is_valid(F.col("c")).alias("v")
    )
    return {r.i: r for r in frame.collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[repr(c[0]) for c in CASES])
def test_goldens(results, i):
    _, normal, parses, valid = CASES[i]
    assert results[i].n == normal
    assert (results[i].p is not None) == parses
    assert results[i].v == valid


def test_normalizing_twice_changes_nothing_for_13_tokens(spark):
    frame = spark.createDataFrame([(c[0],) for c in CASES], "c string").withColumn("n", cpe_normalize(F.col("c")))
    full = frame.filter(F.size(F.split("n", ":")) == 13)
    assert full.filter(cpe_normalize(F.col("n")) != F.col("n")).count() == 0


def test_fields_come_from_one_split_and_filters_on_them_do_not_repeat_it(spark):
    frame = spark.createDataFrame([("cpe:2.3:a:v:p:1" + ":*" * 7,), ("bad",)], "c string")
    picked = with_cpe_fields(frame, "c", {"vendor": "v", "version": "ver"})
    assert {(r.v, r.ver) for r in picked.collect()} == {("v", "1"), (None, None)}
    plan = picked.filter("v is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_normalizing_strips_once(spark):
    frame = spark.createDataFrame([("cpe:/a:v:p",)], "c string").select(cpe_normalize(F.col("c")).alias("n"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("trim(") <= 1
