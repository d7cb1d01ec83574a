"""Quality rules: counts against plain Python, the query against its SQL, no Python and no exchange in the plan."""

import random
import re

from devident.llm.quality_rules import COUNTS, STOP_WORDS, judge, measured
from devident.llm.queries.quality_rules import SQL, query
from tests.oracle_check import connect, difference

DOCS = "doc_id long, text string"
SF_DIR = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p for places in windows.values() if len(places) > 1 for i in places for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(w in STOP_WORDS for w in words),
        len(lines), len(lines) - len(set(lines)), len(covered),
    )


def test_counts(spark, rows):
    rng = random.Random(1)
    bits = ["a", "b", "the", "é𝒳", "x|y", "#", " ", "  ", "\n", "\t", "\r", "\x0b", "\xa0", "der", "a b c d e ", "same line\n"]
    data = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    data += [(-1, None), (-2, ""), (-3, " \n \n"), (-4, "one two three four five " * 30000), (None, "a a a a a a a"), (1, "again")]
    frame = rows(DOCS, data).selectExpr("*", "1 AS n_lines_", "'x' AS _words", "2 AS h")
    got = measured(frame).select("text", *COUNTS).collect()
    assert len(got) == len(data)
    for row in got:
        assert tuple(row)[1:] == brute(row.text), repr(row.text)[:200]
    assert measured(rows(DOCS, [])).count() == 0


def test_judgement(spark, rows):
    clean = " ".join(f"{w} text{i} of words{i}" for i, w in enumerate(["the", "and", "to"] * 8))
    data = [(1, clean), (2, "too short"), (3, None), (4, "and so it goes on " * 20), (5, clean.replace(" ", " ## ")), (6, "zzz qqq vvv kkk jjj " + " ".join(f"x{i}q" for i in range(60)))]
    got = {r.doc_id: (r.base_failed, r.kept) for r in judge(rows(DOCS, data)).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, False), 6: (False, False)}


def test_query_like_sql(spark):
    assert difference(query(spark, SF_DIR), connect(SF_DIR), SQL) is None


def test_plan_stays_native(spark):
    plan = query(spark, SF_DIR).filter("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_clashing_columns_are_replaced(rows):
    data = [(1, "one two three"), (2, None), (3, "a b c d e f g h i j k l")]
    plain = judge(rows(DOCS, data)).collect()
    names = [*COUNTS, "base_failed", "kept"]
    odd = rows(DOCS, data).selectExpr("*", *[f"'x' AS {c}" for c in names], "7 AS other")
    got = judge(odd)
    assert sorted(got.columns) == sorted(["doc_id", "text", "other", *names])
    assert [[r[c] for c in names] for r in got.collect()] == [[r[c] for c in names] for r in plain]
