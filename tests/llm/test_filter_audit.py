"""The audit of filters against a chain that is run text by text."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from devident.llm.filter_audit import COUNTS, audit, removal_steps
from devident.llm.queries.filter_audit import SQL, query
from tests.oracle_check import connect, difference


def failed(doc_id, text, all_rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    rules = {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in all_rows),
    }
    return {name for name, fails in rules.items() if fails}


def chained(data, labels):
    """Every order run over every row, as the definition says."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    marked = [(i, source or "", failed(i, text, data)) for i, text, source in data]
    out = {}
    for part in {m[1] for m in marked}:
        rows = [m for m in marked if m[1] == part]
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, name in enumerate(order, 1):
                gone, left_now = [m for m in left if name in m[2]], [m for m in left if name not in m[2]]
                out[part, order, step] = [
                    len(left_now), len(gone), sum(name in m[2] for m in rows) - len(gone), sum(m[2] == {name} for m in rows),
                    sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone), name,
                ]
                left = left_now
        for name in "ABCDE":
            keys = [k for k in out if k[0] == part and out[k][6] == name]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k][6] = total
    return out


def texts(rng):
    body = " ".join(rng.choice("abcdefghij") + rng.choice("klmnopq") + str(rng.randrange(40)) for _ in range(rng.choice([5, 60, 80])))
    return body.upper() if rng.random() < 0.2 else body + rng.choice(["", "", " 5 %", " same"]) + " word" * rng.choice([0, 0, 60])


@pytest.mark.parametrize("seed", [1, 2])
def test_like_the_chain(rows, seed):
    rng = random.Random(seed)
    pool = [None, "", *[texts(rng) for _ in range(15)]]
    data = [(i if rng.random() < 0.95 else None, rng.choice(pool), rng.choice(["a", "b", None, ""])) for i in range(70)]
    data += data[:6]  # repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 70, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = rows("doc_id long, text string, source string", data).selectExpr("*", "1 AS part", "'x' AS mask", "2 AS n", "3 AS good", "4 AS digest")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in audit(docs, rows("doc_id long, quality int, toxic int", labels)).collect()}
    assert got == chained(data, labels)


def test_steps():
    orders, steps = removal_steps(3)
    assert orders.shape == (6, 3) and (steps[0] == 4).all() and (steps[7] == 1).all()
    for order, by_mask in zip(orders, steps.T):
        assert [by_mask[1 << f] for f in order] == [1, 2, 3]
        assert by_mask[(1 << order[1]) | (1 << order[2])] == 2
    assert removal_steps(1)[1].tolist() == [[2], [1]] and np.array(removal_steps(5)[1]).shape == (32, 120)


def test_own_rules_empty_and_long(rows):
    from pyspark.sql import functions as F

    labels = rows("doc_id long, quality int, toxic int", [])
    assert audit(rows("doc_id long, text string, source string", []), labels).count() == 0
    docs = rows("doc_id long, text string, source string", [(1, "x " * 500_000, "s"), (2, "y" * 1_000_000, "s"), (3, "y" * 1_000_000, "s")])
    got = {(r.filter_order, r.step): r for r in audit(docs, labels, rules={"L": F.length("text") > 1_000_000 - 1}).collect()}
    assert len(got) == 4 and got["LE", 1].removed == 3 and got["EL", 1].removed == 1 and got["EL", 2].redundant == 1
    full = {(r.filter_order, r.step): r for r in audit(docs, labels).collect()}
    assert full["BADCE", 1].removed == 1 and full["ABCDE", 5].redundant == 1 and len(full) == 600


def test_query_like_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert difference(query(spark, sf_dir), connect(sf_dir), SQL) is None
