"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from devident.llm.queries.substring_dedup import SQL, query
from devident.llm.substring_dedup import anchored, dedupe, subtree, word_hashes
from tests.oracle_check import connect, difference

DOCS = "doc_id long, text string"


def brute(data, length):
    least, texts = {}, [(d, (t or "").encode().split()) for d, t in data]
    for d, w in texts:
        if d is not None:
            for p in range(len(w) - length + 1):
                k = tuple(w[p : p + length])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in texts:
        gone = set()
        for p in range(len(w) - length + 1):
            if d is not None and least[tuple(w[p : p + length])] < d:
                gone.update(range(p, p + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n, length):
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "the", "the", "the"]
    shared = [rng.choices(vocabulary, k=rng.randint(length, 3 * length)) for _ in range(4)]
    data = []
    for d in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choices(vocabulary, k=rng.randint(0, length))
            if rng.random() < 0.7:
                passage = rng.choice(shared)
                cut = rng.randint(0, length // 2)
                parts += passage[cut:]
        if rng.random() < 0.1:
            parts = ["the"] * rng.randint(0, 4 * length)
        data.append((d, rng.choice([" ", "\n", "\t "]).join(parts)))
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("part", [1, 2, 256])
def test_like_brute_force(spark, rows, part):
    data = corpus(random.Random(part), 60, 14)
    got = dedupe(rows(DOCS, data), 14, part).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(data, 14)


def test_odd_rows(spark, rows):
    long = " ".join(f"x{i % 17}" for i in range(40))
    data = [(1, long), (1, long), (1, long + " y"), (2, long), (2, long), (None, long), (3, None), (4, ""), (5, " \n"), (6, "a b")]
    frame = rows(DOCS, data).selectExpr("*", "'k' AS key", "1 AS segment", "0 AS print")
    got = dedupe(frame, 14).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(data, 14)
    assert dedupe(rows(DOCS, []), 14).count() == 0


def test_real_outputs(spark, rows):
    data = [(1, " ".join(f"a{i}" for i in range(30))), (2, "before " + " ".join(f"a{i}" for i in range(30)) + " after")]
    found = {r.doc_id: r for r in dedupe(rows(DOCS, data), 14).collect()}
    assert found[2].spans == [1, 31] and found[2].kept == "before after" and found[1].kept is None


def test_every_window_has_one_anchor():
    hashes = word_hashes([str(i % 23).encode() for i in range(500)])
    _, low, more, _ = anchored(hashes, 50)
    covered = np.concatenate([np.arange(a, a + m + 1) for a, m in zip(low, more)])
    assert (covered == np.arange(451)).all()


def test_subtree_nodes():
    a, b = np.arange(20), np.concatenate([np.arange(5, 20), [99]])
    owner, offset, least = subtree(np.array([1, 1]), [a, b], np.array([7, 3]), 10)
    found = {(o, f): x for o, f, x in zip(owner.tolist(), offset.tolist(), least.tolist())}
    assert found[0, 0] == 7 and found[0, 5] == 3 and found[0, 10] == 3 and found[1, 6] == 3 and found[1, 0] == 3


def test_long_text(spark, rows):
    line = " ".join(f"v{i * 7919 % 5003}" for i in range(60_000))
    got = {r.doc_id: r for r in dedupe(rows(DOCS, [(1, line), (2, "new " + line), (3, "same " * 50_000)])).collect()}
    assert (got[2].n_words, got[2].n_removed, got[3].n_removed) == (60_001, 60_000, 0)


def test_query_like_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert difference(query(spark, sf_dir), connect(sf_dir), SQL) is None
