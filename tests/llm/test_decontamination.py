"""Alignment against a plain table; contaminated documents found, clean ones left."""

import random

import numpy as np
import pytest

from devident.llm.decontamination import align, matches, token_hashes
from devident.llm.queries.decontamination import query

DOCS = "doc_id long, text string"


def plain(passage, item):
    best, table = 0.0, [[0.0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            step = 1.0 if a == b else -0.5
            table[i][j] = max(0, table[i - 1][j - 1] + step, table[i - 1][j] - 0.5, table[i][j - 1] - 0.5)
            best = max(best, table[i][j])
    return best


def test_alignment():
    rng = random.Random(2)
    for _ in range(300):
        passage = [rng.randint(1, 6) for _ in range(rng.randint(1, 30))]
        item = [rng.randint(1, 6) for _ in range(rng.randint(1, 15))]
        score, first, last = align(np.array(passage), np.array(item))
        assert score == plain(passage, item)
        if score:
            assert plain(passage[first : last + 1], item) == score


def test_copies_are_found_and_clean_texts_left(spark, rows):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20 + i))) for i in range(20)]
    docs, want = [], set()
    for d in range(200):
        parts = rng.choices(vocabulary, k=rng.randint(0, 300))
        if d % 4 == 0:
            item = items[d // 4 % 20]
            copy = item[1].split()
            for _ in range(d // 40):  # up to four edited words
                copy[rng.randrange(len(copy))] = rng.choice(["edited", "x y", ""])
            at = rng.randint(0, len(parts))
            parts[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in copy]
            want.add((d, item[0]))
        docs.append((d, " ".join(parts)))
    got = {(r.doc_id, r.item_id): r for r in matches(rows(DOCS, docs), rows("item_id long, text string", items)).collect()}
    assert set(got) == want and got[0, 0].score == 1.0
    r = got[0, 0]
    assert r.last_word - r.first_word + 1 == 20


def test_odd_rows(spark, rows):
    item = "alpha beta gamma delta epsilon zeta"
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "too short"), (None, item), (5, "alpha beta gamma delta epsilon eta")]
    docs = [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "... !!! " * 50), (5, "so " * 20000 + item)]
    frame = rows(DOCS, docs).selectExpr("*", "1 AS passage", "2 AS item_id", "'x' AS score")
    got = {(r.doc_id, r.item_id): r.score for r in matches(frame, rows("item_id long, text string", items).selectExpr("*", "1 AS doc_id", "2 AS grams")).collect()}
    assert {k for k in got if k[1] == 1} == {(1, 1), (None, 1), (5, 1)} and got[5, 1] == 1.0 and 0.5 <= got[1, 5] < 1
    assert matches(rows(DOCS, []), rows("item_id long, text string", items)).count() == 0
    assert matches(rows(DOCS, docs), rows("item_id long, text string", [])).count() == 0


def test_query_against_every_pair(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id): r.score for r in query(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    tokens = {d.doc_id: token_hashes((d.text or "").encode()) for d in docs}
    want = {}
    for i in items:
        own = token_hashes(i.text.encode())
        own = own[own != 0]
        for d, t in tokens.items():
            score = align(t[t != 0], own)[0] / len(own) if len(t) else 0.0
            if score >= 0.5:
                want[d, i.item_id] = score
    assert got == want


def every_pair(docs, items, threshold=0.5):
    want = {}
    for item_id, item in items:
        own = token_hashes(item.encode())
        for doc_id, text in docs:
            score = align(token_hashes(text.encode()), own)[0] / len(own)
            if score >= threshold:
                want[doc_id, item_id] = score
    return want


@pytest.mark.parametrize("around", [False, True])
def test_groups_of_equal_edited_copies(spark, rows, around):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.sample(vocabulary, 37))) for i in range(3)]
    edited = items[0][1].split()
    for at in (6, 12, 18, 24, 30):
        edited[at] = "edited"
    text = lambda own: " ".join([*(rng.sample(vocabulary, 80) if around else []), *own])
    docs = [(0, text(items[0][1].split())), (1, text(items[1][1].split()))]
    docs += [(10 + i, text(edited)) for i in range(20)]
    # frequent n-grams only, in passages that all differ
    docs += [(100 + i, text([*edited[:31], f"tail{i}", f"w{i}"])) for i in range(40)]
    want = every_pair(docs, items)
    assert all((10 + i, 0) in want and (100 + i, 0) in want for i in range(20))
    got = {(r.doc_id, r.item_id): r for r in matches(rows(DOCS, docs), rows("item_id long, text string", items)).collect()}
    assert {k: r.score for k, r in got.items()} == want and all(r.n_seeds >= 1 for r in got.values())
    texts = dict(docs)
    for (doc_id, _), r in got.items():
        assert texts[doc_id].split()[r.first_word] in edited + items[0][1].split() + items[1][1].split()
