"""The pipeline: every stage on odd rows, its decisions, and the whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from devident.llm.simhash import RESEMBLING, near_duplicates
from tests.llm.test_simhash import brute_print

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def five(text):
    parts = text.lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, rows, name, stage):
    long = " ".join(f"word{i * 7919 % 997}" for i in range(30000))
    data = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "same line here", "en", "s", 14), (3, "same line here", "en", "s", 14),
            (None, "no id at all", "en", "s", 12), (4, long, "en", "s", len(long)), (5, "tie tie tie tie tie tie", "en", "s", 1)]
    frame = rows(COLUMNS, data).selectExpr("*", "1 AS score", "2 AS predicted", "3 AS lane0", "4 AS piece", "5 AS n_lines")
    out = stage(spark, frame, SF_DIR)
    got = out.collect()
    assert got
    if stage is not corpus_pipeline.pack:
        # the tiny sample of labels may call short texts toxic
        assert out.columns == frame.columns and {r.doc_id for r in got} >= ({1, 2} if name == "toxicity" else {None, 4, 5})
    empty = stage(spark, rows(COLUMNS, []), SF_DIR)
    assert empty.count() == 0


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.count()
    for (name, stage) in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR).cache()
        assert kept.columns == docs.columns and 0.7 * before < kept.count() <= before, name
        again = kept.filter(F.length("text") > 0)
        assert again.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs = kept


def test_near_duplicates_at_high_resemblance(spark, rows):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    docs, pairs = [], []
    for g in range(60):
        base = rng.choices(vocabulary, k=300)
        copy = list(base)
        for at in rng.sample(range(300), 1 + g % 5):
            copy[at] = rng.choice(vocabulary)
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        a, b = five(docs[-2][1]), five(docs[-1][1])
        pairs.append(len(a & b) / len(a | b))
    found = {r.doc_id: r.component_id for r in near_duplicates(rows("doc_id long, text string", docs), RESEMBLING).collect()}
    linked = [found[2 * g + 1] == 2 * g for g in range(60)]
    sure = [x for x, j in zip(linked, pairs) if j >= 0.9]
    assert sum(sure) >= 0.95 * len(sure) and sum(linked) >= 0.8 * 60
    assert all(found[2 * g] == 2 * g for g in range(60))


def test_near_duplicates_by_fingerprint(spark, rows):
    # three shingles of five words, and another one at the end: 3 of 4 are common, but the fingerprints are equal
    line = "a b c " * 50
    docs = rows(COLUMNS, [(1, line, "en", "s", 300), (2, line + "x", "en", "s", 301), (3, "quite another text than the one before it", "en", "s", 41)])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()) == [1, 3]


def test_near_duplicates_by_fingerprint_and_resemblance(spark, rows):
    rng = random.Random(14)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    docs = []
    for g in range(40):
        base = rng.choices(vocabulary, k=300)
        copy = list(base)
        for at in rng.sample(range(300), 1 + g % 8):
            copy[at] = rng.choice(vocabulary)
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    line = "a b c " * 50
    docs += [(100, line), (101, line + "x")]
    # the first of these is near in bits to 100, as the second is alike in words to the first
    long = "a b c " * 9 + "x"
    docs += [(90, long), (91, long + " y")]
    sets, prints = {d: five(t) for d, t in docs}, {d: brute_print(t) for d, t in docs}
    by_set = {(a, b) for a in sets for b in sets if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    by_print = {(a, b) for a in sets for b in sets if (prints[a] ^ prints[b]).bit_count() <= 2}
    assert len(by_set - by_print) >= 20 and by_print - by_set
    label = {d: d for d in sets}
    for _ in range(4):
        for a, b in by_set | by_print:
            label[a] = label[b] = min(label[a], label[b])
    frame = rows(COLUMNS, [(d, t, "en", "s", len(t)) for d, t in docs])
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, SF_DIR).collect())
    assert kept == sorted(set(label.values()))


def test_run(spark):
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 for v in by.values()) and len(packed) > 100
