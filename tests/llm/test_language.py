"""Language filters: no lost members, n-grams whatever the stretch, held-out accuracy, odd rows."""

import numpy as np
import pytest

from devident.llm import language
from devident.llm.language import Learning, build, grams, held_out, identify, learn

SF_DIR = "/root/testdata/sf0.01"


def brute_grams(text):
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return sorted(
        line[i : i + n] for n in (2, 3, 4) for i in range(len(line) - n + 1)
        if " " not in line[i + 1 : i + n - 1] and line[i : i + n].strip()
    )


@pytest.mark.parametrize("stretch", [3, 7, 1 << 19])
def test_grams(monkeypatch, stretch):
    monkeypatch.setattr(language, "_STRETCH", stretch)
    for text in ("a", "Été, d'un jour  42", "x y", "ab1cd", "𝒳y z", "the end"):
        found = np.concatenate(list(grams(text.encode())))
        names = brute_grams(text)
        assert len(found) == len(names) and len(set(found.tolist())) == len(set(names)), (text, len(found), names)


def test_filter_loses_no_member():
    rng = np.random.default_rng(1)
    names = [f"l{i:03}" for i in range(70)]
    members = [(i, rng.integers(0, 1 << 63, 50, dtype=np.uint64)) for i in range(70)]
    made = build(names, members, 1 << 12)
    for i, hashes in members:
        both = np.bitwise_and.reduce([made.slots[i // 64][p] for p in made.places(hashes)])
        assert (both >> np.uint64(i % 64) & np.uint64(1)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = identify(docs, learn(docs), keep=("doc_id", "lang")).withColumn("held_out", held_out()).filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_odd_rows(spark, rows):
    data = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", None), (5, "42 !", "fr"),
            (None, "the dog", "en"), (6, "the dog", None), (6, "the dog", "en"), (7, "the " * 50000, "en"), (8, "zzz", None)]
    frame = rows("doc_id long, text string, lang string", data).selectExpr("*", "'s' AS score", "1 AS lang_pred")
    got = identify(frame, learn(frame, Learning(documents=100)), keep=("doc_id",)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    assert by[1].lang_pred == "en" and by[2].lang_pred == "fr" and by[7].lang_pred == "en" and by[8].lang_pred in ("en", "fr")
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und"
    empty = rows("doc_id long, text string, lang string", [])
    assert identify(empty, learn(empty)).count() == 0
    assert {r.lang_pred for r in identify(frame, learn(empty)).collect()} == {"und"}
    kept = identify(frame, learn(empty), keep=("doc_id", "score", "lang_pred", "lang"))
    assert kept.columns == ["doc_id", "lang", "lang_pred", "score"] and kept.first().lang_pred == "und"


def test_symbols_beyond_the_basic_plane(spark, rows):
    for text in ("\U0001f600\U0001f680 \U0001f4a9", "a\U0001f600b", "\U0001d4b3y \U00010400"):
        assert len(np.concatenate(list(grams(text.encode())) or [[]])) == len(brute_grams(text)), text
    data = [(1, "the cat and the dog", "en"), (2, "\U0001f600\U0001f680 \U0001f4a9", "en"), (3, "\U0001f600 the dog", None)]
    frame = rows("doc_id long, text string, lang string", data)
    got = {r.doc_id: r.lang_pred for r in identify(frame, learn(frame, Learning(documents=100)), keep=("doc_id",)).collect()}
    assert got == {1: "en", 2: "und", 3: "en"}
