"""The recurrent network's gradients, its windows, and what it learns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from devident.llm import gru
from devident.llm.toxicity import STRIDE, WINDOW, Model, Scorer, Training, held_out, learn, score, train, window_ids, window_starts

SF_DIR = "/root/testdata/sf0.1"


def model(seed):
    hashed = gru.features([b"some", b"short", *[f"w{i}".encode() for i in range(0, 1500, 2)]])
    known = np.unique(hashed[0]), np.unique(hashed[1])
    params = gru.initial(seed, len(known[0]), len(known[1]))
    params["word"] *= 50
    return Model(params, *known)


def test_gradients():
    rng = np.random.default_rng(2)
    hashed = gru.features([b"one", b"two", b"thr\xc3\xa9e", b"a"])
    known = np.unique(hashed[0][:3]), np.unique(hashed[1])[2:]
    params = {k: v.astype(np.float64) for k, v in gru.initial(3, len(known[0]), len(known[1])).items()}
    for k in ("word", "char"):
        params[k][1:] = rng.standard_normal(params[k][1:].shape) * 0.5
    feats = gru.resolve(hashed, gru.Rows(known[0]), gru.Rows(known[1]))
    ids = np.array([[0, 1, 2, 1, -1], [3, 0, -1, -1, -1], [2, 2, 1, 0, 3]])
    weights = np.array([1.0, -2.0, 0.5])

    def value():
        vectors = gru.embed(params, *feats)
        return vectors, gru.forward(params, gru.project(params, vectors), ids, keep=True)

    vectors, (logit, cache) = value()
    grad = gru.gradients(params, vectors, feats, ids, weights, cache)
    for name, g in grad.items():
        if isinstance(g, tuple):
            full = np.zeros_like(params[name])
            full[g[0]] = g[1]
            g = full
        flat = np.flatnonzero(np.abs(g).ravel() > 1e-4)
        for at in rng.choice(flat, min(6, len(flat)), replace=False):
            old = params[name].ravel()[at]
            ends = []
            for step in (1e-3, -1e-3):
                params[name].ravel()[at] = old + step
                ends.append((value()[1][0] * weights).sum())
            params[name].ravel()[at] = old
            assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(g.ravel()[at], rel=2e-2, abs=2e-4), name


def test_windows_overlap_and_cover():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        starts = window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + WINDOW))}
        assert covered == set(range(n)) and (np.diff(starts) == STRIDE).all()
        ids = window_ids(np.arange(n))
        assert (ids[ids >= 0].max() if n else -1) == n - 1


def test_padding_does_not_change_a_score():
    scorer = Scorer(model(4))
    ids = scorer.windows([b"some", b"short", b"text"])
    assert scorer.probabilities(ids)[0] == pytest.approx(scorer.probabilities(ids[:, :3])[0], abs=1e-5)


def test_long_text_scores_like_its_windows(monkeypatch):
    monkeypatch.setattr("devident.llm.toxicity.CACHED_WORDS", 400)
    params = model(5)
    parts = [f"w{i * 7919 % 1500}".encode() for i in range(3000)]
    whole = Scorer(params).scores([b" ".join(parts), b"x", None])
    by_window = max(Scorer(params).scores([b" ".join(parts[s : s + WINDOW])])[0] for s in window_starts(3000))
    assert whole[0] == pytest.approx(by_window, abs=1e-5) and whole[2] == 0.0


def test_learns_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    params = learn(docs.select("doc_id", "text"), labels)
    rows = score(docs, params, keep=["doc_id"]).withColumn("held_out", held_out()).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    auc = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert auc > 0.97 and np.mean([r.predicted == r.toxic for r in rows]) > 0.95


def test_odd_rows(spark, rows):
    data = [(1, "you idiot moron " * 5, 1), (2, "fine text here " * 9, 0), (3, None, 1), (4, "", 0), (None, "idiot", 1), (1, "again idiot", 1)] * 3
    data += [(i, "you idiot" if i % 2 else "fine text", i % 2) for i in range(10, 40)] + [(99, "x", None)]
    frame = rows("doc_id long, text string, toxic int", data)
    params = learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), Training(steps=5))
    clash = frame.withColumn("score", F.lit("old")).withColumn("predicted", F.lit(7))
    out = score(clash, params).collect()
    assert len(out) == len(data) and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0 for r in out if not r.text)
    empty = rows("doc_id long, text string, toxic int", [])
    nothing = learn(empty.select("doc_id", "text"), empty.select("doc_id", "toxic"))
    assert score(empty, nothing).count() == 0 and score(frame, nothing).filter("predicted = 1").count() == 0
