import json
import random

import pytest

from devident.operators.outputs import accepted_entries
from devident.operators.scoring import rescore, score_predictions, score_runs, score_status, scoring_context, unscored_runs

TAIL = ":*" * 7


def cpe(version, product="p"):
    return f"cpe:2.3:a:v:{product}:{version}{TAIL}"


# predicted, accepted (version, tier) in order: matched place, exact, valid, tier, score
GOLDENS = [
    ("1.0", [("1.0", "exact")], 0, 1, 1, "exact", 1.0),
    ("2.0", [("1.0", "exact")], 0, 0, 1, "exact", 1.0),
    ("*", [("1.0", "exact")], 0, 0, 1, "exact", 1.0),
    ("1.0", [("*", "partial")], 0, 1, 1, "partial", 0.5),
    ("1.0", [("1.0", "partial"), ("2.0", "exact")], 1, 0, 1, "exact", 1.0),
    ("1.0", [("*", "exact"), ("1.0", "exact")], 0, 1, 1, "exact", 1.0),
    ("1.0", [("2.0", "exact"), ("1.0", "exact")], 1, 1, 1, "exact", 1.0),
    ("1.0", [("1.0", "related")], 0, 1, 1, "related", 0.25),
    ("1.0", [("1.0", "odd")], 0, 1, 1, "odd", 0.0),
    ("1.0", [("1.0", None)], 0, 1, 1, None, 0.0),
    ("1.0", [("2.0", "odd"), ("2.0", "none"), ("1.0", None)], 2, 1, 1, None, 0.0),
    ("1.0", [], None, 0, 0, "none", 0.0),
]


@pytest.fixture
def tables(rows):
    def make(truth, runs, scores=()):
        """Device, session and input share the truth's key; runs are (id, input, document, status)."""
        keys = sorted({r[1] for r in runs})
        return {
            "inputs": rows("id long, scan_session_id long", [(k, k) for k in keys]),
            "sessions": rows("id long, device_id long", [(k, k) for k in keys]),
            "truth": rows("id long, device_id long, accepted_cpes_json string", truth),
            "runs": rows("id long, aggregated_input_id long, parsed_output_json string, status string", runs),
            "scores": rows("id long, model_run_id long, predicted_cpe string", list(scores)),
        }

    return make


def scored(t):
    return score_runs(t["runs"], t["inputs"], t["sessions"], t["truth"], accepted_entries(t["truth"]))


def test_goldens(tables):
    truth = [
        (i, i, json.dumps([{"cpe": cpe(v), "tier": tier} for v, tier in accepted] + ["bad", {"cpe": cpe("1.0", "other")}]))
        for i, (_, accepted, *_) in enumerate(GOLDENS)
    ]
    runs = [(i, i, json.dumps({"cpes": [cpe(g[0])]}), "complete") for i, g in enumerate(GOLDENS)]
    for r in scored(tables(truth, runs)).collect():
        predicted, accepted, place, exact, valid, tier, score = GOLDENS[r.model_run_id]
        matched = cpe(accepted[place][0]) if place is not None else None
        assert (r.matched_accepted_cpe, r.exact_match, r.cve_lookup_valid, r.best_match_tier, r.match_score) == (
            matched, exact, valid, tier, score,
        ), GOLDENS[r.model_run_id]
        assert (r.part_correct, r.vendor_correct, r.product_correct, r.version_correct) == (valid, valid, valid, exact)
        assert (r.predicted_vendor, r.predicted_product, r.score_notes, r.scorer_version) == ("v", "p", None, "1.0")


def test_malformed_and_silent_runs(tables):
    t = tables(
        [(1, 1, "[]")],
        [(1, 1, '{"cpes": ["bad", null]}', "complete"), (2, 1, None, "complete"), (3, 9, '{"cpes": ["x"]}', "complete")],
    )
    found = sorted(
        (r.model_run_id, -1 if r.pos is None else r.pos, r.predicted_cpe, r.score_notes, r.best_match_tier, r.match_score)
        for r in scored(t).collect()
    )
    assert found == [
        (1, 0, "bad", "malformed CPE string", "none", 0.0),
        (1, 1, None, "malformed CPE string", "none", 0.0),
        (2, -1, None, "no predicted CPEs", "none", 0.0),
    ]


def best_by_brute_force(predicted, accepted):
    """Plain loop over the list: tier, then version, then order."""
    fields = predicted.split(":")
    if len(fields) != 13:
        return None
    ranks, best, best_key = {"exact": 3, "partial": 2, "related": 1}, None, None
    for entry in accepted:
        other = entry["cpe"].split(":")
        if len(other) != 13 or other[2:5] != fields[2:5]:
            continue
        key = (ranks.get(entry["tier"], 0), other[5] in ("*", fields[5]))
        if best_key is None or key > best_key:
            best, best_key = (entry["cpe"], entry["tier"], int(key[1])), key
    return best


def test_random_lists_against_brute_force_with_a_hot_device(tables, rows):
    """One device holds a third of all predictions, one run of it most of them."""
    rng = random.Random(7)
    tiers, versions = ["exact", "partial", "related", "none", "odd", None], ["1", "2", "3", "*"]

    def some_cpe():
        part, vendor, product = rng.choice("ao"), rng.choice("uv"), rng.choice("pq")
        return "bad" if rng.random() < 0.05 else f"cpe:2.3:{part}:{vendor}:{product}:{rng.choice(versions)}:{rng.choice('xy')}" + ":*" * 6

    lists = {d: [{"cpe": some_cpe(), "tier": rng.choice(tiers)} for _ in range(rng.randint(0, 25))] for d in range(1, 40)}
    predictions, inputs = [], {}
    for run in range(1, 400):
        inputs[run] = 1 if run % 3 == 0 else rng.randint(1, 45)
        count = 900 if run == 3 else rng.randint(0, 6)
        predictions += [(run, pos, some_cpe()) for pos in range(count)]
    t = tables(
        [(d, d, json.dumps(entries)) for d, entries in lists.items()],
        [(run, device, None, "complete") for run, device in inputs.items()],
    )
    context = scoring_context(t["runs"], t["inputs"], t["sessions"], t["truth"])
    result = score_predictions(context, rows("run_id long, pos int, cpe string", predictions), accepted_entries(t["truth"]))
    expected = []
    for run, pos, predicted in predictions:
        if inputs[run] in lists:
            best = best_by_brute_force(predicted, lists[inputs[run]])
            expected.append((run, pos, predicted, *(best or (None, "none", 0))))
    given = {run for run, *_ in predictions}
    expected += [(run, None, None, None, "none", 0) for run in inputs if run not in given and inputs[run] in lists]
    found = [
        (r.model_run_id, r.pos, r.predicted_cpe, r.matched_accepted_cpe, r.best_match_tier, r.version_correct)
        for r in result.collect()
    ]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_first_label_counts(tables):
    truth = [(8, 1, json.dumps([cpe("1")])), (5, 1, "[]")]
    t = tables(truth, [(1, 1, json.dumps({"cpe": cpe("1")}), "complete")])
    row = scored(t).first()
    assert (row.ground_truth_id, row.best_match_tier) == (5, "none")


def test_incremental_scoring_and_status(tables, rows):
    t = tables(
        [(1, 1, "[]")],
        [(1, 1, None, "complete"), (2, 1, None, "error"), (3, 1, None, "complete"), (4, 7, None, "complete")],
        [(10, 3, "old"), (11, 3, "old")],
    )
    assert sorted(r.id for r in unscored_runs(t["runs"], t["scores"]).collect()) == [1, 4]
    asked = rows("model_run_id long", [(1,), (3,), (4,), (99,)])
    status = score_status(asked, t["runs"], t["inputs"], t["sessions"], t["truth"], t["scores"])
    assert {r.model_run_id: r.score_status for r in status.collect()} == {
        1: "scorable", 3: "already scored", 4: "no truth", 99: "not found",
    }


def test_rescore_keeps_runs_it_cannot_score(tables, rows):
    t = tables(
        [(1, 1, "[]")],
        [(2, 1, '{"cpe": "bad"}', "error"), (3, 1, None, "complete"), (4, 7, None, "complete")],
        [(10, 2, "old"), (11, 3, "old"), (12, 4, "old")],
    )
    asked = rows("model_run_id long", [(2,), (4,), (99,)])
    kept, fresh = rescore(asked, t["runs"], t["inputs"], t["sessions"], t["truth"], accepted_entries(t["truth"]), t["scores"])
    assert sorted(r.id for r in kept.collect()) == [11, 12]
    assert [(r.model_run_id, r.predicted_cpe) for r in fresh.collect()] == [(2, "bad")]
