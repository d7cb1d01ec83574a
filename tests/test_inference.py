import json
import os

import pytest

from devident.operators.inference import (
    ModelSettings, build_requests, infer, infer_in_rounds, rejected_requests, run_records, sweep, with_settings,
)

GOOD = "cpe:2.3:h:v:p" + ":*" * 8


@pytest.fixture
def inputs(rows):
    return rows("id long, input_payload_json string", [(1, "one"), (2, "two"), (3, "boom"), (4, "null"), (5, "none")])


@pytest.fixture
def prompts(rows):
    return rows("id long, prompt_text string", [(1, "System A"), (2, "System B")])


@pytest.fixture
def backend():
    class Echo:
        def chat(self, messages, *, temperature, top_p, seed, max_tokens):
            assert [m["role"] for m in messages] == ["system", "user"]
            text = messages[1]["content"]
            if text == "boom":
                raise RuntimeError("no answer")
            if text == "null":
                return '{"cpes": null}'
            if text == "none":
                return "I cannot say"
            return ' {"cpes": ["cpe:2.3:h:v:p%s", "%s %s %s"]}\n' % (":*" * 8, messages[0]["content"], seed, max_tokens)

    return lambda name, version: Echo()


def test_grid(inputs):
    grid = sweep(inputs, [1, 2], [ModelSettings("a"), ModelSettings("b", seed=None)])
    assert grid.count() == 20
    assert {r.seed for r in grid.collect()} == {42, None}


def test_requests_and_rejects(inputs, prompts, rows):
    asked = with_settings(
        rows("aggregated_input_id long, prompt_id long", [(1, 1), (9, 1), (2, 9), (9, 9)]), ModelSettings("m")
    )
    requests = build_requests(asked, inputs, prompts).collect()
    assert [[(m.role, m.content) for m in r.messages] for r in requests] == [[("system", "System A"), ("user", "one")]]
    rejects = rejected_requests(asked, inputs, prompts).collect()
    assert sorted((r.aggregated_input_id, r.prompt_id, r.reason) for r in rejects) == [
        (2, 9, "unknown prompt"), (9, 1, "unknown input"), (9, 9, "unknown input"),
    ]


def test_runs(inputs, prompts, backend):
    asked = sweep(inputs, [1], [ModelSettings("m", "v", 0.5, 0.9, 64, 2**60 + 1)])
    records = {r.aggregated_input_id: r for r in run_records(infer(build_requests(asked, inputs, prompts), backend)).collect()}
    one = records[1]
    assert one.raw_output_text == '{"cpes": ["%s", "System A %d 64"]}' % (GOOD, 2**60 + 1)
    assert json.loads(one.parsed_output_json) == {"cpes": [GOOD]}
    assert json.loads(one.conversation_history_json) == [
        {"role": "system", "content": "System A"}, {"role": "user", "content": "one"},
    ]
    assert (one.status, one.error_text, one.trial_number, one.seed, one.temperature, one.max_tokens) == (
        "complete", None, 1, 2**60 + 1, 0.5, 64,
    )
    assert one.started_at <= one.ended_at and one.started_at.endswith("+00:00")
    assert (records[3].status, records[3].error_text, records[3].raw_output_text) == ("error", "no answer", "")
    assert (records[4].status, records[4].error_text, records[4].raw_output_text) == (
        "error", "'NoneType' object is not iterable", '{"cpes": null}',
    )
    assert (records[5].status, records[5].parsed_output_json) == ("complete", None)


def test_no_seed_and_broken_backend(inputs, prompts, backend):
    def broken(name, version):
        raise ValueError("no model")

    asked = build_requests(sweep(inputs, [2], [ModelSettings("m")]), inputs, prompts)
    failed = infer(asked, broken).collect()
    assert {(r.status, r.error_text) for r in failed} == {("error", "no model")}


def test_each_model_answers_for_itself_in_many_tasks(spark, inputs, prompts):
    class Named:
        def __init__(self, name, version):
            self.name, self.supports_seed = f"{name}-{version}", name == "a"

        def chat(self, messages, *, seed, **settings):
            from pyspark import TaskContext

            return f"{self.name} {seed} task {TaskContext.get().partitionId()}"

    asked = build_requests(sweep(inputs, [1], [ModelSettings("a", "1", seed=t) for t in range(30)] + [ModelSettings("b", "2", seed=t) for t in range(30)]), inputs, prompts)
    answers = infer(asked, lambda name, version: Named(name, version), tasks=6).collect()
    assert all(r.raw_output_text.startswith(f"{r.model_name}-{r.model_version} {r.seed} ") for r in answers)
    assert {r.seed for r in answers if r.model_name == "b"} == {None} and 29 in {r.seed for r in answers}
    assert infer(asked, lambda name, version: Named(name, version), tasks=6).rdd.getNumPartitions() == 6


def counted(notes, left=None):
    """A backend that notes every call in a file; a worker dies at a call after `left` of them."""

    class Model:
        def chat(self, messages, **settings):
            with open(notes, "a") as f:
                f.write(messages[1]["content"] + "\n")
            if left is not None and sum(1 for _ in open(notes)) > left:
                os._exit(1)
            return f"answer to {messages[1]['content']}"

    return lambda name, version: Model()


def test_answers_survive_a_lost_task(spark, rows, prompts, tmp_path):
    inputs = rows("id long, input_payload_json string", [(i, f"text {i}") for i in range(40)])
    grid = with_settings(rows("aggregated_input_id long, prompt_id long", [(i, 1) for i in range(40)] + [(7, 1)] * 2), ModelSettings("m"))
    requests = build_requests(grid, inputs, prompts)
    notes, folder = str(tmp_path / "calls"), str(tmp_path / "answers")
    with pytest.raises(Exception):
        infer_in_rounds(requests, counted(notes, 25), folder, 6, 1)
    first = open(notes).read().splitlines()
    kept = spark.read.parquet(f"{folder}/round-*").count()
    assert 0 < kept <= 25 <= len(first)
    answered = infer_in_rounds(requests, counted(notes), folder, 6, 1)
    assert sorted(r.aggregated_input_id for r in answered.collect()) == sorted([*range(40), 7, 7])
    assert set(answered.columns) == set(infer(requests, counted(notes), 1).columns)
    # only what has no answer is asked again: at most the calls of the round that died
    assert len(open(notes).read().splitlines()) - len(first) == 42 - kept
    before = len(open(notes).read().splitlines())
    again = infer_in_rounds(requests.filter("aggregated_input_id < 5"), counted(notes), folder, 3, 1)
    assert again.count() == 5 and len(open(notes).read().splitlines()) == before
    assert {r.raw_output_text for r in again.collect()} == {f"answer to text {i}" for i in range(5)}


def test_rounds_without_requests(rows, inputs, prompts, tmp_path):
    requests = build_requests(with_settings(rows("aggregated_input_id long, prompt_id long", [(99, 1)]), ModelSettings("m")), inputs, prompts)
    got = infer_in_rounds(requests, lambda name, version: None, str(tmp_path / "none"), 2, 1)
    assert got.count() == 0 and "raw_output_text" in got.columns and "_copy" not in got.columns
