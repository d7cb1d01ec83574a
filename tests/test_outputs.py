import json

from pyspark.sql import functions as F

from devident.operators.outputs import accepted_entries, extract_object, filter_predictions, predicted_cpes, with_predictions

V = "cpe:2.3:a:x:y" + ":*" * 8
# raw text, stored JSON, dropped, error, predicted list
RAW = [
    ('hi ```json\n{"cpes": ["%s", "M"]}\n``` x' % V, {"cpes": [V]}, 1, None),
    ('so {"cpes": ["%s"]} then' % V, {"cpes": [V]}, 0, None),
    ('```{broken}``` {"cpe": "%s"}' % V, {"cpe": V}, 0, None),
    ('```{"cpe": broken}``` {"cpe": "%s"}' % V, None, 0, None),
    ('```{"cpes": ["%s"]}``` ```{"cpe": "z"}```' % V, {"cpes": [V]}, 0, None),
    ('{"cpes": ["M"]}', None, 1, None),
    ('{"cpes": []}', None, 0, None),
    ('```{"other": 1}```', {"other": 1}, 0, None),
    ("```{}```", None, 0, None),
    ('{"cpes": ["%s", "%s"]}' % (V, V), {"cpes": [V, V]}, 0, None),
    ('{"cpes": "%s"}' % V, None, len(V), None),
    ('{"cpes": null}', None, 0, "'NoneType' object is not iterable"),
    ('{"cpes": 7}', None, 0, "'int' object is not iterable"),
    ('{"cpes": 1.5}', None, 0, "'float' object is not iterable"),
    ('{"cpes": true}', None, 0, "'bool' object is not iterable"),
    ('```{"cpes": {"%s": 1, "M": 2}}```' % V, {"cpes": [V]}, 1, None),
    ('{"cpe": 7}', None, 1, None),
    ('{"cpe": "a", "cpe": "%s"}' % V, {"cpe": V}, 0, None),
    ('{"cpes": ["%s", null, 7, ["%s"]]}' % (V, V), {"cpes": [V]}, 3, None),
    ('{"cpes": null, "cpe": "%s"}' % V, None, 0, "'NoneType' object is not iterable"),
    ("nothing", None, 0, None),
    (None, None, 0, None),
]


def test_extract_and_filter(rows):
    frame = rows("i int, raw string", [(i, r[0]) for i, r in enumerate(RAW)])
    for r in filter_predictions(extract_object(frame, "raw")).collect():
        _, stored, dropped, error = RAW[r.i]
        assert (json.loads(r.parsed_output_json) if r.parsed_output_json else None) == stored, RAW[r.i]
        assert (r.n_dropped, r.filter_error) == (dropped, error), RAW[r.i]


def test_text_after_the_object_is_an_error(rows):
    frame = rows("raw string", [('```{"cpe": "a"} x}```',), ('```{"cpe": "a"}, {"cpe": "b"}```',)])
    found = extract_object(frame, "raw").select(F.to_json("parsed")).collect()
    assert found[0][0] == '{"cpe":"a"}'  # the bare object is taken instead
    assert found[1][0] == '{"cpe":"a"}'


def test_stored_lists(rows):
    documents = [
        '{"cpes": ["a", null, 7, true, 1.5]}', '{"cpe": "V"}', '{"cpes": "x", "cpe": "V"}', '{"cpes": []}', "[]", "7", "",
        None, '{"cpes": ["a"]} x', '{"cpes": ["b", "b"]}',
    ]
    frame = rows("id long, parsed_output_json string", list(enumerate(documents)))
    listed = [tuple(r) for r in predicted_cpes(frame).orderBy("run_id", "pos").collect()]
    assert listed == [
        (0, 0, "a"), (0, 1, None), (0, 2, "7"), (0, 3, "1"), (0, 4, "1.5"), (1, 0, "V"), (2, 0, "V"), (9, 0, "b"), (9, 1, "b"),
    ]
    silent = with_predictions(frame).filter("pos is null")
    assert sorted(r.id for r in silent.collect()) == [3, 4, 5, 6, 7, 8]


def test_accepted_lists(rows):
    lists = [
        '["V", {"cpe": "V"}, {"cpe": "V", "tier": null}, {"tier": "exact"}, 7, {"cpe": "V", "tier": "odd"}]',
        '{"b": 1, "a": 2}', '"xy"', None, "", "[1", "7", "[]", "null",
    ]
    frame = rows("id long, device_id long, accepted_cpes_json string", [(i, 10 + i, t) for i, t in enumerate(lists)])
    found = sorted((r.truth_id, r.pos, r.cpe, r.tier) for r in accepted_entries(frame).collect() if r.truth_id == 0)
    assert found == [(0, 0, "V", "exact"), (0, 1, "V", "exact"), (0, 2, "V", None), (0, 5, "V", "odd")]
    others = sorted((r.truth_id, r.cpe, r.tier) for r in accepted_entries(frame).collect() if r.truth_id)
    assert others == [(1, "a", "exact"), (1, "b", "exact"), (2, "x", "exact"), (2, "y", "exact")]


def test_whole_long_texts_are_read(rows):
    noise = "word { not json } " * 50_000
    frame = rows(
        "i int, raw string",
        [(1, noise + '```json\n{"cpe": "%s"}\n```' % V), (2, noise + '{"cpe": "%s"}' % V + noise), (3, "```{" + "x" * 1_000_000)],
    )
    found = {r.i: r.parsed_output_json for r in filter_predictions(extract_object(frame, "raw")).collect()}
    assert found == {1: '{"cpe":"%s"}' % V, 2: '{"cpe":"%s"}' % V, 3: None}
