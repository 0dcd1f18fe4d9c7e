"""Archived predictions and probe answers: a sound file is accepted, and one broken file for each rule is not."""

import json

import pytest

from strataweave.operators.checks import accepted
from strataweave.sources import archive as A

PATTERN = r"/([^/]+)/([^/]+)/([^/]+)/seed_(\d+)\.json$"
SOUND = {"dataset": "hi", "model": "m1", "seed": 7, "predictions": [
    {"case_id": "amlc_00000", "illicit": True, "center_edge_id": "e_0", "gt_label": 1}, {"case_id": "amlc_00001", "illicit": 0}, {"case_id": "amlc_00002", "illicit": None, "gt_label": 0},
]}


@pytest.fixture
def cases(spark):
    return spark.createDataFrame([("amlc_00000", "e_0", 1), ("amlc_00001", "e_1", 0), ("amlc_00002", "e_2", 0)], "case_id string, edge_id string, label int")


def report(spark, cases, folder, data):
    path = folder / "hi" / "m1" / "text" / "seed_7.json"
    path.parent.mkdir(parents=True)
    path.write_text(json.dumps(data, indent=1))
    return A.archive_report(cases, A.archive(spark, f"file://{path}", PATTERN))


def test_a_sound_file_is_accepted(spark, cases, tmp_path):
    row = accepted(report(spark, cases, tmp_path, SOUND), A.RULES).collect()[0]
    assert (row.dataset, row.model, row.method, row.seed) == ("hi", "m1", "text", "7")
    assert (row.records, row.missing_illicit, row.null_illicit, row.non_binary_illicit, row.flag, row.missing_edge, row.checked_label) == (3, 0, 1, 0, 1, 2, 2)


def changed(**more):
    return {**SOUND, **more}


def with_record(i, **more):
    return changed(predictions=[{**r, **more} if j == i else r for j, r in enumerate(SOUND["predictions"])])


@pytest.mark.parametrize("rule, data", [
    ("bad_metadata", changed(dataset="li")), ("bad_metadata", changed(seed=8)), ("bad_metadata", changed(model=None)), ("bad_metadata", changed(method="table")), ("no_list", changed(predictions={"case_id": "amlc_00000"})),
    ("no_list", {"dataset": "hi"}), ("invalid_case", with_record(1, case_id="case 1")), ("invalid_case", with_record(1, case_id=1)), ("unknown_case", with_record(1, case_id="amlc_00009")), ("repeated_case", with_record(1, case_id="amlc_00002")),
    ("wrong_edge", with_record(1, center_edge_id="e_2")), ("wrong_label", with_record(1, gt_label=1)), ("missing_case", changed(predictions=SOUND["predictions"][:2])), ("missing_case", changed(predictions=[])),
])
def test_each_rule(spark, cases, tmp_path, rule, data):
    got = report(spark, cases, tmp_path, data)
    assert got.collect()[0][rule] > 0
    with pytest.raises(ValueError):
        accepted(got, A.RULES)


def test_kinds_of_verdicts(spark):
    kinds = ['{}', '{"illicit": null}', '{"illicit": true}', '{"illicit": false}', '{"illicit": 1}', '{"illicit": 0}', '{"illicit": 2}', '{"illicit": 1.0}', '{"illicit": 0.0}', '{"illicit": "no"}', '{"illicit": ""}', '{"illicit": []}', '{"illicit": [0]}', '{"illicit": {}}', '{"illicit": "[]"}']
    rows = spark.createDataFrame(list(enumerate(kinds)), "i int, t string").selectExpr("i", "parse_json(t) AS record")
    for r in A.read_record(rows).collect():
        said = json.loads(kinds[r.i])
        v = said.get("illicit", False)
        want = (int(bool(v)), int("illicit" not in said), int("illicit" in said and v is None), int(v is not None and not (type(v) in (bool, int) and v in (0, 1))))
        if "illicit" not in said:
            want = (0, 1, 0, 0)
        assert (r.flag, r.missing_illicit, r.null_illicit, r.non_binary_illicit) == want, kinds[r.i]


def test_probe_answers(spark, tmp_path):
    lines = [
        {"model": "a", "variant": "x", "case_id": "v2_00012", "class": "cycle", "label": 1, "parsed": {"observed_pattern": "cycle", "conclusion": "yes"}, "usage": {"input_tokens": 5}, "latency_ms": 12.34, "thinking": "long", "response_text": "t"},
        {"model": "a", "variant": "x", "case_id": "amlc_00013", "error": "time", "parsed": None},
        {"model": "a", "variant": "x", "case_id": "elsewhere_1"},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    got = sorted((tuple(r) for r in A.probe_answers(spark, f"file://{tmp_path}/r.jsonl").collect()), key=repr)
    assert ("a", "x", "amlc_00012", "cycle", 1, "cycle", "yes", 0, 5, 0, 12.3, 2, 1, None) in got
    assert ("a", "x", "amlc_00013", "", 0, "", "", 1, 0, 0, 0.0, 0, 0, None) in got
    assert sorted(r[-1] or "" for r in got) == ["", "", "no JSON", "no case"]
