"""Hook registrations, drafts, steps of an experiment and the rules of frontmatter."""

import json
import os
from datetime import UTC, datetime

import pytest

from millrace.operators import audit, experiment
from millrace.sources import drafts, hooks

NOW = datetime(2026, 9, 13, 20, 49, 55, tzinfo=UTC)


def test_hooks_come_and_go(tmp_path):
    path = tmp_path / "conf" / "hooks.json"
    first = hooks.install(str(path), "spool it", now=NOW)
    assert (first["events_registered"], first["backup"], first["schema_version_added"]) == (21, None, True)
    assert path.stat().st_mode & 0o777 == 0o600
    again = hooks.install(str(path), "spool it", now=NOW)
    assert (again["events_registered"], again["backup"]) == (0, None) and len(os.listdir(path.parent)) == 1
    gone = hooks.uninstall(str(path), "spool it", now=NOW)
    assert gone["events_removed"] == 21 and gone["backup"].endswith(".bak-20260913T204955Z")
    assert json.loads(path.read_text()) == {"version": 1, "hooks": {}}


def test_hooks_of_others_stay(tmp_path):
    path = tmp_path / "hooks.json"
    theirs = {"version": 2, "extra": [1], "hooks": {"stop": [{"command": "other"}, "odd"], "theirOwn": [{"command": ["spool it"]}]}}
    path.write_text(json.dumps(theirs))
    hooks.install(str(path), "spool it", now=NOW)
    now = json.loads(path.read_text())
    assert now["version"] == 2 and now["extra"] == [1] and now["hooks"]["stop"] == [{"command": "other"}, "odd", {"command": "spool it"}]
    hooks.uninstall(str(path), "spool it", now=NOW)
    assert json.loads(path.read_text()) == theirs


@pytest.mark.parametrize("text", ["{", "[]", "3"])
def test_hooks_unreadable_is_untouched(tmp_path, text):
    path = tmp_path / "hooks.json"
    path.write_text(text)
    with pytest.raises(ValueError, match="untouched"):
        hooks.install(str(path), "c")
    assert path.read_text() == text and os.listdir(tmp_path) == ["hooks.json"]


def test_hooks_without_a_file(tmp_path):
    assert hooks.uninstall(str(tmp_path / "none.json"), "c")["events_removed"] == 0
    assert os.listdir(tmp_path) == []


def test_drafts_stay_inside(tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "in-two"
    inside.mkdir()
    outside.mkdir()
    (inside / "way").symlink_to(outside)
    may = {"within": [str(inside)]}
    assert drafts.write_draft(str(inside / "d.md"), ["a", "é"], **may) == 3
    for bad in (str(outside / "d"), str(inside / "way" / "d"), str(inside / ".." / "d"), str(inside), ""):
        with pytest.raises(ValueError):
            drafts.write_draft(bad, ["a"], **may)
    (inside / "link").symlink_to(inside / "d.md")
    assert "link" in drafts.refusal(str(inside / "link"), **may)
    assert "stay out" in drafts.refusal(str(inside / "d.md"), within=[str(inside)], never=[str(tmp_path)])
    assert drafts.contains(str(inside), str(inside / ("x/" * 1000)))


def test_failed_draft_leaves_nothing(tmp_path):
    def pieces():
        yield "a"
        raise RuntimeError("half-way")

    with pytest.raises(RuntimeError):
        drafts.write_draft(str(tmp_path / "d"), pieces(), within=[str(tmp_path)])
    assert os.listdir(tmp_path) == []
    assert drafts.to_document({"a": "<&>"}) == '{\n  "a": "\\u003c\\u0026\\u003e"\n}\n'


def test_steps_must_write_their_profile(tmp_path):
    path = str(tmp_path / "runs" / "p.json")
    with pytest.raises(RuntimeError, match="no profile"):
        experiment.carry_out("true", path)
    experiment.carry_out(f"echo out; echo 1 > '{path}'", path)
    with pytest.raises(RuntimeError, match="no profile"):
        experiment.carry_out("true", path)
    with pytest.raises(RuntimeError, match="status 3"):
        experiment.carry_out("exit 3", path)
    step = {"harness": "h", "snapshot_hash": "s", "skill_dir": None}
    assert experiment.profile_mismatch({"harness": "h", "snapshot_hash": "s"}, step) is None
    assert experiment.profile_mismatch({"harness": "h", "snapshot_hash": "t"}, step).startswith("snapshot_hash")


def test_frontmatter_rules(spark):
    front = {
        "good-one": "name: good-one\ndescription: 'Use when.'\nlicense: MIT",
        "other": "name: good-one\ndescription: d",
        "Bad_Name": 'name: "Bad_Name"\ndescription: d',
        "a" * 65: f"name: {'a' * 65}\ndescription: {'d' * 1025}",
        "bare": "name:\nlicense: MIT",
    }
    docs = spark.createDataFrame([(k, f"---\n{v}\n---\nbody") for k, v in front.items()] + [("null", None), ("empty", "")], "skill string, text string")
    found = {}
    for r in audit.spec_findings(audit.sections(docs)).collect():
        found.setdefault(r.skill, set()).add(r.rule)
    nothing = {"SPEC001", "SPEC004"}
    assert found == {"other": {"SPEC002"}, "Bad_Name": {"SPEC003"}, "a" * 65: {"SPEC003", "SPEC005"}, "bare": nothing, "null": nothing, "empty": nothing}
    assert audit.spec_findings(audit.sections(docs.limit(0))).count() == 0
