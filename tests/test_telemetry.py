"""Counters, leaves, decoding and documents against worked values."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import leaves as L
from millrace.operators import audit, experiment, redaction, signals, spool
from millrace.plans import profile
from millrace.sources import otlp, spool as spool_source

SESSION = "00000000-0000-4000-8000-000000000001"


def point(value, start=None, temporality=2, kind="input", session=SESSION):
    p = {"attributes": [{"key": "session.id", "value": {"stringValue": session}}, {"key": "type", "value": {"stringValue": kind}}], "asInt": str(value)}
    return p | ({"startTimeUnixNano": start} if start else {}), temporality


def export(*points, scope="com.anthropic.claude_code"):
    return "".join(json.dumps({"resourceMetrics": [{"scopeMetrics": [{"scope": {"name": scope}, "metrics": [{"name": "claude_code.token.usage", "sum": {"aggregationTemporality": t, "dataPoints": [p]}}]}]}]}) for p, t in points)


def tokens(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    decoded = otlp.read_exports(spark, str(tmp_path / "e.json"))
    ids = spark.createDataFrame([(SESSION,)], "session string")
    return signals.tokens(decoded, ids).first()


@pytest.mark.parametrize(
    "points, total",
    [
        ([point(100, temporality=1), point(200, temporality=1), point(300, temporality=1)], 600),
        ([point(100, "1"), point(20, "2"), point(500)], 520),
        ([point(100, "1"), point(100, "2"), point(100, "3"), point(150)], 350),
        ([point(500, "1"), point(900, "1"), point(700, "1")], 900),
        ([point(120, "0"), point(100), point(60)], 120),
    ],
)
def test_counter_merge(spark, tmp_path, points, total):
    got = tokens(spark, tmp_path, export(*points))
    assert (got.state, got.input, got.output) == ("present", total, None)


def test_mixed_series_is_refused(spark, tmp_path):
    got = tokens(spark, tmp_path, export(point(100, temporality=1), point(200, "1")))
    assert got.state == "unknown" and "1 time series carried both" in got.reason


def test_foreign_scope_and_other_session_are_counted(spark, tmp_path):
    got = tokens(spark, tmp_path, export(point(5), scope="other.tool") + export(point(7, session="else")))
    assert got.reason.endswith("1 data point not carrying session.id " + SESSION + " and 1 data point recorded by an instrumentation scope that is not claude_code's")


def test_a_bad_byte_fails_the_file():
    rows = otlp.decode("f", b'{"resourceMetrics": []} {"a": tru}')
    assert len(rows) == 1 and rows[0]["error"].startswith("malformed JSON at byte") and "batch 2" in rows[0]["error"]
    assert otlp.decode("f", b"\xef\xbb\xbf  ")[0]["error"] == "OTel export file is empty"
    assert "is array" in otlp.decode("f", b"[1]")[0]["error"]


def test_identity_tells_kinds_apart():
    one = lambda v: otlp.attributes_identity([{"key": "k", "value": v}])
    assert one({"intValue": "5"}) == one({"intValue": otlp._Number("5")}) != one({"stringValue": "5"})
    pair = lambda *ks: {"kvlistValue": {"values": [{"key": k, "value": {"stringValue": k}} for k in ks]}}
    assert one(pair("a", "b")) == one(pair("b", "a"))


def test_leaves(spark):
    rows = spark.createDataFrame([("5",), ('"5"',), ('" 5 "',), ("5.5",), ("1e300",), ("-0.4",), ("-0.5",), (None,)], "raw string")
    got = rows.select(L.int_leaf(F.col("raw")).alias("i"), L.count_gate(F.col("raw"), F.lit(None).cast("string")).alias("g"), L.count_leaf(F.col("raw"), F.lit(None).cast("string")).alias("n")).collect()
    assert [r.i for r in got] == [5, 5, None, None, None, None, None, None]
    assert [r.g for r in got] == ["ok", "ok", "unreadable", "ok", "not_a_count", "ok", "not_a_count", "unreadable"]
    assert [r.n for r in got] == [5, 5, None, 6, None, 0, None, None]
    t = spark.createDataFrame([(1789332595100000000,), (0,), (None,)], "ns long").select(L.rfc3339_nanos("ns" and F.col("ns")).alias("t")).collect()
    assert [x.t for x in t] == ["2026-09-13T20:49:55.1Z", "1970-01-01T00:00:00Z", ""]


def test_profile_of_an_unreadable_file_is_an_error(spark, tmp_path):
    (tmp_path / "e.json").write_text("{")
    ids = spark.createDataFrame([(SESSION,)], "session string")
    row = profile.profiles(otlp.read_exports(spark, str(tmp_path / "e.json")), ids).first()
    assert row.tokens.state == row.timing.state == row.tool_calls.state == "error" and row.tokens.value is None


def test_redaction_and_stripping():
    text = '{"API-Key": "x", "n": 12345678901234567890123, "a": ["Bearer abc", {"prompt": "héllo"}]}'
    assert redaction.kept_payload(text, True) == '{"API-Key":"[REDACTED]","n":12345678901234567890123,"a":["[REDACTED]",{"prompt":{"_stripped_bytes":8}}]}'
    assert redaction.kept_payload("no json Bearer abc", True) == '"no json Bearer abc"'
    assert redaction.kept_payload('{"a":1} x', False) == '"{\\"a\\":1} x"'


def test_spool_lines(spark, tmp_path):
    (tmp_path / "2026-09-13.jsonl").write_text('{"ts":"2026-09-13T01:00:00Z","event":"stop","raw":{"a":"b"}}\n\n{"ts":5}\nnull\nnot json\n')
    got = spool_source.read_spool(spark, str(tmp_path))
    s = spool.summary(got).first()
    assert (s.lines, s.envelopes, s.unreadable_lines, s.object_payloads) == (4, 2, 2, 1) and spool_source.spool_files(spark, str(tmp_path)) == 1


def test_experiment_rules():
    side = {"command": "run $TASK $PROFILE $HOME", "snapshot_hash": "h", "skill_dir": "d"}
    good = experiment.with_defaults({"name": "n", "task_families": ["a b"], "baseline": side, "candidate": side})
    assert experiment.design_refusal(good) is None
    assert experiment.design_refusal(good | {"ordering": "random"}).startswith('ordering: "random"')
    assert experiment.design_refusal(good | {"task_families": []}).startswith("task_families: ")
    assert experiment.substituted("run $TASK $PROFILE $HOME", {"TASK": "$REP", "REP": "1", "PROFILE": "p"}) == "run $REP p $HOME"


def test_audit(spark):
    fine = "---\nlicense: MIT\n---\n## When to use\n## Process\n## Example\n## Deterministic\n## Orchestration\n## Constraints\n- x\n```sh\n./scripts/a.sh\n```\n[l](b.md)"
    docs = spark.createDataFrame([("ok", fine), ("bare", "")], "skill string, text string")
    files = spark.createDataFrame([("ok", "scripts/a.sh"), ("ok", "b.md")], "skill string, path string")
    got = {r.skill: (r.passed, r.exit_status, r.structure) for r in audit.report(docs, files).collect()}
    assert got == {"ok": (True, 0, 0), "bare": (False, 2, 9)}


def test_decoded_records_equal_their_sql_at_time_0(spark, tmp_path):
    import duckdb

    from millrace.plans import registry

    events = [(i, 9 + i % 5, ("click", "error")[i % 2]) for i in range(40)]  # the first file that is read whole holds event 0
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = registry.QUERIES["decode_records"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = "file, session, scope, name, ns, tool_name, success"
    expected = db.execute(f"SELECT {columns} FROM ({registry.ORACLE_SQL['decode_records']})").fetchall()
    rows = [tuple(r) for r in got.select(*columns.split(", ")).collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr) and 0 in [r[4] for r in rows]
