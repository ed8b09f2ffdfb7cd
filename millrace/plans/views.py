"""The relations that operators work on, laid over the driver's tables; each is written in both engines' SQL at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: One text for both engines, but for the few places named in {braces}.
SPOOL = """
SELECT event_id,
       {ts} AS ts,
       CASE event_type WHEN 'signup' THEN 'sessionStart' WHEN 'click' THEN 'preToolUse' WHEN 'view' THEN 'postToolUse' WHEN 'error' THEN 'postToolUseFailure'
                       ELSE CASE WHEN event_id % 2 = 0 THEN 'subagentStart' ELSE 'subagentStop' END END AS event,
       'spool/v1' AS schema_version,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS {text}) END AS conversation_id,
       CASE WHEN event_id % 10 = 0 THEN TRUE WHEN event_id % 10 < 7 THEN FALSE END AS strict,
       CASE WHEN event_id % 13 = 0 THEN concat('"note ', event_id, ' über"')
            ELSE concat('{{"hook_event_name":"', event_type, '","model":"m', user_id % 5, '","duration":', event_id % 1000, ',"session_id":"s', user_id % 40, '"',
                        CASE WHEN event_id % 3 <> 0 THEN concat(',"tool_name":"t', user_id % 7, '"') ELSE '' END,
                        CASE WHEN event_id % 4 = 0 THEN concat(',"prompt":"word ', event_id, '"') ELSE '' END,
                        CASE WHEN event_id % 3 = 0 THEN concat(',"subagent_type":"a', event_id % 4, '","duration_ms":', event_id % 5000, ',"tool_call_count":', event_id % 9) ELSE '' END, '}}') END AS raw
FROM {events}
"""

POINTS = """
SELECT CAST(l_orderkey % 20 AS {text}) AS session,
       concat(l_suppkey, '|', l_returnflag) AS series,
       CASE l_suppkey % 4 WHEN 0 THEN 'input' WHEN 1 THEN 'output' WHEN 2 THEN 'cacheRead' ELSE 'cacheCreation' END AS label,
       CAST(l_quantity AS BIGINT) AS value,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS start_ns,
       CASE WHEN l_suppkey % 10 = 0 THEN l_linestatus = 'F' ELSE l_suppkey % 3 <> 0 END AS cumulative,
       l_orderkey, l_linenumber, l_suppkey
FROM {lineitem}
"""

RAW_POINTS = """
SELECT p.*,
       CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN '"2"' WHEN 3 THEN '"AGGREGATION_TEMPORALITY_CUMULATIVE"' WHEN 4 THEN '0' WHEN 5 THEN '2' ELSE '"soon"' END AS temporality_raw,
       CASE WHEN l_orderkey % 17 = 0 THEN 'total' ELSE label END AS type_attr,
       CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 5 = 1 THEN concat(value, '.5') WHEN l_orderkey % 5 = 2 THEN concat('"', value, '"') WHEN l_orderkey % 5 = 3 THEN concat('-', value, '.25') ELSE '"x"' END AS as_double_raw,
       CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN concat('"', value, '"') ELSE concat('-', value) END AS as_int_raw,
       CASE WHEN l_orderkey % 19 = 0 THEN 'com.other.tool' WHEN l_orderkey % 2 = 0 THEN '' ELSE 'com.anthropic.claude_code' END AS scope
FROM ({points}) p
"""

RECORDS = """
SELECT event_id,
       CASE WHEN user_id % 9 = 0 THEN NULL ELSE CAST(user_id AS {text}) END AS session,
       CASE WHEN event_id % 19 = 0 THEN 'other.scope' WHEN event_id % 3 = 0 THEN '' ELSE 'com.anthropic.claude_code' END AS scope,
       CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'claude_code.tool_result' WHEN event_id % 4 = 2 THEN NULL ELSE CASE WHEN event_id % 8 = 3 THEN 'claude_code.api_request' ELSE 'other.event' END END AS body,
       CASE event_id % 5 WHEN 0 THEN 'tool_result' WHEN 1 THEN 'claude_code.tool_decision' WHEN 2 THEN 'skill_activated' WHEN 3 THEN 'api_request' END AS event_attr,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE {nanos} END AS ns,
       CASE WHEN event_id % 29 = 0 THEN '' ELSE event_type END AS tool_name,
       CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '"T"' WHEN event_id % 7 = 2 THEN '"yes"' WHEN event_type = 'error' THEN 'false' ELSE 'true' END AS success_raw,
       CASE event_id % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'accept' END AS decision,
       CASE WHEN event_id % 31 = 0 THEN '' ELSE concat('skill-', user_id % 6) END AS skill_name,
       CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'model' END AS {trigger}
FROM {events}
"""

SKILLS = """
SELECT concat('skill-', doc_id) AS skill,
       concat(CASE WHEN doc_id % 7 <> 0 THEN concat('---\\nname: skill-', doc_id, '\\n', CASE WHEN doc_id % 4 <> 1 THEN 'license: MIT\\n' ELSE 'License: MIT\\n' END, '---\\n') ELSE '' END,
              CASE WHEN doc_id % 3 <> 0 THEN '## When to use\\n\\nAlways.\\n\\n' ELSE '' END,
              CASE WHEN doc_id % 5 <> 0 THEN '### The Process\\n\\n- one\\n- two\\n\\n' ELSE '' END,
              CASE WHEN doc_id % 2 = 0 THEN '## EXAMPLE\\n\\n## deterministic parts\\n\\n' ELSE '## Orchestration\\n\\n## Validation\\n\\n' END,
              CASE WHEN doc_id % 6 <> 0 THEN '## Constraints\\n' ELSE '' END,
              CASE WHEN doc_id % 4 <> 0 THEN concat('```bash\\n./scripts/run-', doc_id % 5, '.sh x\\n"$HOME/scripts/y.sh"\\n```\\n') ELSE '' END,
              CASE WHEN doc_id % 9 = 0 THEN repeat('line\\n', 501) ELSE '' END,
              'See [guide](references/guide-', doc_id % 5, '.md), [site](https://example.org), [all](assets/*.png) and [top](#top).\\n') AS text
FROM {documents}
"""

#: Files of every skill: those numbered 0, 1 and 2.
FILES = """
SELECT concat('skill-', doc_id) AS skill, concat(kind, n, ext) AS path FROM {documents}, (VALUES ('scripts/run-', '.sh'), ('references/guide-', '.md')) k(kind, ext), (VALUES (0), (1), (2)) m(n)
"""

SPARK = {"text": "STRING", "ts": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "nanos": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts) * 1000 + event_id % 1000", "trigger": "trigger"}
DUCKDB = {"text": "VARCHAR", "ts": "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", "nanos": "epoch_us(ts) * 1000 + event_id % 1000", "trigger": '"trigger"'}


def spark_view(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("events", "lineitem", "documents")}
    return spark.sql(_filled(template, SPARK | tables))


def duckdb_view(template: str) -> str:
    text = _filled(template, DUCKDB | {t: t for t in ("events", "lineitem", "documents")})
    # text literals with \\n in them, as DuckDB writes them
    return re.sub(r"'[^']*'", lambda m: ("E" + m[0]) if "\\" in m[0] else m[0], text)


def _filled(template: str, values: dict[str, str]) -> str:
    return template.format(**values | {"points": POINTS.format(**values)})
