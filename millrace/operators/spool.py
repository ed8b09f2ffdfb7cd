"""Questions about a spool(ts, event, schema_version, conversation_id, strict, raw): eight reports, a summary and censuses.

ts is an RFC 3339 text; days and hours are those of UTC. A payload's keys are looked at only where it is an object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.redaction import censusable


def day() -> Column:
    return F.to_date(F.substring("ts", 1, 10))


def is_object(raw: Column) -> Column:
    return F.json_object_keys(raw).isNotNull()


def field(name: str) -> Column:
    """A member of an object payload as text."""
    return F.when(is_object(F.col("raw")), F.get_json_object("raw", f"$.{name}"))


def events_per_day(spool: DataFrame) -> DataFrame:
    return spool.groupBy(day().alias("day"), "event").agg(F.count("*").alias("lines"))


def conversations_per_day(spool: DataFrame) -> DataFrame:
    return spool.groupBy(day().alias("day")).agg(F.count_distinct("conversation_id").alias("conversation_ids"), F.count_if(F.col("event") == "sessionStart").alias("session_start_lines"))


def time_of_day(spool: DataFrame) -> DataFrame:
    return spool.groupBy(F.hour(F.to_utc_timestamp(F.to_timestamp("ts"), F.current_timezone())).cast("long").alias("hour_utc")).agg(F.count("*").alias("lines"), F.count_distinct("conversation_id").alias("conversation_ids"))


def model_mix(spool: DataFrame) -> DataFrame:
    return spool.select("conversation_id", field("model").alias("model_value")).where("model_value IS NOT NULL").groupBy("model_value").agg(F.count("*").alias("lines"), F.count_distinct("conversation_id").alias("conversation_ids"))


def average(value: str, event: str) -> Column:
    """Rounded mean of a payload number over the lines of one event."""
    return F.round(F.avg(F.when(F.col("event") == event, F.col(value).try_cast("double"))))


def tool_call_mix(spool: DataFrame) -> DataFrame:
    rows = spool.where(F.col("event").isin("preToolUse", "postToolUse", "postToolUseFailure")).select("event", field("tool_name").alias("tool_name_value"), field("duration").alias("d"))
    return rows.where("tool_name_value IS NOT NULL").groupBy("tool_name_value").agg(
        F.count_if(F.col("event") == "preToolUse").alias("pre_tool_use_lines"), F.count_if(F.col("event") == "postToolUseFailure").alias("post_tool_use_failure_lines"), average("d", "postToolUse").alias("avg_duration_field")
    )


def subagent_usage(spool: DataFrame) -> DataFrame:
    rows = spool.where(F.col("event").isin("subagentStart", "subagentStop")).select("event", field("subagent_type").alias("subagent_type_value"), field("duration_ms").alias("d"), field("tool_call_count").alias("n"))
    return rows.where("subagent_type_value IS NOT NULL").groupBy("subagent_type_value").agg(
        F.count_if(F.col("event") == "subagentStart").alias("subagent_start_lines"), average("d", "subagentStop").alias("avg_duration_ms_field"), average("n", "subagentStop").alias("avg_tool_call_count_field")
    )


def payload_sizes(spool: DataFrame, size: Column) -> DataFrame:
    """Lines and payload sizes by conversation, then by day; a sum over no line is null."""
    rows = spool.select("conversation_id", day().cast("string").alias("day"), F.coalesce("strict", F.lit(False)).alias("stripped"), size.alias("size"))

    def by(scope: str, label: str) -> DataFrame:
        return rows.groupBy(F.lit(scope).alias("scope"), F.col(label).alias("label")).agg(
            F.count("*").alias("lines"), F.count_if("stripped").alias("stripped_lines"), F.sum(F.when(~F.col("stripped"), F.col("size"))).alias("payload_bytes_unstripped"), F.sum(F.when(F.col("stripped"), F.col("size"))).alias("payload_bytes_stripped")
        )

    return by("per_conversation_id", "conversation_id").where("label IS NOT NULL").unionByName(by("per_day", "day"))


def payload_bytes(spool: DataFrame) -> DataFrame:
    """Characters, as the report has always counted them under this name."""
    return payload_sizes(spool, F.length("raw").cast("long"))


def payload_octets(spool: DataFrame) -> DataFrame:
    """The same in UTF-8 bytes."""
    return payload_sizes(spool, F.octet_length("raw").cast("long"))


def payload_keys(spool: DataFrame) -> DataFrame:
    """Each key of object payloads, with its lines and events. Counted by key and event first, so one frequent key is no large group."""
    pairs = spool.select("event", F.explode(F.json_object_keys("raw")).alias("key")).groupBy("key", "event").agg(F.count("*").alias("n"))
    events = F.collect_set("event")
    return pairs.groupBy("key").agg(F.sum("n").alias("lines"), F.size(events).cast("long").alias("distinct_events"), F.when(F.size(events) > 0, F.array_join(F.array_sort(events), ", ")).alias("events"))


def summary(spool: DataFrame) -> DataFrame:
    """One row: counts over all lines. spool may have `readable`; without it every line is."""
    readable = F.col("readable") if "readable" in spool.columns else F.lit(True)
    rows = spool.withColumn("_ok", readable)
    ok = F.col("_ok")
    return rows.agg(
        F.count("*").alias("lines"),
        F.count_if(ok).alias("envelopes"),
        F.count_if(~ok).alias("unreadable_lines"),
        F.count_if(ok & F.coalesce("strict", F.lit(False))).alias("stripped_envelopes"),
        F.count_distinct(F.when(ok & (F.col("conversation_id") != ""), F.col("conversation_id"))).alias("conversation_ids"),
        F.sum(F.when(ok, F.octet_length("raw"))).alias("payload_bytes"),
        F.count_if(ok & is_object(F.col("raw"))).alias("object_payloads"),
        F.count_if(ok & ~is_object(F.col("raw"))).alias("other_payloads"),
        F.max(F.when(ok, F.col("ts"))).alias("last_capture_at"),
    )


def histograms(spool: DataFrame) -> DataFrame:
    """field, value, lines for schema_version, event (absent: empty) and capture day (of times that have one)."""
    values = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (("schema_version", F.coalesce("schema_version", F.lit(""))), ("event", F.coalesce("event", F.lit(""))), ("day", F.when(F.length("ts") >= 10, F.substring("ts", 1, 10))))])
    return spool.select(F.explode(values).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("lines"))


def key_value_census(spool: DataFrame) -> DataFrame:
    """key, value, lines of the short texts of object payloads, content aside. Payloads are taken apart as variants, on the JVM."""
    parts = spool.where(is_object(F.col("raw"))).select(F.try_parse_json("raw").alias("v")).lateralJoin(spool.sparkSession.tvf.variant_explode(F.col("v").outer()))
    text = parts.where(F.schema_of_variant("value") == "STRING").select("key", F.col("value").cast("string").alias("value"))
    return text.where(censusable(F.col("key"), F.col("value"))).groupBy("key", "value").agg(F.count("*").alias("lines"))


def session_events(spool: DataFrame, session: str) -> DataFrame:
    """Lines of one session: by conversation, or the payload's session_id or generation_id. Order by ts, file, line_no."""
    if not session:
        raise ValueError("a session id is required")
    hit = lambda c: F.coalesce(c == session, F.lit(False))
    return spool.where(hit(F.col("conversation_id")) | hit(field("session_id")) | hit(field("generation_id")))


def ordered_session_events(spool: DataFrame, session: str, tie: tuple[str, ...] = ("file", "line_no")) -> DataFrame:
    """session_events() with their place, from 1, in the order of ts as text; ties by file and line."""
    rows = session_events(spool, session)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("ts").asc_nulls_first(), *tie))).orderBy("place")


def ranked(report: DataFrame, *order) -> DataFrame:
    """A report in an order, nulls last, with each row's rank; equal rows share one. Reports hold one row a key, so one task orders them."""
    columns = [(c.asc_nulls_last() if up else c.desc_nulls_last()) for c, up in ((F.col(o.lstrip("-")), not o.startswith("-")) for o in order)]
    return report.withColumn("rank", F.rank().over(Window.orderBy(*columns))).orderBy("rank")
