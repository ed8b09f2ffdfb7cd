"""Signals of a session: scoping, counter totals, token counts, tool calls, skill activations, timing.

Every signal is a state (present, unknown, error) with a reason unless present. Sessions drive the results: a session without a row
still gets an answer. Rows are classified in one pass, so what was left out can be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import leaves as L

#: Token types and their names in a profile.
TOKEN_TYPES = {"input": "input", "output": "output", "cacheRead": "cache_read", "cacheCreation": "cache_creation"}
#: Metric and event names behind the namespace.
TOKEN_METRIC = "token.usage"
EVENTS = ("tool_result", "tool_decision", "api_request", "skill_activated")
NAMESPACE = "claude_code"


def owns_scope(scope: Column, namespace: str = NAMESPACE) -> Column:
    """An empty scope name, or one with the namespace among its dot-separated parts."""
    s = F.coalesce(scope, F.lit(""))
    return (s == "") | F.array_contains(F.split(s, r"\."), namespace)


def scope_class(scope: Column, session: Column, wanted: Column, namespace: str = NAMESPACE) -> Column:
    """'foreign_scope' before 'other_session' before 'owned'."""
    return F.when(~owns_scope(scope, namespace), "foreign_scope").when(~F.coalesce(session == wanted, F.lit(False)), "other_session").otherwise("owned")


def point_gate(temporality_raw: Column, label: Column, as_double: Column, as_int: Column) -> Column:
    """The first failing rule of a token data point, or 'ok'."""
    t = L.temporality(temporality_raw)
    return (
        F.when(t == -1, "absent_temporality")
        .when(t == -2, "unreadable_temporality")
        .when(~t.isin(L.DELTA, L.CUMULATIVE), "other_temporality")
        .when(~F.coalesce(label, F.lit("")).isin(*TOKEN_TYPES), "unrecognised_type")
        .when(L.count_gate(as_double, as_int) == "unreadable", "unreadable_value")
        .when(L.count_gate(as_double, as_int) == "not_a_count", "not_a_count")
        .otherwise("ok")
    )


def series_totals(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, series, label, total, mixed: points(keys, series, label, cumulative, start_ns, value) merged by series.

    Delta points add up. Cumulative ones count by run: each start's greatest value, and of points without a start what they exceed the largest
    run by. A series with both kinds is mixed and has no total. Runs are reduced first, so a large session is split before its series meet.
    """
    runs = points.groupBy(*keys, "series", "label", "cumulative", "start_ns").agg(L.saturating_sum(F.col("value")).alias("added"), F.max("value").alias("most"))
    started = F.col("cumulative") & F.col("start_ns").isNotNull()
    loose = F.col("cumulative") & F.col("start_ns").isNull()
    merged = runs.groupBy(*keys, "series", "label").agg(
        F.bool_or("cumulative").alias("some_cumulative"),
        F.bool_or(~F.col("cumulative")).alias("some_delta"),
        F.sum(F.when(~F.col("cumulative"), F.col("added").cast("decimal(38,0)"))).alias("increments"),
        F.sum(F.when(started, F.col("most").cast("decimal(38,0)"))).alias("run_sum"),
        F.max(F.when(started, F.col("most"))).alias("run_most"),
        F.max(F.when(loose, F.col("most"))).alias("unplaced"),
    )
    zero = F.lit(0).cast("decimal(38,0)")
    rest = F.greatest(zero, F.coalesce(F.col("unplaced"), F.lit(0)).cast("decimal(38,0)") - F.coalesce(F.col("run_most"), F.lit(0)).cast("decimal(38,0)"))
    cumulative = F.coalesce(F.col("run_sum"), zero) + rest
    mixed = F.col("some_cumulative") & F.col("some_delta")
    total = F.least(F.when(F.col("some_cumulative"), cumulative).otherwise(F.coalesce(F.col("increments"), zero)), F.lit(L.MOST).cast("decimal(38,0)")).cast("bigint")
    return merged.select(*keys, "series", "label", F.when(~mixed, total).alias("total"), mixed.alias("mixed"))


def label_totals(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, total over the series that aren't mixed."""
    return series.where("NOT mixed").groupBy(*keys, "label").agg(L.saturating_sum(F.col("total")).alias("total"))


def pivoted_tokens(totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys and one column a token type; null where nothing was read, which is not 0."""
    return totals.groupBy(*keys).agg(*[F.max(F.when(F.col("label") == t, F.col("total"))).alias(name) for t, name in TOKEN_TYPES.items()])


def excluded(noun: str, other: Column, foreign: Column, session: Column, namespace: str = NAMESPACE) -> Column:
    """What an unknown signal adds about records that were left out."""
    parts = F.array_compact(
        F.array(
            F.when(other > 0, F.concat(L.quantity(other, noun), F.lit(" not carrying session.id "), session)),
            F.when(foreign > 0, F.concat(L.quantity(foreign, noun), F.lit(f" recorded by an instrumentation scope that is not {namespace}'s"))),
        )
    )
    return F.when(F.size(parts) > 0, F.concat(F.lit("; the export also carries "), F.array_join(parts, " and "))).otherwise(F.lit(""))


def _by_session(sessions: DataFrame, rows: DataFrame, at: list[Column]) -> DataFrame:
    """Aggregates of rows for each of sessions(session), also for those without a row: own rows by key, and over all rows once."""
    return sessions.join(rows.groupBy("session").agg(*at), "session", "left")


def tokens(decoded: DataFrame, sessions: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """session, state, reason, input, output, cache_read, cache_creation."""
    metric = f"{namespace}.{TOKEN_METRIC}"
    rows = decoded.where((F.col("kind") == "point") & (F.col("metric") == metric))
    owned = rows.where(owns_scope(F.col("scope"), namespace)).withColumn("gate", point_gate(F.col("temporality_raw"), F.col("label"), F.col("as_double_raw"), F.col("as_int_raw")))
    good = owned.where("has_point AND gate = 'ok'").select("session", "series", "label", (L.temporality(F.col("temporality_raw")) == L.CUMULATIVE).alias("cumulative"), L.nanos_leaf(F.col("start_raw")).alias("start_ns"), L.count_leaf(F.col("as_double_raw"), F.col("as_int_raw")).alias("value"))
    series = series_totals(good, ["session"])
    totals = pivoted_tokens(label_totals(series, ["session"]), ["session"])
    gates = ("absent_temporality", "unreadable_temporality", "other_temporality", "unrecognised_type", "unreadable_value", "not_a_count")
    n = _by_session(sessions, owned.where("has_point"), [F.count("*").alias("points"), *[F.count_if(F.col("gate") == g).alias(g) for g in gates]])
    mixed = series.groupBy("session").agg(F.count_if("mixed").alias("mixed"))
    whole = rows.agg(
        F.count_if(owns_scope(F.col("scope"), namespace) & F.col("has_point")).alias("all_owned"),
        F.count_if(~owns_scope(F.col("scope"), namespace) & F.col("has_point")).alias("foreign"),
        F.count_if(owns_scope(F.col("scope"), namespace) & ~F.col("has_point")).alias("empty"),
    )
    # whole is one row
    got = n.join(totals, "session", "left").join(mixed, "session", "left").crossJoin(F.broadcast(whole)).fillna(0, ["points", "mixed", *gates])
    types = "/".join(TOKEN_TYPES)
    clauses = L.reason(
        (F.col("absent_temporality"), "data point", "carried no aggregationTemporality"),
        (F.col("unreadable_temporality"), "data point", "carried an aggregationTemporality that could not be read"),
        (F.col("other_temporality"), "data point", "declared an aggregationTemporality that is neither 1 (delta) nor 2 (cumulative)"),
        (F.col("unrecognised_type"), "data point", f"carried no recognised type attribute ({types})"),
        (F.col("unreadable_value"), "data point", "carried no asDouble or asInt value that reads as a number"),
        (F.col("not_a_count"), "data point", f"carried a value that is not a token count: a count is a whole number from 0 to {L.MOST}"),
        (F.col("mixed"), "time series", "carried both delta (1) and cumulative (2) aggregationTemporality points"),
    )
    none = F.coalesce(*[F.col(c) for c in TOKEN_TYPES.values()]).isNull()
    left_out = excluded("data point", F.col("all_owned") - F.col("points"), F.col("foreign"), F.col("session"), namespace)
    why = (
        F.when((F.col("points") == 0) & (F.col("empty") == 0), F.concat(F.lit(f"no {metric} metric found in OTel export"), left_out))
        .when(F.col("points") == 0, F.concat(F.lit(f"no readable {metric} metric in OTel export: it carried no sum data points"), left_out))
        .when(none, F.concat(F.lit(f"no readable {metric} metric in OTel export: "), clauses, left_out))
    )
    return got.select("session", F.when(why.isNull(), "present").otherwise("unknown").alias("state"), why.alias("reason"), *TOKEN_TYPES.values())


def records(decoded: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Log records with their event's short name and time."""
    name = L.event_name(F.col("body"), F.col("event_attr"), namespace)
    rows = decoded.where("kind = 'record'").withColumn("name", name).withColumn("ns", L.nanos_leaf(F.col("time_raw")))
    return rows.withColumn("owned", owns_scope(F.col("scope"), namespace)).withColumn("short", F.when(F.col("name").startswith(f"{namespace}."), F.col("name").substr(F.lit(len(namespace) + 2), F.length("name"))))


def tool_outcomes(rows: DataFrame) -> DataFrame:
    """session, ns, place, name, success of tool results, and of rejected decisions as failures."""
    results = rows.where("short = 'tool_result' AND coalesce(tool_name, '') <> ''").withColumn("success", L.bool_leaf(F.col("success_raw"))).where("success IS NOT NULL")
    rejected = rows.where("short = 'tool_decision' AND coalesce(tool_name, '') <> '' AND decision = 'reject'").withColumn("success", F.lit(False))
    columns = ["session", "ns", "batch", "place", F.col("tool_name").alias("name"), "success"]
    return results.select(*columns).unionByName(rejected.select(*columns))


def ordered(entries: DataFrame, value: list[str]) -> DataFrame:
    """session and its entries as a list: timed before untimed, by time, ties in document order."""
    item = F.struct(F.col("ns").isNull().alias("untimed"), "ns", "batch", "place", *value)
    # one list a session is the result itself: a profile holds its session's calls
    return entries.groupBy("session").agg(F.array_sort(F.collect_list(item)).alias("entries"))


def tool_calls(decoded: DataFrame, sessions: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """session, state, reason, calls (name, timestamp, success)."""
    rows = records(decoded, namespace).where("owned")
    seen = rows.where("short IN ('tool_result', 'tool_decision')").groupBy("session").agg(F.count("*").alias("seen"))
    lists = ordered(tool_outcomes(rows), ["name", "success"])
    got = sessions.join(seen, "session", "left").join(lists, "session", "left")
    calls = F.transform("entries", lambda e: F.struct(e["name"].alias("name"), L.rfc3339_nanos(e["ns"]).alias("timestamp"), e["success"].alias("success")))
    why = F.when(F.col("seen").isNull(), f"no {namespace}.tool_result or {namespace}.tool_decision log events found in OTel export").when(F.col("entries").isNull(), F.concat(F.lit("no tool call outcomes in OTel export: "), L.quantity(F.col("seen"), "log event"), F.lit(" carried none")))
    return got.select("session", F.when(why.isNull(), "present").otherwise("unknown").alias("state"), why.alias("reason"), calls.alias("calls"))


def skill_activations(decoded: DataFrame, sessions: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """session, state, reason, activations (skill_name, timestamp, trigger)."""
    rows = records(decoded, namespace).where("owned AND short = 'skill_activated'")
    seen = rows.groupBy("session").agg(F.count("*").alias("seen"))
    lists = ordered(rows.where("coalesce(skill_name, '') <> ''"), ["skill_name", "trigger"])
    got = sessions.join(seen, "session", "left").join(lists, "session", "left")
    items = F.transform("entries", lambda e: F.struct(e["skill_name"].alias("skill_name"), L.rfc3339_nanos(e["ns"]).alias("timestamp"), e["trigger"].alias("trigger")))
    why = F.when(F.col("seen").isNull(), f"no {namespace}.skill_activated log events found in OTel export").when(F.col("entries").isNull(), F.concat(F.lit("no skill activations in OTel export: "), L.quantity(F.col("seen"), "log event"), F.lit(" carried no skill.name")))
    return got.select("session", F.when(why.isNull(), "present").otherwise("unknown").alias("state"), why.alias("reason"), items.alias("activations"))


def timing(decoded: DataFrame, sessions: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """session, state, reason, start_time, end_time, total_ms over api_request records."""
    rows = records(decoded, namespace).where("owned AND short = 'api_request'")
    got = _by_session(sessions, rows, [F.count("*").alias("seen"), F.min("ns").alias("first"), F.max("ns").alias("last")])
    why = F.when(F.col("seen").isNull(), f"no {namespace}.api_request log events found in OTel export").when(F.col("first").isNull(), f"no readable {namespace}.api_request log events in OTel export: none carried a parseable timeUnixNano")
    present = why.isNull()
    return got.select("session", F.when(present, "present").otherwise("unknown").alias("state"), why.alias("reason"), F.when(present, L.rfc3339_nanos(F.col("first"))).alias("start_time"), F.when(present, L.rfc3339_nanos(F.col("last"))).alias("end_time"), F.expr("(last - first) div 1000000").alias("total_ms"))
