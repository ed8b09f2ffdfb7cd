"""Profiles: the signals of each session in one row, what each could be read from, and the exit status of a capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import signals as S

#: The metrics of a profile, in order.
METRICS = ("tokens", "tool_calls", "skill_activation", "timing", "attribution", "estimated_context_tokens")
ATTRIBUTION_REASON = "Claude Code telemetry carries no output-to-skill mapping"
SCHEMA_ID = "profile/v1"


def signal_states(decoded: DataFrame, sessions: DataFrame, namespace: str = S.NAMESPACE) -> DataFrame:
    """session, metric, state, reason in long form: one row for each session and signal."""
    parts = [("tokens", S.tokens), ("tool_calls", S.tool_calls), ("skill_activation", S.skill_activations), ("timing", S.timing)]
    out = None
    for name, signal in parts:
        rows = signal(decoded, sessions, namespace).select("session", F.lit(name).alias("metric"), "state", "reason")
        out = rows if out is None else out.unionByName(rows)
    fixed = sessions.select("session", F.lit("attribution").alias("metric"), F.lit("unknown").alias("state"), F.lit(ATTRIBUTION_REASON).alias("reason"))
    return out.unionByName(fixed)


def capabilities(states: DataFrame) -> DataFrame:
    """Adds source: where a present signal was read from, none for others."""
    return states.withColumn("source", F.when(F.col("state") == "present", "otel").otherwise("none"))


def exit_status(states: DataFrame) -> DataFrame:
    """session, exit_status: 2 if some signal failed and none is present."""
    return states.groupBy("session").agg(F.when((F.count_if(F.col("state") == "error") > 0) & (F.count_if(F.col("state") == "present") == 0), 2).otherwise(0).alias("exit_status"))


def failure_reasons(states: DataFrame) -> DataFrame:
    """session and its distinct reasons, in the order of the metrics."""
    order = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(order.alias("at"), F.col("reason").alias("reason")))))
    return states.groupBy("session").agg(F.array_distinct(F.transform(pairs, lambda x: x["reason"])).alias("reasons"))


def profiles(decoded: DataFrame, sessions: DataFrame, *, harness: Column | str = "claude_code", snapshot_hash: str = "", skill_dir: str = "", profiled_at: str = "") -> DataFrame:
    """One row for each session: a result struct (state, reason, source, value) a metric. Files that couldn't be read make every signal an error."""
    bad = decoded.where("kind = 'file' AND error IS NOT NULL").agg(F.first("error").alias("file_error"))
    none = decoded.where("kind = 'file' AND envelope").agg((F.count("*") == 0).alias("no_envelope"))
    about = F.broadcast(bad.crossJoin(none))  # one row

    def result(rows: DataFrame, name: str, value: Column) -> DataFrame:
        error = F.col("file_error").isNotNull()
        state = F.when(error, "error").when(F.col("no_envelope"), "unknown").otherwise(F.col("state"))
        why = F.when(error, F.concat(F.lit("failed to read OTel export file: "), "file_error")).when(F.col("no_envelope"), "OTel export is not OTLP/JSON: no resourceMetrics or resourceLogs found. ").otherwise(F.col("reason"))
        source = F.when(state == "present", "otel").otherwise("none")
        return rows.crossJoin(about).select("session", F.struct(state.alias("state"), why.alias("reason"), source.alias("source"), F.when(state == "present", value).alias("value")).alias(name))

    out = sessions.select("session", F.lit(SCHEMA_ID).alias("schema"), F.lit(profiled_at).alias("profiled_at"), F.lit(harness).alias("harness"), F.lit(snapshot_hash).alias("snapshot_hash"), F.lit(skill_dir).alias("skill_dir"))
    out = out.join(result(S.tokens(decoded, sessions), "tokens", F.struct(*S.TOKEN_TYPES.values())), "session")
    out = out.join(result(S.tool_calls(decoded, sessions), "tool_calls", F.col("calls")), "session")
    out = out.join(result(S.skill_activations(decoded, sessions), "skill_activation", F.col("activations")), "session")
    out = out.join(result(S.timing(decoded, sessions), "timing", F.struct("start_time", "end_time", "total_ms")), "session")
    return out.withColumn("attribution", F.struct(F.lit("unknown").alias("state"), F.lit(ATTRIBUTION_REASON).alias("reason"), F.lit("none").alias("source")))


def capture(decoded: DataFrame, session: str, **about) -> DataFrame:
    """The profile of one session. An empty id is refused: it would profile whatever has no session."""
    if not session:
        raise ValueError("a session id is required to capture")
    one = decoded.sparkSession.createDataFrame([(session,)], "session string")
    return profiles(decoded, one, **about)


#: The session that probe() gives every row, so that the signals of all sessions count together.
ANY = "*"


def probe(decoded: DataFrame, **about) -> DataFrame:
    """Over all sessions together: one row with capability (metric to source) and diagnostics (distinct reasons of what wasn't found, in the order of the metrics)."""
    together = decoded.withColumn("session", F.when(F.col("kind") != "file", F.lit(ANY)))
    one = profiles(together, decoded.sparkSession.createDataFrame([(ANY,)], "session string"), **about)
    signals = [m for m in METRICS if m in one.columns]
    sources = F.map_from_arrays(F.array(*[F.lit(m) for m in signals]), F.array(*[F.col(f"{m}.source") for m in signals]))
    reasons = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"{m}.state") != "present", F.nullif(F.trim(f"{m}.reason"), F.lit(""))) for m in signals])))
    return one.select(sources.alias("capability"), reasons.alias("diagnostics"))


def environment(decoded: DataFrame | None, spool_summary: DataFrame | None = None, hooks: dict | None = None) -> dict:
    """What there is to measure with: tier "export" if a probe of the export finds a signal, else "none"; what the spool and hooks.json hold. Nothing of it raises: what
    can't be read is reported as such."""

    def observed(what):
        try:
            return what() | {"readable": True}
        except Exception as e:  # noqa: BLE001 (a report on what works must outlive what doesn't)
            return {"readable": False, "why": str(e).splitlines()[0] if str(e) else type(e).__name__}

    out: dict = {"tier": "none"}
    if decoded is not None:
        out["export"] = observed(lambda: probe(decoded).first().asDict(recursive=True))
        if any(s != "none" for s in out["export"].get("capability", {}).values()):
            out["tier"] = "export"
    if spool_summary is not None:
        out["spool"] = observed(lambda: spool_summary.first().asDict(recursive=True))
    if hooks is not None:
        out["hooks"] = observed(lambda: {"events": sorted((hooks.get("hooks") or {}).keys())})
    return out
