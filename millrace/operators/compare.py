"""Pairs of profiles: for each metric a difference, or the reason why there is none.

Profiles come in long form, one row a (profile, metric): profile_id, metric, state, source, has_value, adapter_version, and the values of the
metrics as columns. A refusal is decided before anything is subtracted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.leaves import round2, success_rate

TOKENS = ("input", "output", "cache_read", "cache_creation")
#: refusal() states its reasons in the wording that readers of reports match.


#: A saved profile, as profile.capture() gives it, and its long form's values.
PROFILE = ", ".join(
    [
        "schema string, harness string, snapshot_hash string, skill_dir string, capability struct<adapter_version:string>",
        *[f"{m} struct<state:string,reason:string,source:string,value:{v}>" for m, v in (("tokens", "struct<input:bigint,output:bigint,cache_read:bigint,cache_creation:bigint>"), ("tool_calls", "array<struct<name:string,timestamp:string,success:boolean,count:bigint>>"), ("skill_activation", "array<struct<skill_name:string,timestamp:string,trigger:string>>"), ("timing", "struct<start_time:string,end_time:string,total_ms:bigint>"), ("attribution", "struct<count:bigint>"), ("estimated_context_tokens", "struct<total:bigint>"))],
    ]
)
METRICS = ("tokens", "tool_calls", "skill_activation", "timing", "attribution", "estimated_context_tokens")


def call_count(calls: Column, which=lambda x: F.lit(True)) -> Column:
    """Calls in a list: an entry stands for its count, one that says none or 0 for one."""
    return F.aggregate(F.filter(calls, which), F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.nullif(x["count"], F.lit(0).cast("bigint")), F.lit(1).cast("bigint")))


def has_value(metric: str) -> Column:
    """Whether a result carries a value; an empty list is none."""
    value = F.col(f"{metric}.value")
    return F.coalesce(F.size(value) > 0, F.lit(False)) if metric in ("tool_calls", "skill_activation") else value.isNotNull()


def profile_refusal(profiles: DataFrame, schema: str = "profile/v1") -> DataFrame:
    """profile_path, reason of the profiles that can't be compared: another schema, or a signal that is present without a value (the first by name)."""
    bare = [F.when(F.coalesce(F.col(f"{m}.state"), F.lit("")) == "present", F.when(~has_value(m), F.lit(f"{m}: present without a value"))) for m in sorted(METRICS)]
    other = F.when(~F.col("schema").eqNullSafe(F.lit(schema)), F.concat(F.lit("schema: "), quoted(F.col("schema")), F.lit(f" is not {schema}")))
    return profiles.select("profile_path", F.coalesce(other, *bare).alias("reason")).where("reason IS NOT NULL")


def long_form(profiles: DataFrame) -> DataFrame:
    """One row for each profile (profile_path and the columns of PROFILE) and metric, as paired() takes them. A signal without a source comes from none."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(f"{m}.state"), F.lit("unknown")).alias("state"), F.coalesce(F.nullif(F.col(f"{m}.source"), F.lit("")), F.lit("none")).alias("source"), has_value(m).alias("has_value")) for m in METRICS])
    values = {f"{t}": F.col(f"tokens.value.{t}") for t in TOKENS} | {
        "calls": call_count(F.col("tool_calls.value")),
        "successes": call_count(F.col("tool_calls.value"), lambda x: F.coalesce(x["success"], F.lit(False))),
        "skills": F.transform("skill_activation.value", lambda x: x["skill_name"]),
        "total_ms": F.col("timing.value.total_ms"),
        "count": F.col("attribution.value.count"),
        "total": F.col("estimated_context_tokens.value.total"),
    }
    whole = profiles.select("profile_path", F.col("capability.adapter_version").alias("adapter_version"), rows.alias("rows"), *[v.alias(k) for k, v in values.items()])
    return whole.select("profile_path", "adapter_version", F.explode("rows").alias("r"), *values).select("profile_path", "adapter_version", "r.*", *values)


def read_profiles(spark, paths) -> DataFrame:
    """Saved profiles in long form. The first that profile_refusal() names is an error, with its path."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.schema(PROFILE).option("mode", "FAILFAST").json(paths, multiLine=True).withColumn("profile_path", F.regexp_replace(F.input_file_name(), "^file:(//)?", ""))
    if bad := profile_refusal(rows).orderBy("profile_path").first():
        raise ValueError(f"{bad.profile_path}: {bad.reason}")
    return long_form(rows)


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))


def refusal(metric: Column, b: str, c: str) -> Column:
    """The first refusal that holds for a pair whose sides are structs named b and c; null if they may be compared."""
    bv, cv = F.coalesce(F.col(f"{b}.adapter_version"), F.lit("")), F.coalesce(F.col(f"{c}.adapter_version"), F.lit(""))
    bs, cs = F.col(f"{b}.state"), F.col(f"{c}.state")
    return (
        F.when(bv != cv, F.concat(F.lit("adapter version mismatch: baseline "), quoted(bv), F.lit(" vs candidate "), quoted(cv), F.lit(" — the two profiles were read by different adapters, so a difference between them may be the reader changing rather than the skill")))
        .when(bv == "", "neither profile names an adapter version: capability.adapter_version is empty on both sides, so nothing shows the two were read the same way")
        .when((bs != "present") | (cs != "present"), F.concat(metric, F.lit(" is not present in both profiles: baseline "), quoted(bs), F.lit(", candidate "), quoted(cs)))
        .when(~F.col(f"{b}.has_value") | ~F.col(f"{c}.has_value"), F.concat(metric, F.lit(' is marked "present" and one of the profiles carries no value for it')))
        .when(
            F.col(f"{b}.source") != F.col(f"{c}.source"),
            F.concat(F.lit("source mismatch: baseline "), quoted(F.col(f"{b}.source")), F.lit(" vs candidate "), quoted(F.col(f"{c}.source")), F.lit(" — a delta across two sources is not a measurement of the same thing")),
        )
    )


def paired(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """pairs(pair_id, baseline_id, candidate_id) with both sides of each metric as structs b and c, and the refusal as reason."""
    side = F.struct(*profiles.columns)
    b = profiles.select(F.col("profile_id").alias("baseline_id"), F.col("metric"), side.alias("b"))
    c = profiles.select(F.col("profile_id").alias("candidate_id"), F.col("metric"), side.alias("c"))
    both = pairs.join(b, "baseline_id").join(c, ["candidate_id", "metric"])
    return both.withColumn("reason", refusal(F.col("metric"), "b", "c"))


def token_deltas(both: DataFrame) -> DataFrame:
    """Differences of the counts that both sides read; with none of them the pair isn't comparable."""
    rows = both.where("metric = 'tokens'")
    shared = sum(((F.col(f"b.{t}").isNotNull() & F.col(f"c.{t}").isNotNull()).cast("int") for t in TOKENS), F.lit(0))
    none = "the two profiles share no token count that both of them read, so there is nothing to subtract"
    why = F.coalesce(F.col("reason"), F.when(shared == 0, none))
    ok = why.isNull()
    return rows.select("pair_id", ok.alias("comparable"), why.alias("reason"), *[F.when(ok, F.col(f"c.{t}") - F.col(f"b.{t}")).alias(f"delta_{t}") for t in TOKENS])


def tool_call_deltas(both: DataFrame) -> DataFrame:
    """Differences of calls, successes and rounded rates."""
    rows, ok = both.where("metric = 'tool_calls'"), F.col("reason").isNull()
    rate = lambda s: success_rate(F.col(f"{s}.successes"), F.col(f"{s}.calls"))
    return rows.select("pair_id", ok.alias("comparable"), "reason", F.when(ok, F.col("c.calls") - F.col("b.calls")).alias("delta_count"), F.when(ok, F.col("c.successes") - F.col("b.successes")).alias("delta_successes"), F.when(ok, round2(rate("c") - rate("b"))).alias("delta_rate"))


def activation_deltas(both: DataFrame) -> DataFrame:
    """Difference of list lengths, and the sorted names that only one side has."""
    rows, ok = both.where("metric = 'skill_activation'"), F.col("reason").isNull()
    only = lambda x, y: F.array_sort(F.array_except(F.col(f"{x}.skills"), F.col(f"{y}.skills")))
    return rows.select("pair_id", ok.alias("comparable"), "reason", F.when(ok, (F.size("c.skills") - F.size("b.skills")).cast("long")).alias("delta_count"), F.when(ok, only("c", "b")).alias("added"), F.when(ok, only("b", "c")).alias("removed"))


def number_deltas(both: DataFrame, metric: str, value: str, note: str | None = None) -> DataFrame:
    """Difference of one number: timing (total_ms), attribution (count), estimated_context_tokens (total, with its note)."""
    rows, ok = both.where(F.col("metric") == metric), F.col("reason").isNull()
    return rows.select("pair_id", ok.alias("comparable"), "reason", F.when(ok, F.col(f"c.{value}") - F.col(f"b.{value}")).alias("delta"), F.when(ok, F.lit(note)).alias("note"))


#: Fixed value: goes with each estimate's difference.
ESTIMATE_NOTE = "relative estimate, not billed — an ordinal signal only, and never a cost"


def notes(pairs: DataFrame, fields: tuple[str, ...] = ("harness", "snapshot_hash", "skill_dir")) -> DataFrame:
    """pair_id and what differs between baseline_<field> and candidate_<field>; nothing is refused for it."""
    say = [F.when(~F.col(f"baseline_{f}").eqNullSafe(F.col(f"candidate_{f}")), F.concat(F.lit(f"{f} differs: baseline "), quoted(F.col(f"baseline_{f}")), F.lit(" vs candidate "), quoted(F.col(f"candidate_{f}")))) for f in fields]
    return pairs.select("pair_id", F.array_compact(F.array(*say)).alias("notes"))


def any_comparable(report: DataFrame) -> DataFrame:
    return report.groupBy("pair_id").agg(F.bool_or("comparable").alias("comparable"))


def all_comparable(report: DataFrame, keys: list[str]) -> DataFrame:
    """At least one run, and all of them comparable."""
    return report.groupBy(*keys).agg((F.count("*") > 0).alias("some"), F.bool_and("comparable").alias("all")).select(*keys, F.coalesce(F.col("some") & F.col("all"), F.lit(False)).alias("comparable"))
