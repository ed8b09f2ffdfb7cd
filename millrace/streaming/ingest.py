"""Hook payloads as a stream: normalised, redacted, and appended to a spool partitioned by day; event-time reports over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.redaction import is_one_value, kept_payloads
from millrace.sources.spool import line_of

SPOOL_VERSION = "spool/v1"


def normalized(payloads: DataFrame, *, payload: str = "value", strict: bool = False, now: Column | None = None) -> DataFrame:
    """Envelopes of payloads, batch or stream: event by hook_event_name (unknown without one), known members promoted where they are texts.

    What isn't exactly one JSON value is kept as a JSON string, neither redacted nor stripped.
    """
    at = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw, is_json = F.col(payload), is_one_value(F.col(payload))
    variant = F.when(is_json, F.try_parse_json(raw))

    def text(name: str) -> Column:
        member = F.try_variant_get(variant, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(member) == "STRING", member.cast("string"))

    return payloads.select(
        at.alias("ts"),
        F.coalesce(F.nullif(text("hook_event_name"), F.lit("")), F.lit("unknown")).alias("event"),
        F.lit(SPOOL_VERSION).alias("schema_version"),
        text("cursor_version").alias("cursor_version"),
        text("cwd").alias("cwd"),
        text("conversation_id").alias("conversation_id"),
        F.lit(strict).alias("strict"),
        kept_payloads(raw, F.lit(strict)).alias("raw"),
    )


def append(spool: DataFrame, path: str) -> None:
    """Batch sink: envelopes as lines in a folder for each day, as read_spool() reads them. Times shorter than a date are refused."""
    _lines(spool).write.mode("append").partitionBy("day").text(path)


def _lines(spool: DataFrame) -> DataFrame:
    """day, value: each envelope's line."""
    day = F.when(F.length("ts") >= 10, F.substring("ts", 1, 10)).otherwise(F.raise_error(F.lit("a spool event needs a time")))
    return spool.select(day.alias("day"), line_of(spool).alias("value"))


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str, *, strict: bool = False, once: bool = True) -> StreamingQuery:
    """Streams payload lines of the text files in source to the spool at path."""
    lines = spark.readStream.option("wholetext", "false").option("lineSep", "\n").text(source).where("trim(value) <> ''")
    out = _lines(normalized(lines, strict=strict))
    writer = out.writeStream.format("text").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def events_by_window(spool: DataFrame, *, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Lines by event-time window and event, over a stream or a table: late lines count up to the watermark."""
    rows = spool.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window).alias("w"), "event").agg(F.count("*").alias("lines")).select(F.col("w.start").alias("start"), "event", "lines")
