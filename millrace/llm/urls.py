"""URL filters by a temporal list join [native: DataFrame functions only].

A list is a log of dated entries: from effective_at on, an entry (a host with all below it, or a host with a path
prefix) is added or removed. Each key's log becomes validity intervals that don't overlap; a capture is matched with the
intervals that hold at its fetch time, so a page is judged by the list as it was then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An open end of an interval.
FOREVER = "9999-12-31 00:00:00"


def validity_intervals(entries: DataFrame) -> DataFrame:
    """entries(entry, action, effective_at) as key, valid_from, valid_to: from an "add" to the next change of the same key.

    Keys are compared in lower case without a scheme, a leading "*." or a trailing slash. Of several actions on one key at one time "add" wins. Rows with a null or
    another action are left out, an add after an add opens a new interval where the old one closes.
    """
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim("entry")), r"^([a-z][a-z0-9+.-]*:)?//|^\*\.", ""), "/+$", "")
    log = entries.select(key.alias("key"), F.col("action"), F.col("effective_at").cast("timestamp").alias("at")).where("key <> '' AND at IS NOT NULL AND action IN ('add', 'remove')")
    log = log.groupBy("key", "at").agg(F.bool_or(F.col("action") == "add").alias("on"))
    until = F.coalesce(F.lead("at").over(Window.partitionBy("key").orderBy("at")), F.lit(FOREVER).cast("timestamp"))
    return log.select("key", "on", F.col("at").alias("valid_from"), until.alias("valid_to")).where("on").drop("on")


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and trailing dots; null or no authority: empty."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))


def url_path(url: Column) -> Column:
    """Path in lower case without query, fragment and trailing slashes."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#]*)", 1), r"\s*/*\s*$", ""))


def list_keys(host: Column, path: Column) -> Column:
    """Every key that may list a URL: its host and each parent domain; its host with each path prefix."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.when(path == "", F.array().cast("array<string>")).otherwise(prefixes))))


def temporal_url_filter(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched_at", salts: int = 32) -> DataFrame:
    """One row for each row of captures: id_col, url_col, fetched_at, host, matched_entry, listed_since, blocked.

    matched_entry is the longest entry that holds at the fetch time (from its start on, its end excluded), listed_since its start; both are null for pages that
    aren't blocked. A null URL or one without a host has host "" and is never blocked; a null fetch time matches nothing. Repeated captures give repeated rows. An empty
    list blocks nothing; an empty table gives no rows.
    The key of a hot host, or a top-level domain, holds many captures: the list is repeated salts times and captures are dealt by a hash, so no key meets in one task.
    Of captures that share address and time only one is matched; what it matched goes back to all of them under salts times as many keys, and captures without a host or
    a time, which match nothing, aren't joined at all.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(fetched_col).cast("timestamp").alias("fetched_at"))
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    keys = rows.where("host <> '' AND fetched_at IS NOT NULL").select("host", "path", "fetched_at").distinct()
    keys = keys.withColumn("salt", F.pmod(F.xxhash64("host", "path", "fetched_at"), F.lit(salts)).cast("int")).select("host", "path", "fetched_at", "salt", F.explode(list_keys(F.col("host"), F.col("path"))).alias("key"))
    intervals = validity_intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    active = keys.join(intervals, ["key", "salt"]).where((F.col("fetched_at") >= F.col("valid_from")) & (F.col("fetched_at") < F.col("valid_to")))
    best = active.groupBy("host", "path", "fetched_at").agg(F.max(F.struct(F.length("key").alias("n"), "key", "valid_from")).alias("m"))
    hits = best.select("host", "path", "fetched_at", F.col("m.key").alias("matched_entry"), F.col("m.valid_from").alias("listed_since"))
    # the way back: a capture's copies are dealt over the salts
    back = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    can = (F.col("host") != "") & F.col("fetched_at").isNotNull()
    rows = rows.withColumn("salt", F.when(can, F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")))
    none = rows.where("salt IS NULL").select("id", "url", "fetched_at", "host", F.lit(None).cast("string").alias("matched_entry"), F.lit(None).cast("timestamp").alias("listed_since"))
    judged = rows.where("salt IS NOT NULL").join(back, ["host", "path", "fetched_at", "salt"], "left").select("id", "url", "fetched_at", "host", "matched_entry", "listed_since")
    return judged.unionAll(none).select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched_at").alias(fetched_col), "host", "matched_entry", "listed_since", F.col("matched_entry").isNotNull().alias("blocked")
    )
