"""One query for each operator of this subpackage over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.binary import token_files
from millrace.llm.common import id_remainder, table
from millrace.llm.decontamination import contaminated
from millrace.llm.lmscore import language_scores
from millrace.llm.mixing import mixture
from millrace.llm.outliers import outliers
from millrace.llm.sharding import interleaved_shards
from millrace.llm.simhash import near_duplicates
from millrace.llm.tokens import token_counts
from millrace.llm.toxicity import score, train
from millrace.llm.urls import temporal_url_filter

#: A dated list of hosts and host paths, as (entry, action, effective_at).
URL_LIST = [
    ("spam-farm.example.org", "add", "2023-11-15"),
    ("spam-farm.example.org", "remove", "2024-03-01"),
    ("spam-farm.example.org", "add", "2024-05-20"),
    ("*.cheap-pills.example.com", "add", "2024-02-10"),
    ("cheap-pills.example.com", "remove", "2024-11-01"),
    ("https://tionsh.example.net/en", "add", "2024-01-20"),
    ("tionsh.example.net/en", "remove", "2024-02-20"),
    ("tionsh.example.net/es/", "add", "2024-06-01"),
    ("blog.tionble.example.com", "add", "2024-04-01"),
    ("Blog.Tionble.example.com", "remove", "2024-04-15"),
    ("blog.tionble.example.com", "add", "2024-09-01"),
    ("ththan.example.net", "add", "2024-07-01"),
    ("ththan.example.net", "remove", "2024-07-01"),
    ("m.ththin.example.org/de/", "add", "2024-03-15"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(table(spark, sf_dir, "documents")).drop("distance2")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir, "documents"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), learns=id_remainder(F.col("doc_id"), 5) != 1)


def op6_simhash_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("copies")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"), usable=id_remainder(F.col("id"), 3) != 1)
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    return score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_url_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time: page n counts as fetched at midnight of day n mod 366 of 2024."""
    values = ", ".join(f"('{e}', '{a}', '{t}')" for e, a, t in URL_LIST)
    entries = spark.sql(f"SELECT * FROM VALUES {values} AS list(entry, action, effective_at)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("timestamp_seconds(1704067200 + 86400 * pmod(page_id, 366))").alias("fetched_at"))
    found = temporal_url_filter(pages, entries)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return found.select("page_id", "url", day("fetched_at").alias("fetched_on"), "host", "matched_entry", day("listed_since").alias("listed_since"), "blocked")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_quality_outliers, op3_decontamination, op4_interleaved_shards, op5_context_mixing, op6_simhash_partitions, op7_source_mixture, op8_token_files, op9_toxicity, op10_url_temporal_list)
}

#: CRC-32 of a VARCHAR's UTF-8 bytes in DuckDB: the table is made by its rule, then bytes are folded in.
_CRC_TABLE = "(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1])), 4294967295)"""

_OP4 = f"""
WITH crc AS {_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, {_CRC.format(text="coalesce(text, '')")}::BIGINT AS text_crc32,
             CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS s, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS h
      FROM documents, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32, size) AS r, count(*) OVER (PARTITION BY s) AS n FROM d),
g AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, s, h, doc_id, text_crc32, size) - 1 AS g, count(*) OVER () AS total FROM r),
p AS (SELECT *, (g * 8) // total AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (g - (shard * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""

_OP7 = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS s,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT s, source, sum(size)::BIGINT AS source_size FROM d GROUP BY s, source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM t),
o AS (SELECT *, 2.0::DOUBLE * source_size / w AS room FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY room, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY room, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
v AS (SELECT *, first_value(level) OVER (ORDER BY level > room, room, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS at_level FROM l),
g AS (SELECT s, source_size, least(2.0::DOUBLE * source_size, at_level * w) AS target FROM v),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM d JOIN g USING (s))
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM c
"""

_OP10 = rf"""
WITH list(entry, action, effective_at) AS (VALUES {", ".join(f"('{e}', '{a}', DATE '{t}')" for e, a, t in URL_LIST)}),
log AS (SELECT regexp_replace(regexp_replace(lower(entry), '^([a-z]+:)?//|^\*\.', ''), '/+$', '') AS key, effective_at AS since, bool_or(action = 'add') AS is_on FROM list GROUP BY 1, 2),
iv AS (SELECT key, is_on, since AS valid_from, coalesce(lead(since) OVER (PARTITION BY key ORDER BY since), DATE '9999-12-31') AS valid_to FROM log),
c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched_on,
             lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')) AS host,
             lower(regexp_replace(regexp_extract(coalesce(url, ''), '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#]*)', 1), '\s*/*\s*$', '')) AS path FROM pages),
m AS (SELECT c.*, key, valid_from, row_number() OVER (PARTITION BY page_id, url ORDER BY length(key) DESC NULLS LAST) AS k
      FROM c LEFT JOIN iv ON is_on AND fetched_on >= valid_from AND fetched_on < valid_to AND host <> ''
           AND (host = key OR ends_with(host, '.' || key) OR (contains(key, '/') AND (host || path = key OR starts_with(host || path, key || '/')))))
SELECT page_id, url, strftime(fetched_on, '%Y-%m-%d') AS fetched_on, host, key AS matched_entry, strftime(valid_from, '%Y-%m-%d') AS listed_since, key IS NOT NULL AS blocked FROM m WHERE k = 1
"""

ORACLE_SQL: dict[str, str] = {"op4_interleaved_shards": _OP4, "op7_source_mixture": _OP7, "op10_url_temporal_list": _OP10}
