"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; row r of n gets the fractional rank (2r - 1) / 2n. In the
order of that rank all sources run through their rows at one pace, so every contiguous cut holds the whole
table's mixture. The cuts are equal in rows: shard counts differ by at most one (law "rows").

Ranks are found without putting a source, or the table, into one task: hash prefixes deal a source's rows into
buckets, bucket counts give each bucket its first rank, and rows are numbered inside their bucket only. The global order
is found the same way from buckets of the fractional rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import byte_size, group_key, text_crc32


def interleaved_shards(docs: DataFrame, *, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", hash_digits: int = 3, rank_buckets: int = 4096) -> DataFrame:
    """One row for each row of docs: id_col, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 1. slot: place in the shard, gapless from 0. grown_shard: null under this law.
    Rows with a null source form a source of their own. A null text counts as empty; a null id is hashed as such; rows equal in
    all of id, text and source take neighbouring places in either order. An empty table gives no rows. Equal texts are not kept
    together: the law is on row counts. hash_digits (hex) and rank_buckets set how finely hot sources are split.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        (byte_size(F.col(text_col)) + 1).alias("size"),
        text_crc32(F.col(text_col)).alias("text_crc32"),
        group_key(F.col(source_col)).alias("s"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("h"),
    ).withColumn("b", F.substring("h", 1, hash_digits))
    counts = rows.groupBy("s", "b").count()
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("s", "b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"), F.sum("count").over(Window.partitionBy("s")).alias("n"))
    inside = Window.partitionBy("s", "b").orderBy("h", "id", "text_crc32", "size")
    ranked = rows.join(firsts, ["s", "b"]).withColumn("r", F.col("first") + F.row_number().over(inside))
    ranked = ranked.withColumn("f", (2 * F.col("r") - 1).cast("double") / (2 * F.col("n")).cast("double")).withColumn("q", F.floor(F.col("f") * rank_buckets).cast("int"))
    # one row for each of at most rank_buckets buckets: bounded, so it may be broadcast
    upto = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = ranked.groupBy("q").count().select("q", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("start"), F.sum("count").over(whole).alias("total"))
    order = Window.partitionBy("q").orderBy("f", "s", "h", "id", "text_crc32", "size")
    placed = ranked.join(F.broadcast(starts), "q").withColumn("g", F.col("start") + F.row_number().over(order) - 1)
    shard = F.expr(f"(g * {shards}) div total").cast("int")
    return placed.withColumn("shard", shard).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"g - (shard * total + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", **options) -> None:
    """Writes docs to path/shard=k, each row as a struct `row` beside its slot, sorted by slot, so that its columns may have any names. id_col must be unique here: it joins
    rows to their places. An empty table writes no shard; read_shards() gives docs' columns back."""
    placed = interleaved_shards(docs, id_col=id_col, **options).select(F.col(f"`{id_col}`").alias("id"), "shard", "slot")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = rows.join(placed, rows["row"][id_col].eqNullSafe(placed["id"])).select("row", "shard", "slot")
    whole.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The rows of one shard as they were given, in the order of their slots."""
    return spark.read.parquet(f"{path}/shard={shard}").orderBy("slot").select("row.*")
