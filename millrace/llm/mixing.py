"""Mixing sources to target weights: repetition rates by source, then whole copies and one seeded Bernoulli copy by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import group_key, kept, unit_hash, word_count

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """For each source of sizes(s, source, size): source_size and target.

    The targets share share * all sizes by weight, none above most * its source's size; the excess of those held there is
    reshared by weight until none is above. Held sources are those with the least room for their weight, so in the order of
    most * size / weight the level is the first (rest to give / rest of the weights) that its own source can take. The table has one row a
    source; its windows run over that aggregate alone, never over documents.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "at")
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.groupBy("s", "source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("at", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("room", most * F.col("source_size") / F.col("w"))
    left = share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("level", left / F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("at_level", F.min_by(F.when(F.col("level") <= F.col("room"), F.col("level")), F.when(F.col("level") <= F.col("room"), F.struct("room", "at"))).over(everything))
    return t.select("s", "source_size", F.least(most * F.col("source_size"), F.col("at_level") * F.col("w")).alias("target"))


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row for each row of docs: id_col, size (words), source_size, target (its source's), copies, taken (size * copies).

    copies is the whole part of target / source_size and one more with the fraction's probability, drawn from a hash of the id and the seed, so reruns agree.
    A source's taken words have the target as their mean and spread around it by sqrt(sum of size^2 * f * (1 - f)), f the rate's fraction: the fewer its documents, the wider.
    A null text has size 0; rows with a null source are one source, last in order; a source without words has target 0 and its documents no copies.
    Rows with one id draw alike. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), group_key(F.col(source_col)).alias("s"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    # kept: its size is then known, and only a small table is broadcast
    targets = kept(source_targets(rows.select("s", "source", "size"), share=share, most=most, weights=weights), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    one_more = unit_hash(seed, F.col("id")) < F.col("rate") - F.floor("rate")
    mixed = rows.join(targets, "s").withColumn("rate", rate).withColumn("copies", (F.floor("rate") + one_more.cast("long")).cast("long"))
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, its columns as they are (and so may have any other names). The small table of
    sources joins the rows; the rows themselves are emitted where they are."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = rows.withColumn("s", group_key(F.col("row")[source_col])).withColumn("source", F.col("row")[source_col]).withColumn("size", word_count(F.col("row")[text_col]))
    targets = source_targets(rows.select("s", "source", "size"), **options)
    rates = kept(targets.select("s", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")), "rates")
    one_more = unit_hash(seed, F.col("row")[id_col]) < F.col("rate") - F.floor("rate")
    copies = (F.floor("rate") + one_more.cast("long")).cast("int")
    many = rows.select("row", "s").join(rates, "s").withColumn("_copies", copies).where("_copies > 0")
    return many.select("row", F.explode(F.expr("sequence(1, _copies)"))).select("row.*")
