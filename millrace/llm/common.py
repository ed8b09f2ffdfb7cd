"""What several operators share: the scratch folder, tables kept there, and small column rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and U+0009 to U+000D. A word is a longest run of anything else.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests; an error on a cluster, whose machines
    don't share their own folders."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/millrace/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files at its end; it makes them again if the query is run once more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once; the JVM and the worker each hold such a batch whole.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def kept(df: DataFrame, what: str, *, batch_rows: int | None = None) -> DataFrame:
    """df written to the scratch folder and read back: cuts its lineage, survives lost executors, and is computed once however often it is used. What was shuffled
    for it is deleted. batch_rows: how many rows its Python workers get at once at most, for large rows (default: as the session says)."""
    spark = df.sparkSession
    path, before = scratch_path(spark, what), {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH_ROWS: spark.conf.get(BATCH_ROWS)}
    spark.conf.set(CLEANUP, "true")
    if batch_rows:
        spark.conf.set(BATCH_ROWS, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this application has kept; call it once no result that reads it is needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text as a long; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n: the folds of the learning operators. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def group_key(source: Column) -> Column:
    """A source as a key that is never null: null gets a key of its own, apart from every text."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source))


def unit_hash(seed: int, *cols: Column) -> Column:
    """52 hash bits of the columns and the seed, as a fraction in [0, 1): the same on every rerun and every engine with MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


_held: dict = {}


def held(key, make):
    """A worker's state for key, made once and kept over batches and tasks; only one at a time, so that operators that share a worker don't add up their caches."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
