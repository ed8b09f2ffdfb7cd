"""Spools: directories of JSON lines, one hook event a line."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from millrace.operators.redaction import dump, one_value

#: The envelope's fields.
SPOOL = "ts string, event string, schema_version string, cursor_version string, cwd string, conversation_id string, strict boolean, raw string"
FIELDS = [f.split() for f in SPOOL.split(", ")]


def envelope(line: str | None) -> dict | None:
    """A line's envelope, its payload as JSON text; None if a field has a wrong type or the line isn't one JSON value. null is an empty envelope."""
    try:
        value = one_value(line or "")
    except ValueError:
        return None
    if value is None:
        return {}
    if not isinstance(value, dict):
        return None
    out: dict = {}
    for key, v in value.items():
        name = key.lower()
        kind = dict(FIELDS).get(name)
        if kind is None or v is None and name != "raw":
            continue
        if name == "raw":
            out[name] = dump(v)
        elif type(v) is (bool if kind == "boolean" else str):
            out[name] = v
        else:
            return None
    return out


@F.pandas_udf(StructType([StructField("readable", BooleanType()), *[StructField(n, BooleanType() if k == "boolean" else StringType()) for n, k in FIELDS]]))
def read_lines(lines: pd.Series) -> pd.DataFrame:
    found = [envelope(x) for x in lines]
    rows = [{"readable": e is not None} | {n: (e or {}).get(n) for n, _ in FIELDS} for e in found]
    return pd.DataFrame(rows, columns=["readable", *[n for n, _ in FIELDS]]).astype(object)


def read_spool(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each line that isn't blank: file, line_no, readable and the envelope's fields. Files are those named *.jsonl of the directory itself, and what append() and ingest() put into its
    folders of days. Large files are read in splits; line_no ascends with the lines of a file, and tells no more than their order."""
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.{jsonl,txt}").option("recursiveFileLookup", "true").text(directory)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("n"), F.col("value").alias("line"))
    under = F.lit(directory.rstrip("/").rpartition("/")[2])
    own = F.regexp_extract("file", "([^/]+)/[^/]+\\.jsonl$", 1) == under
    lines = lines.where((own | F.col("file").rlike("/day=[^/]*/[^/]+\\.txt$")) & F.col("line").rlike("\\S"))
    split = lines.select("file", (F.shiftleft("start", 20) + F.col("n")).alias("line_no"), "line")
    return split.select("file", "line_no", read_lines("line").alias("e")).select("file", "line_no", "e.*")


def spool_files(spark: SparkSession, directory: str) -> int:
    """Files of the spool, empty ones too."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sum(1 for f in found if f.isFile() and f.getPath().getName().endswith(".jsonl"))


def line_of(spool: DataFrame) -> Column:
    """An envelope's line as a Column: absent fields are left out, the payload stands as it is."""
    text = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f'"{n}":'), F.col(n) if n == "raw" else F.col(n).cast("string") if k == "boolean" else F.regexp_replace(F.to_json(F.array(F.col(n))), "^\\[|\\]$", ""))) for n, k in FIELDS if n in spool.columns]
    return F.concat(F.lit("{"), F.concat_ws(",", *text), F.lit("}"))


def to_line(row: dict) -> str:
    """An envelope as a line; absent fields are left out."""
    parts = [f"{json.dumps(n)}:{row['raw'] if n == 'raw' else json.dumps(row[n], ensure_ascii=False)}" for n, _ in FIELDS if row.get(n) is not None]
    return "{" + ",".join(parts) + "}"
