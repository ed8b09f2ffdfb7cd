"""Token counts: a map-side two-tier lookup.

Tier one is a compact hash table of frequent pre-tokens' lengths, broadcast once (bounded by the
vocabulary: about 50,000 entries, under 1 MB). What it misses goes to a bounded cache in each Python worker, which
asks the tokenizers library. Nothing is shuffled: each text is counted whole where it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pretokens import frequent_lengths, pack_table, worker_encoder


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes and 0 tokens. A null id stays null; repeated rows give repeated
    rows; an empty table gives none. Only the two named columns are read, so others may have any name.
    No begin, end or other special tokens are added; special strings inside a text are handled as the library does.
    """
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast(pack_table(frequent_lengths(vocabulary)))
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = worker_encoder(vocabulary, packed.value)
        for b in batches:
            text = b.column("text")
            n = pa.array(map(encoder.count, text.to_pylist()), pa.int64())
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), size, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = ids.schema["id"].dataType.simpleString()
    return ids.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
