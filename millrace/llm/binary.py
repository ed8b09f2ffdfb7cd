"""Token-ID output: an id array for each segment of documents, with Elias-Fano encoded document boundaries.

A segment is one binary value: a header, the documents' ids (the keys), the boundaries, and the concatenated
token ids at two bytes each (four for vocabularies over 65,536). Boundaries and keys are Elias-Fano coded: about 2 + log2(mean
length) bits a document in place of a 64-bit table, and select() finds any document's offset without decoding
the rest. Segments travel as rows of Parquet files, so that Spark's own commit protocol and any file system that Spark
knows carry them; part and segment numbers follow ascending doc_id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import scratch_path, text_crc32
from millrace.llm.pretokens import worker_encoder


class EliasFano:
    """A non-decreasing sequence of non-negative integers: low bits packed, high parts in unary, one select sample for each SAMPLE ones."""

    SAMPLE = 256
    HEAD = struct.Struct("<QBQQ")  # values, low bits of each, bytes of low bits, bytes of high bits

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, int(int(v[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[:: cls.SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at a byte, and the byte after it."""
        n, low_bits, n_low, n_high = cls.HEAD.unpack_from(data, at)
        at += cls.HEAD.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", -(-n // cls.SAMPLE), at + n_low + n_high)
        return cls(n, low_bits, low, high, samples), at + n_low + n_high + 4 * len(samples)

    def select(self, i: int) -> int:
        """The value at i, from the nearest sample on."""
        at, left = int(self.samples[i // self.SAMPLE]), i % self.SAMPLE
        byte = at // 8
        ones = bin(int(self.high[byte]) >> at % 8).count("1")
        if ones > left:  # in the sample's own byte
            return self._value(i, self._nth(int(self.high[byte]) >> at % 8, left) + at)
        left -= ones
        while True:
            byte += 1
            ones = bin(int(self.high[byte])).count("1")
            if ones > left:
                return self._value(i, self._nth(int(self.high[byte]), left) + 8 * byte)
            left -= ones

    @staticmethod
    def _nth(x: int, k: int) -> int:
        """Place of the set bit k of x."""
        for _ in range(k):
            x &= x - 1
        return (x & -x).bit_length() - 1

    def _value(self, i: int, place: int) -> int:
        first = i * self.low_bits
        bits = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (place - i) << self.low_bits | bits >> first % 8 & (1 << self.low_bits) - 1

    def decode(self) -> np.ndarray:
        """All values."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high << self.low_bits) + bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


#: Magic, bytes of an id, 1 if the keys are Elias-Fano coded, documents with a key, documents, tokens, first key.
HEAD = struct.Struct("<4sBBQQQq")
MAGIC = b"EFT1"


def pack_segment(keys: list, ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """One segment. keys: ascending, nulls last. ends: tokens up to and with each document."""
    known = np.array([k for k in keys if k is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    short = bool(len(known)) and int(known[-1]) - first < 1 << 52
    coded = EliasFano.encode((known - first).astype(np.uint64)).to_bytes() if short else known.astype("<i8").tobytes()
    return HEAD.pack(MAGIC, width, short, len(known), len(keys), len(ids) // width, first) + coded + EliasFano.encode(ends).to_bytes() + ids


class Segment:
    """A packed segment, read in place: keys, offsets by select(), ids."""

    def __init__(self, data: bytes):
        magic, self.width, short, known, self.n_docs, self.n_tokens, first = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        if short:
            coded, at = EliasFano.from_bytes(data, HEAD.size)
            keys = (coded.decode() + first).tolist()
        else:
            keys, at = np.frombuffer(data, "<i8", known, HEAD.size).tolist(), HEAD.size + 8 * known
        self.keys = [*keys, *[None] * (self.n_docs - known)]
        self.ends, at = EliasFano.from_bytes(data, at)
        self.tokens = np.frombuffer(data, f"<u{self.width}", self.n_tokens, at)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.tokens[start:end]


def write_token_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, segment_tokens: int = 1 << 20, partitions: int | None = None) -> None:
    """Encodes every text of docs, adds end_id after each, and writes segments in ascending id order to path.

    id_col must be an integer. A null text counts as empty (its end id alone); null ids come last; rows with one id are in the order
    of their texts' checksums; an empty table writes no segment. A segment ends at the first document that
    brings it to segment_tokens, so it holds that many tokens and at most one document more.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_crc32(F.col(text_col).cast("string")).alias("crc"))
    order = [F.col("id").asc_nulls_last(), F.col("crc")]

    def pack(batches):
        import pyarrow as pa

        encoder = worker_encoder(vocabulary)
        width, part = encoder.dtype.itemsize, TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        segment = before = 0
        keys, sizes, parts = [], [], []
        total = 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (segment, pa.int32()), (before, pa.int64()), (len(keys), pa.int64()), (total, pa.int64()), (pack_segment(keys, np.cumsum(sizes), b"".join(parts), width), pa.binary()))],
                ["part", "segment", "tokens_before", "n_docs", "n_tokens", "payload"],
            )

        for b in batches:
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                keys.append(key)
                parts.append(ids)
                sizes.append(len(ids) // width)
                total += sizes[-1]
                if total >= segment_tokens:
                    yield row()
                    segment, before = segment + 1, before + total
                    keys, sizes, parts, total = [], [], [], 0
        if keys:
            yield row()

    packed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pack, "part int, segment int, tokens_before long, n_docs long, n_tokens long, payload binary")
    packed.write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each document in the files: id_col, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers).

    Each document's offset comes from select(). Only a table of one row a part file is summed in order and broadcast: it is bounded by the number of output partitions.
    """
    schema = "part int, segment int, tokens_before long, n_docs long, n_tokens long, payload binary"
    files = spark.read.schema(schema).parquet(path)

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for part, before, payload in zip(b.column("part"), b.column("tokens_before"), b.column("payload"), strict=True):
                s = Segment(payload.as_buffer())
                ends = np.array([s.ends.select(i) for i in range(s.n_docs)], np.int64)
                starts = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(s.tokens[x:y].astype("<u4").tobytes()) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * s.n_docs, pa.int32()), pa.array(s.keys, pa.int64()), pa.array(starts + before.as_py(), pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "id", "start", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "tokens_before", "payload").mapInArrow(read, "part int, id long, start long, n_tokens long, ids_crc32 long")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select(F.col("id").alias(id_col), (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the files (to the scratch folder unless a path is given) and returns what reading them back gives."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, **options)
    return read_token_files(spark, path, id_col=options.get("id_col", "doc_id"))
